"""Information-theoretic sanitisation of personal data.

Patterns find protected entities (email and IP addresses, card and phone numbers). The corpus then tells
how much the words around an entity reveal it: a word discloses an entity, which is a value or a whole
kind, if its pointwise mutual information with it reaches a share of the entity's own information. Such
words, near the entity, are removed with it if they disclose its value, and generalised if they disclose only its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm._shared import SPACE, let, word_array, written

#: The kinds in the order of their spans. Possessive quantifiers and the look-behinds keep each search linear; what they match is unchanged.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method protects besides: keys and tokens, known by their information content.
MORE_KINDS = {"secret": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{24,}+"}
_PATTERNS = KINDS | MORE_KINDS
#: Bits that a secret holds at least: its length times the logarithm of its distinct characters.
SECRET_BITS = 80
#: What a text must contain for a kind to be searched in it.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9+/=_-]{24}"}
#: Characters of a part of a text; what is near a place is cut from the parts around it.
_CHUNK = 64
#: Parts on either side in which the words near an entity are sought, first and then.
_WIDTHS = (2, 32)
#: Stands for each character of an entity while the words around are looked for; words with it are no terms.
_MASK = "\uFFFC"
#: Terms are sought in this many keys at first, a fixed number that may be broadcast.
_KEYS = 1 << 18
#: Matches are placed in parts of so many, so that a text with very many costs no more than its length times this.
_PART = 256
_BYTE_VALUE = r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\z"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(_BYTE_VALUE))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "secret":
        n, letters = F.length(value), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        bits = n * F.log2(F.size(F.array_distinct(F.split(value, ""))).cast("double"))
        return (8 * F.length(digits) >= n) & (8 * letters >= n) & (bits >= SECRET_BITS)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Matches of one kind with their code-point spans: gaps between matches and matches add up to the text."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def placed(found: Column) -> Column:
        gaps = F.split(text, _PATTERNS[kind], -1)

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["value"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

        pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        parts = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _PART).cast("int")), lambda k: F.aggregate(F.slice(p, k * _PART + 1, _PART), start, add))
        first = lambda q: F.aggregate(
            q, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = lambda x, by: F.transform(x["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))
        spans = let(let(pairs, parts), lambda q: F.flatten(F.zip_with(q, first(q), moved)))
        return F.when(F.size(found) == 0, none).otherwise(F.filter(spans, lambda s: _valid(kind, s["value"])))

    found = F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0))
    return F.when(text.rlike(_HINTS[kind]), let(found, placed)).otherwise(none)


def entity_spans(text: Column) -> Column:
    """Column: array of (kind, start, end, value), by kind as in KINDS, then MORE_KINDS, and then by start; offsets in code points, end exclusive."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_matches(text, k) for k in _PATTERNS])


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """Column: the characters from ``start`` to ``end`` of a text in chunks, at a cost of their number and not of the text."""
    first, last = F.floor(start / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")
    joined = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end <= start, "").otherwise(F.substring(joined, start - first * _CHUNK + 1, end - start))


def replaced(text: Column, cuts: Column) -> Column:
    """Column: ``text`` with each span of ``cuts`` (start, end, tag) as its tag; of overlapping spans the first one counts, extended over the others.

    Spans are merged in parts of ``_PART``, each of which begins where the spans of the parts before end.
    """
    def add(acc: Column, x: Column) -> Column:
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), x["start"].alias("to"), x["tag"].alias("tag")))).alias("out"))
        return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(fresh)

    none = F.array().cast("array<struct<from:int,to:int,tag:string>>")
    merge = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), add, lambda a: a["out"])
    ends_of = lambda parts: F.transform(parts, lambda p: F.array_max(F.transform(p, lambda x: x["end"])))
    before = lambda ends: F.transform(ends, lambda _, k: F.coalesce(F.array_max(F.slice(ends, F.lit(1), k)), F.lit(0)))
    in_parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _PART).cast("int")), lambda k: F.slice(x, k * _PART + 1, _PART))

    def join(c: Column) -> Column:
        def all_of(parts: Column) -> Column:
            ends = ends_of(parts)
            rest = F.struct(F.array_max(ends).alias("from"), (F.size(c) * _CHUNK).alias("to"), F.lit("").alias("tag"))
            return F.concat(F.flatten(F.zip_with(parts, let(ends, before), merge)), F.array(rest))

        merged = let(let(F.array_sort(cuts), in_parts), all_of)
        return F.array_join(F.transform(merged, lambda x: F.concat(_part(c, x["from"], x["to"]), x["tag"])), "")

    return F.when(F.size(cuts) == 0, text).otherwise(let(_chunks(text), join))


def _terms(part: Column, from_right: bool, near: int) -> Column:
    """The ``near`` words of ``part`` next to the entity, with their offset in ``part``."""
    words = F.split(part, f"[{SPACE}]", -1)

    def offsets(w: Column) -> Column:
        empty = F.array().cast("array<struct<word:string,at:int>>")

        def add(acc: Column, x: Column) -> Column:
            here = F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("word"), acc["at"].alias("at")))).alias("out"))
            return here

        return F.aggregate(w, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: F.filter(acc["out"], lambda x: x["word"] != ""))

    ordered = let(words, offsets)
    return let(ordered, lambda x: F.slice(x, F.greatest(F.size(x) - near, F.lit(0)) + 1, near)) if from_right else F.slice(ordered, 1, near)


def _around(text: Column, spans: Column, near: int) -> Column:
    """Column: array of (kind, value, place, term, start, end): the ``near`` words on either side of each entity, in lower case.

    ``place`` is where the entity starts. Words are whole; those that adjoin the entity end or begin at it, and those that
    overlap another entity are left out. They are cut from the chunks next to the entity, from more chunks where these hold too
    few words, and from the whole text where even these do, so that a text of very many entities is not copied for each.
    """
    enough = lambda part: F.size(word_array(part)) > near
    some = rf"\A[^{SPACE}]*+(?:[{SPACE}]++[^{SPACE}]++){{0,{near}}}+"

    def of(c: Column) -> Column:
        def one(s: Column) -> Column:
            i, j = F.floor(s["start"] / _CHUNK).cast("int"), F.floor(s["end"] / _CHUNK).cast("int")
            lefts = [(i <= k, _part(c, F.greatest(i - k, F.lit(0)) * _CHUNK, s["start"])) for k in _WIDTHS]
            rights = [(j + k + 1 >= F.size(c), _part(c, s["end"], (j + k + 1) * _CHUNK)) for k in _WIDTHS]
            whole = (_part(c, F.lit(0), s["start"]), _part(c, s["end"], F.size(c) * _CHUNK))
            pick = lambda sides, rest: F.when(sides[0][0] | enough(sides[0][1]), sides[0][1]).when(sides[1][0] | enough(sides[1][1]), sides[1][1]).otherwise(rest)
            left = pick(lefts, F.reverse(F.regexp_extract(F.reverse(whole[0]), some, 0)))
            right = pick(rights, F.regexp_extract(whole[1], some, 0))
            before = let(left, lambda b: F.transform(_terms(b, True, near), lambda x: F.struct(x["word"].alias("word"), (x["at"] + s["start"] - F.length(b)).alias("start"))))
            after = F.transform(_terms(right, False, near), lambda x: F.struct(x["word"].alias("word"), (x["at"] + s["end"]).alias("start")))
            words = F.filter(F.concat(before, after), lambda w: ~w["word"].contains(_MASK))
            return F.transform(words, lambda w: F.struct(
                s["kind"].alias("kind"), s["value"].alias("value"), s["start"].alias("place"), F.lower(w["word"]).alias("term"), w["start"].alias("start"), (w["start"] + F.length(w["word"])).alias("end")))

        return F.flatten(F.transform(spans, one))

    masks = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(_MASK), s["end"] - s["start"]).alias("tag")))
    none = F.array().cast("array<struct<kind:string,value:string,place:int,term:string,start:int,end:int>>")
    return F.when(F.size(spans) == 0, none).otherwise(let(let(replaced(text, masks), _chunks), of))


def found_spans(docs: DataFrame, near: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _text, spans, around, parts), one row for each input row, without the text: written once for all that follows. ``parts`` are terms of around that are no whole words of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = let(entity_spans(text), lambda s: F.struct(s.alias("spans"), _around(text, s, near).alias("around")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_text"), text.alias("text"), both.alias("x"))
    some = F.array_except(F.transform("x.around", lambda w: w["term"]), F.transform(word_array(F.col("text")), F.lower))
    parts = F.when(F.size("x.around") > 0, some).otherwise(F.array().cast("array<string>"))
    return written(rows.select("doc_id", "_text", "x.spans", "x.around", parts.alias("parts")), "spans")


def _with_entity(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """``rows`` with the entities that a match counts for, its value and its kind: column entity, and whole, whether it is the kind."""
    return rows.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("entity", F.when(F.col("whole"), F.xxhash64(kind)).otherwise(F.xxhash64(kind, value)))


def disclosing(docs: DataFrame, found: DataFrame, around: DataFrame, threshold: float, support: int, text_col: str) -> DataFrame:
    """(entity, term) where the term reveals the entity; ``around`` has the rows of ``found``'s around with their entities.

    Over N different texts, pmi = log2(N n(e,t) / (n(e) n(t))) must reach ``threshold`` times log2(N / n(e)), and the
    two must meet at ``support`` places at least, in one text or in several. Equal copies of a text count once in all
    four counts. Words are counted only for terms that meet an entity often enough.
    """
    meet = around.select("_text", "entity", "whole", "term", "place").distinct().groupBy("entity", "whole", "term", "_text").agg(F.count(F.lit(1)).alias("n"))
    joint = meet.groupBy("entity", "whole", "term").agg(F.count(F.lit(1)).alias("n_both"), F.sum("n").alias("n_places")).where(F.col("n_places") >= support)
    joint = written(joint.select("entity", "whole", "term", F.xxhash64("term").alias("t"), "n_both"), "joint")
    marked = _with_entity(found.select("_text", F.explode("spans").alias("e")), "e.kind", "e.value").select("_text", "entity", "whole").distinct()
    entity = written(marked.groupBy("entity", "whole").agg(F.count(F.lit(1)).alias("n_entity")), "entities")
    key = F.pmod("t", F.lit(_KEYS)).alias("key")
    # copies of a text meet in the partial aggregation; only then are its words counted, each once
    once = docs.select(F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("text")).where("text IS NOT NULL").groupBy("_text").agg(F.first("text").alias("text"))
    words = once.select(F.explode(F.array_distinct(F.transform(word_array(F.col("text")), F.lower))).alias("term"))
    words = words.select(F.xxhash64("term").alias("t")).withColumn("key", key).join(F.broadcast(joint.select(key).distinct()), "key", "left_semi").select("t")
    parts = found.select("_text", F.explode("parts").alias("term")).distinct().select(F.xxhash64("term").alias("t"))  # parts of words that adjoin an entity are terms of their text too
    terms = written(words.union(parts).groupBy("t").agg(F.count(F.lit(1)).alias("n_term")), "terms")
    total = found.select("_text").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    kinds = joint.where("whole").join(F.broadcast(entity.where("whole").select("entity", "n_entity")), "entity")  # as many as there are kinds
    values = joint.where("NOT whole").join(entity.where("NOT whole").select("entity", "n_entity"), "entity")
    known = kinds.unionByName(values).join(terms, "t").crossJoin(F.broadcast(total))
    own = F.log2(F.col("n_all") / F.col("n_entity"))
    pmi = F.log2(F.col("n_all") * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    return written(known.where((pmi > 0) & (pmi >= threshold * own)).select("entity", "term"), "disclosing")


def _private(docs: DataFrame, near: int, threshold: float, support: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _text, spans, terms) of each row."""
    found = found_spans(docs, near, id_col, text_col)
    around = _with_entity(found.select("doc_id", "_text", F.explode("around").alias("w")), "w.kind", "w.value").select("doc_id", "_text", "entity", "whole", "w.kind", "w.place", "w.term", "w.start", "w.end")
    flagged = disclosing(docs, found, around, threshold, support, text_col)
    terms = around.join(flagged, ["entity", "term"]).groupBy("doc_id", "_text", "start", "end").agg(F.min("kind").alias("kind"), F.max(~F.col("whole")).alias("of_value"))
    extra = terms.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "of_value"))).alias("terms"))
    joined = found.select("doc_id", "_text", "spans").alias("a").join(extra.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a._text <=> b._text"), "left")
    return joined.select("a.doc_id", "a._text", "spans", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,kind:string,of_value:boolean>>")).alias("terms"))


def find_private(docs: DataFrame, *, near: int = 5, threshold: float = 0.75, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data and of the terms that reveal it; one row for each input row, no text.

    Returns doc_id, spans (kind, start, end, value, by kind and start; the kinds of KINDS and MORE_KINDS) and terms (array
    of start, end, kind, of_value: disclosing words near an entity, sorted, none of which overlaps a span; of_value tells
    that the word reveals a value and not only a kind). Null and empty texts have none. Rows that repeat an id and text
    get the same spans. Counts cover all different texts. An empty table gives no rows; other columns are ignored.
    A very long text costs its length for each kind, and the words near its entities.
    """
    return _private(docs, near, threshold, support, id_col, text_col).drop("_text")


def sanitise(text: Column, spans: Column, terms: Column) -> Column:
    """Column: ``text`` with each span as ``<KIND>``; a term that reveals a value is removed, one that reveals only a kind becomes ``<KIND TERM>``."""
    tag = lambda t: F.when(t["of_value"], "").otherwise(F.concat(F.lit("<"), F.upper(t["kind"]), F.lit(" TERM>")))
    return replaced(text, F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("tag"))),
        F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), tag(t).alias("tag"))),
    ))


def sanitised(docs: DataFrame, *, near: int = 5, threshold: float = 0.75, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts sanitised; all rows and other columns stay as they are. See ``find_private``."""
    found = _private(docs, near, threshold, support, id_col, text_col).where("size(spans) > 0").dropDuplicates(["doc_id", "_text"])
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    joined = rows.join(found, F.expr("_id <=> doc_id AND _hash = _text"), "left")
    text = F.when(F.col("spans").isNull(), F.col("_row")[text_col]).otherwise(sanitise(F.col("_row")[text_col], F.col("spans"), F.col("terms")))
    return joined.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
