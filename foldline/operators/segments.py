"""Segments: blocks split to a token bound, packed into passages, overlapped at sentence ends, and hung into a tree with ids and gates.

Splitting and packing are folds inside a row, over the units of one block or the sizes of one section's blocks; nothing but built-in functions.
A token is a run of characters that are no white space, unless a caller counts otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foldline.functions.text import WS
from foldline.functions.text import word_count as token_count

#: Fixed value: what a line at the left margin begins with where code goes on to something new.
DEFINES = r"^(async def |def |class |@|function |export |public |private |static |fn |func |impl |struct |interface )"
_PIECE = "array<struct<from:int,to:int,n:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def text_lines(text: Column) -> Column:
    """Column: the lines of ``text`` with their line ends, so that they join to it again."""
    return _matches(text, r"[^\n]*\n|[^\n]+")


def sentences(text: Column) -> Column:
    """Column: the sentences of ``text`` with the white space behind them. A sentence ends at a line end, or at ``.``, ``!``, ``?`` or ``…`` (with closing quotes and brackets) before white space."""
    return _matches(text, rf"(?s).+?(?:[.!?…]+[\"'”’)\]]*[{WS}]+|\n[{WS}]*|\z)")


def _unit(text: Column, rank: Column) -> Column:
    return F.struct(text.alias("s"), token_count(text).alias("n"), rank.cast("int").alias("rank"))


def _by_word(units: Column, most: int) -> Column:
    """Units of over ``most`` tokens as their words; the first keeps the rank of the boundary before it, the others have none."""
    words = lambda u: F.transform(_matches(u["s"], rf"[{WS}]*[^{WS}]+[{WS}]*"), lambda w, k: F.struct(w.alias("s"), F.lit(1).alias("n"), F.when(k == 0, u["rank"]).otherwise(0).alias("rank")))
    return F.flatten(F.transform(units, lambda u: F.when(u["n"] > most, words(u)).otherwise(F.array(u))))


def cut_units(units: Column, most: Column, ranks: tuple[int, ...] = (3, 2, 1)) -> Column:
    """Column: pieces (from, to, n) of an array of units (n tokens each, rank of the boundary before it), in order and without gaps.

    A piece takes units while its tokens stay within ``most``. It ends at the last boundary of the highest rank that leaves it at least half
    full and the rest within ``most``, else before the unit that no longer fits. Only a single unit of over ``most`` tokens makes a piece above it. ``ranks`` are those that occur,
    highest first; without any the fold keeps no boundaries.
    """
    zero = F.struct(
        F.array().cast(_PIECE).alias("pieces"), *[F.lit(0).alias(c) for c in ("i", "sum", "start", "base")],
        *[F.lit(x).alias(f"{c}{k}") for k in ranks for c, x in (("at", -1), ("sum", 0))],
    )

    def step(a: Column, u: Column) -> Column:
        here = {k: (F.when(u["rank"] == k, a["i"]).otherwise(a[f"at{k}"]), F.when(u["rank"] == k, a["sum"]).otherwise(a[f"sum{k}"])) for k in ranks}
        total = a["sum"] + u["n"]
        full = (a["i"] > a["start"]) & (total - a["base"] > most)
        good = {k: (here[k][0] > a["start"]) & (total - here[k][1] <= most) & ((here[k][1] - a["base"]) * 2 >= most) for k in ranks}
        pick = lambda j, last: F.coalesce(*[F.when(good[k], here[k][j]) for k in ranks], last)
        to, upto = pick(0, a["i"]), pick(1, a["sum"])
        piece = F.struct(a["start"].alias("from"), to.alias("to"), (upto - a["base"]).alias("n"))
        return F.struct(
            F.when(full, F.concat(a["pieces"], F.array(piece))).otherwise(a["pieces"]).alias("pieces"), (a["i"] + 1).alias("i"), total.alias("sum"),
            F.when(full, to).otherwise(a["start"]).alias("start"), F.when(full, upto).otherwise(a["base"]).alias("base"),
            *[x.alias(f"{c}{k}") for k in ranks for c, x in zip(("at", "sum"), here[k], strict=True)],
        )

    last = lambda a: F.when(a["i"] > a["start"], F.concat(a["pieces"], F.array(F.struct(a["start"].alias("from"), a["i"].alias("to"), (a["sum"] - a["base"]).alias("n"))))).otherwise(a["pieces"])
    return F.aggregate(units, zero, step, last)


def _pieces(units: Column, most: int, head: Column, ranks: tuple[int, ...]) -> Column:
    """Column: (start, end, n_tokens, head, text) of the pieces of ``units``; ``head``, which the units do not hold, comes before every piece."""
    heads = F.length(head)
    zero = F.struct(F.array().cast("array<struct<start:int,end:int,n_tokens:int,head:string,body:string>>").alias("out"), heads.alias("at"))

    def place(u: Column, head_tokens: Column):
        def step(a: Column, p: Column) -> Column:
            body = F.array_join(F.transform(F.slice(u, p["from"] + 1, p["to"] - p["from"]), lambda x: x["s"]), "")
            return _let(body, lambda b: F.struct(F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(b)).alias("end"), (p["n"] + head_tokens).alias("n_tokens"), head.alias("head"), b.alias("body")))).alias("out"), (a["at"] + F.length(b)).alias("at")))

        return step

    room = lambda n: F.greatest(F.lit(most) - n, F.lit(1))
    return _let(token_count(head), lambda n: _let(room(n), lambda m: _let(units, lambda u: F.aggregate(cut_units(u, m, ranks), zero, place(u, n), lambda a: a["out"]))))


def _ranked_lines(text: Column) -> Column:
    def rank(xs: Column):
        def of(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(xs, i - 1)).otherwise(F.lit("x"))
            blank = ~before.rlike(rf"[^{WS}]")
            return _unit(x, F.when(x.rlike(DEFINES) | before.rlike(r"^\}"), 3).when(blank, 2).otherwise(1))

        return of

    return _let(text_lines(text), lambda xs: F.transform(xs, rank(xs)))


def _table_head(text: Column) -> Column:
    """The header row and the row of dashes below it, if any."""
    return F.regexp_extract(text, r"\A[^\n]*\n(?:[ |:\t]*-[ |:\t-]*(?:\n|\z))?", 0)


_ITEM = r"(?:[-*+•] |\p{Nd}+[.)][ \t])"


def _items(text: Column) -> Column:
    """The items of a list, each with the lines that go on with it."""
    return _matches(text, rf"(?s)(?:\A|(?<=\n)){_ITEM}.*?(?=\n{_ITEM}|\z)\n?")


def _list_head(text: Column) -> Column:
    """What stands before the first item."""
    return F.regexp_extract(text, rf"(?s)\A(?!{_ITEM})(.*?\n)(?={_ITEM})", 1)


def split_block(kind: Column, text: Column, most: int) -> Column:
    """Column: the pieces of a block, as structs of start, end (code points of ``text``), n_tokens (head included), head and body.

    Tables are cut between rows and lists between items; the head (header rows; the line before the first item) is taken before every piece and its tokens count. A row or an
    item is never cut, so a longer one is a piece above ``most``. Code is cut before definitions, else behind empty lines, else between lines; other blocks between
    sentences; a line or sentence of over ``most`` tokens between words. The head and all bodies in order give ``text`` back. Text that fits is one
    piece without head. Null and empty texts have no pieces; of a text without tokens, one.
    """
    t = F.coalesce(text, F.lit(""))
    none = F.lit("")
    plain = lambda x: F.transform(x, lambda u: _unit(u, F.lit(1)))

    def headed(head: Column, units) -> Column:
        return _let(head, lambda h: _pieces(plain(units(F.substring(t, F.length(h) + 1, F.length(t)))), most, h, ()))

    whole = F.when(t != "", F.array(F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), token_count(t).alias("n_tokens"), none.alias("head"), t.alias("body")))).otherwise(F.array().cast("array<struct<start:int,end:int,n_tokens:int,head:string,body:string>>"))
    many = (
        F.when(kind == "table", headed(_table_head(t), text_lines)).when(kind == "list", headed(_list_head(t), _items))
        .when(kind == "code", _pieces(_by_word(_ranked_lines(t), most), most, none, (3, 2, 1))).otherwise(_pieces(_by_word(plain(sentences(t)), most), most, none, (1,)))
    )
    return F.when(token_count(t) <= most, whole).otherwise(many)


def split_blocks(blocks: DataFrame, most: int = 600, special: int = 1200) -> DataFrame:
    """``blocks`` (type, text, and more) as pieces: piece_no, start, end, n_tokens, head, body. Tables and code may have ``special`` tokens before they are split; a piece has ``most``."""
    limit = F.when(F.col("type").isin("table", "code"), special).otherwise(most)
    found = F.when(token_count(F.coalesce("text", F.lit(""))) <= limit, split_block(F.lit("whole"), F.col("text"), 2**31 - 1)).otherwise(split_block(F.col("type"), F.col("text"), most))
    rest = [c for c in blocks.columns if c not in ("text", "piece_no", "start", "end", "n_tokens", "head", "body")]
    return blocks.select(*rest, F.posexplode(found).alias("piece_no", "_p")).select(*rest, "piece_no", "_p.*")


def pack_passages(blocks: DataFrame, least: int = 300, target: int = 600, most: int = 900) -> DataFrame:
    """(doc_id, section, block_no, passage): blocks (doc_id, section, block_no, n_tokens) packed in order into passages of a section.

    A passage ends once it has ``target`` tokens or the next block would take it over ``most``; a last one of under ``least``
    joins the one before where both fit ``most``. The sizes of a section's blocks meet in one row, 16 bytes a block; its text does not. Blocks of a null size count nothing.
    """
    size = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))
    rows = blocks.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct(F.col("block_no").cast("long").alias("no"), size.alias("n")))).alias("b"))
    zero = F.struct(F.array().cast("array<struct<from:int,n:bigint>>").alias("cuts"), F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, x: Column) -> Column:
        ends = (a["i"] > 0) & ((a["sum"] >= target) | (a["sum"] + x["n"] > most))
        return F.struct(
            F.when(ends, F.concat(a["cuts"], F.array(F.struct(a["start"].alias("from"), a["sum"].alias("n"))))).otherwise(a["cuts"]).alias("cuts"), (a["i"] + 1).alias("i"),
            F.when(ends, a["i"]).otherwise(a["start"]).alias("start"), (F.when(ends, F.lit(0).cast("long")).otherwise(a["sum"]) + x["n"]).alias("sum"),
        )

    def last(a: Column) -> Column:
        k = F.size(a["cuts"])
        joins = (k > 0) & (a["sum"] < least) & (F.get(a["cuts"], k - 1)["n"] + a["sum"] <= most)
        return F.when(joins, a["cuts"]).otherwise(F.concat(a["cuts"], F.array(F.struct(a["start"].alias("from"), a["sum"].alias("n")))))

    cut = rows.select("doc_id", "section", "b", F.aggregate("b", zero, step, last).alias("c"))
    to = F.coalesce(F.get(F.col("c"), F.col("p") + 1)["from"], F.size("b"))
    each = cut.select("doc_id", "section", "b", "c", F.posexplode("c").alias("p", "x")).select("doc_id", "section", F.col("p").cast("long").alias("passage"), F.explode(F.slice("b", F.col("x.from") + 1, to - F.col("x.from"))).alias("y"))
    return each.select("doc_id", "section", F.col("y.no").alias("block_no"), "passage")


def with_overlap(passages: DataFrame, ratio: float = 0.10) -> DataFrame:
    """Passages (doc_id, section, passage, id, start, text, n_tokens) with what they borrow from the one before in their section.

    overlap_text is the longest run of whole sentences at the end of the passage before whose tokens are at most ``ratio`` of that passage's; where not even
    its last sentence is that short, nothing is borrowed. overlap_from is that passage's id, overlap_start and overlap_end the place of the borrowed text in the
    document (``start`` is the passage's), overlap_tokens its tokens. All are null where nothing is borrowed. ``ratio`` must lie in [0, 0.15].
    """
    if not 0 <= ratio <= 0.15:
        raise ValueError("ratio must lie between 0 and 0.15")
    text = F.coalesce("text", F.lit(""))
    room = F.floor(F.col("n_tokens") * F.lit(ratio) + 1e-9)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("open"))

    def step(a: Column, s: Column) -> Column:
        n = a["n"] + token_count(s)
        fits = a["open"] & (n <= room)
        return F.struct(F.when(fits, n).otherwise(a["n"]).alias("n"), (a["chars"] + F.when(fits, F.length(s)).otherwise(0)).alias("chars"), fits.alias("open"))

    tail = F.aggregate(F.reverse(sentences(text)), zero, step)
    lent = F.struct(
        F.col("id").alias("from"), (F.col("start") + F.length(text) - F.col("_t.chars")).alias("start"), (F.col("start") + F.length(text)).alias("end"),
        F.col("_t.n").alias("n"), F.substring(text, F.length(text) - F.col("_t.chars") + 1, F.col("_t.chars")).alias("text"),
    )
    rows = passages.withColumn("_t", tail).withColumn("_lent", F.when(F.col("_t.n") > 0, lent)).drop("_t")
    got = rows.withColumn("_o", F.lag("_lent").over(Window.partitionBy("doc_id", "section").orderBy("passage")))
    o = lambda name, kind: F.col(f"_o.{name}").cast(kind)
    return got.select(
        *passages.columns, F.col("_o.from").alias("overlap_from"), o("start", "long").alias("overlap_start"), o("end", "long").alias("overlap_end"),
        o("n", "long").alias("overlap_tokens"), F.col("_o.text").alias("overlap_text"),
    )


def segment_id(*parts: Column) -> Column:
    """Column: SHA-256 of the parts, each with its length, so that no two lists of parts look alike; null parts count as such."""
    one = lambda p: F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, parts)), 256)


def segment_tree(anchored: DataFrame, passages: DataFrame, versions: DataFrame) -> DataFrame:
    """SECTION and PASSAGE segments: segment_id, doc_id, type, parent_id, section_path, anchor, ordinal, depth, start, end, token_count.

    ``anchored`` comes from ``structure.anchored`` (its sections: each path once, below the path without its last heading if that exists), ``passages`` has (doc_id,
    section_path, anchor, start, end, n_tokens), ``versions`` (doc_id, version). Ids hash document, version, type, path, anchor and span, so equal inputs give equal ids and
    an edit changes those it touches. ordinal counts a parent's sections, or passages, in reading order from 0. A document's sections
    hang below one root section, which every document of ``versions`` has.
    """
    level = F.min("level").alias("level")
    heads = anchored.groupBy("doc_id", "section_path", "sec_anchor").agg(F.min("start_off").alias("start"), F.max("end_off").alias("end"), level, F.min_by("parent_idx", "block_idx").alias("parent_idx"))
    paths = anchored.where("type = 'heading'").select("doc_id", F.col("block_idx").alias("parent_idx"), F.col("section_path").alias("parent_path"))
    heads = heads.where("section_path <> 'root'").join(paths, ["doc_id", "parent_idx"], "left").select("doc_id", "section_path", "sec_anchor", "start", "end", F.coalesce("parent_path", F.lit("root")).alias("parent_path"))
    ends = anchored.groupBy("doc_id").agg(F.max("end_off").alias("end"))
    root = versions.join(ends, "doc_id", "left").select("doc_id", F.lit("root").alias("section_path"), F.substring(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("root")), 256), 1, 32).alias("sec_anchor"), F.lit(0).alias("start"), F.coalesce("end", F.lit(0)).alias("end"), F.lit(None).cast("string").alias("parent_path"))
    made = lambda kind: segment_id(F.col("doc_id"), F.col("version"), F.lit(kind), F.col("section_path"), F.col("anchor"), F.col("start"), F.col("end"))
    sections = root.unionByName(heads).join(versions, "doc_id").withColumnRenamed("sec_anchor", "anchor").withColumn("segment_id", made("SECTION"))
    known = sections.select("doc_id", F.col("section_path").alias("parent_path"), F.col("segment_id").alias("parent_id"))
    sections = sections.join(known, ["doc_id", "parent_path"], "left").withColumn("type", F.lit("SECTION")).withColumn("n_tokens", F.lit(None).cast("long"))
    leaves = passages.join(versions, "doc_id").withColumn("segment_id", made("PASSAGE")).withColumn("parent_path", F.col("section_path")).join(known, ["doc_id", "parent_path"], "left").withColumn("type", F.lit("PASSAGE"))
    columns = ["segment_id", "doc_id", "type", "parent_id", "section_path", "anchor", "start", "end", F.col("n_tokens").cast("long").alias("token_count")]
    both = sections.select(*columns).unionByName(leaves.select(*columns))
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_id", "type").orderBy("start", "section_path", "anchor", "segment_id")) - 1
    return both.withColumn("ordinal", nth.cast("long"))


def tree_violations(segments: DataFrame) -> DataFrame:
    """(doc_id, segment_id, violations) of segments that break the tree: repeated id, missing parent, parent that is no section, more than one root, a passage without text span, ordinals with gaps."""
    parents = segments.select("doc_id", F.col("segment_id").alias("parent_id"), F.col("type").alias("_above"), F.lit(True).alias("_there")).distinct()
    same = Window.partitionBy("doc_id", "segment_id")
    below = Window.partitionBy("doc_id", "parent_id", "type")
    rows = segments.withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_k", F.count(F.lit(1)).over(below)).withColumn("_most", F.max("ordinal").over(below)).join(parents, ["doc_id", "parent_id"], "left")
    root = F.col("parent_id").isNull()
    checks = {
        "repeated id": F.col("_n") > 1, "missing parent": ~root & F.col("_there").isNull(), "parent is no section": ~root & (F.col("_above") != "SECTION"),
        "second root": root & (F.col("type") == "SECTION") & (F.col("_k") > 1), "passage without section": root & (F.col("type") == "PASSAGE"),
        "empty span": (F.col("type") == "PASSAGE") & (F.col("end") <= F.col("start")), "gap in ordinals": F.col("_most") + 1 != F.col("_k"),
    }
    named = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    return rows.select("doc_id", "segment_id", named.alias("violations")).where(F.size("violations") > 0)


def gates(least: int = 300, most: int = 900, special: Column | None = None) -> list[Column]:
    """Metrics of segments (type, text, token_count, segment_id, anchor, parent_id, section_path) for one pass: how many there are, and how many break each gate."""
    passage = F.col("type") == "PASSAGE"
    normal = passage & ~(special if special is not None else F.lit(False))
    count = lambda cond, name: F.coalesce(F.sum(F.coalesce(cond, F.lit(True)).cast("long")), F.lit(0).cast("long")).alias(name)
    ends = F.regexp_replace(F.col("text"), rf"[{WS}]+\z", "").rlike(r"[.!?…:;|`}\])\"'”’]\z|\A\z")
    return [
        count(passage, "passages"), count(~passage, "sections"), count(passage & ~F.coalesce("text", F.lit("")).rlike(rf"[^{WS}]"), "empty"),
        count(normal & ~F.col("token_count").between(least, most), "out_of_bounds"), count(normal, "normal"), count(normal & ~ends, "mid_sentence"),
        count(F.col("segment_id").isNull() | F.col("anchor").isNull() | F.col("section_path").isNull() | (passage & (F.col("parent_id").isNull() | F.col("token_count").isNull())), "incomplete"),
    ]


def gate_report(facts: dict[str, int], in_bounds: float = 0.95, mid_sentence: float = 0.005) -> dict[str, bool]:
    """Whether each gate holds for the numbers of ``gates``: no empty passage, no missing field, enough passages in bounds, few cut sentences."""
    n = max(facts["normal"], 1)
    return {
        "no_empty": facts["empty"] == 0, "complete": facts["incomplete"] == 0, "bounds": (facts["normal"] - facts["out_of_bounds"]) / n >= in_bounds or not facts["normal"],
        "sentences": facts["mid_sentence"] / n <= mid_sentence,
    }


def write_gated(segments: DataFrame, path: str, **limits: int) -> dict[str, int]:
    """Write segments as Parquet and return the numbers of ``gates``, observed in the job that writes."""
    seen = Observation("gates")
    segments.observe(seen, *gates(**limits)).write.mode("overwrite").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}
