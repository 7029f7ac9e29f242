"""Pages from JSON of unknown shape: a walk level by level with Spark's own JSON and VARIANT functions.

VARIANT tells what a value is, but sorts the keys of objects; the order of a document comes from reading the same object as a map of texts, which keeps it. Every
level of all payloads is one step, so steps grow with the depth of the deepest payload and not with the number of payloads.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.text import strip
from foldline.sources.tables import kept

#: Keys whose texts count before what lies deeper, in their order.
PREFERRED = ("text", "content", "md_content", "html", "latex")
_REPLACED = "�"


def _kind(v: Column) -> Column:
    """What a VARIANT is: object, array, string, void (JSON null), else its SQL type in lower case."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0))


def json_roots(payloads: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """(keys, kind, raw): the value that each payload is. Null, broken JSON and objects that repeat a key give no row."""
    whole = F.concat(F.lit("["), F.col(json_col), F.lit("]"))
    both = lambda w: F.struct(F.from_json(w, "array<string>").alias("s"), F.from_json(w, "array<variant>").alias("v"))
    read = payloads.select(*keys, F.explode(F.transform(F.array(whole), both)).alias("_x")).where("size(_x.s) = 1 AND size(_x.v) = 1")  # a generator, so that a payload is made and read once
    return read.select(*keys, _kind(F.col("_x.v")[0]).alias("kind"), F.col("_x.s")[0].alias("raw"))


def children(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, key, kind, raw) of the members of objects and items of arrays among ``nodes`` (keys, kind, raw), in their order; key is null for items."""
    is_object = F.col("kind") == "object"
    texts, values = F.from_json("raw", "map<string,string>"), F.from_json("raw", "map<string,variant>")
    items, things = F.from_json("raw", "array<string>"), F.from_json("raw", "array<variant>")
    entries = F.transform(F.arrays_zip(F.map_entries(texts).alias("e"), F.map_values(values).alias("v")), lambda x: F.struct(x["e"]["key"].alias("key"), x["e"]["value"].alias("raw"), x["v"].alias("v")))
    both = F.when(is_object, entries)
    both = both.otherwise(F.arrays_zip(F.transform(items, lambda _: F.lit(None).cast("string")).alias("key"), items.alias("raw"), things.alias("v")))
    rows = nodes.where(F.col("kind").isin("object", "array")).select(*keys, F.posexplode(both).alias("pos", "x"))
    return rows.select(*keys, "pos", "x.key", _kind(F.col("x.v")).alias("kind"), "x.raw")


def walk(roots: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, key, inside, kind, raw) of all values below and with ``roots`` (keys, kind, raw): path has the position at each level, inside says what holds the value.

    raw is a string's text, or the JSON of anything else. JSON of over 1,000 levels is broken JSON for Spark.
    """
    level = kept(roots.select(*keys, F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("inside"), "kind", "raw"), "level")
    out = level
    while not (holders := level.where("kind IN ('object', 'array')")).isEmpty():
        held = holders.withColumnRenamed("path", "_above").withColumn("_inside", F.col("kind"))
        below = children(held, *keys, "_above", "_inside")
        level = kept(below.select(*keys, F.concat("_above", F.array("pos")).alias("path"), "key", F.col("_inside").alias("inside"), "kind", "raw"), "level")
        out = out.unionByName(level)
    return out


def _ordered(roots: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, text): the texts that count, at places that sort into their order; ``roots`` is a written table."""
    level = roots.select(*keys, F.array().cast("array<int>").alias("place"), "kind", "raw")
    found = level.where("kind = 'string'").select(*keys, "place", F.col("raw").alias("text"))
    while not (holders := level.where("kind IN ('object', 'array')")).isEmpty():
        below = children(holders.withColumn("_in", F.col("kind")), *keys, "place", "_in")
        rank = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("key")).cast("int") - 1
        counts = (F.col("kind") == "string") & ((F.col("_in") == "array") | (rank >= 0))
        deeper = F.col("kind").isin("object", "array")
        at = F.when((F.col("_in") == "object") & (F.col("kind") == "string"), rank).otherwise(F.col("pos") + len(PREFERRED))  # preferred texts come before all that lies deeper
        level = kept(below.where(counts | deeper).select(*keys, F.concat("place", F.array(at)).alias("place"), "kind", "raw"), "level")
        found = found.unionByName(level.where("kind = 'string'").select(*keys, "place", F.col("raw").alias("text")))
    return found


def text_fragments(roots: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): for each root (keys, kind, raw) its texts, a line each, depth first: items of arrays that are texts, and members of objects under the keys ``PREFERRED``.

    An object's own texts come first, in the order of ``PREFERRED``, then what its members and items hold, in the order of the JSON. Texts are stripped and blank ones go; more
    than one empty line in a row becomes one. A root without texts has an empty one.
    """
    roots = kept(roots, "roots")
    rows = _ordered(roots, *keys).select(*keys, "place", strip(F.col("text")).alias("text")).where("text <> ''")
    joined = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    whole = strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n{3,}", "\n\n"))
    return roots.select(*keys).distinct().join(joined, list(keys), "left").select(*keys, whole.alias("text"))


def listed_pages(payloads: DataFrame) -> DataFrame:
    """(doc_id, page_idx, text) from (doc_id, payload): one page for each item of the list that a payload is, or that it has under ``pdf_info``; its text is that of ``text_fragments``.

    Other payloads, broken JSON and null have no pages. doc_id is unique.
    """
    roots = kept(json_roots(payloads, "payload", "doc_id"), "roots")
    info = children(roots.where("kind = 'object'"), "doc_id").where("key = 'pdf_info' AND kind = 'array'").select("doc_id", "kind", "raw")
    pages = children(roots.where("kind = 'array'").unionByName(info), "doc_id").select("doc_id", F.col("pos").alias("page_idx"), "kind", "raw")
    return text_fragments(pages, "doc_id", "page_idx")


def code_point(n: Column) -> Column:
    """Column: the character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numbered(n: Column) -> Column:
    """The text of a numeric reference, as HTML 5 reads it."""
    windows = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}
    table = F.create_map(*[F.lit(x) for k, c in windows.items() for x in (k, c)])
    gone = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    return (
        F.when(n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(_REPLACED)).when(n.between(0x80, 0x9F), F.element_at(table, n.cast("int")))
        .when(gone, F.lit("")).otherwise(code_point(n))
    )


#: Names that count without a semicolon.
BARE = tuple(k for k in html5 if not k.endswith(";"))


def unescape(text: Column, bare: tuple[str, ...] = BARE) -> Column:
    """Column: ``text`` with HTML's character references as characters, the longest known name where a name goes on. No Python worker.

    A name that is not among ``bare`` and has no semicolon, as a cut leaves it, stays as it is.
    """
    known = "\x01".join(f"{k}\x02{c}" for k, c in sorted(html5.items()) if k.endswith(";") or k in bare)
    named = F.str_to_map(F.lit(known), F.lit("\x01"), F.lit("\x02"))
    bare = sorted(bare, key=len, reverse=True)
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"), F.lit(0))

    def decoded(p: Column) -> Column:
        name = F.substring(p, 2, F.length(p))
        digits = F.regexp_extract(name, "^#0*([0-9]{1,10});?$", 1)
        hexes = F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]{1,8});?$", 1)
        prefix = F.regexp_extract(name, f"^({'|'.join(bare)})", 1)
        long = F.when(digits != "", digits.try_cast("long")).otherwise(F.conv(hexes, 16, 10).try_cast("long"))
        number = F.when(name.rlike("^#[xX]?0+;?$"), F.lit(0)).otherwise(F.when((digits != "") | (hexes != ""), long))
        other = F.when(prefix != "", F.concat(F.try_element_at(named, prefix), F.substring(name, F.length(prefix) + 1, F.length(name)))).otherwise(p)
        return F.when(~p.startswith("&") | (p == "&"), p).when(name.startswith("#"), _numbered(number)).otherwise(F.coalesce(F.try_element_at(named, name), other))

    return F.when(text.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def html_text(fragment: Column) -> Column:
    """Column: text of an HTML fragment: breaks, ends of paragraphs and of table rows are line ends, other tags go, references become characters, at most one empty line in a row."""
    text = unescape(F.regexp_replace(F.regexp_replace(fragment, "<br/>|<br>|</p>|</tr>", "\n"), "<[^>]+>", ""))
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def _member(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, kind, raw) of the last member of that name of each object."""
    return rows.where(F.col("key") == name).groupBy(*keys).agg(F.max_by(F.struct("kind", "raw"), "pos").alias("m")).select(*keys, "m.*")


def _facts(objects: DataFrame, *keys: str) -> DataFrame:
    """(keys, page_idx, text, width, height) of objects (keys, kind, raw) by their id, page, html and bbox; page_idx is null where neither gives one.

    The page is the number in an id like ``/page/3/...``, else a whole number ``page`` of 0 or more. bbox counts if it is a list of four numbers. A html that is no text counts as its JSON, null as none.
    """
    fields = F.from_json("raw", "struct<id:variant,page:variant,html:variant,bbox:variant>")
    rows = objects.where("kind = 'object'").select(*keys, fields.alias("f"))
    kind = lambda c: F.coalesce(_kind(F.col(f"f.{c}")), F.lit("void"))
    as_text = lambda c: F.when(kind(c) == "string", F.try_variant_get(F.col(f"f.{c}"), "$", "string"))
    by_id = F.nullif(F.regexp_extract(F.coalesce(as_text("id"), F.lit("")), r"/page/(\d+)/", 1), F.lit("")).try_cast("int")
    page = F.when(kind("page") == "bigint", F.try_variant_get("f.page", "$", "int"))
    html = F.when(kind("html") == "void", "").otherwise(F.coalesce(as_text("html"), F.to_json("f.html")))
    return rows.select(*keys, F.coalesce(by_id, F.when(page >= 0, page)).alias("page_idx"), html_text(html).alias("text"), *_sides(F.col("f.bbox")))


def _sides(bbox: Column) -> list[Column]:
    """width and height of a VARIANT that is a list of four numbers, else null."""
    box = F.try_variant_get(bbox, "$", "array<variant>")
    numbers = F.transform(box, lambda x: F.when(_kind(x).isin("bigint", "decimal", "double", "float"), F.try_variant_get(x, "$", "double")))
    good = (F.size(box) == 4) & F.forall(numbers, lambda x: x.isNotNull())
    return [F.when(good, F.get(numbers, F.lit(k + 2)) - F.get(numbers, F.lit(k))).alias(c) for k, c in enumerate(("width", "height"))]


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text"))))
    return rows.groupBy(*keys).agg(strip(F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).alias("text"))


def block_pages(payloads: DataFrame) -> DataFrame:
    """(doc_id, page_idx, text, width, height) from (doc_id, payload), pages of an engine's JSON.

    With a list ``blocks``, blocks are gathered by their page; the pages of the object ``page_info`` are there too, with or without blocks, and give the dimensions (a full outer join). Else each object of the
    list ``children`` is a page with its own bbox, and its text is that of its children. Blocks and pages without a page
    number go, and blocks without text add nothing. Payloads of another shape, broken JSON and null have no pages. doc_id is unique.
    """
    roots = json_roots(payloads, "payload", "doc_id").where("kind = 'object'")
    members = kept(children(roots, "doc_id").where("key IN ('blocks', 'page_info', 'children')"), "members")
    blocks = _member(members, "blocks", "doc_id").where("kind = 'array'")
    found = _facts(children(blocks, "doc_id").select("doc_id", "pos", "kind", "raw"), "doc_id", "pos").where("page_idx IS NOT NULL AND text <> ''")
    texts = _joined(found, "doc_id", "page_idx")
    info = _member(members, "page_info", "doc_id").where("kind = 'object'").join(blocks.select("doc_id"), "doc_id", "left_semi")
    pages = children(info, "doc_id").withColumn("page_idx", F.when(F.col("key").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("key").try_cast("int"))).where("page_idx IS NOT NULL")
    box = F.when((F.col("key") == F.col("page_idx").cast("string")) & (F.col("kind") == "object"), F.from_json("raw", "struct<bbox:variant>")["bbox"])
    dims = pages.select("doc_id", "page_idx", *_sides(box)).groupBy("doc_id", "page_idx").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    flat = texts.join(dims, ["doc_id", "page_idx"], "full_outer").select("doc_id", "page_idx", F.coalesce("text", F.lit("")).alias("text"), "width", "height")
    trees = _member(members, "children", "doc_id").where("kind = 'array'").join(blocks.select("doc_id"), "doc_id", "left_anti")
    tops = kept(children(trees, "doc_id").where("kind = 'object'").select("doc_id", F.col("pos").alias("top"), "kind", "raw"), "tops")
    numbered = _facts(tops, "doc_id", "top").where("page_idx IS NOT NULL").drop("text")
    nested = _member(children(tops, "doc_id", "top").where("key = 'children'"), "children", "doc_id", "top").where("kind = 'array'")
    inner = _joined(_facts(children(nested, "doc_id", "top"), "doc_id", "top", "pos"), "doc_id", "top")
    # Spark takes VARIANT for so large that it takes the texts, from rows of which one was cut, for small, and would broadcast them
    inner = inner.select(F.col("doc_id").alias("_doc"), F.col("top").alias("_top"), "text").hint("merge")
    tree = numbered.join(inner, (F.col("doc_id") == F.col("_doc")) & (F.col("top") == F.col("_top")), "left").select("doc_id", "page_idx", F.coalesce("text", F.lit("")).alias("text"), "width", "height")
    return flat.unionByName(tree)
