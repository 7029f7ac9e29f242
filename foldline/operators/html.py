"""HTML pages as Markdown-like text, by windows over a table of tokens.

One regular expression cuts a page into tags and text. Running counts over the tokens of a page tell where
a block ends, which list, table row or preformatted part a token lies in; grouped sums put the blocks together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.text import WS, strip
from foldline.operators.json_pages import unescape

#: Comments; scripts and styles with all they hold; tags, quoted attributes first; declarations; text.
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?=</(?:script|style)\b|\z)"
    r"|</?[a-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|</?[a-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)|[^<]+|<"
)
_RAW = r"(?is)\A<(?:script|style)\b[^>]*>"
_HEADINGS = [f"h{k}" for k in range(1, 7)]
_FENCE = "`" * 3


def _inline(c: Column) -> Column:
    """Column: white space as single spaces."""
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def html_tokens(pages: DataFrame, id_col: str, html_col: str, decode: Callable[[Column], Column] = unescape) -> DataFrame:
    """(id, i, name, ends, token, text): tags with their lower-case name and whether they end an element; text has no name. Null pages have no rows.

    ``decode`` makes entities characters in each text by itself: one that a tag or the end of the text cuts off never goes on in the next. Scripts and styles have none.
    """
    rows = pages.where(F.col(html_col).isNotNull()).select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(_TOKEN), F.lit(0))).alias("i", "token"))
    raw = F.col("token").rlike(_RAW)
    name = F.when(~raw, F.lower(F.nullif(F.regexp_extract("token", r"\A</?([A-Za-z][A-Za-z0-9]*)", 1), F.lit(""))))
    text = (
        F.when(raw, F.regexp_replace("token", _RAW, "")).when(F.col("token").rlike(r"\A</?[A-Za-z]"), F.when(name == "br", "\n"))
        .when(~F.col("token").rlike(r"\A<[!?]"), decode(F.col("token")))
    )
    return rows.select(id_col, "i", name.alias("name"), F.col("token").startswith("</").alias("ends"), "token", text.alias("text"))


def _state(rows: DataFrame, key: str) -> DataFrame:
    """Tokens with the part of the page that each lies in."""
    at = Window.partitionBy(key).orderBy("i")
    upto, before = at.rowsBetween(Window.unboundedPreceding, 0), at.rowsBetween(Window.unboundedPreceding, -1)
    name, ends = F.col("name"), F.col("ends")
    begins = lambda *tags: F.coalesce(name.isin(*tags) & ~ends, F.lit(False))
    closes = lambda *tags: F.coalesce(name.isin(*tags) & ends, F.lit(False))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    count = lambda c, w: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
    flush = begins(*_HEADINGS, "p", "li", "pre", "table") | closes(*_HEADINGS, "p", "li")
    rows = rows.select(
        "*", flush.alias("flush"), count(flush, before).alias("block"),
        F.coalesce(last(F.when(begins("pre"), 1).when(closes("pre"), 0), upto), F.lit(0)).alias("in_pre"), count(begins("pre"), upto).alias("pre"),
        F.coalesce(last(F.when(begins("table"), 1).when(closes("table"), 0), before), F.lit(0)).alias("in_table"), count(begins("table"), upto).alias("table"),
        F.coalesce(last(F.when(begins("tr"), 1).when(closes("tr", "table") | begins("table"), 0), before), F.lit(0)).alias("in_row"), count(begins("tr"), upto).alias("row"),
        F.coalesce(last(F.when(begins("td", "th"), 1).when(closes("td", "th", "tr", "table") | begins("tr", "table"), 0), before), F.lit(0)).alias("in_cell"), count(begins("td", "th"), upto).alias("cell"),
        last(F.when(begins(*_HEADINGS), F.substring("name", 2, 1).cast("int")).when(closes(*_HEADINGS), F.lit(0)), before).alias("level"),
        F.coalesce(F.sum(F.when(begins("ul", "ol"), 1).when(closes("ul", "ol"), -1).otherwise(0)).over(upto), F.lit(0)).alias("opened"),
    )
    # an end tag without a list to end counts for nothing
    rows = rows.withColumn("depth", F.col("opened") - F.least(F.min("opened").over(upto), F.lit(0)))
    of_list = Window.partitionBy(key, "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("list", F.when(F.col("depth") > 0, last(F.when(begins("ul", "ol"), F.struct("i", "name")), of_list)))


def _joined(c: str = "text") -> Column:
    """Aggregate column: the texts of the group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("i", c)))), lambda s: s[c]), "")


def _plain_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, sub, block) of headings, list items and paragraphs: what stands between two ends of blocks."""
    free = F.col("text").isNotNull() & (F.col("in_pre") == 0) & ~((F.col("in_cell") == 1) & (F.col("in_row") == 1) & (F.col("in_table") == 1))
    rows = rows.select(key, "i", "block", F.when(free, F.col("text")).alias("text"), F.when(F.col("flush"), F.struct("name", "ends", "level", "list")).alias("by"))
    found = rows.where("text IS NOT NULL OR by IS NOT NULL").groupBy(key, "block").agg(_joined().alias("raw"), F.max("i").alias("at"), F.max_by("by", F.when(F.col("by").isNotNull(), F.col("i"))).alias("by"))
    found = found.where(F.col("raw").rlike(f"[^{WS}]")).withColumn("text", _inline(F.col("raw"))).where("text <> ''")
    item = F.coalesce((F.col("by.name") == "li") & F.col("by.ends"), F.lit(False))
    number = F.row_number().over(Window.partitionBy(key, item, "by.list.i").orderBy("at"))
    prefix = F.when(F.col("item"), F.when(F.col("by.list.name") == "ol", F.concat(F.col("number"), F.lit(". "))).otherwise("- "))
    prefix = prefix.when(F.col("by.name").isin(*_HEADINGS) & F.col("by.ends"), F.concat(F.repeat(F.lit("#"), F.greatest(F.coalesce("by.level", F.lit(1)), F.lit(1))), F.lit(" "))).otherwise("")
    return found.select("*", item.alias("item"), number.alias("number")).select(key, "at", F.lit(0).alias("sub"), F.concat(prefix, "text").alias("block"))


def _code_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, sub, block) of preformatted parts that end, with the language of the class ``language-``."""
    names = F.split(F.regexp_extract("token", r"(?i)\bclass\s*=\s*[\"']?([^\"'>]*)", 1), f"[{WS}]+")
    named = F.filter(F.transform(names, F.lower), lambda x: x.startswith("language-"))
    inside = rows.where((F.col("in_pre") == 1) | ((F.col("name") == "pre") & F.col("ends")))
    inside = inside.withColumn("language", F.when((F.col("name") == "code") & ~F.col("ends"), F.substring(F.get(named, F.lit(0)), 10, 1 << 20)))
    found = inside.groupBy(key, "pre").agg(_joined().alias("raw"), F.max(F.when((F.col("name") == "pre") & F.col("ends"), F.col("i"))).alias("at"), F.max_by("language", F.when(F.col("language").isNotNull(), F.col("i"))).alias("language"))
    text = F.regexp_replace("raw", "\r\n?", "\n")
    return found.where("at IS NOT NULL AND pre > 0").select(key, "at", F.lit(0).alias("sub"), F.concat(F.lit(_FENCE), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n" + _FENCE)).alias("block"))


def _table_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, sub, block) of table rows: as many cells as the widest row has, the first row with a header cell first, with a rule below."""
    ended = rows.where((F.col("name") == "table") & F.col("ends")).groupBy(key, "table").agg(F.min("i").alias("at"))
    inside = rows.where((F.col("in_table") == 1) & (F.col("in_row") == 1) & (F.col("in_cell") == 1))
    closing = (F.col("name").isin("td", "th") & F.col("ends")).cast("int")
    cells = inside.groupBy(key, "table", "row", "cell").agg(_joined().alias("raw"), F.max(closing).alias("closed"), F.max(F.coalesce((F.col("name") == "th") & F.col("ends"), F.lit(False))).alias("head")).where("closed = 1")
    cells = cells.withColumn("text", F.replace(_inline(F.col("raw")), F.lit("|"), F.lit("\\|")))
    lines = cells.groupBy(key, "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda s: s["text"]).alias("x"), F.max("head").alias("head")).join(ended, [key, "table"])
    table = Window.partitionBy(key, "table")
    lines = lines.withColumn("width", F.max(F.size("x")).over(table)).withColumn("first", F.min(F.when(F.col("head"), F.col("row"))).over(table))
    shown = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    padded = F.concat("x", F.array_repeat(F.lit(""), F.col("width") - F.size("x")))
    top = F.col("row") == F.col("first")
    rule = F.when(top, F.array(shown(padded), shown(F.array_repeat(F.lit("---"), F.col("width"))))).otherwise(F.array(shown(padded)))
    out = lines.select(key, "at", F.when(top, -1).otherwise(F.col("row")).alias("row"), F.posexplode(rule).alias("k", "block"))
    return out.select(key, "at", (2 * F.col("row") + F.col("k")).alias("sub"), "block")


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", decode: Callable[[Column], Column] = unescape) -> DataFrame:
    """(id, text): headings, paragraphs, list items, code and table rows of each page as blocks with an empty line between; pass it through ``normalise_markdown`` for canonical text.

    Tags that make no block are transparent; what scripts and styles hold counts as text. Comments, declarations and a tag
    cut off by the end of the page go. Null pages stay null; ids are unique. Pages are dealt by their ids once, before they
    are cut into tokens; what follows keeps to that dealing.
    """
    pages = pages.select(id_col, html_col).repartition(id_col)
    rows = lambda tag: _state(html_tokens(pages.where(F.col(html_col).rlike(f"(?i)<{tag}")), id_col, html_col, decode), id_col)
    blocks = _plain_blocks(_state(html_tokens(pages, id_col, html_col, decode), id_col), id_col).unionByName(_code_blocks(rows("pre"), id_col)).unionByName(_table_blocks(rows("table"), id_col))  # only pages with such a tag have such blocks
    found = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "sub", "block"))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: s["block"]), "\n\n")
    joined = pages.select(id_col, F.col(html_col).isNull().alias("_none")).join(found, id_col, "left")
    return joined.select(id_col, F.when(~F.col("_none"), F.coalesce(text, F.lit(""))).alias("text"))
