"""Content families, canonical Markdown-like text, and plain-text clean-up."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foldline.functions.text import WS, strip
from foldline.operators.adapters import unescaped
from foldline.operators.structure import FENCE

#: Content types of each family; other ``text/*`` is plain.
MARKDOWN = ("text/markdown", "text/x-markdown")
HTML = ("text/html", "application/xhtml+xml")


def content_family(content_type: Column) -> tuple[Column, Column]:
    """Columns: family (markdown, html, plain, unsupported) and a warning, null where supported. Null types are unsupported."""
    kind = F.lower(strip(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    family = F.when(kind.isin(*MARKDOWN), "markdown").when(kind.isin(*HTML), "html").when(kind.startswith("text/"), "plain").otherwise("unsupported")
    return family, F.when(family == "unsupported", F.concat(F.lit("unsupported content_type '"), kind, F.lit("'")))


def decoded(content: Column) -> Column:
    """Bytes as text; malformed UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def normalise_markdown(docs: DataFrame, collapse: int = 2) -> DataFrame:
    """(doc_id, text): line ends as ``\\n``, no trailing blanks, at most ``collapse`` empty lines in a row; fenced code stays as it is.

    Null texts have no row. The lines of a document share one partitioning by doc_id from split to join.
    """
    text = F.regexp_replace("text", "\r\n?", "\n")
    at = Window.partitionBy("doc_id").orderBy("no")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    fence = F.col("line").startswith(FENCE)
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(upto))
    code = fence | (F.col("fences") % 2 == 1)
    rows = rows.select("doc_id", "no", F.when(code, F.col("line")).otherwise(F.regexp_replace("line", "[ \t]+\\z", "")).alias("line"), code.alias("code"))
    rows = rows.withColumn("blank", (~F.col("code") & (F.col("line") == "")).cast("int"))
    rows = rows.withColumn("island", F.sum(1 - F.col("blank")).over(upto))
    run = Window.partitionBy("doc_id", "island").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("run", F.sum("blank").over(run)).withColumn("line", F.when(F.col("run") <= max(0, collapse), F.col("line")))
    joined = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("no", "line")))).alias("x"))
    return joined.select("doc_id", F.trim(F.array_join(F.transform("x", lambda s: s["line"]), "\n"), F.lit("\n")).alias("text"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def clean_text(text: Column, dehyphenate: bool = True, dedupe: bool = True, collapse: bool = True) -> Column:
    """Column: stripped lines, words joined over line ends, adjacent equal lines and empty lines once. Apply ``nfkc`` first where texts may need it."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    if dehyphenate:
        text = F.regexp_replace(text, rf"([\p{{L}}\p{{N}}_])-[{WS}]*\n[{WS}]*([\p{{L}}\p{{N}}_])", "$1$2")
    found = F.transform(F.array(text), lambda t: F.transform(F.split(t, "\n", -1), strip))
    if dedupe:
        found = F.transform(found, lambda a: F.filter(a, lambda x, i: (x == "") | (i == 0) | (x != F.get(a, i - 1))))
    if collapse:
        found = F.transform(found, lambda a: F.filter(a, lambda x, i: (x != "") | (i == 0) | (F.get(a, i - 1) != "")))
    return F.transform(found, lambda a: strip(F.array_join(a, "\n")))[0]


def strip_tags(html: Column, decode: Callable[[Column], Column] = unescaped) -> Column:
    """Column: text of an HTML fragment: breaks and ends of paragraphs and table rows are line ends, other tags go, ``decode`` makes entities characters."""
    text = F.regexp_replace(html, r"(?i)<br[\x09-\x0D ]*/?>|</p[\x09-\x0D ]*>|</tr[\x09-\x0D ]*>", "\n")
    text = F.regexp_replace(decode(F.regexp_replace(text, "<[^>]+>", "")), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def slug_id(stem: Column, content: Column) -> Column:
    """Column: readable stable id: the stem's slug and ten digits of the content's SHA-256."""
    return F.concat(F.lower(F.trim(F.regexp_replace(stem, "[^a-zA-Z0-9]+", "-"), F.lit("-"))), F.lit("-"), F.substring(F.sha2(content, 256), 1, 10))
