"""Blocks from the JSON payloads of extraction engines."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foldline.functions.text import strip

_BLOCK = "struct<block_type:string,type:string,id:string,html:string,raw_text:string,text:string,page:int,page_idx:int,polygon:string,bbox:string>"
_PAGE = f"struct<page:int,page_idx:int,children:array<{_BLOCK}>,blocks:array<{_BLOCK}>>"
_PAYLOAD = f"struct<children:array<{_PAGE}>,pages:array<{_PAGE}>,blocks:array<{_BLOCK}>>"
#: An engine's block types, in lower case, by our type; others are unknown.
TYPES = {
    "heading": ("title", "sectionheader"), "para": ("text", "paragraph"), "list": ("listitem", "list"), "table": ("table",), "code": ("code",),
    "caption": ("picture",), "footer": ("footer",), "header": ("header", "pageheader"),
}
ASSETS = {"picture": "image", "equation": "equation", "table": "table_render"}


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Entities as characters; Spark has no function for it."""
    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


def plain_text(fragment: Column) -> Column:
    """Column: text of an HTML fragment; breaks and ends of paragraphs are line ends, other tags go, entities become characters."""
    text = F.regexp_replace(fragment, r"(?i)<br[\x09-\x0D ]*/?>|</p[\x09-\x0D ]*>", "\n")
    return strip(unescaped(F.regexp_replace(text, "<[^>]+>", "")))


def payload_blocks(payloads: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_no, block_id, type, text, has_coords, asset) from (doc_id, payload): JSON with ``children``, ``pages`` or a flat list ``blocks``.

    A flat block's page is its field, else one less than the number in its id, else 0. Blocks without text go, but for
    tables; pictures and equations without text stay as assets only, with a null type. Broken JSON and null give no rows.
    """
    p = payloads.select("doc_id", F.from_json("payload", _PAYLOAD).alias("p"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    paged = p.select("doc_id", F.posexplode(F.coalesce(some("p.children"), some("p.pages"))).alias("_no", "x"))
    paged = paged.select("doc_id", F.coalesce("x.page", "x.page_idx", "_no").alias("page_idx"), F.posexplode(F.coalesce("x.children", "x.blocks")).alias("block_no", "b"))
    number = F.regexp_extract(F.coalesce("b.id", F.lit("")), r"/page/(\d+)/", 1)
    flat = p.where(F.coalesce(some("p.children"), some("p.pages")).isNull()).select("doc_id", F.posexplode("p.blocks").alias("_no", "b"))
    flat = flat.select("doc_id", "_no", F.coalesce("b.page", "b.page_idx", number.try_cast("int") - 1, F.lit(0)).alias("page_idx"), "b")
    flat = flat.select("doc_id", "page_idx", (F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("_no")) - 1).alias("block_no"), "b")
    rows = paged.unionByName(flat).withColumn("kind", F.lower(F.coalesce("b.block_type", "b.type", F.lit("unknown"))))
    rows = rows.withColumn("text", plain_text(F.coalesce("b.html", "b.raw_text", "b.text", F.lit(""))))
    kinds = F.create_map(*[F.lit(x) for ours, theirs in TYPES.items() for t in theirs for x in (t, ours)])
    assets = F.create_map(*[F.lit(x) for pair in ASSETS.items() for x in pair])
    asset = F.try_element_at(assets, F.col("kind"))
    block = F.when((F.col("text") != "") | (F.col("kind") == "table"), F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("unknown")))
    block_id = F.coalesce("b.id", F.format_string("marker_p%d_b%d", "page_idx", "block_no"))
    out = rows.select("doc_id", "page_idx", "block_no", block_id.alias("block_id"), block.alias("type"), "text", F.coalesce("b.polygon", "b.bbox").isNotNull().alias("has_coords"), asset.alias("asset"))
    return out.where("type IS NOT NULL OR asset IS NOT NULL")


_SPANS = "array<struct<spans:array<struct<content:string>>>>"
_FLAT = f"struct<type:string,id:string,text:string,lines:{_SPANS},bbox:string,polygon:string,page_idx:int>"
_FLAT_PAGE = f"struct<page:int,page_idx:int,blocks:array<{_FLAT}>,preproc_blocks:array<{_FLAT}>>"
#: The other engine's block types by ours; others are unknown.
FLAT_TYPES = {
    "heading": ("title", "heading"), "para": ("text", "paragraph", "text_block"), "list": ("list", "list_item"), "table": ("table",), "code": ("code", "code_block"),
    "footer": ("footnote", "footer"), "header": ("header",), "caption": ("caption", "image_caption", "table_caption"),
}
FLAT_ASSETS = {"image": "image", "figure": "image", "equation": "equation", "table": "table_render"}


def flat_blocks(payloads: DataFrame) -> DataFrame:
    """As ``payload_blocks``, from the other engine's JSON: a list of blocks with ``page_idx``, or pages in ``pdf_info``, ``pdf_info.pages`` or ``pages``.

    A block without text takes that of its lines: contents of spans with a space between, lines with a line end. Of two pages
    of one number the later counts. Blocks stay without text too, but for images and equations, which are then assets
    only, with a null type. Broken JSON and null give no rows.
    """
    listed = lambda c: c.rlike(r"\A[\x09-\x0D ]*\[")
    p = payloads.select("doc_id", "payload", F.from_json("payload", f"struct<pdf_info:string,pages:array<{_FLAT_PAGE}>>").alias("p"))
    info = F.col("p.pdf_info")
    inner = F.when(listed(info), F.from_json(info, f"array<{_FLAT_PAGE}>")).otherwise(F.from_json(info, f"struct<pages:array<{_FLAT_PAGE}>>")["pages"])
    pages = p.where(~listed(F.col("payload"))).select("doc_id", F.posexplode(F.when(info.isNull(), F.col("p.pages")).otherwise(inner)).alias("_no", "x"))
    pages = pages.select("doc_id", "_no", F.coalesce("x.page_idx", "x.page", "_no").alias("page_idx"), F.coalesce("x.blocks", "x.preproc_blocks").alias("blocks"))
    later = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy(F.desc("_no")))
    paged = pages.withColumn("_n", later).where("_n = 1").select("doc_id", "page_idx", F.posexplode("blocks").alias("block_no", "b"))
    flat = p.where(listed(F.col("payload"))).select("doc_id", F.posexplode(F.from_json("payload", f"array<{_FLAT}>")).alias("_no", "b"))
    flat = flat.select("doc_id", "_no", F.coalesce("b.page_idx", F.lit(0)).alias("page_idx"), "b")
    flat = flat.select("doc_id", "page_idx", (F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("_no")) - 1).alias("block_no"), "b")
    rows = paged.unionByName(flat).withColumn("kind", F.lower(F.coalesce("b.type", F.lit("unknown"))))
    words = F.transform("b.lines", lambda x: F.array_join(F.filter(F.transform(x["spans"], lambda s: s["content"]), lambda t: t != ""), " "))
    text = F.coalesce(F.nullif(F.col("b.text"), F.lit("")), F.array_join(F.filter(words, lambda x: x != ""), "\n"), F.lit(""))
    rows = rows.withColumn("text", text)
    kinds = F.create_map(*[F.lit(x) for ours, theirs in FLAT_TYPES.items() for t in theirs for x in (t, ours)])
    asset = F.try_element_at(F.create_map(*[F.lit(x) for pair in FLAT_ASSETS.items() for x in pair]), F.col("kind"))
    block = F.when((F.col("text") != "") | ~F.col("kind").isin("image", "figure", "equation"), F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("unknown")))
    block_id = F.coalesce("b.id", F.format_string("mineru_p%d_b%d", "page_idx", "block_no"))
    return rows.select("doc_id", "page_idx", "block_no", block_id.alias("block_id"), block.alias("type"), "text", F.coalesce("b.bbox", "b.polygon").isNotNull().alias("has_coords"), asset.alias("asset"))
