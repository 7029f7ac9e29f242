"""Extracted pages distilled into one document: reading order, merged paragraphs, canonical text, sections and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.operators.pages import canonical_ranges, merge_over_pages
from foldline.operators.structure import anchored

#: Block types that count as paragraphs.
PARAGRAPHS = ("caption", "footer", "header", "unknown")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page_idx, page_no, key, block_no) with block_no anew: by page, then by ``key`` as text; ties keep their order."""
    order = Window.partitionBy("doc_id").orderBy("page_idx", "page_no", F.col("key").cast("string"), "block_no")
    return blocks.withColumn("block_no", F.row_number().over(order) - 1)


def plain_type(kind: Column) -> Column:
    return F.when(kind.isin(*PARAGRAPHS), "para").otherwise(kind)


def heading_level(text: Column) -> Column:
    """Column: number of leading ``#``, 6 at most and 1 at least."""
    return F.greatest(F.lit(1), F.least(F.lit(6), F.length(F.regexp_extract(text, "^#*", 0))))


def distill(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, page_idx, type, level, heading, section_path, sec_anchor, ordinal, pass_anchor, start_off, end_off, text) of the blocks of ``reading_order``'s input.

    Paragraphs that go on over pages are merged; headings get their level from leading ``#`` and a text made distinct below
    their parent. All windows share one partitioning by doc_id. Empty tables give no rows.
    """
    typed = reading_order(blocks).select("doc_id", "block_no", "page_idx", plain_type(F.col("type")).alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    rows = canonical_ranges(merge_over_pages(typed))
    rows = rows.withColumn("block_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no")) - 1).drop("block_no", "n_merged")
    heading = F.col("type") == "heading"
    found = rows.withColumnRenamed("text", "body").withColumn("level", F.when(heading, heading_level(F.col("body")))).withColumn("text", F.when(heading, F.regexp_replace("body", r"^[# ]+|[# ]+\z", "")))
    out = anchored(found)
    return out.select("doc_id", "block_idx", "page_idx", "type", "level", F.col("text").alias("heading"), "section_path", "sec_anchor", "ordinal", "pass_anchor", "start_off", "end_off", F.col("body").alias("text"))


def canonical_text(distilled: DataFrame) -> DataFrame:
    """(doc_id, text): the text that the ranges of ``distill`` refer to."""
    rows = distilled.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "page_idx", "text"))).alias("x"))
    part = lambda s, i: F.concat(F.when(i == 0, "").when(s["page_idx"] != F.get("x", i - 1)["page_idx"], "\n\n\f\n\n").otherwise("\n\n"), s["text"])
    return rows.select("doc_id", F.array_join(F.transform("x", part), "").alias("text"))
