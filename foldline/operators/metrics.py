"""Metrics of a run over documents, pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.functions.text import not_blank, strip
from foldline.operators.passages import length_percentiles


def run_metrics(pages: DataFrame, chunks: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, pages, non_empty_content_rate, duplicate_line_rate, chunk_count, char_length_p50, char_length_p90) from pages (doc_id, text) and chunks (doc_id, text).

    The duplicate-line rate covers stripped lower-case lines of ``least`` characters or more over all pages of a document. A document without
    chunks has percentiles of 0. Lines and lengths are counted before they meet, so no document's lines are gathered.
    """
    text = F.coalesce("text", F.lit(""))
    by_page = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.avg(not_blank(text).cast("int")).alias("non_empty_content_rate"))
    lines = pages.select("doc_id", F.explode(F.split(text, "\n", -1)).alias("line")).select("doc_id", F.lower(strip(F.col("line"))).alias("line")).where(F.length("line") >= least)
    counts = lines.groupBy("doc_id", F.xxhash64("line").alias("a"), F.md5("line").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rate = counts.groupBy("doc_id").agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicate_line_rate"))
    sizes = length_percentiles(chunks, F.length("text"), [50, 90], "doc_id")
    joined = by_page.join(rate, "doc_id", "left").join(sizes, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("doc_id", "pages", "non_empty_content_rate", zero("duplicate_line_rate").alias("duplicate_line_rate"), F.coalesce("n", F.lit(0)).alias("chunk_count"), zero("p50").alias("char_length_p50"), zero("p90").alias("char_length_p90"))


def histogram(rows: DataFrame, value, width: int, *keys: str) -> DataFrame:
    """(keys, low, n): how many values lie in [low, low + width)."""
    low = (F.floor(value / width) * width).cast("long")
    return rows.select(*keys, low.alias("low")).where("low IS NOT NULL").groupBy(*keys, "low").agg(F.count(F.lit(1)).alias("n"))


def status_matrix(runs: DataFrame, engines: list[str]) -> DataFrame:
    """(doc_id, one column for each engine): the status of the last run (doc_id, engine, status, started) of each engine on each document; null where none ran."""
    last = lambda e: F.max_by(F.when(F.col("engine") == e, F.col("status")), F.when(F.col("engine") == e, F.col("started"))).alias(e)
    return runs.groupBy("doc_id").agg(*map(last, engines))
