"""Overlapping character chunks, passages and corpus metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.text import not_blank, part, strip, text_chunks
from foldline.sources.files import text_pages


def char_windows(text: Column, target: int, overlap: int, least: int) -> Column:
    """Column: pieces of ``target`` characters, each starting ``target - overlap`` after the last; a short tail joins the piece before it.

    An overlap of the target or more counts as a quarter of it. Pieces are stripped and blank ones dropped; null text has none.
    """
    overlap = overlap if overlap < target else target // 4
    step = target - overlap

    def pieces(s: Column) -> Column:
        n = F.when(F.length(s) <= target, 1).otherwise(F.ceil((F.length(s) - target) / step) + 1).cast("int")
        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda k: strip(F.substring(s, k * step + 1, F.lit(target)))), lambda p: p != "")

    def tail(p: Column) -> Column:
        size = F.size(p)
        merged = F.concat(F.slice(p, F.lit(1), F.greatest(size - 2, F.lit(0))), F.array(strip(F.concat(F.get(p, size - 2), F.lit("\n"), F.get(p, size - 1)))))
        return F.when((size > 1) & (F.length(F.get(p, size - 1)) < least), merged).otherwise(p)

    # as elements of arrays of one, the stripped text and its pieces are computed once for each row
    return F.transform(F.transform(F.array(strip(F.coalesce(text, F.lit("")))), pieces), tail)[0]


def chunks(docs: DataFrame, target: int = 1200, overlap: int = 120, least: int = 250) -> DataFrame:
    """(doc_id, page_idx, chunk_no, chunk_id, text): the pieces of each page of a document; pages end at form feeds and no piece crosses them."""
    rows = text_pages(docs).select("doc_id", "page_idx", F.posexplode(char_windows(F.col("text"), target, overlap, least)).alias("chunk_no", "text"))
    return rows.select("doc_id", "page_idx", "chunk_no", F.format_string("%s-p%04d-c%03d", F.col("doc_id").cast("string"), F.col("page_idx") + 1, F.col("chunk_no") + 1).alias("chunk_id"), "text")


def clamp_spans(rows: DataFrame) -> DataFrame:
    """Rows with (text, start, end): clamped spans and their text; empty and blank ones are dropped."""
    n = F.length("text")
    start = F.greatest(F.lit(0), F.least(F.col("start"), n))
    end = F.greatest(start, F.least(F.col("end"), n))
    piece = F.substring("text", start + 1, end - start)
    return rows.withColumn("passage", piece).withColumn("start_off", start).withColumn("end_off", end).where(not_blank(F.col("passage"))).drop("start", "end")


def cut_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, start_off, end_off, passage): spans (doc_id, start, end) of texts (doc_id, text), clamped as by ``clamp_spans``; empty and blank ones are dropped.

    The spans of a document meet in one row and join its text once; each is cut inside that row, at the cost of its own length.
    """
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("_spans"))
    rows = texts.select("doc_id", "text").join(spans, "doc_id").select("doc_id", F.struct(F.length("text").cast("long").alias("n"), text_chunks(F.col("text")).alias("chunks")).alias("_t"), "_spans")

    def cut(t: Column):
        def one(s: Column) -> Column:
            start = F.greatest(F.lit(0).cast("long"), F.least(s["start"], t["n"]))
            end = F.greatest(start, F.least(s["end"], t["n"]))
            return F.struct(start.alias("start_off"), end.alias("end_off"), part(t["chunks"], start, end).alias("passage"))

        return F.transform("_spans", one)

    found = F.transform(F.array("_t"), cut)[0]
    return rows.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*").where(not_blank(F.col("passage")))


def duplicate_line_rate(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, n_lines, duplicate_line_rate) over stripped lower-case lines of at least ``least`` characters."""
    rows = docs.select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.lower(strip(x))), lambda x: F.length(x) >= least).alias("x"))
    n = F.size("x")
    return rows.select("doc_id", n.cast("long").alias("n_lines"), ((n - F.size(F.array_distinct("x"))) / F.greatest(n, F.lit(1))).alias("duplicate_line_rate"))


def secret_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no) of lines that hold an API key of the fixed form."""
    rows = docs.where(F.col("text").contains("AIza")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike("AIza[A-Za-z0-9_-]{35}")).select("doc_id", "line_no")
