"""Titles, and checks of documents that report what is wrong instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.text import WS


def first_filled(*columns: Column) -> Column:
    """Column: the first that is neither null nor empty: a title from metadata, else a source's title, else a reference or id."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def _named(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


def document_violations(*filled: str) -> Column:
    """Column: the names of ``filled`` columns that are null or empty."""
    return _named({f"empty {c}": F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in filled})


def range_violations(start: Column, end: Column, length: Column) -> Column:
    """Column: what is wrong with a range of a text of that length."""
    return _named({"start below 0": start < 0, "end before start": end < start, "end beyond text": end > length})


def malformed_tables(tables: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, block_no, malformed) of table blocks (doc_id, block_no, text): whether a row's number of cells differs from the header's by more than ``share`` of it.

    Such a table should be read as a paragraph. Outer pipes do not count as cells.
    """
    cells = lambda x: F.size(F.split(F.regexp_replace(x, rf"^[{WS}]*\||\|[{WS}]*\z", ""), r"\|", -1))
    rows = F.transform(F.split("text", "\n", -1), cells)
    head = F.get(rows, F.lit(0))
    return tables.select("doc_id", "block_no", F.exists(rows, lambda n: F.abs(n - head) > share * head).alias("malformed"))


def split_valid(rows: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without violations, and those with some, in a column ``violations``."""
    judged = rows.withColumn("violations", violations)
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def output_state(family: Column, source: Column, text: Column, pipeline: Column | None = None) -> Column:
    """Column: (has_textual_content, degraded_output, degraded_reason) of a parsed document, from its content family, the raw input, its canonical text, and what became of the pipeline that should have read it.

    A document with any text is not degraded. Else the reason is the first that holds: a pipeline that was ``unavailable`` or ``failed``, an unsupported family, an input that is null or empty, no text in it.
    """
    filled = F.coalesce(text, F.lit("")).rlike(rf"[^{WS}]")
    reason = F.when(family == "unsupported", "unsupported_content_type").when(F.coalesce(source, F.lit("")) == "", "empty_input").otherwise("no_textual_content")
    if pipeline is not None:
        reason = F.when(pipeline == "unavailable", "pdf_pipeline_unavailable").when(pipeline == "failed", "pdf_pipeline_failed").otherwise(reason)
    return F.struct(filled.alias("has_textual_content"), (~filled).alias("degraded_output"), F.when(~filled, reason).alias("degraded_reason"))


def anchor_completeness(docs: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc_id, anchor_completeness): ``full`` where every block of ``structure.anchored`` has the anchor of its section and, if it is no heading, one of its own; ``document_only`` for others and documents without blocks."""
    bare = F.col("sec_anchor").isNull() | ((F.col("type") != "heading") & F.col("pass_anchor").isNull())
    found = anchored.groupBy("doc_id").agg((~F.max(bare)).alias("_full"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.when(F.col("_full"), "full").otherwise("document_only").alias("anchor_completeness"))
