"""Results as JSON lines, review texts, and bundles of a run with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_json(df: DataFrame, *keep: str, pretty: bool = False) -> DataFrame:
    """(keep, value): each row's other columns as one JSON object with sorted keys; nulls are written."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return df.select(*keep, F.to_json(F.struct(*sorted(c for c in df.columns if c not in keep)), options).alias("value"))


def write_json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write rows as key-sorted JSON lines below ``path``, in folders by the columns ``by``, such as run_id.

    Only the folders that ``df`` has rows for are replaced, so a run that is repeated leaves the same files.
    """
    by = by or []
    as_json(df, *by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic" if by else "static").mode("overwrite").text(path)


def review_texts(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): the chunks (doc_id, chunk_id, text) of each document as one Markdown text to read through, in order of their ids."""
    part = F.concat(F.lit("## "), "chunk_id", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    found = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", part.alias("part")))).alias("x"))
    return found.select("doc_id", F.array_join(F.transform("x", lambda s: s["part"]), "\n\n").alias("text"))


def run_id(version: str, config: str):
    """Column over (content): identity of a run, from the version, the content's digest and the configuration's digest."""
    return F.concat_ws("_", F.lit(version), F.substring(F.sha2("content", 256), 1, 16), F.substring(F.sha2(F.lit(config), 256), 1, 16))


def write_bundle(tables: dict[str, DataFrame], path: str, run: str, facts: dict[str, str] | None = None) -> DataFrame:
    """Write each table as key-sorted JSON lines to ``path``/name/run_id=``run``, then a manifest row with ``facts`` and the rows of each; returns the manifest.

    A repeated run replaces its own files only. The tables are written one after the other; their rows are counted from what was written.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in sorted(tables.items()):
        write_json_lines(df.withColumn("run_id", F.lit(run)), f"{path}/{name}", ["run_id"])
        counts[name] = spark.read.text(f"{path}/{name}/run_id={run}").count()
    row = spark.range(1).select(F.lit(run).alias("run_id"), *[F.lit(v).alias(k) for k, v in sorted((facts or {}).items())], *[F.lit(n).alias(f"{name}_rows") for name, n in counts.items()])
    write_json_lines(row, f"{path}/manifest", ["run_id"])
    return row


def write_header(spark: SparkSession, columns: list[str], path: str) -> None:
    """Write a CSV of no rows with the header of ``columns``, for people to fill in."""
    spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
