"""Runs: whether two runs gave the same tables, and the record of a run from parts that streams and batches can add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions.text import not_blank, strip


def row_digest(df: DataFrame) -> Column:
    """Column: 128 bits of a row's columns in the order of their names; maps count in the order of their keys, floats by value."""
    sorted_maps = [F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes)]
    return F.md5(F.to_json(F.struct(*[c.alias(n) for c, n in zip(sorted_maps, sorted(df.columns), strict=True)]), {"ignoreNullFields": "false"}))


def table_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest): the same for equal bags of rows, however they are ordered or dealt. The digest adds up 128-bit hashes in four parts, so that rows that repeat do not cancel out."""
    d = row_digest(df)
    parts = [F.sum(F.conv(F.substring(F.col("_d"), 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"p{k}") for k in range(4)]
    return df.select(d.alias("_d")).agg(F.count(F.lit(1)).alias("n"), *parts).select("n", F.md5(F.concat_ws("-", *[f"p{k}" for k in range(4)])).alias("digest"))


def run_diff(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> DataFrame:
    """(name, n_first, n_second, same) for every table of either run; a table that one run lacks has a null number of rows."""
    names = sorted({*first, *second})
    out = None
    for name in names:
        sides = [table_digest(run[name]).select(F.col("n").alias(f"n{k}"), F.col("digest").alias(f"d{k}")) if name in run else None for k, run in enumerate((first, second))]
        have = [s for s in sides if s is not None]
        row = have[0] if len(have) == 1 else have[0].join(have[1])  # one row beside one row
        for k, s in enumerate(sides):
            if s is None:
                row = row.withColumn(f"n{k}", F.lit(None).cast("long")).withColumn(f"d{k}", F.lit(None).cast("string"))
        row = row.select(F.lit(name).alias("name"), F.col("n0").alias("n_first"), F.col("n1").alias("n_second"), F.coalesce(F.col("d0") == F.col("d1"), F.lit(False)).alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


def row_diff(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """(keys, change): rows that differ between two runs: added, removed or changed, for each key. Rows of one key are compared as a bag, by a count of digests, so keys may repeat or be null."""
    one = lambda df, sign: df.select(*keys, row_digest(df).alias("_d"), F.lit(sign).alias("_s"))
    counts = one(first, 1).unionByName(one(second, -1)).groupBy(*keys, "_d").agg(F.sum("_s").alias("n"), F.count(F.lit(1)).alias("all"))
    found = counts.groupBy(*keys).agg(F.max(F.col("n") > 0).alias("less"), F.max(F.col("n") < 0).alias("more"))
    return found.where("less OR more").select(*keys, F.when(F.col("less") & F.col("more"), "changed").when(F.col("more"), "added").otherwise("removed").alias("change"))


def run_parts(pages: DataFrame, chunks: DataFrame, least: int = 8) -> DataFrame:
    """(run_id, measure, value, n): what a batch adds to the record of a run, from pages (run_id, status, seconds, text) and chunks (run_id, text).

    Every measure is a count by value, so parts of batches add up by ``merged`` in any order and percentiles stay exact: page_ms and chunk_chars by length, page and its
    status by kind, and lines of ``least`` characters or more by their 64-bit hash. A null status counts as error; a null time is left out.
    """
    text = F.coalesce("text", F.lit(""))
    count = lambda df, measure, value: df.groupBy("run_id", F.lit(measure).alias("measure"), value.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    lines = pages.select("run_id", F.explode(F.split(text, "\n", -1)).alias("line")).select("run_id", F.lower(strip(F.col("line"))).alias("line")).where(F.length("line") >= least)
    parts = [
        count(pages, "page", not_blank(text)), count(pages, "status", F.coalesce("status", F.lit("error"))), count(pages.where("seconds IS NOT NULL"), "page_ms", F.round(F.col("seconds") * 1000).cast("long")),
        count(lines, "line", F.xxhash64("line")), count(chunks, "chunk_chars", F.length(text)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged(*parts: DataFrame) -> DataFrame:
    """The parts of several batches as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("run_id", "measure", "value").agg(F.sum("n").alias("n"))


def run_record(parts: DataFrame, *, failed: tuple[str, ...] = ("error", "timeout"), most_failed: float = 0.0, least_content: float = 0.95, most_duplicates: float = 0.3) -> DataFrame:
    """One row for each run: pages, failures and failure_rate, seconds and seconds_per_page, p95_seconds_per_page, the content and duplicate-line rates, chunks and their length percentiles, and whether the gates hold.

    Percentiles take the value at rank round((n - 1) * p / 100), half to even. A run without pages has rates of 0 and no times.
    """
    at = Window.partitionBy("run_id", "measure")
    number = F.when(F.col("measure").isin("page_ms", "chunk_chars"), F.col("value").cast("long"))
    rows = merged(parts).withColumn("_v", number).withColumn("_all", F.sum("n").over(at)).withColumn("_to", F.when(F.col("_v").isNotNull(), F.sum("n").over(at.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))))
    is_ = lambda m: F.col("measure") == m
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
    percentile = lambda m, p: F.min(F.when(is_(m) & (F.col("_to") > F.bround((F.col("_all") - 1) * p / F.lit(100.0))), F.col("_v")))
    facts = rows.groupBy("run_id").agg(
        total(is_("page")).alias("pages"), total(is_("page") & (F.col("value") == "true")).alias("_filled"), total(is_("status") & F.col("value").isin(*failed)).alias("failures"),
        (F.sum(F.when(is_("page_ms"), F.col("_v") * F.col("n"))) / 1000).alias("seconds"), (F.sum(F.when(is_("page_ms"), F.col("_v") * F.col("n"))) / 1000 / total(is_("page_ms"))).alias("seconds_per_page"),
        (percentile("page_ms", 95) / 1000).alias("p95_seconds_per_page"), total(is_("line")).alias("_lines"), F.coalesce(F.sum(F.when(is_("line"), F.col("n") - 1)), F.lit(0)).alias("_again"),
        total(is_("chunk_chars")).alias("chunk_count"), F.coalesce(percentile("chunk_chars", 50), F.lit(0)).cast("double").alias("char_length_p50"), F.coalesce(percentile("chunk_chars", 90), F.lit(0)).cast("double").alias("char_length_p90"),
    )
    some = lambda c: F.greatest(F.col(c), F.lit(1))
    out = facts.withColumn("failure_rate", F.col("failures") / some("pages")).withColumn("non_empty_content_rate", F.col("_filled") / some("pages")).withColumn("duplicate_line_rate", F.col("_again") / some("_lines"))
    gates = F.struct((F.col("failure_rate") <= most_failed).alias("reliable"), (F.col("non_empty_content_rate") >= least_content).alias("content"), (F.col("duplicate_line_rate") <= most_duplicates).alias("duplicates"))
    return out.drop("_filled", "_lines", "_again").withColumn("gates", gates)


def stream_record(spark: SparkSession, table, pages: DataFrame, chunks: DataFrame, batch: int) -> None:
    """Add a batch of a stream to the parts kept in ``table``, a VersionedTable whose key is ``part``; a replayed batch adds nothing.

    Each batch is a row for each measure of its own, so an upsert never has to add to what another batch wrote.
    """
    parts = run_parts(pages, chunks).withColumn("part", F.concat_ws("/", F.lit(batch), "run_id", "measure", "value"))
    table.apply(parts.withColumn("seq", F.lit(batch)).withColumn("deleted", F.lit(False)), "stream", batch)
