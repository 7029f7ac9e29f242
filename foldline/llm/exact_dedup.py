"""Exact dedup as a stateful stream.

The table is read as a stream. For each digest of a normalised text, a RocksDB state store keeps the
smallest id with the locator of its content (file and row) and the number of rows; state never expires, so a later stream
continues from the same checkpoint and knows the texts of earlier ones. The answers come from that state. Digests hit more
than once are checked on full texts first: those of the table, and those that only a locator into an earlier
file leads to. Equal digests count as copies only where the texts are equal byte for byte.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.llm._shared import SPACE, fresh_path, written

#: State on disk; many small stores neither preallocate files nor upload whole snapshots each batch.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("digest"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _pattern(path: str) -> str:
    """``path`` as a pattern that matches only it: a stream reads a folder, or a pattern, which may name one file. Paths with characters of patterns cannot be streamed."""
    path = path.rstrip("/")
    if re.search(r"[*?\[\]{}\\]", path):
        raise ValueError(f"a stream cannot read a path with characters of patterns: {path}")
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else f"{path[:-1]}{{{path[-1]}}}"


def digest_state(spark: SparkSession, path: str, checkpoint: str, *, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 64) -> DataFrame:
    """Run the stream over the new files of ``path`` and return its state: (digest, keep_id, kept_file, kept_row, group_size).

    Called again with the same ``checkpoint``, it reads only files that came since. Null ids lose to any other.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(path))
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row"))
    state = _digested(stream, id_col, text_col).groupBy("digest").agg(kept.alias("kept"), F.count(F.lit(1)).alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.format("statestore").load(checkpoint).select("key.digest", "value.*").toDF("digest", "kept", "group_size")
    return found.select("digest", F.col("kept.doc_id").alias("keep_id"), F.col("kept._file").alias("kept_file"), F.col("kept._row").alias("kept_row"), "group_size")


def _earlier_texts(spark: SparkSession, hits: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame | None:
    """(digest, _text) of the hits whose kept text lies in a file that is no longer in ``path``; None without any.

    Only names of files reach the driver, which lists the files of a table anyway.
    """
    names = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("kept_file")).distinct()
    old = hits.join(names, "kept_file", "left_anti").select("digest", "kept_file", "kept_row")
    files = [unquote(r[0]) for r in old.select("kept_file").distinct().collect()]
    if not files:
        return None
    there = _digested(spark.read.parquet(*files), id_col, text_col).select("_text", F.col("_file").alias("kept_file"), F.col("_row").alias("kept_row"))
    return there.join(old, ["kept_file", "kept_row"]).select("digest", "_text")


def exact_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None) -> DataFrame:
    """Groups of texts that are equal after white-space runs become one space; one row for each row of ``path``.

    Returns doc_id, keep_id (smallest id of the group, earlier runs on the same ``checkpoint`` included), group_size (rows
    of the group, repeated ids and earlier runs included), kept, and text_sha256 of the normalised text. ``path`` is a Parquet table,
    a folder or one file without characters of patterns in its name, in any store that Spark reads. Null and empty texts are one group. ``checkpoint`` is a folder
    that all executors share; by default a new one in the cluster's shared folder. Null ids: kept is true where the whole
    group has null ids, else they lose to any id. All rows that repeat the smallest id of their group are kept. An empty
    table gives no rows. Very long texts are hashed whole, and compared whole where their digest is hit. The files of
    earlier runs must still be there for this comparison.
    """
    checkpoint = checkpoint or fresh_path(spark, "exact_dedup")
    state = digest_state(spark, path, checkpoint, id_col=id_col, text_col=text_col)
    docs = _digested(spark.read.parquet(path), id_col, text_col)
    hits = written(state.where("group_size > 1"), "hits")
    counted = docs.select("digest", "_text", F.col("doc_id").alias("least"), F.lit(1).cast("long").alias("n"))
    earlier = _earlier_texts(spark, hits, path, id_col, text_col)
    if earlier is not None:
        counted = counted.unionByName(earlier.select("digest", "_text", F.lit(None).cast("long").alias("least"), F.lit(0).cast("long").alias("n")))
    # copies meet in the partial aggregation, so a hot text is one row for each task; beyond this one exchange a short name stands for the text
    texts = counted.groupBy("digest", "_text").agg(F.min("least").alias("least"), F.sum("n").alias("n")).select("digest", F.md5("_text").alias("_other"), "least", "n")
    checked = texts.join(hits, "digest").select("digest", "_other", "least", "n", "keep_id", "group_size")
    alone = F.count(F.lit(1)).over(Window.partitionBy("digest")) == 1  # else the digest has texts that differ
    classes = checked.withColumn("_alone", alone).select(
        "digest", "_other", F.when(F.col("_alone"), F.col("keep_id")).otherwise(F.col("least")).alias("_keep"), F.when(F.col("_alone"), F.col("group_size")).otherwise(F.col("n")).alias("_size")
    )
    rows = docs.select("doc_id", "digest", F.md5("_text").alias("_other")).join(written(classes, "classes"), ["digest", "_other"], "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return rows.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
