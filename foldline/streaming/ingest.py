"""Incremental ingest of a folder as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.operators.canonical import content_family, decoded
from foldline.sources.files import FILE_SCHEMA, raw_documents, resolved_dir


def ingest(spark: SparkSession, base_dir: str, out_dir: str, checkpoint: str, *, files_per_batch: int = 10_000, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> None:
    """Append the text of files that came since the last call to ``out_dir``, one partition for each batch.

    A batch that is run again after a failure overwrites its own partition, so the sink stays exact. The checkpoint is the cursor.
    """
    base_dir = resolved_dir(spark, base_dir)
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(base_dir)
    rows = raw_documents(files, base_dir, include=include, exclude=exclude)
    family, warning = content_family(F.col("content_type"))
    rows = rows.withColumn("family", family).withColumn("warning", warning).withColumn("text", F.when(F.col("family") != "unsupported", decoded(F.col("content")))).drop("content")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest row of each document of ``out_dir``: later batches replace earlier ones."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc("modificationTime"), F.desc("batch"))
    return spark.read.parquet(out_dir).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
