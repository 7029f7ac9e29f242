"""Tables written to the folder that the driver and all executors share, to cut lineage between rounds of a loop."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one for a session on this machine, and an error for a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    parent = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return f"{parent}/{name}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder."""
    path = fresh_table(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
