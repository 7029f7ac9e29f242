"""Which of an engine's output files holds its payload, and the pages that it yields.

Files are rows (run, path, length, and content where it is read): those of one run of an engine on one document. A listing by ``run_files`` does not read contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions.text import not_blank
from foldline.operators.json_pages import listed_pages
from foldline.sources.tables import kept


def run_files(spark: SparkSession, base_dir: str, content: bool = False) -> DataFrame:
    """(run, path, length[, content]) of all files below ``base_dir``; a run is the first folder below it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base_dir)
    inside = F.substring_index("path", "/" + base_dir.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return rows.select(F.substring_index(inside, "/", 1).alias("run"), "path", "length", *([F.decode("content", "UTF-8").alias("content")] if content else []))


def _best(files: DataFrame, tier) -> DataFrame:
    """(run, path): of each run the file of the lowest tier, then the longest, then the first by path."""
    ranked = files.withColumn("_tier", tier).where("_tier IS NOT NULL")
    return ranked.groupBy("run").agg(F.min(F.struct("_tier", F.negative("length").alias("l"), "path")).alias("x")).select("run", F.col("x.path").alias("path"))


def largest_json(files: DataFrame) -> DataFrame:
    """(run, path) of each run's longest JSON that is not its metadata; runs without one are absent."""
    return _best(files, F.when(F.col("path").endswith(".json") & ~F.col("path").endswith("_meta.json"), 0))


def preferred_json(files: DataFrame) -> DataFrame:
    """(run, path) of each run's longest content list, else its longest middle file, else its longest other JSON but for the configuration."""
    json = F.col("path").endswith(".json") & (F.substring_index("path", "/", -1) != "mineru_config.json")
    return _best(files, F.when(F.col("path").endswith("_content_list.json"), 0).when(F.col("path").endswith("_middle.json"), 1).when(json, 2))


def loaded_pages(files: DataFrame) -> DataFrame:
    """(run, page_idx, text): the pages of the first JSON by path that yields any, else the first Markdown by path that is not blank, as page 0. Runs without either have no pages."""
    payloads = kept(files.where(F.col("path").endswith(".json")).select(F.struct("run", "path").alias("doc_id"), F.col("content").alias("payload")), "payloads")
    pages = kept(listed_pages(payloads).select("doc_id.run", "doc_id.path", "page_idx", "text"), "pages")
    first = pages.groupBy("run").agg(F.min("path").alias("path"))
    found = pages.join(first, ["run", "path"]).select("run", "page_idx", "text")
    plain = files.where(F.col("path").endswith(".md") & not_blank(F.coalesce("content", F.lit("")))).groupBy("run").agg(F.min(F.struct("path", "content")).alias("x"))
    rest = plain.join(first.select("run"), "run", "left_anti").select("run", F.lit(0).alias("page_idx"), F.col("x.content").alias("text"))
    return found.unionByName(rest)
