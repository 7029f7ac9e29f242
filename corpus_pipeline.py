"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm._shared import written
from foldline.llm.bpe import bpe_encode
from foldline.llm.line_dedup import line_dedup
from foldline.llm.minhash import near_duplicates
from foldline.llm.mixing import mix
from foldline.llm.quality_rules import base_failed, fitted, text_stats, with_posterior
from foldline.llm.queries import documents, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules keep. Null, empty and short texts go; rows that repeat an id are judged each; an empty table stays empty.

    The rules are fitted on all of ``docs``. Their statistics are written once with the documents, for the fit and the verdict.
    """
    judged = written(docs.select(*COLUMNS, text_stats(F.col("text")).alias("stats")), "stats")
    post = fitted(judged.select("stats"))
    return with_posterior(judged, post).where(~base_failed(F.col("stats")) & (F.col("posterior") >= 0.5)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of two lines or more, and of lines of 50 words or more; n_chars is counted anew.

    All rows stay, also those whose text becomes empty; null texts stay null. A null id counts as the smallest.
    """
    out = line_dedup(docs.select(*COLUMNS), run_lines=2, run_words=50)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, by shingles of five words and a similarity of 0.8.

    Texts without words, null ones included, are in no group and stay. Rows that repeat a kept id stay all; rows without an id stay.
    """
    gone = near_duplicates(docs, shingle=5, percent=80, bands=32).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times. Null sources are one source; texts without words may be taken and add nothing."""
    out = mix(docs.select(*COLUMNS), keep=tuple(COLUMNS)).where("times > 0")
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text of the mix, with digests of the ids and of what they decode to; null texts have no ids. One row for each row of ``docs``."""
    out = bpe_encode(docs, vocabulary(), decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("mixing", mixed), ("bpe", encoded)]
#: Expectation-maximisation, sketches, subset sums and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
