"""Quality classifier with hierarchical empirical Bayes.

A logistic model of each document's words and bytes gives its own evidence. Grouped sums of that evidence
give every host and every path below it a posterior: sparse hosts shrink towards the global prior, sparse
paths towards their host, each by a strength estimated from how much the groups differ. A document's
posterior adds its path's log-odds, relative to the global ones, to its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm import _packs as P
from foldline.llm._shared import small_batches, written

#: Hashed words of a text, then the shares of its bytes.
_WORDS, _BYTES = 1 << 16, 256
_WIDTH = _WORDS + _BYTES + 2


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples: presence of hashed words, byte shares, share of repeated words, and a constant."""
    words = P.Words(texts, lower=True)
    key = np.unique(words.doc * _WORDS + (words.hash % np.uint64(_WORDS)).astype(np.int64))
    doc, col = key // _WORDS, key % _WORDS
    distinct = np.bincount(doc, minlength=len(texts))
    value = np.ones(len(key))
    size = np.array([len(t) for t in texts])
    byte = np.bincount(np.repeat(np.arange(len(texts)), size) * _BYTES + np.frombuffer(b"".join(texts), np.uint8), minlength=len(texts) * _BYTES).reshape(-1, _BYTES)
    share = byte / np.maximum(1, size)[:, None]
    at = np.nonzero(share)
    every = np.arange(len(texts))
    return (
        np.concatenate([doc, at[0], every, every]),
        np.concatenate([col, _WORDS + at[1], np.full(len(texts), _WIDTH - 2), np.full(len(texts), _WIDTH - 1)]),
        np.concatenate([value, 20 * share[at], 1 - distinct / np.maximum(1, words.count), np.ones(len(texts))]),
    )


def fit_logistic(doc: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 0.02) -> np.ndarray:
    """Weights of a logistic model by full gradient steps with per-weight rates; the same input gives the same weights."""
    w, seen, n = np.zeros(_WIDTH), np.full(_WIDTH, 1e-8), max(1, len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[col] * value, minlength=len(y)), -30, 30)))
        g = np.bincount(col, weights=(p - y)[doc] * value, minlength=_WIDTH) / n + l2 * w / n
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def word_scales(doc: np.ndarray, col: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scale of each feature: for words, their log ratio between good and other documents less two standard errors, not below 0.

    So words that happen to occur in a few documents of one kind count for nothing, and the model does not learn them by heart.
    """
    n, a = np.bincount(col, minlength=_WIDTH), np.bincount(col, weights=y[doc], minlength=_WIDTH)
    good = y.sum()
    ratio = np.log((a + 1) / (good + 2)) - np.log((n - a + 1) / (len(y) - good + 2))
    scale = np.maximum(0, np.abs(ratio) - 2 * np.sqrt(1 / (a + 1) + 1 / (n - a + 1)))
    scale[_WORDS:] = 1
    return scale


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 4096, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1 AND toxic = 0") -> np.ndarray:
    """Weights fitted on at most ``sample`` labelled documents, those with the least hash of their id.

    Only the sample is bounded: its ids are broadcast and its features reach the driver. Labels that are null count as not good.
    """
    small_batches(docs.sparkSession)
    picked = labels.select(F.col(id_col).alias("doc_id"), F.coalesce(F.expr(good), F.lit(False)).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, col, value = _features(P.as_bytes(batch.column("text")))
            order = np.argsort(doc, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[order]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "y": batch.column("y"), "col": lists(col.astype(np.int32)), "value": lists(value)})

    rows = sorted(some.mapInArrow(run, "doc_id long, y int, col array<int>, value array<double>").collect())
    if not rows:
        return np.zeros(_WIDTH)
    doc = np.repeat(np.arange(len(rows)), [len(r["col"]) for r in rows])
    col, value, y = np.concatenate([r["col"] for r in rows]), np.concatenate([r["value"] for r in rows]), np.array([r["y"] for r in rows], float)
    scale = word_scales(doc, col, y)
    return fit_logistic(doc, col, value * scale[col], y) * scale


def evidence(docs: DataFrame, weights: np.ndarray, *, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(doc_id, host, path, evidence): log-odds of each whole text. The weights have a fixed size."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, out = P.as_bytes(batch.column("text")), 0, []
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                    size, to = size + len(texts[to]), to + 1
                doc, col, value = _features(texts[at:to])
                out.append(np.bincount(doc, weights=shared.value[col] * value, minlength=to - at))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(np.concatenate([np.zeros(0), *out]))], names=["doc_id", "host", "path", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, centre: Column) -> Column:
    """Pseudo-count of the prior by the method of moments: the more alike the groups, the stronger."""
    spread = F.sum(F.col("n") * (mean - centre) * (mean - centre)) / F.sum("n")
    inside = F.sum(F.col("n") * centre * (1 - centre)) / F.sum("n")
    noise = F.sum(centre * (1 - centre)) / F.sum("n")
    return F.least(F.greatest(inside / F.greatest(spread - noise, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(10_000.0))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, global_prior, host_posterior, path_posterior) from rows (host, path, evidence)."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    prior = hosts.agg((F.sum("good") / F.sum("n")).alias("m"))
    k = hosts.crossJoin(F.broadcast(prior)).agg(_strength(hosts, F.col("good") / F.col("n"), F.col("m")).alias("k"), F.first("m").alias("m"))
    hosts = hosts.crossJoin(F.broadcast(k)).select("host", F.col("m").alias("global_prior"), ((F.col("good") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k"))).alias("host_posterior"))
    paths = paths.join(hosts, "host")
    k = paths.agg(_strength(paths, F.col("good") / F.col("n"), F.col("host_posterior")).alias("k"))
    return paths.crossJoin(F.broadcast(k)).select("host", "path", "n", "global_prior", "host_posterior", ((F.col("good") + F.col("k") * F.col("host_posterior")) / (F.col("n") + F.col("k"))).alias("path_posterior"))


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = 4096, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Posterior of being good for every document; one row for each input row.

    Returns doc_id, host, path, evidence (log-odds of the text alone), global_prior, host_posterior,
    path_posterior, quality (posterior) and kept (at least one half). Null and empty texts have only the
    model's constant as evidence. Null hosts and paths are groups of their own, named "". Without labels all evidence is 0.
    """
    weights = train(docs, labels, sample=sample, id_col=id_col, text_col=text_col)
    scored = written(evidence(docs, weights, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col), "evidence")
    sites = written(site_posteriors(scored).drop("n"), "sites")
    both = scored.join(sites, ["host", "path"])
    odds = F.col("evidence") + _logit(F.col("path_posterior")) - _logit(F.col("global_prior"))
    out = both.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", "evidence", "global_prior", "host_posterior", "path_posterior", "quality", (F.col("quality") >= 0.5).alias("kept"))
