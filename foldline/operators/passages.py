"""Passages: neighbours, context within a budget, overlaps, length percentiles, changes between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(passages: DataFrame) -> DataFrame:
    """Passages (doc_id, section, passage, passage_id) with prev_id and next_id in their section."""
    at = Window.partitionBy("doc_id", "section").orderBy("passage")
    return passages.withColumn("prev_id", F.lag("passage_id").over(at)).withColumn("next_id", F.lead("passage_id").over(at))


def context_budget(passages: DataFrame, budget: int, per_section: int) -> DataFrame:
    """Passages (doc_id, section, passage, n_tokens, score) that fit: the best ``per_section`` of each section, then by score while the sum stays within ``budget``.

    Ties go to the earlier passage. context_no numbers what is left of a document in reading order. Once a passage goes
    over the budget, all after it do. Both windows share the partitioning by doc_id.
    """
    best = Window.partitionBy("doc_id", "section").orderBy(F.desc("score"), "passage")
    taken = Window.partitionBy("doc_id").orderBy(F.desc("score"), "section", "passage").rowsBetween(Window.unboundedPreceding, 0)
    read = Window.partitionBy("doc_id").orderBy("section", "passage")
    rows = passages.repartition("doc_id").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_section)
    rows = rows.withColumn("_sum", F.sum("n_tokens").over(taken)).where(F.col("_sum") <= budget).drop("_n", "_sum")
    return rows.withColumn("context_no", F.row_number().over(read))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Pairs of spans that share characters: ``keys``, a, b (ids) and n_shared, from rows of keys, id, start, end.

    Spans are dealt to bins of ``width`` characters, so that a very long text is many small joins. A pair is reported in
    the bin where the later of the two begins, hence once. Empty spans share nothing.
    """
    def dealt(rows: DataFrame, name: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return rows.where(F.col("end") > F.col("start")).select(*keys, F.col("id").alias(name), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.explode(bins).alias("_bin"))

    both = dealt(left, "a").join(dealt(right, "b"), [*keys, "_bin"])
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return both.where((start < end) & (F.floor(start / width) == F.col("_bin"))).select(*keys, "a", "b", (end - start).alias("n_shared"))


def length_percentiles(rows: DataFrame, length: Column, percents: list[int], *keys: str) -> DataFrame:
    """(keys, n, p50, p90, ...): the length at rank round((n - 1) * percent / 100), half to even.

    Rows are counted by length first, so a window runs over distinct lengths only, however many rows a key has.
    """
    counts = rows.select(*keys, length.cast("long").alias("_length")).where("_length IS NOT NULL").groupBy(*keys, "_length").agg(F.count(F.lit(1)).alias("_k"))
    key = Window.partitionBy(*keys)
    ranked = counts.withColumn("n", F.sum("_k").over(key)).withColumn("_to", F.sum("_k").over(key.orderBy("_length").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.min(F.when(F.col("_to") > F.bround((F.col("n") - 1) * p / F.lit(100.0)), F.col("_length"))).cast("double").alias(f"p{p}")
    return ranked.groupBy(*keys, "n").agg(*map(at, percents))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged from one snapshot to the next; what an upsert with tombstones applies. Keys are unique."""
    digest = F.sha2(F.coalesce(F.col(value).cast("string"), F.lit("")), 256)
    a = old.select(key, digest.alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(key, digest.alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank) at ``k`` from ranked (query_id, doc_id, rank) and relevant (query_id, doc_id), each pair once; queries without relevant rows have none."""
    hits = relevant.join(ranked.where(F.col("rank") <= k), ["query_id", "doc_id"], "left")
    found = hits.groupBy("query_id").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), F.min("rank").alias("_first"))
    return found.select("query_id", "recall", F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"))


def drop_overlapping(passages: DataFrame, width: int = 4096) -> DataFrame:
    """Passages (doc_id, id, start, end, score) of which none shares characters with a better one of the document; ties go to the smaller id.

    A passage goes even where the better one goes too. Overlaps are found by ``overlaps``, in bins of ``width`` characters.
    """
    spans = passages.select("doc_id", "id", "start", "end")
    scores = passages.select("doc_id", F.col("id").alias("_id"), F.col("score").alias("_score"))
    pairs = overlaps(spans, spans, ["doc_id"], width).where("a <> b")
    pairs = pairs.join(scores.toDF("doc_id", "a", "_a"), ["doc_id", "a"]).join(scores.toDF("doc_id", "b", "_b"), ["doc_id", "b"])
    worse = pairs.where((F.col("_a") < F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("a") > F.col("b")))).select("doc_id", F.col("a").alias("id")).distinct()
    return passages.join(worse, ["doc_id", "id"], "left_anti")


def ranking_gain(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): discounted gain at ``k`` of ranked (query_id, doc_id, rank), each relevant (query_id, doc_id) worth one, as a share of the best that is possible."""
    gain = lambda rank: 1 / F.log2(rank + 1)
    hits = relevant.join(ranked.where(F.col("rank") <= k), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.coalesce(F.sum(gain(F.col("rank"))), F.lit(0.0)).alias("_gain"), F.count(F.lit(1)).alias("_n"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + gain(i))
    return hits.select("query_id", (F.col("_gain") / best).alias("ndcg"))


def evidence_coverage(gold: DataFrame, retrieved: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """(keys, coverage): the share of the gold spans (keys, id, start, end) that share characters with a retrieved one."""
    hit = overlaps(gold, retrieved, keys, width).select(*keys, F.col("a").alias("id")).distinct().withColumn("_hit", F.lit(1))
    return gold.join(hit, [*keys, "id"], "left").groupBy(*keys).agg((F.count("_hit") / F.count(F.lit(1))).alias("coverage"))


def churn_rates(changes: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, added, removed, changed, unchanged): shares of the changes of ``snapshot_changes``."""
    share = lambda x: F.avg((F.col("change") == x).cast("int")).alias(x)
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *map(share, ("added", "removed", "changed", "unchanged")))


def segment_lineage(old: DataFrame, new: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """(keys, id, successor, n_shared): for each old segment (keys, id, start, end) the new one that shares most characters, ties to the smaller id; null where none does."""
    best = F.max(F.struct("n_shared", F.negative("b").alias("b")))
    found = overlaps(old, new, keys, width).groupBy(*keys, F.col("a").alias("id")).agg(best.alias("_best"))
    return old.select(*keys, "id").join(found, [*keys, "id"], "left").select(*keys, "id", F.negative("_best.b").alias("successor"), F.col("_best.n_shared").alias("n_shared"))
