"""Mixing sources to target weights by fitting a subset sum to each source's budget.

Sizes are counted by exact length, so a source is a table of (length, documents) however many documents
it has. A source's target is met by whole passes over it, then by a share of every length, and the
words that are left over by a bounded-knapsack dynamic program over the lengths that remain. Which
documents of a length are taken is settled by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm._shared import word_array

#: Parts into which the documents of one source and length are dealt, so that no one task ranks a hot length.
PARTS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, get ``weights`` in turn. They share ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size, and the excess is shared
    again by weight until none is above: the level at which that ends follows from one sorted pass
    over the sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = by.withColumn("weight", turn.cast("double")).withColumn("top", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("top").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("at", (F.sum("source_size").over(whole) * F.lit(float(share)) - filled) / rest)
    free = F.when(F.col("top") > F.col("at") * F.col("weight"), F.struct((F.col("top") / F.col("weight")).alias("r"), "at"))
    line = F.coalesce(F.min(free).over(whole)["at"], F.lit(float("inf")))
    return by.select("source", "source_size", F.least("top", line * F.col("weight")).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their sum comes as near below ``budget`` as can be.

    All but the words of some four of the longest documents are shared out by length in proportion, the longest
    first, each length also taking what the ones before left over. The rest, under five of the longest documents at any
    size of the corpus, is a bounded knapsack over the documents that remain; a smaller budget is one as a whole.
    """
    total = sum(n * k for n, k in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    share = max(0, budget - 4 * lengths[order[0]])
    taken = [0 if lengths[i] else counts[i] * budget // total for i in range(len(lengths))]
    passed = placed = 0
    for i in order:
        passed += counts[i] * lengths[i]
        taken[i] = min(counts[i], (share * passed // total - placed) // lengths[i])
        placed += taken[i] * lengths[i]
    left, items = budget - placed, []
    reach, by = np.zeros(left + 1, bool), np.zeros(left + 1, np.int32)
    reach[0] = True
    for i in order:
        free, part = min(counts[i] - taken[i], left // lengths[i]), 1
        while free > 0 and not reach[left]:
            part = min(part, free)
            size = part * lengths[i]
            new = np.flatnonzero(reach[: left + 1 - size] & ~reach[size:]) + size
            reach[new], by[new] = True, len(items)  # a sum keeps the item that reached it first
            items.append((i, part, size))
            free -= part
            part *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, part, size = items[by[at]]
        taken[i] += part
        at -= size
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // source_size) if source_size else 0
    budget = round(target - passes * source_size)
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": passes, "take": fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), budget)})


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document enters the mix, and its source's target. One row for each input row.

    Returns the id, size (words of the whole text, null 0), source, source_size, target, times, and
    the columns named in ``keep``. Each source's words taken come near its target. Ties of the seeded
    hash are settled by id; rows that repeat an id are ranked one after the other; null ids, sources and texts
    are values like others. ``most`` bounds how often a document is taken. An empty table gives no rows. Of a very long text
    only the number of its words counts. A column in ``keep`` that has the name of a result column is left out. The
    table of sources is sorted in one task: tens of thousands of them are fine, hosts of a crawl are not.
    """
    extra = [c for c in keep if c not in (id_col, source_col, "doc_id", "size", "source", "source_size", "target", "times")]
    key = (F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"))
    row = F.struct(*extra) if extra else F.lit(None)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(word_array(F.col(text_col))).cast("long").alias("size"), row.alias("_row"))
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(word_array(F.col(text_col))).cast("long").alias("size"))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    part = F.pmod(draw, F.lit(PARTS))
    parts = small.groupBy("source", "size", part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(lengths.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    both = lengths.alias("a").join(goal.alias("b"), F.expr("a.source <=> b.source")).select("a.source", "a.size", "a.n", "b.source_size", "b.target")
    plan = both.groupBy("source").applyInPandas(_plan, "source string, size long, passes int, take long")
    run = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    quota = before.alias("p").join(plan.alias("q"), F.expr("p.source <=> q.source AND p.size = q.size")).join(goal.alias("g"), F.expr("p.source <=> g.source")).select(
        "p.source", "p.size", "p._part", "passes", (F.col("take") - F.col("_before")).alias("_quota"), "source_size", "target"
    )
    on = ["_source", "_none", "size", "_part"]
    rank = F.row_number().over(Window.partitionBy(*on).orderBy("_draw", "doc_id"))
    ranked = rows.select("doc_id", "source", "size", *key, part.alias("_part"), draw.alias("_draw"), "_row").withColumn("_rank", rank)
    joined = ranked.join(quota.select(*key, "size", "_part", "passes", "_quota", "source_size", "target"), on)
    times = F.col("passes") + (F.col("_rank") <= F.col("_quota")).cast("int")
    return joined.select("doc_id", "size", "source", "source_size", "target", times.alias("times"), *[F.col("_row")[c].alias(c) for c in extra])
