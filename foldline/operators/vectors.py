"""Nearest vectors by cosine: an index of inverted lists, probed and reranked exactly.

Centroids are fitted on a bounded sample; every row is indexed in the list of its nearest one. A query asks the lists whose centroids are nearest to it. Rows and queries
of a list meet in blocks of bounded size, so a list with a third of all rows, or one that all queries probe, is many small
products of matrices and never one task. Scores are exact (double precision, rounded to 6 digits), ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.sources.tables import kept

#: Rows and queries of one block.
ROWS, QUERIES = 8192, 512
DIGITS = 6


class Index(NamedTuple):
    """``rows``: id, v (unit vector), list, near (cosine to its centroid). ``centroids``: unit vectors, one for each list. ``reach``: the greatest angle in each list."""

    rows: DataFrame
    centroids: np.ndarray
    reach: np.ndarray


def unit(vector: Column) -> Column:
    """Column: ``vector`` in double precision with length 1; null where it is null, without direction, or holds a null."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n))), F.lit(0))  # the norm once for each row


def directed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): unit vectors; rows without id or direction go."""
    return vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _order(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lists by distance for each row, ties to the smaller number."""
    return np.argsort(-np.round(v @ centroids.T, 12), axis=1, kind="stable")


def build_index(vectors: DataFrame, id_col: str, vector_col: str, *, lists: int | None = None, sample: int = 16384, most_lists: int = 1024, rounds: int = 8) -> Index:
    """Index all rows of ``vectors`` that have a direction.

    Centroids come from the ``sample`` rows of least hash (k-means by cosine, at most ``rounds`` rounds). There are ``lists`` of them, by default the square root of the number of rows, and no more than
    ``most_lists`` or half the sample. Vectors of another length than most of the sample are left out, since no cosine is defined.
    """
    rows = kept(directed(vectors, id_col, vector_col), "directed")
    picked = kept(rows.orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    dims = picked.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return Index(kept(rows.select("id", "v", F.lit(0).alias("list"), F.lit(1.0).alias("near")), "index"), np.zeros((0, 0)), np.zeros(0))
    d = dims["d"]
    whole = rows.where(F.size("v") == d)
    k = max(1, min(lists or int(whole.count() ** 0.5), most_lists, dims["count"] // 2))
    if k > 1:
        fitted = KMeans(k=k, seed=17, maxIter=rounds, distanceMeasure="cosine", featuresCol="f").fit(picked.where(F.size("v") == d).select(array_to_vector("v").alias("f")))
        centroids = np.array(fitted.clusterCenters())
        size = np.linalg.norm(centroids, axis=1, keepdims=True)
        centroids = (centroids / np.where(size > 0, size, 1))[size[:, 0] > 0]
    else:
        centroids = np.array([picked.where(F.size("v") == d).first()["v"]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.round(_matrix(batch.column(1), d) @ centroids.T, 12)
            of = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32()), pa.array(near[np.arange(len(of)), of], pa.float64())], names=["id", "v", "list", "near"])

    kind = whole.schema["id"].dataType.simpleString()
    indexed = kept(whole.mapInArrow(assign, f"id {kind}, v array<double>, list int, near double"), "index")
    reach = np.full(len(centroids), -1.0)  # no more than most_lists rows come back
    for r in indexed.groupBy("list").agg(F.min("near").alias("least")).collect():
        reach[r["list"]] = np.arccos(np.clip(r["least"], -1, 1)) + 1e-6
    return Index(indexed, centroids, reach)


def _probing(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """(query_id, v, list) for the ``probes`` nearest lists that hold rows."""
    centroids, there = index.centroids, np.flatnonzero(index.reach >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = there[_order(_matrix(batch.column(1), centroids.shape[1]), centroids[there])[:, :probes]]
            at = np.repeat(np.arange(batch.num_rows), order.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(order.ravel(), pa.int32())], names=["query_id", "v", "list"])

    return queries.mapInArrow(run, f"{_query_type(queries)}, v array<double>, list int")


def _query_type(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}"


def _unruled(queries: DataFrame, index: Index, probes: int, slack: float) -> DataFrame:
    """(query_id, v, list) for the lists beyond the first ``probes`` that could hold a row as good as ``floor``, by the angle to the centroid less the reach of the list."""
    centroids, reach, there = index.centroids, index.reach, np.flatnonzero(index.reach >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, floor = _matrix(batch.column(1), centroids.shape[1]), batch.column(2).to_numpy(zero_copy_only=False)
            order = _order(v, centroids[there])[:, probes:]
            angle = np.arccos(np.clip(v @ centroids[there].T, -1, 1)) - reach[there]
            best = np.cos(np.clip(angle, 0, np.pi))
            far = np.take_along_axis(best, order, axis=1) >= floor[:, None] - slack
            at, k = np.nonzero(far)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(there[order[at, k]], pa.int32())], names=["query_id", "v", "list"])

    return queries.mapInArrow(run, f"{_query_type(queries)}, v array<double>, list int")


def search_lists(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, list, id, score): the ``k`` best rows (id, v, list) of each block of each list that a query (query_id, v, list) asks; a superset of the best of the lists.

    A list of n rows and q queries is ceil(n / ROWS) times ceil(q / QUERIES) blocks.
    """
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("_rows"))
    wants = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_asked"))
    plan = kept(sizes.join(wants, "list"), "plan")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.select("id", "v", "list").join(plan, "list").select("list", "id", "v", F.pmod(F.xxhash64("id"), F.col("_rows")).cast("int").alias("_r"), each("_asked").alias("_q"))
    left = asked.join(plan, "list").select("list", "query_id", "v", F.pmod(F.xxhash64("query_id"), F.col("_asked")).cast("int").alias("_q"), each("_rows").alias("_r"))
    names = ["query_id", "list", "id", "score"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], a["query_id"].type), pa.array([], a["list"].type), pa.array([], b["id"].type), pa.array([], pa.float64())], names=names)
        b = b.sort_by("id")
        dims = len(a["v"][0])
        score = np.round(_matrix(a["v"], dims) @ _matrix(b["v"], dims).T, DIGITS)
        least = np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -np.inf)
        q, at = np.nonzero(score >= least[:, None])  # in the order of ids, ties included
        best = np.lexsort((at, -score[q, at], q))
        nth = np.arange(len(best)) - np.searchsorted(q[best], q[best])
        best = best[nth < k]
        q, at = q[best], at[best]
        return pa.table([a["query_id"].take(pa.array(q)), a["list"].take(pa.array(q)), b["id"].take(pa.array(at)), pa.array(score[q, at] + 0.0, pa.float64())], names=names)

    schema = f"{_query_type(asked)}, list {asked.schema['list'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    return left.groupBy("list", "_r", "_q").cogroup(right.groupBy("list", "_r", "_q")).applyInArrow(meet, schema)


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    at = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def as_queries(queries: DataFrame, index: Index, id_col: str, vector_col: str) -> DataFrame:
    rows = directed(queries, id_col, vector_col).withColumnRenamed("id", "query_id")
    return kept(rows.where(F.size("v") == index.centroids.shape[1]), "queries")


def tuned_probes(queries: DataFrame, index: Index, k: int, *, target: float = 0.95, sample: int = 64, id_col: str = "query_id", vector_col: str = "v") -> int:
    """The least number of probed lists that finds ``target`` of the ``k`` nearest rows, measured by an exact search for the ``sample`` queries of least hash."""
    some = as_queries(queries, index, id_col, vector_col)
    some = kept(some.orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "tuning")
    every = int((index.reach >= 0).sum())
    if not every:
        return 1
    truth = _best(search_lists(_probing(some, index, every), index.rows, k), k)
    centroids, there = index.centroids, np.flatnonzero(index.reach >= 0)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.argsort(_order(_matrix(batch.column(0), centroids.shape[1]), centroids[there]), axis=1)
            of = np.searchsorted(there, batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(rank[np.arange(len(of)), of] + 1, pa.int64())], names=["n"])

    needed = sorted(r["n"] for r in truth.join(some, "query_id").select("v", "list").mapInArrow(places, "n long").collect())  # sample times k numbers
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1


def nearest(queries: DataFrame, index: Index, k: int = 10, *, probes: int = 8, exact: bool = False, id_col: str = "query_id", vector_col: str = "v") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` indexed rows with the greatest cosine to each query, as far as its ``probes`` nearest lists hold them.

    With ``exact``, lists that could still hold a better row are asked too: all but those whose centroid is farther from the query than the ``k``-th
    best of the first lists by more than their reach. Vectors without structure leave few lists out. Queries without
    direction, or of another length than the index, have no rows.
    """
    asked = as_queries(queries, index, id_col, vector_col)
    if not len(index.centroids):
        return asked.join(index.rows, F.lit(False)).select("query_id", "id", F.col("near").alias("score"), F.lit(1).alias("rank"))
    first = kept(search_lists(_probing(asked, index, probes), index.rows, k), "found")
    if exact:
        floors = _best(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        floor = F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(-2.0))
        rest = asked.join(floors, "query_id", "left").select("query_id", "v", floor.alias("floor"))
        first = first.unionByName(kept(search_lists(kept(_unruled(rest, index, probes, 3 * 10.0**-DIGITS), "unruled"), index.rows, k), "more"))
    return _best(first.drop("list"), k)


def section_vectors(passages: DataFrame, *keys: str, vector_col: str = "embedding") -> DataFrame:
    """(keys, v): the mean direction of the passages of each section, by a partial aggregation; sections without any are absent."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = passages.select(*keys, unit(F.col(vector_col)).alias("_u")).where("_u IS NOT NULL")
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("_u"))).alias("v"))


def expand_hits(hits: DataFrame, passages: DataFrame, reach: int = 1) -> DataFrame:
    """(query_id, doc_id, section, passage, id, n_tokens, score, distance): hits (query_id, id, score) with the ``reach`` passages before and after them in their section.

    ``passages`` has doc_id, section, passage (numbered without gaps), id, n_tokens. A passage that several hits lead to
    takes the nearest one, then the best. Hits look up their places, and places are looked up by key; no section is gathered.
    """
    places = passages.select("doc_id", "section", "passage", "id")
    found = hits.select("query_id", "id", "score").join(places, "id").drop("id")
    around = found.withColumn("_by", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("passage", F.col("passage") + F.col("_by"))
    best = around.groupBy("query_id", "doc_id", "section", "passage").agg(F.min(F.struct(F.abs("_by").alias("distance"), F.negative("score").alias("worse"))).alias("_best"))
    there = best.join(passages.select("doc_id", "section", "passage", "id", "n_tokens"), ["doc_id", "section", "passage"])
    return there.select("query_id", "doc_id", "section", "passage", "id", "n_tokens", F.negative("_best.worse").alias("score"), F.col("_best.distance").cast("long").alias("distance"))


def context(expanded: DataFrame, budget: int, per_section: int | None = None) -> DataFrame:
    """``expanded`` with context_no: what fits ``budget`` tokens a query, best first (hits before neighbours), numbered in reading order (doc_id, section, passage).

    Once a passage goes over the budget, all after it do. ``per_section`` keeps the best of a section only.
    """
    order = ("distance", F.desc("score"), "doc_id", "section", "passage")
    rows = expanded
    if per_section is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id", "section").orderBy(*order))).where(F.col("_n") <= per_section).drop("_n")
    taken = Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fit = rows.withColumn("_sum", F.sum("n_tokens").over(taken)).where(F.col("_sum") <= budget).drop("_sum")
    return fit.withColumn("context_no", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "section", "passage")).cast("long"))


def retrieve_passages(queries: DataFrame, index: Index, passages: DataFrame, *, k: int = 10, reach: int = 1, budget: int = 900, probes: int = 8, exact: bool = False) -> DataFrame:
    """Passage first: the nearest ``k`` passages of each query, widened to their neighbours, within ``budget`` tokens, in reading order."""
    return context(expand_hits(nearest(queries, index, k, probes=probes, exact=exact), passages, reach), budget)


def retrieve_sections(queries: DataFrame, sections: Index, index: Index, passages: DataFrame, *, k: int = 3, per_section: int = 3, budget: int = 900, probes: int = 8, exact: bool = False) -> DataFrame:
    """Section first: the nearest ``k`` sections of each query, the best ``per_section`` passages inside each, within ``budget`` tokens, in reading order.

    ``sections`` indexes ``section_key`` of doc_id and section. Inside a section, passages are compared in the same bounded blocks as lists are.
    """
    chosen = kept(nearest(queries, sections, k, probes=probes, exact=exact).select("query_id", F.col("id").alias("list")), "chosen")
    asked = as_queries(queries, index, "query_id", "v").join(chosen, "query_id")
    places = passages.select("doc_id", "section", "passage", "id", "n_tokens")
    inside = index.rows.select("id", "v").join(places.select("id", section_key(F.col("doc_id"), F.col("section")).alias("list")), "id").join(chosen.select("list").distinct(), "list", "left_semi")
    found = search_lists(asked.select("query_id", "v", "list"), inside.select("id", "v", "list"), per_section)
    best = _best(found, per_section, "list").join(places, "id").select("query_id", "doc_id", "section", "passage", "id", "n_tokens", "score", F.lit(0).cast("long").alias("distance"))
    return context(best, budget)


def section_key(doc_id: Column, section: Column) -> Column:
    """Column: one id for a section of a document."""
    return F.concat_ws("/", doc_id.cast("string"), section.cast("string"))
