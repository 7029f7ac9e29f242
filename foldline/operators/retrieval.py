"""Bag-of-words cosine retrieval over a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.functions.text import terms


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): counts of each term in each document."""
    return docs.select(F.col(id_col), F.explode(terms(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_norms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm): Euclidean norm of the term counts; documents without terms are absent."""
    return term_counts(docs, id_col, text_col).groupBy(id_col).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("norm"))


def cosine_scores(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of every document against ``query``; documents or queries without terms score 0.

    Works on the term array of each row, so nothing is shuffled.
    """
    q: dict[str, int] = {}
    for t in _ascii_terms(query):
        q[t] = q.get(t, 0) + 1
    tokens = terms(F.coalesce(F.col(text_col), F.lit("")))
    counts = F.create_map(*[F.lit(x) for t, n in sorted(q.items()) for x in (t, n)]) if q else F.create_map().cast("map<string,int>")
    dot = F.aggregate("_terms", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.try_element_at(counts, t), F.lit(0)))
    ordered = F.sort_array("_terms")
    runs = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("squares")),
        lambda a, x: F.when(a["last"] == x, F.struct(x.alias("last"), (a["n"] + 1).alias("n"), a["squares"].alias("squares"))).otherwise(
            F.struct(x.alias("last"), F.lit(1).cast("long").alias("n"), (a["squares"] + a["n"] * a["n"]).alias("squares"))
        ),
        lambda a: F.sqrt((a["squares"] + a["n"] * a["n"]).cast("double")),
    )
    norm = sum(n * n for n in q.values()) ** 0.5
    scored = docs.select(F.col(id_col), tokens.alias("_terms")).select(id_col, dot.cast("double").alias("dot"), runs.alias("norm"))
    return scored.select(id_col, F.when((F.col("norm") == 0) | F.lit(norm == 0), F.lit(0.0)).otherwise(F.col("dot") / (F.col("norm") * F.lit(norm or 1.0))).alias("score"))


def top_k(docs: DataFrame, query: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """The ``k`` best documents, ties by id. ``k`` must be positive."""
    if k <= 0:
        raise ValueError("k must be positive")
    return cosine_scores(docs, query, id_col, text_col).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def _ascii_terms(text: str) -> list[str]:
    import re

    return [t.lower() for t in re.findall("[a-zA-Z0-9]+", text)]
