"""Nearest vectors and both retrieval patterns against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.operators import vectors

K = 5


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(300, 16)), r.normal(size=(300, 16)) * 0.1 + r.normal(size=16), np.tile(r.normal(size=16), (250, 1))])  # spread, one cluster, one vector many times
    out = [(k, [float(np.float32(v)) for v in row], "label") for k, row in enumerate(x)]
    odd = [(1000, None, "a"), (1001, [0.0] * 16, "b"), (1002, [1.0, 2.0], "c"), (None, [1.0] * 16, "d"), (1003, [float("nan")] * 16, "e")]
    return spark.createDataFrame([*out, *odd], "vec_id long, embedding array<float>, v string").cache(), {k: np.array(v) / np.linalg.norm(v) for k, v, _ in out}


def truth(units, q, k=K):
    ids = np.array(sorted(units))
    s = np.round(np.array([units[i] for i in ids]) @ units[q], 6)
    best = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), float(s[i])) for i in best]


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def asked(rows):
    return rows[0].where("vec_id % 20 = 0 OR vec_id IS NULL OR vec_id > 999").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


def test_exact(rows, asked):
    df, units = rows
    index = vectors.build_index(df, "vec_id", "embedding", lists=12)
    assert index.rows.count() == 850 and 1 < len(index.centroids) <= 12
    got = answers(vectors.nearest(asked, index, K, probes=1, exact=True))
    assert got == {q: truth(units, q) for q in range(0, 850, 20)}


def test_blocks_change_nothing(rows, asked, monkeypatch):
    df, units = rows
    monkeypatch.setattr(vectors, "ROWS", 40)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    index = vectors.build_index(df, "vec_id", "embedding", lists=4)
    assert answers(vectors.nearest(asked, index, K, exact=True)) == {q: truth(units, q) for q in range(0, 850, 20)}


def test_tuned_recall(rows, asked):
    df, units = rows
    index = vectors.build_index(df, "vec_id", "embedding", lists=16)
    probes = vectors.tuned_probes(asked, index, K, target=0.95)
    assert 1 <= probes <= 16
    got = answers(vectors.nearest(asked, index, K, probes=probes))
    hits = sum(len({i for i, _ in truth(units, q)} & {i for i, _ in got[q]}) for q in range(0, 850, 20))
    assert hits / (43 * K) >= 0.9


def test_small_tables(spark, rows, asked):
    df, _ = rows
    empty = vectors.build_index(df.limit(0), "vec_id", "embedding")
    assert vectors.nearest(asked, empty, K).count() == 0 and vectors.tuned_probes(asked, empty, K) == 1
    one = vectors.build_index(df.where("vec_id = 7"), "vec_id", "embedding")
    assert {(r["id"], r["rank"]) for r in vectors.nearest(asked, one, K, exact=True).collect()} == {(7, 1)}
    assert vectors.nearest(asked.limit(0), one, K).count() == 0


def places(df):
    n = F.col("vec_id")
    return df.where("vec_id < 850").select(F.floor(n / 50).alias("doc_id"), F.floor(n % 50 / 10).alias("section"), (n % 10).alias("passage"), n.alias("id"), (n % 7 + 3).alias("n_tokens"), "embedding")


def fit(found, budget):
    """found: (distance, -score, id) in order of worth."""
    total, out = 0, []
    for distance, worse, i in sorted(found):
        total += i % 7 + 3
        if total > budget:
            break
        out.append(i)
    return sorted(out)


def test_passages_first(rows, asked):
    df, units = rows
    index = vectors.build_index(df, "vec_id", "embedding", lists=8)
    got = {}
    for r in vectors.retrieve_passages(asked, index, places(df), k=4, reach=2, budget=45, exact=True).orderBy("query_id", "context_no").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(0, 850, 20):
        best = {}
        for i, s in truth(units, q, 4):
            for d in range(-2, 3):
                if (i + d) // 10 == i // 10 and i + d < 850:
                    best[i + d] = min(best.get(i + d, (9, 9.0)), (abs(d), -s))
        assert got[q] == fit([(*v, i) for i, v in best.items()], 45)


def test_sections_first(rows, asked):
    df, units = rows
    at = places(df)
    means = vectors.section_vectors(at, "doc_id", "section").select(vectors.section_key(F.col("doc_id"), F.col("section")).alias("id"), "v")
    sections = {f"{k // 5}/{k % 5}": np.mean([units[i] for i in range(10 * k, 10 * k + 10)], axis=0) for k in range(85)}
    sections = {k: v / np.linalg.norm(v) for k, v in sections.items()}
    index = vectors.build_index(df, "vec_id", "embedding", lists=8)
    got = {}
    for r in vectors.retrieve_sections(asked, vectors.build_index(means, "id", "v", lists=5), index, at, k=3, per_section=4, budget=50, exact=True).orderBy("query_id", "context_no").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(0, 850, 20):
        chosen = sorted((-round(float(v @ units[q]), 6), k) for k, v in sections.items())[:3]
        found = []
        for _, key in chosen:
            k = int(key.split("/")[0]) * 5 + int(key.split("/")[1])
            inside = sorted((-round(float(units[i] @ units[q]), 6), i) for i in range(10 * k, 10 * k + 10))[:4]
            found += [(0, s, i) for s, i in inside]
        assert got[q] == fit(found, 50)
