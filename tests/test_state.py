"""Versioned tables, comparison of runs and run records against plain Python."""

import json
import random
from collections import Counter

import pytest

from foldline.operators import runs
from foldline.sources.versioned import VersionedTable

SCHEMA = "id string, x int, m map<string,int>, seq long, deleted boolean"


def batch(spark, *rows):
    return spark.createDataFrame([(k, x, {"b": 1, "a": x or 0}, s, d) for k, x, s, d in rows], SCHEMA)


def state(table, version=None):
    return {r["id"]: r["x"] for r in table.read(version).collect()}


def test_upserts_in_any_order(spark, tmp_path):
    r = random.Random(1)
    batches = [[(f"k{r.randint(0, 12)}", r.randint(0, 99), r.randint(0, 40), r.random() < 0.3) for _ in range(r.randint(0, 9))] for _ in range(5)]
    batches = [[(k, s * 7, s, s % 3 == 0) for k, _, s, _ in b] for b in batches]  # a state is the same wherever it is told
    best = {}
    for k, x, s, d in (row for b in batches for row in b):
        best[k] = max(best.get(k, (-1,)), (s, d, x))
    want = {k: x for k, (_, d, x) in best.items() if not d}
    for n, order in enumerate([range(5), reversed(range(5)), [2, 2, 0, 4, 1, 3, 0]]):
        table = VersionedTable(spark, f"{tmp_path}/t{n}", "id", buckets=4)
        for k in order:
            table.apply(batch(spark, *batches[k]), f"writer {k}", 0)
        assert state(table) == want and len(table.versions()) == 5


def test_replays_versions_and_readers(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "id", buckets=3)
    with pytest.raises(ValueError):
        table.read()
    assert table.apply(batch(spark, ("a", 1, 1, False), ("b", 2, 1, False), ("b", 3, 2, None)), "w", 0) == 1
    before = table.read()
    assert table.apply(batch(spark, ("a", 9, 5, True), ("c", 4, 1, False)), "w", 1) == 2
    assert table.apply(batch(spark, ("a", 9, 99, False)), "w", 1) == 2  # a replay changes nothing, whatever it holds
    assert table.apply(batch(spark, ("a", 7, 4, False)), "late", 0) == 3  # older than the tombstone
    assert table.apply(batch(spark), "empty", 3) == 4
    assert state(table) == {"b": 3, "c": 4} and state(table, 1) == {"a": 1, "b": 3}
    assert {r["id"]: r["x"] for r in before.collect()} == {"a": 1, "b": 3}  # a reader's version is never changed
    assert {(r["id"], r["_seq"]) for r in table.read(tombstones=True).where("_deleted").collect()} == {("a", 5)}
    (tmp_path / "t/manifests/00000000000000000005.json").write_text('{"version": 5, "bat')  # a writer that died
    assert state(table) == {"b": 3, "c": 4} and table.apply(batch(spark, ("d", 5, 1, False)), "w", 2) == 6
    assert state(table) == {"b": 3, "c": 4, "d": 5}
    with pytest.raises(Exception, match="rows need a key"):
        table.apply(batch(spark, (None, 1, 1, False)), "w", 3)
    with pytest.raises(ValueError):
        table.apply(batch(spark, ("e", 1, 1, False)).drop("m"), "w", 3)
    table.vacuum(keep=1)
    assert state(table) == {"b": 3, "c": 4, "d": 5} and table.read().where("id = 'b'").first()["m"] == {"a": 3, "b": 1}


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second writer finds the version taken and applies its batch to what the first has made."""
    one, two = (VersionedTable(spark, f"{tmp_path}/t", "id", buckets=2) for _ in range(2))
    publish, raced = VersionedTable._publish, []

    def first(self, made):
        if self is one and not raced:
            raced.append(True)
            two.apply(batch(spark, ("b", 2, 1, False)), "two", 0)
        return publish(self, made)

    monkeypatch.setattr(VersionedTable, "_publish", first)
    assert one.apply(batch(spark, ("a", 1, 1, False)), "one", 0) == 2 and state(one) == {"a": 1, "b": 2}


def test_run_diff(spark):
    rows = [(1, "a", {"y": 1, "x": 2}, 0.5), (1, "a", {"x": 2, "y": 1}, 0.5), (2, None, None, None), (None, "b", {}, 1.0)]
    a = spark.createDataFrame(rows, "id int, t string, m map<string,int>, v double")
    same = a.repartition(3).select("v", "m", "t", "id")
    got = {r["name"]: (r["n_first"], r["n_second"], r["same"]) for r in runs.run_diff({"x": a, "y": a, "z": a, "e": a.limit(0)}, {"x": same, "y": a.dropDuplicates(["id"]), "e": a.limit(0), "w": a}).collect()}
    assert got == {"x": (4, 4, True), "y": (4, 3, False), "z": (4, None, False), "w": (None, 4, False), "e": (0, 0, True)}
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b")], "id int, t string")
    once = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (1, "a")], "id int, t string")
    assert not runs.run_diff({"x": twice}, {"x": once}).first()["same"]
    changed = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (3, "d")], "id int, t string")
    assert {(r["id"], r["change"]) for r in runs.row_diff(twice, changed, "id").collect()} == {(1, "removed"), (2, "changed"), (3, "added")}


def test_run_record(spark, tmp_path):
    r = random.Random(6)
    pages = [(f"r{r.randint(0, 2)}", r.choice(["ok", "ok", "empty", "error", "timeout", None]), r.choice([None, r.randint(0, 5000) / 1000]), r.choice([None, "", " \n", "A repeated line\nshort\nother %d line" % r.randint(0, 3)])) for _ in range(120)]
    chunks = [(f"r{r.randint(0, 2)}", "x" * r.randint(0, 50)) for _ in range(90)]
    p, c = spark.createDataFrame(pages, "run_id string, status string, seconds double, text string"), spark.createDataFrame(chunks, "run_id string, text string")
    whole = {x["run_id"]: x for x in runs.run_record(runs.run_parts(p, c)).collect()}
    table = VersionedTable(spark, f"{tmp_path}/parts", "part", buckets=4)
    for k in (0, 1, 1, 2):  # the second batch of the stream comes twice
        mine = lambda rows, schema, k=k: spark.createDataFrame(rows[k::3], schema)
        runs.stream_record(spark, table, mine(pages, "run_id string, status string, seconds double, text string"), mine(chunks, "run_id string, text string"), k)
    streamed = {x["run_id"]: x for x in runs.run_record(table.read()).collect()}
    assert json.dumps({k: v.asDict(True) for k, v in whole.items()}, sort_keys=True) == json.dumps({k: v.asDict(True) for k, v in streamed.items()}, sort_keys=True)
    at = lambda xs, q: sorted(xs)[round((len(xs) - 1) * q / 100)]
    for run, got in whole.items():
        mine = [x for x in pages if x[0] == run]
        lines = [y for x in mine for y in (z.strip().lower() for z in (x[3] or "").split("\n")) if len(y) >= 8]
        times = [x[2] for x in mine if x[2] is not None]
        sizes = [len(x[1]) for x in chunks if x[0] == run]
        assert got["pages"] == len(mine) and got["failures"] == sum(x[1] in (None, "error", "timeout") for x in mine) and got["chunk_count"] == len(sizes)
        assert got["seconds"] == pytest.approx(sum(times)) and got["seconds_per_page"] == pytest.approx(sum(times) / len(times)) and got["p95_seconds_per_page"] == at(times, 95)
        assert got["duplicate_line_rate"] == pytest.approx(sum(n - 1 for n in Counter(lines).values()) / len(lines)) and (got["char_length_p50"], got["char_length_p90"]) == (at(sizes, 50), at(sizes, 90))
        assert got["non_empty_content_rate"] == pytest.approx(sum(bool((x[3] or "").strip()) for x in mine) / len(mine)) and not got["gates"]["reliable"]
    assert runs.run_record(runs.run_parts(p.limit(0), c.limit(0))).count() == 0
