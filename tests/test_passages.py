import hashlib
import json

from pyspark.sql import functions as F

from foldline.operators import adapters, candidates, code, passages, structure
from foldline.sources import sinks


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()[:32]


def test_anchors(spark):
    text = "before\n\n# A\n\none\n\n- two\n\n## B\n\n## B\n\nthree\n\n## B\n\n# A\n\n## B\n\n#  # \n"
    found = structure.anchored(structure.blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"))).orderBy("block_idx").collect()
    assert [r["section_path"] for r in found if r["type"] == "heading"] == ["A", "A>B", "A>B_0", "A>B_1", "A_0", "A_0>B", "#"]
    rest = [(r["section_path"], r["ordinal"], r["type"], r["pass_anchor"]) for r in found if r["type"] != "heading"]
    assert [x[:3] for x in rest] == [("root", 0, "para"), ("A", 0, "para"), ("A", 1, "list"), ("A>B_0", 0, "para")]
    assert [x[3] for x in rest] == [digest(digest("1" + p) + t + str(n)) for p, n, t, _ in rest]
    blocks = structure.blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    sections = structure.section_anchors(structure.anchored(blocks)).orderBy("first_idx").collect()
    assert [r["section_path"] for r in sections] == ["root", "A", "A>B", "A>B_0", "A>B_1", "A_0", "A_0>B", "#"]
    assert structure.anchored(blocks.limit(0)).count() == 0


def test_fence_code(spark):
    rows = [(1, "text\nmore\n\nconst x = {};\n    y();\n\n  ```\nlet a = {b: 1};\n\n  z();\n```\nlast"), (2, ""), (3, None), (4, "const f = (a) => { g(a); };")]
    got = {r["doc_id"]: (r["text"], r["n_fenced"]) for r in code.fence_code(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {
        1: ("text\nmore\n\n```javascript\nconst x = {};\n    y();\n```\n\n  ```\nlet a = {b: 1};\n\n  z();\n```\nlast", 1),
        2: ("", 0), 4: ("```javascript\nconst f = (a) => { g(a); };\n```", 1),
    }


def test_overlaps_across_bins(spark):
    spans = lambda rows: spark.createDataFrame(rows, "doc_id int, id int, start int, end int")
    left, right = [(1, 0, 0, 25), (1, 1, 30, 30), (2, 2, 5, 6)], [(1, 0, 9, 11), (1, 1, 24, 90), (1, 2, 25, 26), (2, 3, 0, 40)]
    want = {(d, a, b, min(e, f) - max(s, t)) for d, a, s, e in left for x, b, t, f in right if d == x and s < e and t < f and max(s, t) < min(e, f)}
    for width in (3, 10, 4096):
        got = [tuple(r) for r in passages.overlaps(spans(left), spans(right), ["doc_id"], width).collect()]
        assert len(got) == len(want) and set(got) == want
    assert passages.overlaps(spans([]), spans(right), ["doc_id"]).count() == 0


def test_context_and_neighbours(spark):
    rows = [(1, 0, 0, "a", 5, 0.5), (1, 0, 1, "b", 5, 0.9), (1, 0, 2, "c", 5, 0.7), (1, 1, 3, "d", 5, 0.8), (1, 1, 4, "e", 50, 0.1)]
    found = spark.createDataFrame(rows, "doc_id int, section int, passage int, passage_id string, n_tokens int, score double")
    assert [(r["passage_id"], r["context_no"]) for r in passages.context_budget(found, 15, 2).orderBy("context_no").collect()] == [("b", 1), ("c", 2), ("d", 3)]
    assert [r["passage_id"] for r in passages.context_budget(found, 10, 2).orderBy("context_no").collect()] == ["b", "d"]
    assert {r["passage_id"]: (r["prev_id"], r["next_id"]) for r in passages.neighbours(found).collect()} == {"a": (None, "b"), "b": ("a", "c"), "c": ("b", None), "d": (None, "e"), "e": ("d", None)}


def test_percentiles_changes_ranking(spark):
    lengths = [3, 1, 2, 2, 9, 4]
    got = passages.length_percentiles(spark.createDataFrame([(0, x) for x in lengths] + [(1, None)], "k int, n int"), F.col("n"), [0, 50, 90, 100], "k").collect()
    at = lambda p: float(sorted(lengths)[round((len(lengths) - 1) * p / 100)])
    assert [tuple(r) for r in got] == [(0, 6, at(0), at(50), at(90), at(100))]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    changes = passages.snapshot_changes(docs([(1, "a"), (2, "b"), (3, None)]), docs([(2, "c"), (3, None), (4, "d")]), "doc_id", "text")
    assert dict(map(tuple, changes.collect())) == {1: "removed", 2: "changed", 3: "unchanged", 4: "added"}
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (2, 99)], "query_id int, doc_id int")
    assert {tuple(r) for r in passages.ranking_metrics(ranked, relevant, 2).collect()} == {(1, 0.5, 0.5), (2, 0.0, 0.0)}


def test_payloads(spark):
    tree = {"children": [{"children": [{"block_type": "SectionHeader", "html": "<h1>T &amp; U</h1>", "bbox": [1, 2]}, {"block_type": "Text", "html": " "}]}, {"page": 7, "children": [{"block_type": "Picture", "id": "p"}, {"type": "Table", "text": ""}]}]}
    flat = {"blocks": [{"id": "/page/3/x/1", "block_type": "Odd", "raw_text": "a<br>b"}, {"id": "y", "text": "c"}, {"page": 2, "text": "d", "type": "Code"}]}
    rows = [(1, json.dumps(tree)), (2, json.dumps(flat)), (3, "{"), (4, None)]
    got = {tuple(r) for r in adapters.payload_blocks(spark.createDataFrame(rows, "doc_id int, payload string")).collect()}
    assert got == {
        (1, 0, 0, "marker_p0_b0", "heading", "T & U", True, None), (1, 7, 0, "p", None, "", False, "image"), (1, 7, 1, "marker_p7_b1", "table", "", False, "table_render"),
        (2, 2, 0, "/page/3/x/1", "unknown", "a\nb", False, None), (2, 0, 0, "y", "unknown", "c", False, None), (2, 2, 1, "marker_p2_b1", "code", "d", False, None),
    }


def test_sinks_and_log(spark, tmp_path):
    found = spark.createDataFrame([("r1", 2, None), ("r1", 1, "x"), ("r2", 3, "y")], "run_id string, b int, a string")
    for _ in range(2):
        sinks.write_json_lines(found, str(tmp_path / "out"), ["run_id"])
    sinks.write_json_lines(found.where("run_id = 'r2'"), str(tmp_path / "out"), ["run_id"])
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert {(r["run_id"], r["value"]) for r in lines} == {("r1", '{"a":null,"b":2}'), ("r1", '{"a":"x","b":1}'), ("r2", '{"a":"y","b":3}')} and len(lines) == 3
    chunks = spark.createDataFrame([(1, "c2", "two"), (1, "c1", None)], "doc_id int, chunk_id string, text string")
    assert sinks.review_texts(chunks).first()["text"] == "## c1\n\n\n\n## c2\n\ntwo"
    signals = candidates.page_signals(spark.createDataFrame([(1, 0, "marker", "a"), (1, 0, "mineru", ""), (1, 1, "mineru", "b")], "doc_id int, page_idx int, engine string, text string"))
    cands = signals.withColumn("status", F.when(F.col("char_count") > 0, "ok").otherwise("empty"))
    selected = candidates.select_pages(cands).where("page_idx = 0")
    log = {r["page_idx"]: r for r in candidates.selection_log(cands, selected).collect()}
    assert (log[0]["selected_engine"], log[0]["reason"], log[0]["statuses"]) == ("marker", "only_one_ok", {"marker": "ok", "mineru": "empty"})
    assert (log[1]["selected_engine"], log[1]["reason"], set(log[1]["scores"])) == (None, "unknown", {"mineru"})
    assert [tuple(r) for r in candidates.engine_counts(selected).collect()] == [(1, "marker", 1)]
