"""Payload picks, loaders, and what belongs to runs and chunks, on small cases."""

import json

from pyspark.sql import functions as F

from foldline.operators import candidates, validation
from foldline.sources import payloads
from foldline.sources.files import pdf_documents
from foldline.sources.sinks import write_header

FILES = [
    ("r1", "r1/x_meta.json", "m" * 99), ("r1", "r1/a.json", "[]"), ("r1", "r1/b.json", '[{"text": "page one"}, "two"]'), ("r1", "r1/z_content_list.json", "[1]"), ("r1", "r1/y_middle.json", "x" * 50), ("r1", "r1/n.md", "unused"),
    ("r2", "r2/mineru_config.json", "y" * 500), ("r2", "r2/b.json", "{broken"), ("r2", "r2/a.json", "{broken"), ("r2", "r2/1.md", " \n"), ("r2", "r2/2.md", "# Title"), ("r3", "r3/mineru_config.json", "{}"), ("r3", "r3/x_meta.json", "{}"), ("r4", "r4/only.txt", "t"),
    ("r5", "r5/b_middle.json", "zz"), ("r5", "r5/a_middle.json", "zz"), ("r5", "r5/empty.md", None),
]


def test_picks(spark):
    files = spark.createDataFrame([(r, p, len(c or ""), c) for r, p, c in FILES], "run string, path string, length long, content string")
    assert {r["run"]: r["path"] for r in payloads.largest_json(files).collect()} == {"r1": "r1/y_middle.json", "r2": "r2/mineru_config.json", "r3": "r3/mineru_config.json", "r5": "r5/a_middle.json"}
    assert {r["run"]: r["path"] for r in payloads.preferred_json(files).collect()} == {"r1": "r1/z_content_list.json", "r2": "r2/a.json", "r3": "r3/x_meta.json", "r5": "r5/a_middle.json"}
    got = sorted(tuple(r) for r in payloads.loaded_pages(files).collect())
    assert got == [("r1", 0, "page one"), ("r1", 1, "two"), ("r2", 0, "# Title")]
    assert payloads.loaded_pages(files.limit(0)).count() == 0 and payloads.largest_json(files.limit(0)).count() == 0


def test_run_files(spark, tmp_path):
    for run in ("one", "two"):
        (tmp_path / "out" / run / "deep").mkdir(parents=True)
        (tmp_path / "out" / run / "deep" / "p.json").write_text(json.dumps([{"text": run}]))
    files = payloads.run_files(spark, f"{tmp_path}/out", content=True)
    assert sorted((r["run"], r["length"] > 0) for r in files.collect()) == [("one", True), ("two", True)]
    assert sorted(tuple(r) for r in payloads.loaded_pages(files).collect()) == [("one", 0, "one"), ("two", 0, "two")]


def test_runs_and_extractors(spark):
    runs = spark.createDataFrame([(1, "b", "ok", 2), (1, "a", "error", 1), (2, "a", None, 5)], "doc_id int, engine string, status string, started int")
    assert {r["doc_id"]: [tuple(x) for x in r["engine_runs"]] for r in candidates.engine_runs(runs).collect()} == {1: [("a", "error"), ("b", "ok")], 2: [("a", None)]}
    chunks = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "doc_id int, page_idx int, text string")
    selected = spark.createDataFrame([(1, 0, "marker"), (1, 1, None)], "doc_id int, page_idx int, selected_engine string")
    assert {r["text"]: r["extractor"] for r in candidates.with_extractor(chunks, selected, "variant").collect()} == {"x": "marker", "y": "variant", "z": "variant"}


def test_output_states(spark):
    rows = [(1, "markdown", "x", "x", None), (2, "unsupported", "x", "", "ok"), (3, "plain", None, None, "ok"), (4, "plain", " ", "\u2003", "ok"), (5, "unsupported", "", "", "failed"), (6, None, "", "", "unavailable"), (7, "unsupported", "x", "some text", "failed")]
    df = spark.createDataFrame(rows, "id int, family string, source string, text string, pipeline string")
    got = {r["id"]: (r["s"]["has_textual_content"], r["s"]["degraded_reason"]) for r in df.select("id", validation.output_state(*map(F.col, ("family", "source", "text", "pipeline"))).alias("s")).collect()}
    assert got == {1: (True, None), 2: (False, "unsupported_content_type"), 3: (False, "empty_input"), 4: (False, "no_textual_content"), 5: (False, "pdf_pipeline_failed"), 6: (False, "pdf_pipeline_unavailable"), 7: (True, None)}


def test_pdf_documents_and_headers(spark, tmp_path):
    files = spark.createDataFrame([("b/x.PDF", b"one"), ("a/y.pdf", b"one"), ("z.pdf", b"two"), ("z.txt", b"two")], "path string, content binary")
    got = {r["path"]: r["doc_id"] for r in pdf_documents(files).collect()}
    assert got == {"a/y.pdf": "pdf_7692c3ad3540bb80", "z.pdf": "pdf_3fc4ccfe745870e2"}
    write_header(spark, ["page_index", "winner", "notes"], f"{tmp_path}/review")
    assert spark.read.text(f"{tmp_path}/review").collect()[0][0] == "page_index,winner,notes"
