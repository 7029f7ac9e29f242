import json

import pytest
from pyspark.sql import functions as F

from foldline.operators import adapters, candidates, distiller, metrics, pages, passages, segments, validation, verification
from foldline.sources.files import glob_pattern, resolved_dir
from foldline.sources.sinks import write_bundle


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_flat_payloads(spark):
    flat = [{"page_idx": 1, "type": "Title", "text": "T"}, {"type": "image"}, {"type": "text", "lines": [{"spans": [{"content": "a"}, {"content": ""}, {"content": "b"}]}, {"spans": []}, {"spans": [{"content": "c"}]}]}, {"page_idx": 1, "type": "table", "bbox": [1]}]
    nested = {"pdf_info": [{"page_idx": 4, "blocks": [{"type": "text", "text": "old"}]}, {"page_idx": 4, "preproc_blocks": [{"type": "odd", "id": "x", "text": ""}]}]}
    given = [(1, json.dumps(flat)), (2, json.dumps(nested)), (3, json.dumps({"pages": [{"blocks": [{"type": "equation", "text": "e"}]}]})), (4, "{"), (5, None), (6, "[]"), (7, json.dumps({"pdf_info": {"pages": [{"page": 2, "blocks": [{"text": "z"}]}]}}))]
    got = rows(adapters.flat_blocks(spark.createDataFrame(given, "doc_id long, payload string")), "doc_id", "page_idx", "block_no")
    assert got == [
        (1, 0, 0, "mineru_p0_b0", None, "", False, "image"), (1, 0, 1, "mineru_p0_b1", "para", "a b\nc", False, None), (1, 1, 0, "mineru_p1_b0", "heading", "T", False, None), (1, 1, 1, "mineru_p1_b1", "table", "", True, "table_render"),
        (2, 4, 0, "x", "unknown", "", False, None), (3, 0, 0, "mineru_p0_b0", "unknown", "e", False, "equation"), (7, 2, 0, "mineru_p2_b0", "unknown", "z", False, None),
    ]


def test_block_signals(spark):
    given = [(1, 0, "e", "heading", "A b", True, None), (1, 0, "e", "para", "x\n x \n", True, None), (1, 0, "e", "para", "# y", False, None), (1, 0, "e", None, "", True, "image"), (1, 1, "e", None, "", True, "image")]
    found = candidates.block_signals(spark.createDataFrame(given, "doc_id long, page_idx int, engine string, type string, text string, has_coords boolean, asset string"))
    assert rows(found, "page_idx") == [(1, 0, "e", 6, 3, 4, 0.25, 2, True, 1), (1, 1, "e", 0, 0, 0, 0.0, 0, False, 1)]


def test_distilled_documents(spark):
    given = [
        (1, 0, 0, "00", 0, "heading", "# First Heading"), (1, 0, 0, "01", 1, "para", "This is a paragraph under the heading."), (1, 1, 0, "00", 2, "list", "- Item 1\n- Item 2"),
        (2, 0, 0, "00", 0, "para", "Some OCR text."), (2, 1, 0, "0", 1, "unknown", "[UNPARSEABLE PAGE 1]"),
        (3, 0, 0, "2", 0, "heading", "## Repeated Heading"), (3, 0, 0, "1", 1, "heading", "## Repeated Heading"), (3, 0, 0, "10", 2, "caption", "goes"), (3, 1, 0, "0", 3, "para", "on"), (3, 2, 0, "0", 4, "code", "x = 1"),
    ]
    found = distiller.distill(spark.createDataFrame(given, "doc_id long, page_idx int, page_no int, key string, block_no int, type string, text string"))
    text = {r["doc_id"]: r["text"] for r in distiller.canonical_text(found).collect()}
    assert text[1] == "# First Heading\n\nThis is a paragraph under the heading.\n\n\f\n\n- Item 1\n- Item 2"
    for r in found.collect():
        assert text[r["doc_id"]][r["start_off"] : r["end_off"]] == r["text"]
    got = rows(found.select("doc_id", "block_idx", "type", "heading", "section_path", "text"), "doc_id", "block_idx")
    assert got[3:5] == [(2, 0, "para", None, "root", "Some OCR text."), (2, 1, "para", None, "root", "[UNPARSEABLE PAGE 1]")]
    assert [(r[2], r[3], r[5]) for r in got[5:]] == [("heading", "Repeated Heading", "## Repeated Heading"), ("para", None, "goes"), ("heading", "Repeated Heading_0", "## Repeated Heading"), ("para", None, "on"), ("code", None, "x = 1")]
    assert distiller.distill(spark.createDataFrame([], "doc_id long, page_idx int, page_no int, key string, block_no int, type string, text string")).count() == 0


def test_routing_with_a_quick_pass(spark):
    given = [(1, 0, "pypdf", "q" * 90), (1, 0, "marker", "m " * 30), (1, 0, "mineru", "n " * 30), (1, 1, "mineru", "n " * 30), (1, 2, "marker", "m")]
    errors = spark.createDataFrame([(1, "mineru", "timeout"), (1, "other", "x")], "doc_id long, engine string, error string")
    found = pages.route_with_quick_pass(spark.createDataFrame(given, "doc_id long, page_idx int, engine string, text string"), ["marker", "pypdf"], ["mineru", "marker"], errors=errors)
    got = {r["page_idx"]: r for r in found.collect()}
    assert [(got[k]["extractor"], got[k]["scan_likely"], got[k]["quick_chars"], got[k]["extractor_errors"]) for k in range(3)] == [("marker", False, 90, {}), ("mineru", True, 0, {"mineru": "timeout"}), ("marker", True, 0, {"mineru": "timeout"})]
    assert got[0]["char_counts"] == {"pypdf": 90, "marker": 59, "mineru": 59} and got[2]["fallback_reason"] == "primary extractor 'mineru' failed: timeout"
    twice = spark.createDataFrame([(1, 0, "a", 0, "old"), (1, 0, "a", 1, "new")], "doc_id long, page_idx int, engine string, position int, text string")
    assert [r["text"] for r in pages.last_pages(twice).collect()] == ["new"]


def test_metrics(spark):
    paged = spark.createDataFrame([(1, "same line\nSame line \nshort"), (1, "same line"), (1, " "), (2, None)], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, "a" * n) for n in (5, 1, 9)], "doc_id long, text string")
    assert rows(metrics.run_metrics(paged, chunks), "doc_id") == [(1, 3, 2 / 3, 2 / 3, 3, 5.0, 9.0), (2, 1, 0.0, 0.0, 0, 0.0, 0.0)]
    assert rows(metrics.histogram(chunks, F.length("text"), 5), "low") == [(0, 1), (5, 2)]
    runs = spark.createDataFrame([(1, "a", "Fail", 1), (1, "a", "Success", 2), (1, "b", "Empty", 1)], "doc_id long, engine string, status string, started int")
    assert rows(metrics.status_matrix(runs, ["a", "b", "c"]), "doc_id") == [(1, "Success", "Empty", None)]


def test_target_checks(spark):
    tree = {"children": [{"block_type": "Text", "html": "<p>Start of it all</p>", "children": [{"block_type": "List", "html": "x"}]}, {"block_type": "Figure", "html": "f", "children": [{"block_type": "Caption", "html": "Fig 1"}, {"block_type": "Code", "html": "<pre>def f</pre>"}]}, {"block_type": "Table", "html": "Tab 2"}]}
    targets = [("single_block", "Start", None, None, None, True, None), ("single_block", None, "nothing", None, None, None, None), ("figure_linked", None, None, None, "Fig 1", None, True), ("table_linked", None, None, None, "Tab 2", None, None), ("code_merged", None, None, "def f", None, None, None), ("has_list", None, None, None, None, None, None), ("odd", None, None, None, None, None, None)]
    given = spark.createDataFrame([(d, k, *t) for d in (1, 2) for k, t in enumerate(targets)], "doc_id long, target_no int, type string, starts_with string, ends_with string, contains string, caption string, has_list boolean, has_code boolean")
    texts = spark.createDataFrame([(1, "![x](a.png) |a|b|\n|-|-|", ["a.png"]), (2, None, None)], "doc_id long, markdown string, files array<string>")
    blocks = verification.tree_blocks(spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None)], "doc_id long, payload string"))
    assert rows(blocks.select("no", "last", "block_type"), "no")[0] == (0, 6, None)
    checked = verification.check_tree_targets(given, blocks, texts)
    assert [r[3] for r in rows(checked, "doc_id", "target_no")] == [True, False, True, True, True, True, False] + [False] * 7
    assert rows(verification.check_counts(checked, "doc_id"), "doc_id") == [(1, 5, 7), (2, 0, 7)]
    flat = spark.createDataFrame([(1, 0, "para", "Start\n- of it all", None), (1, 1, None, "", "image"), (1, 2, "table", "Tab", "table_render"), (1, 3, "code", "def f", None)], "doc_id long, no int, type string, text string, asset string")
    texts = texts.withColumn("markdown", F.concat("markdown", F.lit(" Fig 1 Tab 2")))
    assert [r[3] for r in rows(verification.check_flat_targets(given, flat, texts), "doc_id", "target_no")] == [True, False, True, True, True, True, False] + [False] * 7


def test_passages_and_rankings(spark):
    spans = "doc_id long, id long, start int, end int, score int"
    given = spark.createDataFrame([(1, 0, 0, 10, 1), (1, 1, 5, 15, 3), (1, 2, 14, 20, 3), (1, 3, 30, 40, 0), (2, 0, 0, 5, 0)], spans)
    assert rows(passages.drop_overlapping(given).select("doc_id", "id"), "doc_id", "id") == [(1, 1), (1, 3), (2, 0)]
    new = spark.createDataFrame([(1, 7, 0, 4, 0), (1, 8, 4, 12, 0)], spans)
    assert rows(passages.segment_lineage(given, new, ["doc_id"]), "doc_id", "id") == [(1, 0, 8, 6), (1, 1, 8, 7), (1, 2, None, None), (1, 3, None, None), (2, 0, None, None)]
    assert rows(passages.evidence_coverage(given, new, ["doc_id"]), "doc_id") == [(1, 0.5), (2, 0.0)]
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id long, doc_id long, rank int")
    good = spark.createDataFrame([(1, 5), (1, 7), (1, 9)], "query_id long, doc_id long")
    assert abs(passages.ranking_gain(ranked, good, 3).first()["ndcg"] - 1.5 / (1 + 1 / 1.584962500721156 + 0.5)) < 1e-9
    changes = spark.createDataFrame([("added",), ("changed",), ("changed",), ("unchanged",)], "change string")
    assert rows(passages.churn_rates(changes), "n") == [(4, 0.25, 0.0, 0.5, 0.25)]
    blocks = spark.createDataFrame([(1, 0, k, n) for k, n in enumerate((250, 200, 200, 500, 400, 100))], "doc_id long, section int, block_no int, n_tokens int")
    assert [r[3] for r in rows(segments.pack_passages(blocks), "block_no")] == [0, 0, 0, 1, 1, 2]
    assert [r[3] for r in rows(segments.pack_passages(blocks.where("block_no < 4 OR block_no = 5")), "block_no")] == [0, 0, 0, 1, 1]


def test_checks_of_documents(spark):
    d = spark.createDataFrame([(1, "a", "", 3), (2, None, "abc", 9)], "doc_id long, source string, text string, n long")
    bad = F.concat(validation.document_violations("source", "text"), validation.range_violations(F.lit(0), F.col("n"), F.length("text")))
    good, wrong = validation.split_valid(d, bad)
    assert good.count() == 0 and rows(wrong.select("violations"), "doc_id") == [(["empty text", "end beyond text"],), (["empty source", "end beyond text"],)]
    assert [r[0] for r in d.orderBy("doc_id").select(validation.first_filled(F.col("text"), F.col("doc_id"))).collect()] == ["1", "abc"]
    t = spark.createDataFrame([(1, 0, "|a|b|\n|-|-|\n|c|d|"), (1, 1, "|a|b|\n|c|d|e|f|")], "doc_id long, block_no int, text string")
    assert [r[2] for r in rows(validation.malformed_tables(t), "block_no")] == [False, True]


def test_globs_folders_and_bundles(spark, tmp_path):
    import re

    hit = lambda glob, path: bool(re.search(glob_pattern(glob).replace(r"\z", r"\Z"), path))
    assert hit("[ab]*.md", "x/b1.md") and not hit("[!ab]*.md", "x/b1.md") and hit("x/?.md", "x/b.md") and not hit("[^b].md", "c.md") and hit("[x.md", "[x.md")
    with pytest.raises(ValueError):
        resolved_dir(spark, f"{tmp_path}/none")
    assert resolved_dir(spark, str(tmp_path)) == f"file:{tmp_path}"
    chunks = spark.createDataFrame([(1, "b"), (2, "a")], "id long, text string")
    for _ in range(2):
        manifest = write_bundle({"chunks": chunks}, f"{tmp_path}/out", "r1", {"source_sha256": "ab"})
    assert manifest.first().asDict() == {"run_id": "r1", "source_sha256": "ab", "chunks_rows": 2}
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out/chunks").select("value").collect()) == ['{"id":1,"text":"b"}', '{"id":2,"text":"a"}']


def test_tree_levels_are_written_once(spark, monkeypatch):
    """Each level of the walk is one table, and the objects of a payload are dealt by document once."""
    written, kept = [], verification.kept
    monkeypatch.setattr(verification, "kept", lambda rows, name: (written.append(name), kept(rows, name))[1])
    blocks = verification.tree_blocks(spark.createDataFrame([(1, '{"block_type":"Page","children":[{"block_type":"Text","html":"a"}, 5]}')], "doc_id long, payload string"))
    assert [tuple(r) for r in blocks.orderBy("no").collect()] == [(1, 0, 1, "Page", None), (1, 1, 1, "Text", "a")]
    assert len(written) == 3  # the root, its child, and no more
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
