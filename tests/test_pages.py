from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from foldline.jobs import page_catalogue
from foldline.operators import canonical, chunking, code, pages
from foldline.operators.html import html_to_markdown
from foldline.sources.files import high_water_mark, read_files, text_pages
from foldline.streaming.ingest import ingest, latest


def table(spark, rows, schema="doc_id int, page_idx int, engine string, text string"):
    return spark.createDataFrame(rows, schema)


def test_normalise_markdown(spark):
    rows = [(0, "\r\n a \t\r\n\n\n\n\nb\n```\n\n\n\n x \n```\n\n"), (1, ""), (2, None), (3, "```\nopen  ")]
    got = dict(map(tuple, canonical.normalise_markdown(table(spark, rows, "doc_id int, text string")).collect()))
    assert got == {0: " a\n\n\nb\n```\n\n\n\n x \n```", 1: "", 3: "```\nopen  "}
    assert canonical.normalise_markdown(table(spark, [], "doc_id int, text string")).count() == 0


def test_text_columns(spark):
    family, warning = canonical.content_family(F.col("text"))
    rows = table(spark, [("text/x-markdown ;a",), ("TEXT/HTML",), ("text/csv",), ("image/png",), (None,)], "text string").select(family, warning).collect()
    assert [tuple(r) for r in rows] == [("markdown", None), ("html", None), ("plain", None), ("unsupported", "unsupported content_type 'image/png'"), ("unsupported", "unsupported content_type ''")]
    one = table(spark, [("exam-\n ple \n same\nsame\n\n\n\nend",)], "text string")
    assert one.select(canonical.clean_text(F.col("text"))).first()[0] == "example\nsame\n\nend"
    assert one.select(canonical.nfkc(F.lit("ﬁ²"))).first()[0] == "fi2"
    assert one.select(canonical.decoded(F.lit(bytearray(b"a\xffb")))).first()[0] == "a�b"
    assert one.select(canonical.strip_tags(F.lit("<p>a<br/>b</p><i>c</i>"))).first()[0] == "a\nb\nc"


def test_routing_and_spine(spark):
    rows = [(1, 0, "marker", "few words"), (1, 0, "mineru", "x " * 30), (1, 2, "mineru", ""), (2, 0, "mineru", "a"), (2, 1, "marker", "b"), (3, 0, "other", "z")]
    found = table(spark, rows)
    errors = spark.createDataFrame([(2, "marker", "timeout")], "doc_id int, engine string, error string")
    got = {(r["doc_id"], r["page_idx"]): (r["extractor"], r["fallback_reason"]) for r in pages.route_pages(found, ["marker", "mineru"], 25, errors).collect()}
    assert got == {
        (1, 0): ("mineru", "primary extractor 'marker' returned low-content page 0"), (1, 1): ("marker", None), (1, 2): ("mineru", "primary extractor 'marker' did not return page 2"),
        (2, 0): ("mineru", "primary extractor 'marker' failed: timeout"), (2, 1): ("marker", None), (3, 0): ("marker", None),
    }
    assert [tuple(r) for r in pages.placeholders(found).select("doc_id", "page_idx", "block_id").collect()] == [(1, 1, "placeholder_p1")]
    assert {r["extractor"] for r in pages.route_pages(found, []).collect()} == {"none"}


def test_strip_margins(spark):
    rows = [(1, k, "", f"Report {k}\n\nPage {k} of 3\nbody {k}\nmore") for k in range(3)] + [(1, 3, "", "other\n\nline"), (1, 4, "", " "), (2, 0, "", "Report 1\n\nx")]
    got = {(r["doc_id"], r["page_idx"]): r["text"] for r in pages.strip_margins(table(spark, rows)).collect()}
    assert got == {(1, 0): "body 0\nmore", (1, 1): "body 1\nmore", (1, 2): "body 2\nmore", (1, 3): "other\nline", (1, 4): " ", (2, 0): "Report 1\n\nx"}


def test_merge_over_pages(spark):
    rows = [(1, 0, 0, "para", "It goes"), (1, 1, 0, "para", "and so"), (1, 2, 1, "para", "on and"), (1, 3, 1, "para", "on."), (1, 4, 2, "para", "no"), (1, 5, 3, "heading", "# h")]
    found = pages.canonical_ranges(pages.merge_over_pages(table(spark, rows, "doc_id int, block_no int, page_idx int, type string, text string"))).orderBy("block_no")
    assert [(r["text"], r["page_idx"], r["start_off"], r["end_off"]) for r in found.collect()] == [("It goes", 0, 0, 7), ("and so on and on.", 0, 9, 26), ("no", 2, 31, 33), ("# h", 3, 38, 41)]


def test_code(spark):
    text = "if (a) {\n  return b;\n}\n\nplain words here\n \nx = [1];\n\ndef f(a):\n    return {a: 1}"
    rows = code.paragraphs(table(spark, [(1, text), (2, None)], "doc_id int, text string"), "doc_id")
    got = rows.select("para_no", code.is_code(F.col("paragraph")), code.language(F.col("paragraph"))).collect()
    assert [tuple(r) for r in got] == [(0, True, "text"), (1, False, "text"), (2, True, "text"), (3, True, "python")]


def test_html(spark):
    cases = {
        "<h2> A <b>b</b></h2><div>x<p>y &amp; z</p></div><ol><li>one</li><li></li><li>two</li></ol><pre><code class='language-Py x'>a\r\n&lt;b</code></pre>"
        "<table><tr><td>1|2</td></tr><tr><th>h</th><th>k</th></tr></table>tail": ["## A b", "x", "y & z", "1. one", "2. two", "```py\na\n<b\n```", "| h | k |", "| --- | --- |", "| 1\\|2 |  |", "tail"],
        "<body><div>first</div><span>second</span></body>": ["firstsecond"],
        "<table><tr><td>a</td></tr><tr><th>h</th></tr><tr><td></td></tr></table>": ["| h |", "| --- |", "| a |", "|  |"],
        "</ul><li>lone</li><ul><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li></ul>": ["- lone", "a", "1. x", "2. y", "- b"],
        "<!-- c --><script>var t = \"</p>&amp;\";</script>a<br>b &lt; c<p title='x>y'>d</h3><p": ["var t = \"</p>&amp;\";a b < c", "# d"],
        "": [], " \n": [], "<pre>never ended": [],
    }
    pages_ = spark.createDataFrame([*enumerate(cases), (99, None)], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_to_markdown(pages_).collect()}
    assert got.pop(99) is None
    assert {k: t for k, t in got.items()} == {k: "\n\n".join(v) for k, v in enumerate(cases.values())}
    assert html_to_markdown(pages_.where("page_id < 0")).count() == 0


def test_cut_references_in_html(spark):
    """A reference that a tag cuts off does not go on in the next text, as Python's parser reads it."""
    cases = {"<title>a&am</title><style>p{}</style>": "a&amp{}", "<p>x &am<b>p; y</b></p>": "x &amp; y", "<pre>&l<i>t;</i></pre>": "```\n&lt;\n```", "<table><tr><td>&#6<b>5;</b></td></tr></table>": "| 5; |", "<p>&amp<b>amp;</b> &quot</p>": '&amp; "'}
    rows = spark.createDataFrame([*enumerate(cases)], "page_id long, html string")
    assert {r["page_id"]: r["text"] for r in html_to_markdown(rows).collect()} == dict(enumerate(cases.values()))


CUT_PAGES = ["<title>a &quot</title><h1>b &am</h1><p>c &quot", "<p>&quot;d&quot; &copy &copy; &amp &ampx &amp;quot; &middot;", "<p>&quote; &notit; &&quot;", "<title>e&am</title><style>p{}</style><p>&am<b>p;</b>", "&", "&quot"]


def both(spark, folder, name):
    """The rows of a query over ``CUT_PAGES``, and those of its SQL."""
    spark.createDataFrame([*enumerate(CUT_PAGES)], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    return sorted(map(tuple, page_catalogue.QUERIES[name](spark, str(folder)).collect())), sorted(db.execute(page_catalogue.SQL[name]).fetchall())


def test_strip_tags_query_on_cut_references(spark, tmp_path):
    """The query keeps a name without its semicolon, as its SQL does; the operator by itself does not."""
    ours, theirs = both(spark, tmp_path, "html_strip_tags")
    assert ours == theirs
    assert spark.range(1).select(canonical.strip_tags(F.lit("a &quot</b> &eacute;"))).first()[0] == 'a " é'


def test_html_query_on_cut_references(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "html_canonical")
    assert ours == theirs


def test_chunk_ids_and_pages(spark):
    d = table(spark, [(7, "a\fb" + "x" * 1300), (8, None)], "doc_id int, text string")
    assert [r["chunk_id"] for r in chunking.chunks(d).collect()] == ["7-p0001-c001", "7-p0002-c001"]
    assert text_pages(d).count() == 2


def test_files_and_ingest(spark, tmp_path):
    base = tmp_path / "in"
    (base / "sub").mkdir(parents=True)
    (base / "a.md").write_bytes(b"# a\xff")
    (base / "sub" / "b.html").write_text("<p>b</p>")
    (base / "c.bin").write_bytes(b"\x00")
    got = {r["source_ref"]: r["content_type"] for r in read_files(spark, str(base), exclude=("sub/*.html",)).collect()}
    assert got == {"a.md": "text/markdown", "c.bin": "application/octet-stream"}
    rows = read_files(spark, str(base))
    mark = high_water_mark(rows)
    assert isinstance(mark, datetime) and read_files(spark, str(base), cursor=mark).count() >= 1
    assert read_files(spark, str(base), cursor=mark + timedelta(hours=1)).count() == 0
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest(spark, str(base), out, checkpoint)
    (base / "d.txt").write_text("late")
    ingest(spark, str(base), out, checkpoint)
    assert {r["source_ref"]: r["text"] for r in latest(spark, out).collect()} == {"a.md": "# a�", "sub/b.html": "<p>b</p>", "c.bin": None, "d.txt": "late"}
