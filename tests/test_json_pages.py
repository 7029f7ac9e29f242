"""JSON pages and fragments against plain Python readers written for these tests."""

import html
import json
import re

from pyspark.sql import functions as F

from foldline.operators import json_pages as J

ORDER = ("text", "content", "md_content", "html", "latex")


def fragments(value):
    if isinstance(value, str):
        return [value.strip()]
    if isinstance(value, list):
        return [x for item in value for x in fragments(item)]
    if not isinstance(value, dict):
        return []
    own = [value[k].strip() for k in ORDER if isinstance(value.get(k), str)]
    return own + [x for v in value.values() if isinstance(v, (dict, list)) for x in fragments(v)]


def joined(value):
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for x in fragments(value) if x)).strip()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


PAGES = [
    {"z": {"items": ["b", ["c", {"latex": "d", "text": " e "}]], "text": "first below"}, "content": "own two", "a": [{"html": "last"}], "text": "own one", "type": "left out", "n": 3},
    {"text": 5, "content": None, "md_content": "", "html": "h\n\n\n\ni", "list": [None, True, 1.5, "  "]}, "just text", ["x", {"y": {"text": "deep"}}], {}, [], None, 7, {"text": "[1, 2]", "k": {"text": '{"a": 1}'}},
    {"Zebra": {"text": "1"}, "apple": {"text": "2"}, "mango": {"text": "3"}, "é": {"text": "ü 😀"}},
]


def nested(depth):
    out = {"text": "bottom"}
    for k in range(depth):
        out = {"text": str(k), "below": [out]}
    return out


def test_listed_pages(spark):
    payloads = [json.dumps({"pdf_info": PAGES}), json.dumps(PAGES), json.dumps({"pdf_info": {"pages": []}}), '"text"', "{broken", None, "", "[]", json.dumps({"other": 1, "pdf_info": []}), "3, 4", json.dumps([nested(30)]), json.dumps(["long " * 200000])]
    df = spark.createDataFrame([(k, p, 1, "x") for k, p in enumerate(payloads)], "doc_id long, payload string, page_idx int, text string")
    want = [(d, k, joined(p)) for d in (0, 1) for k, p in enumerate(PAGES)] + [(10, 0, joined(nested(30))), (11, 0, ("long " * 200000).strip())]
    assert rows_of(J.listed_pages(df), "doc_id", "page_idx", "text") == sorted(want, key=repr)
    assert J.listed_pages(df.limit(0)).count() == 0


def test_walk(spark):
    df = spark.createDataFrame([(1, '{"b":[1,{"c":null}],"a":"x"}'), (2, "true")], "doc_id long, payload string")
    got = rows_of(J.walk(J.json_roots(df, "payload", "doc_id"), "doc_id"), "doc_id", "path", "key", "inside", "kind", "raw")
    assert got == sorted([
        (1, [], None, None, "object", '{"b":[1,{"c":null}],"a":"x"}'), (1, [0], "b", "object", "array", '[1,{"c":null}]'), (1, [1], "a", "object", "string", "x"), (1, [0, 0], None, "array", "bigint", "1"),
        (1, [0, 1], None, "array", "object", '{"c":null}'), (1, [0, 1, 0], "c", "object", "void", None), (2, [], None, None, "boolean", "true"),
    ], key=repr)


REFERENCES = [
    "a &amp; b &lt;c&gt; &quot;d&quot; &#65;&#x42;&#X43; &eacute;&Eacute; &nbsp;|", "&amp", "&notit; &notin; &not; &ampx &copycat;", "&#0; &#128; &#x9f; &#55296; &#1114112; &#99999999999; &#x1F600; &#x110000;",
    "&#1; &#11; &#13; &#xfdd0; &#x1ffff; &#127;", "& &; &# &#x; &unknown; &&amp;& &NotEqualTilde; &acE;", "", None, "none", "&#00065; &#x00041;", "&lt;" * 20000,
]


def test_unescape(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(REFERENCES)], "id int, x string")
    assert rows_of(df.select("id", J.unescape(F.col("x")).alias("y")), "id", "y") == sorted(((k, None if x is None else html.unescape(x)) for k, x in enumerate(REFERENCES)), key=repr)


def test_flat_pages(spark):
    blocks = [
        {"id": "/page/2/Text/1", "page": 9, "html": "<p>two &amp; more</p>"}, {"id": 7, "page": 0, "html": "zero<br>next  \n\n\n\nend"}, {"id": "none", "page": 2, "html": "again<br/>x"}, {"page": -1, "html": "gone"}, {"html": "gone"}, "gone",
        {"page": 1.5, "html": "gone"}, {"page": "3", "html": "gone"}, {"page": 5, "html": "<b> </b>"}, {"page": 4, "html": None}, {"page": 4}, {"page": 6, "html": 12}, {"page": 7, "html": "<tr>a</tr><tr>b</tr>"},
    ]
    info = {"0": {"bbox": [0, 1, 10.5, 21]}, "03": {"bbox": [0, 0, 1, 1]}, "x": {"bbox": [0, 0, 1, 1]}, "8": {"bbox": [0, 0, 1]}, "9": {"bbox": [0, 0, "1", 1]}, "10": 5, "2": {"bbox": [1, 1, 2, 2]}}
    payloads = [json.dumps({"blocks": blocks, "page_info": info, "children": [{"page": 1}]}), json.dumps({"blocks": [], "page_info": {"1": None}}), json.dumps({"blocks": None, "page_info": info}), "[1]", None, "{", json.dumps({"blocks": blocks, "page_info": [1]})]
    df = spark.createDataFrame([(k, p, 3) for k, p in enumerate(payloads)], "doc_id long, payload string, width int")
    texts = {0: "zero\nnext\n\nend", 2: "two & more\nagain\nx", 6: "12", 7: "a\nb"}
    box = {0: (10.5, 20.0), 2: (1.0, 1.0)}
    want = [(0, p, texts.get(p, ""), *box.get(p, (None, None))) for p in (0, 2, 3, 6, 7, 8, 9, 10)] + [(1, 1, "", None, None)] + [(6, p, t, None, None) for p, t in texts.items()]
    assert rows_of(J.block_pages(df), "doc_id", "page_idx", "text", "width", "height") == sorted(want, key=repr)
    assert J.block_pages(df.limit(0)).count() == 0


def test_tree_pages(spark):
    pages = [
        {"id": "/page/1/Page/0", "bbox": [0, 0, 5, 6], "children": [{"html": "<p>b</p>"}, {"html": ""}, "no", {"html": "c"}]}, {"page": 0, "bbox": [1, 2, 3], "children": None}, {"page": 3, "children": [{"html": "x", "page": 8}]}, {"children": [{"html": "no page"}]}, 4,
        {"page": 3, "bbox": [0, 0, 1, 1], "children": [{"html": "same page again"}]},
    ]
    df = spark.createDataFrame([(1, json.dumps({"children": pages})), (2, json.dumps({"children": []})), (3, json.dumps({"children": {}}))], "doc_id long, payload string")
    want = [(1, 1, "b\nc", 5.0, 6.0), (1, 0, "", None, None), (1, 3, "x", None, None), (1, 3, "same page again", 1.0, 1.0)]
    assert rows_of(J.block_pages(df), "doc_id", "page_idx", "text", "width", "height") == sorted(want, key=repr)


def test_tree_pages_broadcast_no_texts(spark):
    """The texts of pages never go to the driver, however small Spark takes them for."""
    df = spark.createDataFrame([(1, json.dumps({"children": [{"page": 0, "children": [{"html": "<p>a</p>"}]}]}))], "doc_id long, payload string")
    tree = J.block_pages(df).where("text IS NOT NULL")
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert joins and all("strategy=merge" in line for line in joins)
