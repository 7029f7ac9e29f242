"""Splits, packing, overlaps, the segment tree and its gates, and lineage by text, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldline.operators import lineage, segments, structure

LONG = "\n".join(f"line {k} of many words here" for k in range(40000))
BLOCKS = [
    ("para", None), ("para", ""), ("para", " \n\t "), ("para", "One sentence here. Another one, longer than that! A third? " * 8), ("para", "word " * 95), ("para", "x" * 5000), ("para", "é… “so.” It goes on\nand on. " * 20),
    ("code", "import os\n\ndef f():\n    return 1\n\n\nclass A:\n    def g(self):\n        return 2\n" * 9), ("code", "a b c d e\n" * 30), ("code", LONG),
    ("table", "| a | b |\n|---|---|\n" + "".join(f"| {k} | some text of row {k} |\n" for k in range(50))), ("table", "| only | header |"), ("table", "| h |\n| " + "long " * 60 + "|\n| x |\n"),
    ("list", "Intro here:\n" + "".join(f"- item {k}\n  goes on\n" for k in range(40))), ("list", "1. a\n2. b\n" * 30), ("list", "no item at all " * 20), ("odd", "kind unknown. " * 30),
]


def count(text):
    return len(text.split())


def test_split_blocks(spark):
    rows = [(k, t, x, 9, "h") for k, (t, x) in enumerate(BLOCKS)]
    df = spark.createDataFrame([*rows, rows[3]], "id long, type string, text string, start long, head string")
    got = defaultdict(list)
    for r in segments.split_blocks(df, most=30, special=40).collect():
        got[r["id"]].append(r)
    assert 0 not in got and 1 not in got and len(got[2]) == 1
    assert Counter((r["piece_no"], r["body"]) for r in got.pop(3)).most_common()[-1][1] == 2  # a repeated row is split twice
    for k, pieces in got.items():
        kind, text = BLOCKS[k]
        pieces.sort(key=lambda r: r["piece_no"])
        head = pieces[0]["head"]
        assert all(r["head"] == head for r in pieces) and head + "".join(r["body"] for r in pieces) == text
        at = len(head)
        for r in pieces:
            assert (r["start"], r["end"]) == (at, at + len(r["body"])) and text[r["start"] : r["end"]] == r["body"] and r["n_tokens"] == count(head + r["body"])
            at = r["end"]
            single = kind in ("table", "list") and (r["body"].rstrip("\n").count("\n") == 0 if kind == "table" else True)
            assert r["n_tokens"] <= (40 if len(pieces) == 1 and kind in ("table", "code") else 30) or single
    assert got[10][0]["head"] == "| a | b |\n|---|---|\n" and all(r["body"].startswith("| ") for r in got[10]) and len(got[10]) > 5
    assert got[13][0]["head"] == "Intro here:\n" and all(r["body"].startswith("- item") and r["body"].endswith("goes on\n") for r in got[13])
    assert all(re.match(r"import os|def f|class A", r["body"]) for r in got[7])
    assert segments.split_blocks(df.limit(0)).count() == 0


def test_cuts_prefer_high_boundaries(spark):
    def pieces(units, most):
        at = [-1, -1, -1, -1]
        out, start, total, base, sums = [], 0, 0, 0, [0] * 4
        for i, (n, rank) in enumerate(units):
            at[rank], sums[rank] = i, total
            if i > start and total + n - base > most:
                good = [k for k in (3, 2, 1) if at[k] > start and total + n - sums[k] <= most and (sums[k] - base) * 2 >= most]
                to, upto = (at[good[0]], sums[good[0]]) if good else (i, total)
                out.append((start, to, upto - base))
                start, base = to, upto
            total += n
        return [*out, (start, len(units), total - base)] if units else out

    r = random.Random(4)
    cases = [([(r.randint(0, 9), r.randint(0, 3)) for _ in range(r.randint(0, 60))], r.choice([5, 9, 20, 40])) for _ in range(150)]
    df = spark.createDataFrame([(k, [(n, q) for n, q in u], m) for k, (u, m) in enumerate(cases)], "k int, u array<struct<n:int,rank:int>>, m int")
    for x in df.select("k", segments.cut_units(F.col("u"), F.col("m")).alias("p")).collect():
        assert [tuple(p) for p in x["p"]] == pieces(*cases[x["k"]])


def test_pack_passages(spark):
    def packed(sizes, least=30, target=60, most=90):
        sums, at = [], []
        for n in sizes:
            if not sums or sums[-1] >= target or sums[-1] + n > most:
                sums.append(0)
            sums[-1] += n
            at.append(len(sums) - 1)
        if len(sums) > 1 and sums[-1] < least and sums[-1] + sums[-2] <= most:
            at = [min(k, len(sums) - 2) for k in at]
        return at

    r = random.Random(2)
    sections = [[r.choice([0, 1, 5, 20, 61, 95, 200]) for _ in range(r.randint(1, 30))] for _ in range(80)] + [[3] * 20000]
    rows = [(k % 7, k, i, n) for k, s in enumerate(sections) for i, n in enumerate(s)]
    r.shuffle(rows)
    got = defaultdict(dict)
    for x in segments.pack_passages(spark.createDataFrame(rows, "doc_id long, section int, block_no int, n_tokens int"), 30, 60, 90).collect():
        got[x["section"]][x["block_no"]] = x["passage"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: packed(s) for k, s in enumerate(sections)}


def test_overlap(spark):
    text = "First one is here. Second has five words now. Third. "
    rows = [(1, 0, k, f"p{k}", 1000 * k, t, n) for k, (t, n) in enumerate([(text, 40), (text * 3, 33), ("no end of a sentence " * 9, 36), ("", 0), (None, 0), ("x.", 300)])] + [(1, 1, 0, "q", 7, text, 40), (2, 0, 1, "z", 0, text, 40)]
    got = {r["id"]: r for r in segments.with_overlap(spark.createDataFrame(rows, "doc_id int, section int, passage int, id string, start long, text string, n_tokens int")).collect()}
    first = got["p1"]  # four tokens are free: the last sentence, not the one before
    assert (first["overlap_from"], first["overlap_text"], first["overlap_tokens"]) == ("p0", "Third. ", 1)
    assert (first["overlap_start"], first["overlap_end"]) == (len(text) - 7, len(text))
    assert got["p2"]["overlap_text"] == "Third. " and got["p2"]["overlap_end"] == 1000 + 3 * len(text)
    assert all(got[k]["overlap_from"] is None and got[k]["overlap_text"] is None for k in ("p0", "p3", "p4", "p5", "q", "z"))
    with pytest.raises(ValueError):
        segments.with_overlap(spark.createDataFrame([], "doc_id int"), 0.5)


TEXT = "intro\n\n# A\n\npara one.\n\n## B\n\npara two.\n\n# A\n\n- x\n- y\n\n## B\n\nlast."


def made_tree(spark, text=TEXT, version="v1"):
    docs = spark.createDataFrame([(1, text), (2, "only text"), (3, "")], "doc_id long, text string")
    found = structure.anchored(structure.blocks(docs))
    passages = found.where("type <> 'heading'").select("doc_id", "section_path", F.col("pass_anchor").alias("anchor"), F.col("start_off").alias("start"), F.col("end_off").alias("end"), F.lit(5).alias("n_tokens"))
    return segments.segment_tree(found, passages, docs.select("doc_id", F.lit(version).alias("version")))


def test_segment_tree(spark):
    tree = made_tree(spark).cache()
    rows = {r["segment_id"]: r for r in tree.collect()}
    assert len(rows) == tree.count() == 3 + 4 + 6
    assert segments.tree_violations(tree).count() == 0
    path = lambda r: r["section_path"]
    by = {(r["doc_id"], r["type"], r["section_path"]): r for r in rows.values() if r["type"] == "SECTION"}
    assert path(rows[by[1, "SECTION", "A>B"]["parent_id"]]) == "A" and path(rows[by[1, "SECTION", "A_0>B"]["parent_id"]]) == "A_0"
    assert by[1, "SECTION", "A"]["ordinal"] == 0 and by[1, "SECTION", "A_0"]["ordinal"] == 1 and by[3, "SECTION", "root"]["parent_id"] is None
    assert all(rows[r["parent_id"]]["section_path"] == r["section_path"] for r in rows.values() if r["type"] == "PASSAGE")
    again = {r["segment_id"] for r in made_tree(spark).collect()}
    assert again == set(rows) and not again & {r["segment_id"] for r in made_tree(spark, version="v2").collect()}


def test_tree_violations(spark):
    schema = "segment_id string, doc_id int, type string, parent_id string, section_path string, anchor string, ordinal long, start int, end int, token_count long"
    rows = [
        ("r", 1, "SECTION", None, "root", "a", 0, 0, 9, None), ("s", 1, "SECTION", "r", "A", "a", 0, 0, 9, None), ("p", 1, "PASSAGE", "s", "A", "a", 0, 0, 5, 5), ("q", 1, "PASSAGE", "p", "A", "a", 0, 0, 5, 5),
        ("m", 1, "PASSAGE", "none", "A", "a", 0, 0, 5, 5), ("e", 1, "PASSAGE", "r", "A", "a", 0, 5, 5, 5), ("g", 1, "SECTION", "s", "A", "a", 1, 0, 9, None), ("x", 2, "SECTION", None, "root", "a", 0, 0, 9, None),
        ("y", 2, "SECTION", None, "root", "a", 1, 0, 9, None), ("d", 2, "PASSAGE", "x", "root", "a", 0, 0, 5, 5), ("d", 2, "PASSAGE", "x", "root", "a", 1, 5, 9, 5), ("o", 2, "PASSAGE", None, "root", "a", 0, 0, 5, 5),
    ]
    got = {(r["doc_id"], r["segment_id"]): r["violations"] for r in segments.tree_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "q"): ["parent is no section"], (1, "m"): ["missing parent"], (1, "e"): ["empty span"], (1, "g"): ["gap in ordinals"], (2, "x"): ["second root"], (2, "y"): ["second root"],
        (2, "d"): ["repeated id"], (2, "o"): ["passage without section"],
    }


def test_gates(spark, tmp_path):
    rows = [("s", "SECTION", None, "A", "a", None, None), ("p", "PASSAGE", "s", "A", "a", "Good one.", 400), ("q", "PASSAGE", "s", "A", "a", "cut in the", 400), ("r", "PASSAGE", "s", "A", "a", " ", 10), ("t", "PASSAGE", None, "A", "a", "Fine.", 950)]
    df = spark.createDataFrame(rows, "segment_id string, type string, parent_id string, section_path string, anchor string, text string, token_count long")
    facts = segments.write_gated(df, f"{tmp_path}/out")
    assert facts == {"passages": 4, "sections": 1, "empty": 1, "out_of_bounds": 2, "normal": 4, "mid_sentence": 1, "incomplete": 1}
    assert segments.gate_report(facts) == {"no_empty": False, "complete": False, "bounds": False, "sentences": False} and spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert all(segments.gate_report(segments.write_gated(df.limit(0), f"{tmp_path}/none")).values())


def words(text):
    return set((text or "").lower().split()) or {""}


def lineage_of(old, new, least):
    """Greedy over classes of equal texts, most similar first."""
    out = {}
    for doc in {d for d, *_ in old}:
        sides = []
        for rows in (old, new):
            of = defaultdict(list)
            for d, k, t in rows:
                if d == doc:
                    of[t or ""].append(k)
            sides.append({t: sorted(ks) for t, ks in of.items()})
        pairs = []
        for a, xs in sides[0].items():
            for b, ys in sides[1].items():
                s = len(words(a) & words(b)) / len(words(a) | words(b))
                if s >= least - 1e-9:
                    pairs.append((-s, a != b, xs[0], ys[0], a, b))
        left = [{t: list(ks) for t, ks in side.items()} for side in sides]
        for s, _, _, _, a, b in sorted(pairs):
            while left[0][a] and left[1][b]:
                out[doc, left[0][a].pop(0)] = left[1][b].pop(0), round(-s, 9)
    return {(d, k): out.get((d, k), (None, None)) for d, k, _ in old}


def test_text_lineage(spark):
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(25)]
    old = [(d, k, r.choice([None, "", "same line", " ".join(r.choices(vocabulary, k=r.randint(1, 9)))])) for d in range(12) for k in range(r.randint(0, 25))] + [(99, 1, "gone")]
    new = [(d, 500 - k, t if r.random() < 0.5 else f"{t or ''} {r.choice(vocabulary)}") for d, k, t in old if r.random() < 0.8 and d != 99] + [(98, 1, "fresh"), (3, 7, "same line"), (3, 8, "same line")]
    schema = "doc_id long, id long, text string"
    for least in (0.5, 0.8, 1.0):
        got = {(x["doc_id"], x["id"]): (x["successor"], None if x["similarity"] is None else round(x["similarity"], 9)) for x in lineage.text_lineage(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), least).collect()}
        assert got == lineage_of(old, new, least)
    assert lineage.text_lineage(spark.createDataFrame([], schema), spark.createDataFrame(new, schema)).count() == 0
    with pytest.raises(ValueError):
        lineage.text_lineage(spark.createDataFrame([], schema), spark.createDataFrame(new, schema), 0)
