import math

import pytest
from pyspark.sql import functions as F

from foldline.jobs import catalogue
from foldline.operators import candidates, chunking, retrieval, structure


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_top_k_ranks_and_rejects_bad_k(spark):
    d = docs(spark, "a cat sat", "retrieval augmented generation and semantic ranking", "gardening", None)
    assert retrieval.top_k(d, "semantic retrieval for rag", 2, "doc_id", "text").first()["doc_id"] == 1
    with pytest.raises(ValueError):
        retrieval.top_k(d, "x", 0, "doc_id", "text")
    scores = {r["doc_id"]: r["score"] for r in retrieval.cosine_scores(d, "cat cat", "doc_id", "text").collect()}
    assert scores[3] == 0 and math.isclose(scores[0], 1 / math.sqrt(3))


def test_blocks_and_sections(spark):
    text = "# A\n\npara\n- one\nmore\n\n| x |\n```\ncode\n\n# no\n```\n## B\n### C\n## D\n1. x\n```open"
    found = structure.blocks(docs(spark, text, "", None)).orderBy("doc_id", "block_idx")
    kinds = [(r["type"], text[r["start_off"] : r["end_off"]]) for r in found.collect()]
    assert kinds == [
        ("heading", "# A"), ("para", "para"), ("list", "- one\nmore"), ("table", "| x |"), ("code", "```\ncode\n\n# no\n```"),
        ("heading", "## B"), ("heading", "### C"), ("heading", "## D"), ("list", "1. x"), ("code", "```open"),
    ]
    paths = [(r["section_path"], r["parent_idx"]) for r in structure.headings(found).orderBy("block_idx").collect()]
    assert paths == [("A", None), ("A>B", 0), ("A>B>C", 5), ("A>D", 0)]


@pytest.mark.parametrize("target,overlap,least", [(10, 3, 4), (5, 5, 2), (7, 0, 3)])
def test_char_windows_match_a_loop(spark, target, overlap, least):
    texts = ["", None, "short", "  abcdefghij klmnop  qrst ", "x" * 23, "a b c d e f g h i j k"]

    def loop(t):
        s, o = (t or "").strip(), overlap if overlap < target else target // 4
        out, at = [], 0
        while len(s) <= target and not at or at < len(s):
            out.append(s[at : at + target].strip())
            if at + target >= len(s):
                break
            at += target - o
        out = [x for x in out if x]
        if len(out) > 1 and len(out[-1]) < least:
            out[-2:] = [(out[-2] + "\n" + out[-1]).strip()]
        return out

    rows = docs(spark, *texts).select("doc_id", chunking.char_windows(F.col("text"), target, overlap, least).alias("x")).collect()
    assert {r["doc_id"]: r["x"] for r in rows} == {k: loop(t) for k, t in enumerate(texts)}


def test_page_selection_reasons(spark):
    def rows(marker, mineru):
        signal = lambda e, s, n: (0, 0, e, s, n, 1, 1, 0.0, 0, False, 0)
        return spark.createDataFrame([signal("marker", *marker), signal("mineru", *mineru)], "doc_id int, page_idx int, engine string, status string, char_count int, block_count int, line_count int, duplicate_line_ratio double, heading_like_count int, has_coords boolean, asset_count int")

    def pick(marker, mineru, force=None):
        return tuple(candidates.select_pages(rows(marker, mineru), force).select("selected_engine", "reason").first())

    assert pick(("error", 0), ("timeout", 0)) == (None, "all_failed")
    assert pick(("ok", 50), ("error", 0)) == ("marker", "only_one_ok")
    assert pick(("empty", 0), ("empty", 0)) == ("marker", "all_empty_prefer_marker")
    assert pick(("ok", 50), ("ok", 1000)) == ("mineru", "highest_score")
    assert pick(("ok", 50), ("ok", 50)) == ("marker", "score_tie_break_marker")
    assert pick(("ok", 1000), ("ok", 50), "mineru") == ("mineru", "forced_by_config")
    assert pick(("ok", 1000), ("error", 50), "mineru") == ("marker", "only_one_ok")


def test_clamped_spans(spark):
    d = spark.createDataFrame([("Short.", -1, 3), ("Short.", 0, 0), ("Short.", 2, 20), ("   ", 0, 3)], "text string, start int, end int")
    assert [tuple(r) for r in chunking.clamp_spans(d).select("passage", "start_off", "end_off").collect()] == [("Sho", 0, 3), ("ort.", 2, 6)]


def test_block_spans_cover_the_whole_text(spark):
    text = "\n\n".join(f"paragraph {k} " + "x" * 90 for k in range(40))
    found = docs(spark, text, None, "")
    got = chunking.cut_spans(found, catalogue.block_spans(found)).orderBy("start_off").collect()
    assert len(got) == 40 and got[0]["start_off"] == 0 and got[-1]["end_off"] == len(text) > 2000
    assert "\n\n".join(r["passage"] for r in got) == text


def test_spans_of_a_very_long_text(spark):
    text = "".join(f"line {k} é😀\n\n" for k in range(40000))
    found = docs(spark, text)
    got = chunking.cut_spans(found, catalogue.block_spans(found)).orderBy("start_off").collect()
    assert len(got) == 40000 and all(r["passage"] == text[r["start_off"] : r["end_off"]] for r in got)
