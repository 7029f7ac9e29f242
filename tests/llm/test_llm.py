"""Operators against brute force on a small fixture with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("foldline.llm.queries")
import corpus_pipeline  # noqa: E402
from foldline.llm._shared import written  # noqa: E402
from foldline.llm.bpe import bpe_decode, bpe_encode  # noqa: E402
from foldline.llm.exact_dedup import exact_dedup  # noqa: E402
from foldline.llm.line_dedup import line_dedup  # noqa: E402
from foldline.llm.lm_scoring import _level, held_out, level_counts, lm_scores  # noqa: E402
from foldline.llm.minhash import near_duplicates  # noqa: E402
from foldline.llm.mixing import fit_budget, mix  # noqa: E402
from foldline.llm.pii import find_private  # noqa: E402
from foldline.llm.quality_classifier import classify, word_scales  # noqa: E402
from foldline.llm.quality_rules import fitted, quality_rules, text_stats  # noqa: E402
from foldline.llm.queries import vocabulary  # noqa: E402
from foldline.llm.substring_dedup import substring_dedup  # noqa: E402

PASSAGE = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    None, "", " \t\n ", "one", PASSAGE, f"a b {PASSAGE} c", PASSAGE + " end", "Mail me@x.org now\nline two\nline three",
    "zero\nline two\nline three\n\nfour", "x " * 3000, "same text", "same  text", "é😀 <|endoftext|> \x85 'll ...", " ".join(f"w{i}" for i in range(39)),
]
SCHEMA = "doc_id long, text string, source string, lang string, n long, size long, pack long, stats string, label string"


def rows():
    out = [(k, t, f"s{k % 3}" if k % 5 else None, "en" if k % 2 else None, k, k, k, "x", "y") for k, t in enumerate(TEXTS)]
    return [*out, out[5]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(rows(), SCHEMA), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return written(spark.createDataFrame([], SCHEMA), "empty")


def test_substring_dedup(docs, empty):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(docs).collect())
    words = sorted((k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, *_ in rows())
    first = {}
    for k, w in words:
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    want = []
    for k, w in words:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        want.append((k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == sorted(want)
    assert substring_dedup(empty).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(vocabulary()), vocabulary()
    got = sorted((r["doc_id"], list(r["ids"]), r["decoded"]) for r in bpe_decode(bpe_encode(docs, path), path).collect())
    want = [(k, t.encode(x or "", add_special_tokens=False).ids) for k, x, *_ in rows()]
    assert got == sorted((k, ids, t.decode(ids, skip_special_tokens=False)) for k, ids in want)
    assert got == sorted((r["doc_id"], list(r["ids"]), r["out"]) for r in bpe_encode(docs, path, decoded_col="out").collect())
    assert bpe_encode(empty, path).count() == 0


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got[0] == (0, 0) and got[2] == (0, 2) and got[3] == (1, 3)
    assert got[10] == got[11] == (1, 10)
    assert [got[k][1] for k in (4, 5, 6, 13)] == [4, 4, 4, 4]
    assert near_duplicates(empty).count() == 0


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: r for r in line_dedup(docs).collect()}
    assert got[8]["text"] == "zero\n\nfour" and got[8]["removed_lines"] == [1, 2] and got[7]["text"] == TEXTS[7]
    assert got[0]["text"] is None and got[8]["pack"] == 8
    assert line_dedup(docs).count() == len(rows()) and line_dedup(empty).count() == 0


def test_long_single_lines(spark):
    long = " ".join(f"w{i}" for i in range(50))
    texts = [f"a\n{long}\nb", f"c\n {long}\t\nshort\n{long}\nd", long, "short", long + " x", None, "\n\n"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, d.select(*columns), "").collect()}
    assert kept == {0: texts[0], 1: "c\nshort\nd", 2: "", 3: "short", 4: texts[4], 5: None, 6: "\n\n"}
    assert {r["doc_id"]: r["text"] for r in line_dedup(d).collect()}[2] == long


def test_exact_dedup(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/d.parquet")
    got = {r["doc_id"]: r for r in exact_dedup(spark, f"{tmp_path}/d.parquet").collect()}
    assert (got[11]["keep_id"], got[11]["group_size"], got[11]["kept"]) == (10, 2, False)
    assert (got[1]["keep_id"], got[1]["group_size"]) == (0, 2) and got[2]["keep_id"] == 2 and got[5]["group_size"] == 2
    assert got[2]["text_sha256"] == hashlib.sha256(b" ").hexdigest()


def test_lm_scores(docs, empty):
    got = {r["doc_id"]: r for r in lm_scores(docs, bits=1 << 20).collect()}
    assert got[0]["n_tokens"] == 1 and got[9]["n_tokens"] == 3001 and all(r["score"] <= 0 for r in got.values())
    shared = [got[k] for k in (4, 5, 6, 13)]  # one passage: its pairs are worth more than its words alone
    assert sum(r["score"] for r in shared) > sum(r["base_score"] for r in shared)
    assert lm_scores(empty, bits=1 << 20).count() == 0


def test_lm_scores_keep_every_pair(spark, docs):
    many = [(k, " ".join(f"v{k}x{i}" for i in range(400)), None, None, k, k, k, "x", "y") for k in range(20, 60)]
    wide = written(docs.union(spark.createDataFrame(many, SCHEMA)), "wide")
    least, most = (sorted((r["doc_id"], round(r["score"], 6)) for r in lm_scores(wide, bits=b).collect()) for b in (1 << 10, 1 << 26))
    assert least == most  # some 16,000 pairs; the filter grows past 1,024 bits instead of leaving pairs out

    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]

    texts = [(k, tokens(t)) for k, t, *_ in [*rows(), *many]]
    trained = [t for k, t in texts if not held_out([k])[0]]
    word, pair = Counter(w for t in trained for w in t), Counter(p for t in trained for p in zip([None, *t[:-1]], t, strict=True))
    n = sum(word.values())

    def score(t):
        out = 0.0
        for a, b in zip([None, *t[:-1]], t, strict=True):
            c = min(float(level_counts(_level(np.array([pair[a, b]])))[0]) if pair[a, b] else 0.0, word[a], word[b])
            out += np.log10((c + 100 * (word[b] + 0.5) / (n + 0.5 * (len(word) + 1))) / (word[a] + 100))
        return out

    assert np.allclose([s for _, s in most], [s for _, s in sorted((k, score(t)) for k, t in texts)], atol=1e-5)


def test_quality(docs, empty):
    stats = docs.select(text_stats(F.col("text")).alias("stats"))
    got = {r["doc_id"]: r["quality"] for r in quality_rules(docs, fitted(stats)).collect()}
    assert not got[0]["kept"] and got[9]["base_failed"] and got[9]["n_repeat_words"] == 3000
    assert quality_rules(empty, fitted(empty.select(text_stats(F.col("text")).alias("stats")))).count() == 0


def test_fit_budget_is_exact_where_possible():
    assert sum(n * k for n, k in zip([3, 5, 7], fit_budget([3, 5, 7], [4, 2, 3], 31), strict=True)) == 31
    assert fit_budget([4], [3], 7) == [1] and fit_budget([4], [3], 99) == [3]


def test_mix(docs, empty):
    got = mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["size"] * r["times"]
        target[r["source"]] = r["target"]
        assert 0 <= r["times"] <= 2
    assert len(got) == len(rows()) and abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mix(docs).collect())) and mix(empty).count() == 0


def test_find_private(docs, empty):
    got = {r["doc_id"]: r["spans"] for r in find_private(docs).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[7]] == [("email", 5, 13)] and got[0] == []
    assert find_private(empty).count() == 0


def test_private_terms(spark):
    long = "y" * 300
    texts = [f"plain filler number{k} here" for k in range(40)]
    copied = ["zorblax wrote 10.0.0.1 first", "so 10.0.0.1 zorblax second", "third zorblax 10.0.0.1"]
    texts += copied + copied[:1] * 60  # copies must not hide the term
    texts += [f"n{k} mailbox u{k}@x.org q{k}" for k in range(5)]  # no value repeats, the kind does
    texts += ["quux 10.9.9.9 a b c d e f g h quux 10.9.9.9 i j k l m n o p quux 10.9.9.9"]  # evidence in one text
    texts += [f"r{k} snark {long} {long} +1 212 555 010{k}" for k in range(3)]  # beyond 200 characters
    texts += [f"tel:+44 20 7946 095{k} s{k}" for k in range(3)]  # a part of a word that adjoins the entity
    d = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "private")
    got = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]} for r in find_private(d).collect()}
    want = {k: set() for k in range(len(texts))}
    for k, t in enumerate(texts):
        want[k] = {w for w in ("zorblax", "mailbox", "quux", "snark", long, "tel:") if k >= 40 and w in t}
    assert got == want


def test_classify(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k > 6), 0) for k in range(14)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["quality"] <= 1 for r in got)
    assert classify(empty, labels).count() == 0


def test_word_scales_ignore_chance():
    doc, col = np.array([*range(40), 45]), np.array([7] * 40 + [9])
    scale = word_scales(doc, col, np.array([0] * 40 + [1] * 40, float))
    assert scale[7] > 1 and scale[9] == 0 and scale[-1] == 1
