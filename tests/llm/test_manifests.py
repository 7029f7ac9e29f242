"""The conversation trie, the Merkle manifest and the licence scan against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("foldline.llm.queries")
from foldline.llm import license_scan as L  # noqa: E402
from foldline.llm import merkle as M  # noqa: E402
from foldline.llm import queries  # noqa: E402
from foldline.llm._ranks import ranked  # noqa: E402
from foldline.llm._shared import written  # noqa: E402
from foldline.llm.conversation_trie import conversation_trie, prefix_trie, turn_rows  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, pos long, n long, digest string, depth long, name string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, pos long, proof string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def crc(k):
    return zlib.crc32(str(k).encode())


def test_ranked_crosses_tasks(spark):
    rows = written(spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 700)) AS key", "(id * 7919) % 5003 AS v"), "rows")
    placed, sizes = ranked(rows, "key", ["v"], "placed")
    want = defaultdict(list)
    for r in rows.collect():
        want[r["key"]].append(r["v"])
    got = defaultdict(dict)
    for r in placed.collect():
        got[r["key"]][r["pos"]] = r["v"]
    assert {k: [x[i] for i in range(len(x))] for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert {r["key"]: r["n"] for r in sizes.collect()} == {k: len(x) for k, x in want.items()}


def turns_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(t)] for c, t in own.items()}


def rebuilt_of(own):
    out = {}
    for c, t in own.items():
        h = crc(c) % 9
        out[c] = own.get(c - c % 5, [])[:h] + t[h:]
    return out


def nodes_of(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in children[p])
    ends = {p: sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))) for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], ends[p]) for p, m in members.items()
    )


def node_rows(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def conversations():
    r = random.Random(5)
    out = []
    for c in [*range(60), 101, 102, 207, 10**12 + 1]:
        for t in range(r.choice([0, 1, 2, 3, 8])):
            out.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bé", "", None])))
    out += [(5, None, "system", "first"), (5, None, "system", "first"), (7, 1, "user", "tie"), (7, 1, "user", "eit"), (None, 0, "user", "lost")]
    out += [(70, t, "user", f"turn {t % 3}") for t in range(150)] + [(72, t, "user", f"turn {t % 3}") for t in range(149)]  # 70 is the base of 72
    out += [(80 + k, t, "user", f"same {t}" * 300) for k in range(5) for t in range(12)]
    return out


def test_conversation_trie(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, 9, 9, "d", 9, "n") for x in rows], TURNS)
    assert node_rows(conversation_trie(df)) == nodes_of(rebuilt_of(turns_of(rows)))
    plain = turns_of(rows)
    assert node_rows(prefix_trie(*turn_rows(df))) == nodes_of(plain)
    assert conversation_trie(df.limit(0)).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7)]  # no bases: those with h >= 1 keep nothing
    got = node_rows(conversation_trie(spark.createDataFrame([(*x, 9, 9, "d", 9, "n") for x in rows], TURNS)))
    assert got == nodes_of(rebuilt_of(turns_of(rows))) and got[0][1] == 0 and got[0][3] == 6


def leaf_of(doc, lower=False):
    doc_id, source, lang, n_chars, text = doc
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(parts))


def up(nodes):
    return [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def siblings(levels, p):
    """(before, after) of the path from place p to the root."""
    out = []
    for nodes in levels[:-1]:
        a = p - p % 8
        out.append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + 8])))
        p //= 8
    return out


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def merkle_of(docs):
    trees = defaultdict(list)
    for d in docs:
        trees["0" if d[2] is None else "1" + d[2]].append(d)
    for t in trees.values():
        t.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
    low = {k: levels_of([leaf_of(d) for d in t]) for k, t in trees.items()}
    order = sorted(trees, key=str.encode)
    top = levels_of([low[k][-1][0] for k in order])
    out = []
    for k, t in trees.items():
        for p, d in enumerate(t):
            path = siblings(low[k], p) + siblings(top, order.index(k))
            now = leaf_of(d, lower=d[0] is not None and crc(d[0]) % 3 == 0)
            for a, b in path:
                now = sha(a + now + b)
            out.append((-1 if d[0] is None else d[0], leaf_of(d), low[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out)


def digest_rows(df):
    out = df.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), ""), 256).alias("p"), "folded_root", "verified")
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out.collect())


def manifest_docs():
    langs = [f"l{k}" for k in range(11)] + ["é", "", None]
    out = [(k, f"s{k % 3}" if k % 4 else None, langs[k % len(langs)], k if k % 5 else None, f"Text {k}" if k % 7 else None) for k in range(200)]
    out += [(1000 + k, "s", "en", 3, "ABC" if k % 2 else "abc") for k in range(4200)]  # over one block of leaves
    return out + [out[3], (None, None, None, None, None), (None, "s", "en", 1, ""), (5000000, "s", "one", 2, "Word " * 60000), (4, "other", "l4", 1, "x")]


@pytest.fixture(scope="module")
def manifest_df(spark):
    return written(spark.createDataFrame([(*d, "a", "b", 1, "c") for d in manifest_docs()], DOCS), "docs")


def test_merkle_manifest(manifest_df):
    got = digest_rows(M.merkle_manifest(manifest_df, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0))
    assert got == merkle_of(manifest_docs())
    assert {r[-1] for r in got} == {True, False}


def test_merkle_small_tables(spark, manifest_df):
    assert M.merkle_manifest(manifest_df.limit(0)).count() == 0
    one = [(7, "s", "en", 1, "T")]
    got = digest_rows(M.merkle_manifest(spark.createDataFrame([(*one[0], "a", "b", 1, "c")], DOCS)))
    assert got[0][1] == got[0][2] == got[0][3] == leaf_of(one[0]) and got[0][4] == sha("") and got[0][6]


def test_proofs_of_some_leaves(spark, manifest_df):
    leaves, nodes, trees = M.manifest(manifest_df)
    every = {(r["doc_id"], r["leaf"]): r["proof"] for r in M.prove(leaves, nodes, trees).collect()}
    wanted = spark.createDataFrame([(k,) for k in [*range(0, 60, 7), 1001, 1002, 3000, 5190, 5199, 5000000, 4]], "doc_id long")
    some = M.prove(leaves, nodes, trees, wanted=wanted).withColumn("back", M.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(some) == 9 + 6 + 2 and all(r["proof"] == every[r["doc_id"], r["leaf"]] and r["back"] == r["root"] for r in some)


def test_missing_is_least():
    r = random.Random(1)
    for _ in range(200):
        n = r.choice([1, 2, 8, 9, 64, 65, 700])
        places = r.sample(range(n), r.randint(1, min(n, 12)))
        need = M.missing(places, n)
        levels = levels_of([sha(str(k)) for k in range(n)])
        found = M.climb({p: levels[0][p] for p in places}, 0, n, 64, {(k, p): levels[k][p] for k, p in need})
        assert found[-1] == {0: levels[-1][0]}
        given = {(0, p) for p in places} | set(need)
        for level, place in need:  # none of them follows from the rest
            below = [(level - 1, c) for c in range(place * 8, min(place * 8 + 8, len(levels[level - 1])))] if level else []
            assert not below or not all(x in given for x in below)
        assert len(need) == len(set(need)) and not {(0, p) for p in places} & set(need)


LICENCES = [
    None, "", "---", "Under the MIT  License, and under-the-mit-license", "cc by nc cc by nc by nc", "CC BY\nNC_sa xcc by nc cc by ncé cc by nc",
    "apache license version 2.0 Apache License, Version 20", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception */",
    "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\n// spdx-license-identifier: MIT", "SPDX-License-Identifier: (MIT OR", "SPDX-License-Identifier: MIT is the licence",
    "This work is licensed under the GNU General Public License, version 3.", "cc by nc " * 50000, "SPDX-License-Identifier: Some-Thing-9.9", "the licence of this text is not named", "SPDX-License-Identifier:",
    "(SPDX-License-Identifier: MIT)", "K K under the mıt license under the mit license",
]


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark, tmp_path):
    rows = [*enumerate(LICENCES), (3, LICENCES[3]), (None, "cc by nc")]
    spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, places string, n_words long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_license_scan(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    base = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key)
    assert base == sorted(((k, *base_of(t)) for k, t in rows), key=key)
    of = {r["doc_id"]: r for r in got}
    assert (of[7]["labels"], of[7]["score"]) == ("apache-2,gpl-3,mit", 0.1) and of[7]["n_expressions"] == 1
    assert (of[8]["labels"], of[8]["score"], of[8]["n_expressions"]) == ("gpl-2,mit", 0.35, 2)
    assert (of[9]["labels"], of[9]["score"]) == ("", L.UNKNOWN) and (of[10]["labels"], of[10]["score"]) == ("mit", 0.1)
    assert (of[11]["labels"], of[11]["score"]) == ("gpl,gpl-3", 0.7) and (of[13]["labels"], of[13]["score"]) == ("some-thing-9.9", L.UNKNOWN)
    assert (of[12]["n_base"], of[12]["last_word"]) == (50000, 149997)
    assert all(of[k]["score"] == 0 and of[k]["labels"] == "" for k in (0, 1, 2, 14, 15)) and of[16]["labels"] == "mit"
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_expressions_against_python():
    """Random expressions: the parser's choice equals Python's own reading of the same expression as max and min."""
    r = random.Random(3)
    ids = ["MIT", "GPL-3.0-only", "MPL-2.0", "CC-BY-NC-4.0", "Odd-1.0"]

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            return [r.choice(ids)]
        x = [*made(depth - 1), r.choice(["AND", "or"]), *made(depth - 1)]
        return ["(", *x, ")"] if r.random() < 0.5 else x

    class Degree(float):
        __and__ = lambda a, b: Degree(max(a, b))
        __or__ = lambda a, b: Degree(min(a, b))

    for _ in range(300):
        tokens = made(4)
        text = " ".join({"AND": "&", "or": "|", "(": "(", ")": ")"}.get(t) or f"Degree({L.restriction(L.label_of(t))})" for t in tokens)
        assert L.evaluated(L.postfix(tokens))[0] == eval(text, {"Degree": Degree})
    assert L.postfix(["MIT", "AND"]) is None and L.postfix(["(", "MIT"]) is None and L.postfix(["OR", "MIT"]) is None
    assert L.evaluated(L.postfix("GPL-2.0 WITH X OR MIT AND CC-BY-NC-4.0".split())) == (0.35, ["gpl-2"])
    assert [L.label_of(x) for x in ("MIT", "Apache-2.0", "GPL-3.0-or-later", "CC-BY-NC-4.0", "LGPL-2.1+", "BSD-3-Clause")] == ["mit", "apache-2", "gpl-3", "cc-by-nc", "lgpl-2.1", "bsd-3-clause"]
