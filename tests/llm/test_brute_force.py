"""Operators against plain Python on small fixtures."""

import importlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("foldline.llm.queries")
import corpus_pipeline  # noqa: E402
from foldline.llm import minhash  # noqa: E402
from foldline.llm._shared import written  # noqa: E402
from foldline.llm.exact_dedup import _pattern, exact_dedup  # noqa: E402
from foldline.llm.line_dedup import line_dedup  # noqa: E402
from foldline.llm.lm_scoring import held_out, lm_scores  # noqa: E402
from foldline.llm.minhash import near_duplicates  # noqa: E402
from foldline.llm.mixing import fit_budget, mix  # noqa: E402
from foldline.llm.pii import entity_spans, find_private, sanitised  # noqa: E402
from foldline.llm.quality_classifier import site_posteriors  # noqa: E402
from foldline.llm.quality_rules import PRIOR, PRIOR_WEIGHT, RULES, fit, text_stats  # noqa: E402
from foldline.llm.queries import vocabulary  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall(t or "")


def texts(seed, n, vocabulary=400, length=120):
    """Texts with near copies, exact copies, repeated lines, short and empty ones."""
    rng = random.Random(seed)
    out = [None, "", " \n", "one two"]
    while len(out) < n:
        base = [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(rng.randint(8, length))]
        for _ in range(rng.choice((1, 1, 1, 6))):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            cut = sorted({0, len(own), *(rng.randrange(len(own)) for _ in range(3))})
            out.append("\n".join(" ".join(own[a:b]) + "." * rng.randrange(2) for a, b in itertools.pairwise(cut)))
    return out[:n]


def table(spark, found, name, source=lambda k: f"s{k % 4}" if k % 5 else None):
    return written(spark.createDataFrame([(k, t, "en", source(k), 0) for k, t in enumerate(found)], COLUMNS), name)


def shingles(t, k=5):
    w = words((t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(found, percent):
    """Smallest key that each key of ``found`` (key: text) reaches."""
    sets = {k: shingles(t) for k, t in found.items()}
    root = {k: k for k in found}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(found), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: top(k) for k in found}


def test_near_duplicates_lose_no_link(spark):
    found = dict(enumerate(texts(5, 220)))
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    for k in range(220, 300):  # a dense group in which many are similar to each other but not to its centre
        own = list(base)
        for at in rng.sample(range(len(own)), rng.choice((1, 2, 3, 4))):
            own[at] = f"y{rng.randrange(40)}"
        found[k] = " ".join(own)
    rows = [*found.items(), (None, found[4]), (None, "never seen " * 3), (7, found[7])]
    d = written(spark.createDataFrame(rows, "doc_id long, text string"), "near")
    for percent, options in ((85, {}), (80, {"bands": 32})):
        got = near_duplicates(d, percent=percent, **options).collect()
        want = components(found, percent)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == sorted([str(want[4]), "None"])
        assert len(got) == len(rows) and {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] is not None} == {k: len(shingles(t)) for k, t in found.items()}


def test_templated_pages_form_no_pairs_of_all(spark, monkeypatch):
    """Pages of one template with as much of their own: compared pairs grow with their number; edits of a page, and chains of edits, are found all the same."""
    r = random.Random(9)
    template = [f"t{k}" for k in range(200)]
    seen = {}

    def spy(df, name):
        out = written(df, name)
        if name == "pairs":
            seen["pairs"] = seen.get("pairs", 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "written", spy)
    pairs = []
    for n in (60, 120, 240):
        seen.clear()
        pages = [template + [f"p{k}x{j}" for j in range(66)] for k in range(n)]
        for _ in range(n // 6):  # edits of pages and of edits
            page = list(r.choice(pages))
            for _ in range(2):
                page[r.randrange(len(page))] = f"e{r.random()}"
            pages.append(page)
        found = {k: " ".join(p) for k, p in enumerate(pages)}
        df = written(spark.createDataFrame(list(found.items()), "doc_id long, text string"), "docs")
        got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df).collect()}
        assert got == components(found, 85)
        pairs.append(seen["pairs"])
    assert pairs[2] < 3 * pairs[1] < 9 * pairs[0] and pairs[2] < 20 * 280


def test_small_tables_are_a_few_files(spark, monkeypatch):
    """Also where the session has many shuffle partitions and does not merge small ones."""
    lines, files = importlib.import_module("foldline.llm.line_dedup"), []

    def spy(df, name):
        out = written(df, name)
        files.append(len(out.inputFiles()))
        return out

    for at in (minhash, lines):
        monkeypatch.setattr(at, "written", spy)
    base = [[f"t{k}x{j}" for j in range(90)] for k in range(40)]
    found = {k: " ".join([*base[k % 40], f"own{k}"]) + f"\n{k % 9} a\n{k % 9} b" for k in range(200)}
    d = written(spark.createDataFrame(list(found.items()), "doc_id long, text string"), "docs")
    few = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        assert {x["doc_id"]: x["component_id"] for x in near_duplicates(d).collect()} == {k: k % 40 for k in found}
        assert sum(len(x["removed_lines"]) for x in line_dedup(d, 2).collect()) == 2 * (len(found) - 9)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 20 and max(files) <= spark.sparkContext.defaultParallelism


def test_base_scores(spark):
    found = texts(3, 60)
    docs = [[*words((t or "").lower()), None] for t in found]
    seen = Counter(w for k, t in enumerate(docs) if not held_out([k])[0] for w in t)
    n, v = sum(seen.values()), len(seen)
    for r in lm_scores(table(spark, found, "lm")).collect():
        t = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(seen[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)


def stats(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics_and_fit(spark):
    found = [*texts(4, 80, vocabulary=12), "a b a b a b a", "é😀 # | x\nx\n x\nx", "| a | b |\n" * 4]
    got = {r["doc_id"]: r["s"] for r in table(spark, found, "stats").select("doc_id", text_stats(F.col("text")).alias("s")).collect()}
    for k, t in enumerate(found):
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == stats(t), t
    counts, m = {int("212120110", 3): 40, int("222222222", 3): 300, int("000111000", 3): 60, int("202012021", 3): 25, int("111111111", 3): 5}, len(RULES)
    votes = np.array([[c // 3 ** (m - 1 - k) % 3 for k in range(m)] for c in counts])
    n, weight = np.array(list(counts.values()), float), 1 + PRIOR_WEIGHT * sum(counts.values())
    p = np.array([0.95 if 0 not in v else 0.05 if (v == 0).sum() > 1 else 0.5 for v in votes])
    for _ in range(50):
        score = []
        for y, q in ((0, 1 - p), (1, p)):
            share = np.stack([[weight * PRIOR[y][x] + (n * q * (votes[:, k] == x)).sum() for x in range(3)] for k in range(m)])
            share /= share.sum(axis=1, keepdims=True)
            score.append(np.log(1 + (n * q).sum()) + sum(np.log(share[k][votes[:, k]]) for k in range(m)))
        p = 1 / (1 + np.exp(score[0] - score[1]))
    assert np.allclose(list(fit(counts).values()), p, atol=1e-9) and p[1] > 0.99 > 0.01 > p[2]


def test_budgets_are_met_exactly_where_they_can_be():
    rng = random.Random(2)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 6)))
        counts = [rng.randint(1, 5) for _ in lengths]
        budget = rng.randint(0, min(4 * lengths[-1], sum(n * k for n, k in zip(lengths, counts, strict=True))))
        sums = {0}
        for n, k in zip(lengths, counts, strict=True):
            sums = {x + j * n for x in sums for j in range(k + 1)}
        got = fit_budget(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(got, counts, strict=True))
        assert sum(n * k for n, k in zip(lengths, got, strict=True)) == max(x for x in sums if x <= budget)
    lengths, counts = list(range(1, 4000, 7)), [3] * 572  # far more words than any fixed capacity
    total = sum(lengths) * 3
    assert sum(n * k for n, k in zip(lengths, fit_budget(lengths, counts, total // 3), strict=True)) == total // 3


def test_mix_meets_its_targets(spark):
    found = texts(6, 160)
    source = lambda k: "big" if k % 2 else ("a", "b", None)[k % 3]
    got = mix(table(spark, found, "mix", source), keep=("text", "size", "target")).collect()
    assert "text" in got[0] and len(got[0]) == len(set(got[0].asDict())) == 7
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(words(found[r["doc_id"]])) and 0 <= r["times"] <= 2
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["times"]
        target[r["source"]] = r["target"]
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), itertools.cycle((3, 1, 2)), strict=False))
    want, full, left = {}, set(), 1.5 * sum(size.values())
    while True:  # as the contract has it: stop at twice the size, share the excess again
        rest = [s for s in size if s not in full]
        want |= {s: (left - sum(2 * size[f] for f in full)) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if want[s] > 2 * size[s]}
        if not over:
            break
        full |= over
        want |= {s: 2.0 * size[s] for s in over}
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= 2


def test_site_posteriors_shrink_sparse_sites(spark):
    rng = np.random.default_rng(1)
    rows = [("h1", "p1", float(x)) for x in rng.normal(2, 1, 400)] + [("h1", "p2", -3.0)] * 3 + [("h2", "p1", float(x)) for x in rng.normal(-2, 1, 300)] + [("h3", "p1", -5.0)]
    got = {(r["host"], r["path"]): r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    by_path, by_host = defaultdict(list), defaultdict(list)
    for h, p, e in rows:
        by_path[h, p].append(1 / (1 + math.exp(-e)))
        by_host[h].append(1 / (1 + math.exp(-e)))

    def strength(groups, centre):
        n = {g: len(x) for g, x in groups.items()}
        spread = sum(n[g] * (sum(x) / n[g] - centre(g)) ** 2 for g, x in groups.items()) / sum(n.values())
        inside = sum(n[g] * centre(g) * (1 - centre(g)) for g in groups) / sum(n.values())
        noise = sum(centre(g) * (1 - centre(g)) for g in groups) / sum(n.values())
        return min(max(inside / max(spread - noise, 1e-6) - 1, 1.0), 10_000.0)

    prior = sum(map(sum, by_host.values())) / len(rows)
    k = strength(by_host, lambda _: prior)
    host = {h: (sum(x) + k * prior) / (len(x) + k) for h, x in by_host.items()}
    k = strength(by_path, lambda g: host[g[0]])
    for g, x in by_path.items():
        assert math.isclose(got[g]["host_posterior"], host[g[0]], rel_tol=1e-9) and math.isclose(got[g]["path_posterior"], (sum(x) + k * host[g[0]]) / (len(x) + k), rel_tol=1e-9)
    assert abs(host["h3"] - prior) < abs(by_host["h3"][0] - prior) and got["h1", "p2"]["path_posterior"] > sum(by_path["h1", "p2"]) / 3


KIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in KIND.items():
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_private_spans(spark):
    rng = random.Random(11)
    pieces = ["a.b@c.de", "x@y", "@", "..@a.b.", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (212) 555-0101", "+4 4", "+12345678901234567", "é😀", " ", "-", ".", "1", "22", "u_1%@h-1.x"]
    found = ["".join(rng.choice(pieces) + rng.choice(("", " ", "\n")) for _ in range(rng.randint(1, 14))) for _ in range(400)] + [None, ""]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["s"] if s["kind"] in KIND] for r in table(spark, found, "spans").select("doc_id", entity_spans(F.col("text")).alias("s")).collect()}
    assert got == {k: base_spans(t) for k, t in enumerate(found)}


def test_disclosing_terms(spark):
    rng = random.Random(12)
    found = [" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(60)]
    found += [f"w{rng.randrange(60)} call agent{k % 2} w{rng.randrange(60)} 10.0.0.{k % 3} w1 w2 end w{rng.randrange(60)}" for k in range(9)] + [f"token = k{k}{'ab12' * 9} w{k}" for k in range(4)]
    found += found[60:62] * 5  # copies change nothing
    near, threshold, support = 3, 0.75, 3
    ip, secret = re.compile(KIND["ip"]), re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{24,}")
    once = sorted(set(found))
    places, has = defaultdict(set), defaultdict(set)
    where = defaultdict(list)
    for t in once:
        for kind, pattern in (("ip", ip), ("secret", secret)):
            for m in pattern.finditer(t):
                left, right = [x for x in WORD.finditer(t[: m.start()])][-near:], [x for x in WORD.finditer(t, m.end())][:near]
                for e in ((kind,), (kind, m[0])):
                    has[e].add(t)
                    for x in left + right:
                        if not ip.search(x[0]) and not secret.search(x[0]):
                            places[e, x[0].lower()].add((t, m.start()))
                            where[t].append((e, x[0].lower(), x.start(), x.end()))
    own = lambda e: math.log2(len(once) / len(has[e]))
    holds = lambda w: sum(w in words(t.lower()) for t in once)
    flagged = set()
    for (e, w), at in places.items():
        pmi = math.log2(len(once) * len({t for t, _ in at}) / (len(has[e]) * holds(w)))
        if len(at) >= support and pmi > 0 and pmi >= threshold * own(e):
            flagged.add((e, w))
    want = {k: sorted({(a, b) for e, w, a, b in where[t] if (e, w) in flagged}) for k, t in enumerate(found)}
    assert any(len(e) == 1 for e, _ in flagged) and any(w == "token" for _, w in flagged) and any(want.values())
    d = table(spark, found, "terms")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in find_private(d, near=near, threshold=threshold, support=support).collect()}
    assert got == want
    clean = {r["doc_id"]: r["text"] for r in sanitised(d, near=near, threshold=threshold, support=support).collect()}
    assert clean[0] == found[0] and clean[69].startswith("<SECRET TERM> <SECRET TERM> <SECRET>") and "10.0.0" not in " ".join(clean.values()) and len(clean) == len(found)


def test_very_long_texts(spark):
    lines = [f"line number {k} of a long text" for k in range(20_000)]
    d = written(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[10_000:] + ["other"])), (3, None)], "doc_id long, text string"), "long")
    assert {r["doc_id"]: len(r["removed_lines"]) for r in line_dedup(d).collect()} == {1: 0, 2: 10_000, 3: 0}
    mails = " ".join(f"write to u{k}@mail.example.com today" for k in range(4_000))
    d = written(spark.createDataFrame([(1, mails), (2, "plain words"), (3, "and others")], "doc_id long, text string"), "mails")
    assert {r["doc_id"]: len(r["spans"]) for r in find_private(d).collect()} == {1: 4_000, 2: 0, 3: 0}


def test_exact_dedup_answers_from_its_state(spark, tmp_path):
    first = spark.createDataFrame([(5, "a  b"), (6, "c"), (None, "d")], "doc_id long, text string")
    late = spark.createDataFrame([(7, "a b"), (3, "c"), (9, "new"), (9, "new"), (1, None)], "doc_id long, text string")
    first.write.parquet(f"{tmp_path}/in 1")
    late.write.parquet(f"{tmp_path}/late/")
    state = f"{tmp_path}/state"
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(spark, f"{tmp_path}/in 1", checkpoint=state).collect()}
    assert got == {5: (5, 1, True), 6: (6, 1, True), None: (None, 1, True)}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(spark, f"{tmp_path}/late/", checkpoint=state).collect()}
    assert got == {7: (5, 2, False), 3: (3, 2, True), 9: (9, 2, True), 1: (1, 1, True)}
    assert _pattern("/a/b.parquet") == "/a/b.parque[t]" and _pattern("/a/b-/") == "/a/b{-}"
    with pytest.raises(ValueError):
        _pattern("/a/b[1]")


def test_exact_dedup_exchanges_texts_once(spark, tmp_path, monkeypatch):
    """Also where the hits are too many to broadcast; texts of earlier files are exchanged once more, to be picked."""
    at, plans = importlib.import_module("foldline.llm.exact_dedup"), []

    def spy(df, name):
        if name == "classes":
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            plans.append(df._jdf.queryExecution().explainString(mode))
        return written(df, name)

    monkeypatch.setattr(at, "written", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for run, ids in (("one", range(0, 40)), ("two", range(40, 80))):
            spark.createDataFrame([(k, f"text  {k % 25} ") for k in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/{run}")
            got = exact_dedup(spark, f"{tmp_path}/{run}", checkpoint=f"{tmp_path}/state").collect()
            seen = range(ids[-1] + 1)
            for r in got:
                same = [k for k in seen if k % 25 == r["doc_id"] % 25]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), r["doc_id"] == same[0])
            assert sorted(r["doc_id"] for r in got) == list(ids)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*_text#", p)) for p in plans] == [1, 2]


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    line = lambda n: " ".join(rng.choice(("the", "of", "reader", "house", "garden", "walks", "slowly", f"word{rng.randrange(300)}")) for _ in range(n)) + "."
    found = ["\n".join(line(rng.randint(8, 14)) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    found += [found[3], found[4].replace("house", "home", 1), found[5] + "\n" + "\n".join(found[6].split("\n")[1:4]), "too short", None, "# | $ * # | $ " * 40, line(60) + "\n" + line(20)]
    found.append("\n".join(["short", line(30), found[-1].split("\n")[0], line(40)]))
    found += ["\n".join([line(60)] * 2), found[7].replace("\n", " ")]
    table(spark, found, "pipe").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, docs, "").collect())
    assert kept == [k for k, t in enumerate(found) if t is not None and stats(t)[0] >= 50 and 2 * stats(t)[4] <= stats(t)[0] and "$" not in t]
    left, seen_runs, seen_long = {}, {}, {}
    for k in kept:  # documents in order of their ids; all is judged on the input
        rows = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(found[k].split("\n"))]
        rows = [x for x in rows if x[1]]
        gone = set()
        for p, (a, b) in enumerate(itertools.pairwise(rows)):
            first = seen_runs.setdefault((a[1], b[1]), (k, p))
            if first[0] < k or p >= first[1] + 2:
                gone |= {a[0], b[0]}
        for i, x in rows:
            if len(words(x)) >= 50 and seen_long.setdefault(x, (k, i)) != (k, i):
                gone.add(i)
        left[k] = "\n".join(x for i, x in enumerate(found[k].split("\n")) if i not in gone)
    near = components(left, 80)
    stay = {k: t for k, t in left.items() if near[k] == k}
    assert len(stay) < len(kept) < len(found) and any(left[k] != found[k] for k in kept)
    t, times, taken, sizes = Tokenizer.from_file(vocabulary()), Counter(), Counter(), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert list(r["ids"]) == t.encode(stay[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        times[r["doc_id"]] += 1
    source = lambda k: f"s{k % 4}" if k % 5 else None
    for k, text in stay.items():
        taken[source(k)] += times[k] * len(words(text))
        sizes[source(k)] += len(words(text))
    assert max(times.values()) <= 2 and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)
