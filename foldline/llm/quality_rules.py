"""Quality rules as weak supervision: rules vote or abstain, and a latent-class model weighs them.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes what on good and on bad documents; the posterior of a
document's pattern decides. There are at most 3 ** rules patterns, so only those counts reach the driver,
whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm._shared import SPACE, let, word_array

RULES = ("symbols", "capitals", "word_length", "dup_lines", "repeats", "shouting", "pipes", "sentences", "letters")

#: Prior shares of the votes bad, abstain, good on bad and on good documents, and the weight of this prior as a share of all documents.
PRIOR = {0: (0.4, 0.2, 0.4), 1: (0.01, 0.1, 0.89)}
PRIOR_WEIGHT = 0.2


def text_stats(text: Column) -> Column:
    """Column: struct of counts over the whole text; null counts as empty.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to
    an earlier one), n_repeat_words (words inside three-word windows found twice or more), n_lines
    (lines with a word), n_capitals, n_shouts (exclamation marks), n_pipes (words that are one
    pipe), n_ends (words ending a sentence), n_letters.
    """
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    def stats(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.array_join(w, ""))).alias("word_chars"),
            long(without(r"[#*$%&|<>]+")).alias("n_symbols"),
            let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            long(_repeat_words(w)).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            long(without(r"\p{Lu}+")).alias("n_capitals"),
            long(without(r"!+")).alias("n_shouts"),
            long(F.size(F.filter(w, lambda x: x == "|"))).alias("n_pipes"),
            long(F.size(F.filter(w, lambda x: x.endswith(".")))).alias("n_ends"),
            long(without(r"\p{L}+")).alias("n_letters"),
        )

    return let(word_array(text), stats)


def _repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more; in n log n of the words."""
    n = F.size(w)
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    )

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.array_sort(F.transform(F.filter(
            F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))
        added = lambda p: F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, twice), added))

    return let(windows, covered)


def votes(s: Column) -> list[Column]:
    """One vote for each of RULES from a struct of ``text_stats``."""
    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)

    share = lambda a, b: F.when(b > 0, a / b)
    symbols, capitals = share(s["n_symbols"], s["word_chars"]), share(s["n_capitals"], s["word_chars"])
    length, dups = share(s["word_chars"], s["n_words"]), F.when(s["n_lines"] >= 2, s["n_dup_lines"] / s["n_lines"])
    repeats, shouts = share(s["n_repeat_words"], s["n_words"]), share(s["n_shouts"], s["n_words"])
    pipes, ends = share(s["n_pipes"], s["n_words"]), F.when(s["n_words"] >= 30, s["n_ends"] / s["n_words"])
    letters = share(s["n_letters"], s["word_chars"])
    return [
        vote(symbols, symbols < 0.02, symbols > 0.1),
        vote(capitals, capitals < 0.15, capitals > 0.4),
        vote(length, (length > 3) & (length < 8.5), (length < 2) | (length > 12)),
        vote(dups, dups == 0, dups > 0.3),
        vote(repeats, repeats < 0.1, repeats > 0.3),
        vote(shouts, shouts < 0.02, shouts > 0.15),
        vote(pipes, pipes < 0.02, pipes > 0.15),
        vote(ends, (ends > 0.02) & (ends < 0.3), ends < 0.002),
        vote(letters, letters > 0.9, letters < 0.8),
    ]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def pattern(s: Column) -> Column:
    """The votes as one number of base three."""
    code = F.lit(0)
    for v in votes(s):
        code = code * 3 + (v + 1)
    return code.cast("int")


def fit(pattern_counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation.

    PRIOR, weighed as a share of all documents, says that rules seldom vote bad on good documents;
    it fixes which class is which and behaves alike at every size.
    """
    m, weight = len(RULES), 1 + PRIOR_WEIGHT * sum(pattern_counts.values())
    codes = {c: [(c // 3 ** (m - 1 - k)) % 3 for k in range(m)] for c in pattern_counts}
    post = {c: 0.95 if 0 not in v else 0.05 if v.count(0) > 1 else 0.5 for c, v in codes.items()}
    for _ in range(rounds):
        total = {0: 1.0, 1: 1.0}
        seen = {y: [[weight * x for x in PRIOR[y]] for _ in range(m)] for y in (0, 1)}
        for c, n in pattern_counts.items():
            for y, p in ((1, post[c]), (0, 1 - post[c])):
                total[y] += n * p
                for k, v in enumerate(codes[c]):
                    seen[y][k][v] += n * p
        for c, v in codes.items():
            score = {y: math.log(total[y]) + sum(math.log(seen[y][k][x] / sum(seen[y][k])) for k, x in enumerate(v)) for y in (0, 1)}
            top = max(score.values())
            good, bad = math.exp(score[1] - top), math.exp(score[0] - top)
            post[c] = good / (good + bad)
    return post


def fitted(stats: DataFrame, stats_col: str = "stats") -> dict[int, float]:
    """``fit`` on the patterns of all rows. At most 3 ** len(RULES) counts reach the driver."""
    rows = stats.groupBy(pattern(F.col(stats_col)).alias("pattern")).count().collect()
    return fit({r["pattern"]: r["count"] for r in rows})


def with_posterior(stats: DataFrame, post: dict[int, float], *, stats_col: str = "stats", out_col: str = "posterior") -> DataFrame:
    """``stats`` with the posterior of each row's pattern; 0.5 for a pattern that was not seen. The table that is broadcast has at most 3 ** len(RULES) rows."""
    table = stats.sparkSession.createDataFrame(sorted(post.items()), "_pattern int, _good double")
    rows = stats.withColumn("_pattern", pattern(F.col(stats_col))).join(F.broadcast(table), "_pattern", "left")
    return rows.withColumn(out_col, F.coalesce("_good", F.lit(0.5))).drop("_pattern", "_good")


def quality_rules(docs: DataFrame, post: dict[int, float], *, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """Adds ``out_col``: struct of the stats, base_failed, posterior (double) and kept (boolean).

    A document is kept unless it has under 50 words or over half of its words in repeated three-word
    windows, and its posterior is at least one half. Null and empty texts are not kept. All columns
    and rows stay, repeated ones included; an existing ``out_col`` is replaced. An empty table gives no rows. A very long text
    costs n log n of its words, in one row.
    """
    names = [c for c in docs.columns if c != out_col]
    rows = docs.select(F.struct(*names).alias("_row"), text_stats(F.col(text_col)).alias("_stats"))
    judged, s = with_posterior(rows, post, stats_col="_stats", out_col="_posterior"), F.col("_stats")
    full = s.withField("base_failed", base_failed(s)).withField("posterior", F.col("_posterior")).withField("kept", ~base_failed(s) & (F.col("_posterior") >= 0.5))
    return judged.select(*[F.col("_row")[c].alias(c) for c in names], full.alias(out_col))
