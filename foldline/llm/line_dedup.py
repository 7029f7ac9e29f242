"""Line dedup by winnowing over line hashes.

Every window of ``run_lines`` consecutive lines selects its least line hash as a fingerprint, so two
copies of a run of that many lines always select the same one. Fingerprints seen at more than one
place are hits; from a hit the match extends to every window of lines around its position, and
windows whose lines also occur at an earlier place make up the later repeated runs. First places come
from aggregations, never from pairs, so a line in a third of all documents costs one row for each; the join
that brings them back has a table on either side, so that adaptive execution splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm._packs import table_files
from foldline.llm._shared import SPACE, SPACE_CHARS, in_files, let, written

_NO_ID = -(1 << 63)


def _hashes(line: Column) -> list[Column]:
    """Two 64-bit hashes of a line: together they tell lines apart, the first alone picks fingerprints."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def _lines(text: Column) -> Column:
    """Lines with a word: their line number, and hashes of the line without outer white space."""
    stripped = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.trim(x, F.lit(SPACE_CHARS)).alias("x"), i.alias("no")))
    return F.transform(F.filter(stripped, lambda y: y["x"] != ""), lambda y: F.struct(*_hashes(y["x"]), y["no"].alias("no")))


def _long_lines(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, no) of later repeats of single lines of at least ``words`` words."""
    split = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(F.trim(x, F.lit(SPACE_CHARS)).alias("x"), i.alias("no")))
    long = F.filter(split, lambda y: (F.length(y["x"]) >= 2 * words - 1) & (F.size(F.split(y["x"], f"[{SPACE}]+")) >= words))
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_text"),
        F.explode(F.transform(long, lambda y: F.struct(*_hashes(y["x"]), y["no"].alias("no")))).alias("l"),
    ).select("_id", "_text", "l.*")
    first = written(in_files(_firsts(lines, F.struct("_id", "no")), table_files(docs)), "firsts")
    return lines.join(first, ["h", "g"]).where(F.struct("_id", "no") > F.col("first")).select("_id", "_text", "no")


def _firsts(rows: DataFrame, place: Column) -> DataFrame:
    """(h, g, first): the least place of each key that occurs twice or more. Written before it is joined, so that a hot key's rows can be split."""
    return rows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")


def line_runs(docs: DataFrame, run_lines: int = 2, *, run_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _gone): line numbers to delete from each text that has any. See ``line_dedup``.

    The lines of a text are one small row of hashes, written once; what is taken from it for each position is cut inside the
    row, so a text of very many lines costs no more than its lines times ``run_lines``.
    """
    w, files = run_lines, table_files(docs)
    numbers = F.when(F.size("lines") >= w, F.sequence(F.lit(0), F.size("lines") - w)).otherwise(F.array().cast("array<int>"))
    least = let(F.col("lines"), lambda x: F.transform(numbers, lambda i: F.array_min(F.transform(F.slice(x, i + 1, w), lambda y, k: F.struct(y["h"].alias("h"), (i + k).alias("at"))))))
    picks = let(least, lambda p: F.filter(p, lambda v, i: (i == 0) | (v["at"] != F.get(p, i - 1)["at"])))  # a place is picked by windows in a row
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_text"), _lines(F.col(text_col)).alias("lines"))
    keyed = written(texts.where(F.size("lines") >= w).select("_id", "_text", "lines", picks.alias("picks")), "lines")
    picked = keyed.select("_id", "_text", F.explode("picks").alias("f")).select("_id", "_text", "f.h", "f.at")
    shared = written(in_files(picked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), files), "shared")
    hits = picked.join(shared, "h").groupBy("_id", "_text").agg(F.collect_set("at").alias("hits"))
    near = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(F.greatest(i - (w - 1), F.lit(0)), F.least(i, F.size("lines") - w)))))
    joined = keyed.select("_id", "_text", "lines").join(hits, ["_id", "_text"]).select("_id", "_text", "lines", near.alias("near"))
    of = lambda i, name: F.transform(F.slice("lines", i + 1, w), lambda y: y[name])
    windows = F.transform("near", lambda i: F.struct(F.xxhash64(of(i, "h")).alias("h"), F.xxhash64(of(i, "g")).alias("g"), i.alias("at"), of(i, "no").alias("nos")))
    placed = written(in_files(joined.select("_id", "_text", F.explode(windows).alias("p")).select("_id", "_text", "p.*"), files), "windows")
    first = written(in_files(_firsts(placed, F.struct("_id", "at")), files), "firsts")
    later = placed.join(first, ["h", "g"]).where((F.col("_id") > F.col("first._id")) | ((F.col("_id") == F.col("first._id")) & (F.col("at") >= F.col("first.at") + w)))
    gone = later.select("_id", "_text", F.explode("nos").alias("no"))
    if run_words is not None:
        gone = gone.union(_long_lines(docs, run_words, id_col, text_col))
    return gone.groupBy("_id", "_text").agg(F.array_sort(F.collect_set("no")).alias("_gone"))


def line_dedup(docs: DataFrame, run_lines: int = 2, *, run_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", out_col: str = "removed_lines") -> DataFrame:
    """Delete later repeats of runs of at least ``run_lines`` lines, and of single lines of at least ``run_words`` words if given; one row for each input row, all columns kept.

    Lines are split at ``\\n`` and compared without outer white space; lines without a word are
    neither compared nor deleted and do not end a run. A run is a later repeat if the same lines
    also occur in a document with a smaller id, or earlier in the same document without overlap.
    Deletions are judged on the input. ``text_col`` becomes the remaining lines; ``out_col`` gets the
    deleted line numbers (an existing column of that name is replaced). Null texts stay null and empty
    ones empty. A null id counts as the smallest; rows that repeat an id with the same text keep theirs alike.
    Lines are compared by 128 bits of hashes, which tell 10**12 lines apart but for a chance of 10**-15. An empty table
    gives no rows. A very long text is one row of 20 bytes a line while it is searched.
    """
    gone = line_runs(docs, run_lines, run_words=run_words, id_col=id_col, text_col=text_col)
    names = [c for c in docs.columns if c != out_col]
    keyed = docs.select(F.struct(*names).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_text"))
    lines = F.split(F.col("_row")[text_col], "\n", -1)
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"))
    joined = keyed.join(gone, ["_id", "_text"], "left")
    text = F.when(F.col("_gone").isNull(), F.col("_row")[text_col]).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names]
    return joined.select(*out, F.coalesce("_gone", F.array().cast("array<int>")).alias(out_col))
