"""Block structure of Markdown-like texts: lines, blocks, headings, anchors.

Every operator works on one key, (doc_id, line or block number), so one exchange on doc_id serves all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.text import WS



def _doc():
    return Window.partitionBy("doc_id")


FENCE = "```"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start) of each line of ``text``; offsets count code points. Null texts have none."""
    split = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = _doc().orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return split.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_idx, type, start_off, end_off, level, text) of headings, code, tables, lists and paragraphs.

    Blank lines separate blocks. A fence runs to the next one or the end. A list takes the plain lines
    that follow its first item; a paragraph ends where any other kind begins.
    """
    at = _doc().orderBy("line_no")
    rows = lines(docs).withColumn("fences", F.sum(F.col("line").startswith(FENCE).cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    fence = F.col("line").startswith(FENCE)
    kind = (
        F.when(fence | ((F.col("fences") - fence.cast("int")) % 2 == 1), "code")
        .when(~F.col("line").rlike(f"[^{WS}]"), "blank")
        .when(F.col("line").rlike(rf"^#{{1,6}}[{WS}]+[^\n]"), "heading")
        .when(F.col("line").startswith("|"), "table")
        .when(F.col("line").rlike(rf"^(- |\p{{Nd}}+\.[{WS}])"), "list")
        .otherwise("para")
    )
    rows = rows.withColumn("kind", kind)
    group = (
        F.when(F.col("kind") == "code", F.concat(F.lit("code"), F.ceil(F.col("fences") / 2)))
        .when(F.col("kind") == "heading", F.concat(F.lit("heading"), "line_no"))
        .when(F.col("kind").isin("list", "para"), F.lit("text"))
        .otherwise(F.col("kind"))
    )
    rows = rows.withColumn("grp", group)
    change = (F.col("grp") != F.lag("grp").over(at)).cast("int")
    rows = rows.withColumn("island", F.sum(F.coalesce(change, F.lit(1))).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("listed", F.max((F.col("kind") == "list").cast("int")).over(inside))
    rows = rows.where("kind <> 'blank'").withColumn("type", F.when(F.col("grp") == "text", F.when(F.col("listed") == 1, "list").otherwise("para")).otherwise(F.col("kind")))
    found = rows.groupBy("doc_id", "island", "listed", "type").agg(
        F.min("start").alias("start_off"), F.max(F.col("start") + F.length("line")).alias("end_off"), F.min_by("line", "line_no").alias("first"),
    )
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("first", "^#+", 0)))
    text = F.when(F.col("type") == "heading", F.regexp_replace(F.regexp_replace("first", rf"^#+[{WS}]+", ""), rf"[{WS}]+\z", ""))
    return found.select("doc_id", (F.row_number().over(_doc().orderBy("start_off")) - 1).alias("block_idx"), "type", "start_off", "end_off", level.alias("level"), text.alias("text"))


def outline(found: DataFrame) -> DataFrame:
    """``blocks`` with parent_idx, the heading that a block hangs below, and section_path, the headings above joined by ``>`` (a heading's own included)."""
    upto = _doc().orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("block_idx", "text")), ignorenulls=True).over(upto).alias(f"l{k}") for k in range(1, 7)]
    rows = found.select("*", *last)
    level = F.coalesce("level", F.lit(7))
    idx = lambda k: F.coalesce(F.col(f"l{k}.block_idx"), F.lit(-1))
    open_ = [(idx(k) >= 0) & (F.lit(k) <= level) & ((idx(k) > F.greatest(*[idx(j) for j in range(1, k)], F.lit(-1))) if k > 1 else F.lit(True)) for k in range(1, 7)]
    parent = F.greatest(*[F.when(open_[k - 1] & (F.lit(k) < level), idx(k)).otherwise(-1) for k in range(1, 7)])
    path = F.array_join(F.filter(F.array(*[F.when(open_[k - 1], F.col(f"l{k}.text")) for k in range(1, 7)]), lambda x: x.isNotNull()), ">")
    return rows.select(*found.columns, F.when(parent >= 0, parent).alias("parent_idx"), path.alias("section_path"))


def headings(found: DataFrame) -> DataFrame:
    """(doc_id, block_idx, level, text, parent_idx, section_path) from ``blocks``: each heading hangs below the last shallower one."""
    return outline(found.where("type = 'heading'").select("doc_id", "block_idx", "level", "text"))


def anchored(found: DataFrame) -> DataFrame:
    """``blocks`` with stable anchors: text of headings made distinct, section_path, sec_anchor, ordinal, pass_anchor.

    The second heading of one text below one parent gets the suffix ``_0``, the third ``_1``; an empty one is called
    ``heading``. Blocks before any heading are in the section ``root``. ordinal counts the blocks of a section, and
    with its type and section gives pass_anchor; headings have neither. All windows share one partitioning by doc_id.
    """
    named = found.withColumn("text", F.when(F.col("type") == "heading", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit("heading"))))
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_idx", "level", "text").orderBy("block_idx"))
    ranked = outline(named).withColumn("nth", nth).drop("parent_idx", "section_path")
    ranked = ranked.withColumn("text", F.when(F.col("level").isNotNull() & (F.col("nth") > 1), F.concat("text", F.lit("_"), F.col("nth") - 2)).otherwise(F.col("text")))
    rows = outline(ranked).withColumn("section_path", F.when(F.col("section_path") == "", "root").otherwise(F.col("section_path")))
    digest = lambda *x: F.substring(F.sha2(F.concat(*x), 256), 1, 32)
    rows = rows.withColumn("sec_anchor", digest(F.col("doc_id").cast("string"), F.col("section_path")))
    rows = rows.withColumn("ordinal", F.when(F.col("level").isNull(), F.col("nth") - 1)).drop("nth")
    return rows.withColumn("pass_anchor", digest(F.col("sec_anchor"), F.col("type"), F.col("ordinal").cast("string")))


def section_anchors(found: DataFrame) -> DataFrame:
    """(doc_id, section_path, sec_anchor, first_idx) from ``anchored``: each path of a document once, with its first block."""
    return found.groupBy("doc_id", "section_path", "sec_anchor").agg(F.min("block_idx").alias("first_idx"))


def doc_anchor(doc_id):
    """Column: stable anchor of a document."""
    return F.substring(F.sha2(doc_id.cast("string"), 256), 1, 32)
