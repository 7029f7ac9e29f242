"""Candidates of several extraction engines for each page: signals, scores, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.text import WS, strip

#: The weights of the score.
WEIGHTS = {"chars": 1.0, "blocks": 0.2, "dups": 2.0, "coords": 0.3, "headings": 0.2, "assets": 0.1}


def page_signals(pages: DataFrame) -> DataFrame:
    """Signals of (doc_id, page_idx, engine, text): one text block for each page, without coordinates and assets.

    char_count counts code points that are no white space; the line signals cover stripped lines that are not empty.
    """
    found = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: x != "")
    rows = pages.select("doc_id", "page_idx", "engine", F.length(F.regexp_replace("text", f"[{WS}]+", "")).alias("char_count"), found.alias("lines"), F.col("text").startswith("#").cast("int").alias("heading_like_count"))
    n = F.size("lines")
    return rows.select("doc_id", "page_idx", "engine", "char_count", F.lit(1).alias("block_count"), n.alias("line_count"), F.when(n == 0, 0.0).otherwise((n - F.size(F.array_distinct("lines"))) / n).alias("duplicate_line_ratio"), "heading_like_count", F.lit(False).alias("has_coords"), F.lit(0).alias("asset_count"))


def score() -> Column:
    """Column: score of a candidate from its signals."""
    w = WEIGHTS
    return (
        w["chars"] * F.log1p("char_count") + w["blocks"] * F.log1p("block_count") - w["dups"] * F.col("duplicate_line_ratio")
        + w["coords"] * F.col("has_coords").cast("int") + w["headings"] * F.log1p("heading_like_count") + w["assets"] * F.log1p("asset_count")
    )


def select_pages(candidates: DataFrame, force: str | None = None) -> DataFrame:
    """(doc_id, page_idx, selected_engine, reason) from candidates with signals and a status.

    A forced engine that succeeded wins; without any success nothing is selected; one alone that is ok, or all
    empty, is settled by status and priority; else the best score wins, ties within 1e-9 by priority.
    """
    priority = F.when(F.col("engine") == "marker", 0).when(F.col("engine") == "mineru", 1).otherwise(2)
    page = Window.partitionBy("doc_id", "page_idx")
    ok, empty = (F.sum((F.col("status") == x).cast("int")).over(page) for x in ("ok", "empty"))
    forced = F.max(((F.col("engine") == F.lit(force)) & F.col("status").isin("ok", "empty")).cast("int")).over(page) if force else F.lit(0)
    rows = candidates.select("*", score().alias("score"), priority.alias("priority"), ok.alias("n_ok"), empty.alias("n_empty"), forced.alias("n_forced"))
    tier = F.when((F.col("n_forced") == 1) & (F.col("engine") == F.lit(force)), 0).when(F.col("status") == "ok", 1).when(F.col("status") == "empty", 2).otherwise(3)
    order = page.orderBy("tier", F.desc("score"), "priority")
    ranked = rows.withColumn("tier", tier).withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).withColumn("next_tier", F.lead("tier").over(order))
    tied = (F.col("next_tier") == 1) & (F.abs(F.col("score") - F.col("next")) <= F.greatest(1e-9 * F.greatest(F.abs("score"), F.abs("next")), F.lit(1e-9)))
    first = Window.partitionBy("doc_id", "page_idx", "tier").orderBy("priority")
    ranked = ranked.withColumn("by_priority", F.first("engine").over(first))
    reason = (
        F.when(F.col("tier") == 0, "forced_by_config").when(F.col("tier") == 3, "all_failed")
        .when((F.col("tier") == 2) & (F.col("n_empty") == 1), "only_one_empty").when(F.col("tier") == 2, F.concat(F.lit("all_empty_prefer_"), "by_priority"))
        .when(F.col("n_ok") == 1, "only_one_ok").when(tied, F.concat(F.lit("score_tie_break_"), "engine")).otherwise("highest_score")
    )
    engine = F.when(F.col("tier") == 3, F.lit(None)).when(F.col("tier") == 2, F.col("by_priority")).otherwise(F.col("engine"))
    return ranked.where("rn = 1").select("doc_id", "page_idx", engine.alias("selected_engine"), reason.alias("reason"))


def selection_log(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(doc_id, page_idx, selected_engine, reason, scores, statuses, signals): why each page's engine was selected, with maps by engine; signals are all other columns of ``candidates``.

    Pages without a selection have the reason ``unknown``.
    """
    signals = F.struct(*[c for c in candidates.columns if c not in ("doc_id", "page_idx", "engine", "status", "text")]).alias("signals")
    by = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", value))))
    found = candidates.withColumn("_score", score()).groupBy("doc_id", "page_idx").agg(by("_score").alias("scores"), by("status").alias("statuses"), by(signals).alias("signals"))
    joined = found.join(selected, ["doc_id", "page_idx"], "left")
    return joined.select("doc_id", "page_idx", "selected_engine", F.coalesce("reason", F.lit("unknown")).alias("reason"), "scores", "statuses", "signals")


def engine_counts(selected: DataFrame) -> DataFrame:
    """(doc_id, selected_engine, n_pages) of pages with a selection."""
    return selected.where("selected_engine IS NOT NULL").groupBy("doc_id", "selected_engine").agg(F.count(F.lit(1)).alias("n_pages"))


def engine_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, engine_runs): engine and status of each run (doc_id, engine, status, started) in the order they started, as an array of structs."""
    ordered = F.array_sort(F.collect_list(F.struct("started", "engine", "status")))
    return runs.groupBy("doc_id").agg(F.transform(ordered, lambda r: F.struct(r["engine"].alias("engine"), r["status"].alias("status"))).alias("engine_runs"))


def with_extractor(chunks: DataFrame, selected: DataFrame, default: str) -> DataFrame:
    """``chunks`` (doc_id, page_idx, ...) with extractor: the engine selected for their page, else ``default``."""
    engines = selected.select("doc_id", "page_idx", F.col("selected_engine").alias("extractor"))
    return chunks.join(engines, ["doc_id", "page_idx"], "left").withColumn("extractor", F.coalesce("extractor", F.lit(default)))


def block_signals(blocks: DataFrame, *keys: str) -> DataFrame:
    """Signals of each page from its blocks (doc_id, page_idx, engine, type, text, has_coords, asset); ``keys`` default to doc_id, page_idx, engine.

    Rows with a null type are assets only. has_coords is whether more than half of the blocks have coordinates; line
    signals cover the stripped lines of all blocks that are not empty, each block's lines as a small array.
    """
    keys = keys or ("doc_id", "page_idx", "engine")
    text = F.when(F.col("type").isNotNull(), F.col("text"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")
    rows = blocks.select(*keys, "type", "asset", F.length(F.regexp_replace(text, f"[{WS}]+", "")).alias("chars"), lines.alias("lines"), "has_coords", text.startswith("#").alias("hash"))
    is_block, all_lines = F.col("type").isNotNull(), F.flatten(F.collect_list("lines"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    found = rows.groupBy(*keys).agg(
        F.coalesce(F.sum("chars"), F.lit(0)).alias("char_count"), count(is_block).alias("block_count"), all_lines.alias("lines"), count(is_block & ((F.col("type") == "heading") | F.col("hash"))).alias("heading_like_count"),
        count(is_block & F.col("has_coords")).alias("_boxes"), F.count("asset").alias("asset_count"),
    )
    n = F.size("lines")
    return found.select(*keys, "char_count", "block_count", n.alias("line_count"), F.when(n == 0, 0.0).otherwise((n - F.size(F.array_distinct("lines"))) / n).alias("duplicate_line_ratio"), "heading_like_count", (2 * F.col("_boxes") > F.col("block_count")).alias("has_coords"), "asset_count")
