"""Pages from several extractors: the page spine, routing, margins, and paragraphs that run over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.text import WS, not_blank, strip


def page_spine(pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx) for each page from 0 to the last one of any extractor."""
    last = pages.groupBy("doc_id").agg(F.max("page_idx").alias("last"))
    return last.select("doc_id", F.explode(F.sequence(F.lit(0), "last")).alias("page_idx"))


def placeholders(pages: DataFrame) -> DataFrame:
    """Candidates for the pages that no extractor returned: status error, one empty block of unknown type."""
    gaps = page_spine(pages).join(pages.select("doc_id", "page_idx").distinct(), ["doc_id", "page_idx"], "left_anti")
    return gaps.select("doc_id", "page_idx", F.lit("placeholder").alias("engine"), F.lit("error").alias("status"), F.concat(F.lit("placeholder_p"), "page_idx").alias("block_id"), F.lit("unknown").alias("type"), F.lit("").alias("text"))


def route_pages(pages: DataFrame, order: list[str], min_tokens: int = 25, errors: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_idx, extractor, text, fallback_reason) for each page of the spine.

    The first extractor of ``order`` with enough words wins, else the first with any text, else the first that
    returned the page, else an empty page in the primary's name. ``errors`` (doc_id, engine, error) tells why an
    extractor gave nothing for a document.
    """
    if not order:
        return page_spine(pages).select("*", F.lit("none").alias("extractor"), F.lit("").alias("text"), F.lit(None).cast("string").alias("fallback_reason"))
    primary = order[0]
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(f"[^{WS}]+"), F.lit(0)))
    tier = F.when(words >= max(0, min_tokens), 0).when(not_blank(text), 1).otherwise(2)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("engine"))
    best = pages.where(F.col("engine").isin(*order)).groupBy("doc_id", "page_idx").agg(
        F.min_by(F.struct("engine", text.alias("text")), F.struct(tier.alias("tier"), rank.alias("rank"))).alias("best"), F.max(F.col("engine") == primary).alias("seen")
    )
    rows = page_spine(pages).join(best, ["doc_id", "page_idx"], "left")
    if errors is not None:
        failed = errors.where(F.col("engine") == primary).groupBy("doc_id").agg(F.min("error").alias("error"))
        rows = rows.join(failed, "doc_id", "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    taken = F.coalesce("best.engine", F.lit(primary))
    named = F.lit(f"primary extractor '{primary}' ")
    reason = (
        F.when(taken == primary, F.lit(None)).when(F.col("error").isNotNull(), F.concat(named, F.lit("failed: "), "error"))
        .when(~F.coalesce("seen", F.lit(False)), F.concat(named, F.lit("did not return page "), "page_idx")).otherwise(F.concat(named, F.lit("returned low-content page "), "page_idx"))
    )
    return rows.select("doc_id", "page_idx", taken.alias("extractor"), F.coalesce("best.text", F.lit("")).alias("text"), reason.alias("fallback_reason"))


def signature(line: Column) -> Column:
    """Column: a line in lower case with runs of digits as ``#`` and single spaces. Apply ``nfkc`` first where texts may need it."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "#"), f"[{WS}]+", " "))


def strip_margins(pages: DataFrame, top: int = 2, share: float = 0.4) -> DataFrame:
    """(doc_id, page_idx, text) without leading lines whose signature opens at least two and ``share`` of the document's pages.

    Where a document has such lines, all its pages with text lose their empty lines. A signature of a page counts once;
    a document has at most ``top / share`` of them, so a document's set is small.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), strip), lambda x: x != "")
    rows = pages.select("doc_id", "page_idx", "text", lines.alias("lines"))
    opening = rows.select("doc_id", F.explode_outer(F.array_distinct(F.transform(F.slice("lines", 1, top), signature))).alias("sig"))
    counts = opening.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("n")).where("sig IS NOT NULL")
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2")
    repeated = counts.join(total, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share + 0.999)))
    known = repeated.groupBy("doc_id").agg(F.collect_set("sig").alias("known"))
    joined = rows.join(known, "doc_id", "left")
    n, hit = F.size("lines"), lambda i: F.coalesce(F.array_contains("known", signature(F.get("lines", F.lit(i)))), F.lit(False))
    gone = F.lit(0)
    for i in range(top):
        gone = F.when((gone == i) & (n > i) & hit(i), i + 1).otherwise(gone)
    cut = strip(F.array_join(F.slice("lines", gone + 1, F.greatest(n, F.lit(1))), "\n"))
    return joined.select("doc_id", "page_idx", F.when(F.col("known").isNull() | (n == 0), F.col("text")).otherwise(cut).alias("text"))


def merge_over_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, page_idx, type, text, n_merged) from blocks (doc_id, block_no in reading order, page_idx, type, text).

    A paragraph joins the one before it, with a space, if it lies on a later page than that one's start, begins in
    lower case, and the text before does not end a sentence.
    """
    at = Window.partitionBy("doc_id").orderBy("block_no")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.lag(c).over(at)
    goes_on = (F.col("type") == "para") & (before("type") == "para") & ~before("text").rlike("""[.?!:"']\\z""") & F.col("text").rlike(r"^\p{Ll}")
    rows = blocks.withColumn("run", F.sum(1 - F.coalesce(goes_on, F.lit(False)).cast("int")).over(upto))
    run = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("first_page", F.min("page_idx").over(run))
    heads = run.orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.max(F.when(F.col("page_idx") == F.col("first_page"), F.col("block_no"))).over(heads))
    found = rows.groupBy("doc_id", "head").agg(F.min("page_idx").alias("page_idx"), F.min_by("type", "block_no").alias("type"), F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("x"))
    return found.select("doc_id", F.col("head").alias("block_no"), "page_idx", "type", F.array_join(F.transform("x", lambda s: s["text"]), " ").alias("text"), F.size("x").alias("n_merged"))


def canonical_ranges(blocks: DataFrame) -> DataFrame:
    """Blocks with start_off and end_off in the canonical text: an empty line between blocks, a form feed between pages too."""
    at = Window.partitionBy("doc_id").orderBy("block_no")
    gap = F.when(F.lead("page_idx").over(at) != F.col("page_idx"), 5).otherwise(2)
    rows = blocks.withColumn("_gap", gap)
    start = F.coalesce(F.sum(F.length("text") + F.col("_gap")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start_off", start).withColumn("end_off", F.col("start_off") + F.length("text")).drop("_gap")


def last_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_idx, engine, position, ...): of those that an extractor returned twice, the one it returned last."""
    newest = Window.partitionBy("doc_id", "page_idx", "engine").orderBy(F.desc("position"))
    return pages.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def route_with_quick_pass(pages: DataFrame, default_order: list[str], scan_order: list[str] | None = None, *, quick: str = "pypdf", scan_chars: int = 80, min_tokens: int = 25, errors: DataFrame | None = None) -> DataFrame:
    """``route_pages`` by an order that depends on each page: ``scan_order`` where the ``quick`` extractor found under ``scan_chars`` characters.

    Returns doc_id, page_idx, extractor, text, fallback_reason, quick_chars, scan_likely, char_counts (map by extractor that
    returned the page), fallback_chain and extractor_errors (map of those in the chain). A page the quick pass lacks is likely a scan.
    """
    scan_order = scan_order or default_order
    length = F.length(strip(F.coalesce("text", F.lit(""))))
    by_page = pages.groupBy("doc_id", "page_idx").agg(F.coalesce(F.max(F.when(F.col("engine") == quick, length)), F.lit(0)).alias("quick_chars"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", length)))).alias("char_counts"))
    rows = page_spine(pages).join(by_page, ["doc_id", "page_idx"], "left").withColumn("quick_chars", F.coalesce("quick_chars", F.lit(0)))
    rows = rows.withColumn("scan_likely", F.col("quick_chars") < max(1, scan_chars))
    chain = lambda names: F.array(*map(F.lit, names))
    both = [route_pages(pages, order, min_tokens, errors).withColumn("scan_likely", F.lit(scan)) for scan, order in ((True, scan_order), (False, default_order))]
    out = rows.join(both[0].unionByName(both[1]), ["doc_id", "page_idx", "scan_likely"])
    out = out.withColumn("fallback_chain", F.when(F.col("scan_likely"), chain(scan_order)).otherwise(chain(default_order)))
    none = F.create_map().cast("map<string,string>")
    if errors is None:
        return out.withColumn("extractor_errors", none).withColumn("char_counts", F.coalesce("char_counts", F.create_map().cast("map<string,int>")))
    failed = errors.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "error")))).alias("_errors"))
    out = out.join(failed, "doc_id", "left").withColumn("extractor_errors", F.coalesce(F.map_filter("_errors", lambda k, _: F.array_contains("fallback_chain", k)), none)).drop("_errors")
    return out.withColumn("char_counts", F.coalesce("char_counts", F.create_map().cast("map<string,int>")))
