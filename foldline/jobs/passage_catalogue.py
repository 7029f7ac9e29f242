"""Registered queries over anchors, fenced code, passages, selection logs and engine payloads, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.jobs import catalogue
from foldline.jobs.catalogue import _BLOCKS, _CANDIDATES, _LINES, _candidates, _docs, _strip, marked_up
from foldline.jobs.page_catalogue import _IS_CODE, _JUDGED, _LANGUAGE, _NL, _RAW
from foldline.operators import adapters, candidates, chunking, code, passages, structure


def _long(*names: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in names]


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the marked-up documents, with headings cut to their first letter so that many repeat."""
    found = structure.blocks(marked_up(_docs(spark, sf_dir)))
    return structure.anchored(found.withColumn("text", F.substring("text", 1, 1)))


def dup_heading_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir).where("type = 'heading'").select("doc_id", *_long("block_idx", "level"), "text", F.md5("section_path").alias("path_md5"))


def section_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_anchors(_anchored(spark, sf_dir)).select("doc_id", "sec_anchor", *_long("first_idx"))


def block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir).where("type <> 'heading'").select("doc_id", *_long("block_idx", "ordinal"), "type", "pass_anchor")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the marked-up documents with their whole headings."""
    return structure.anchored(structure.blocks(marked_up(_docs(spark, sf_dir))))


def heading_anchors_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).where("type = 'heading'").select("doc_id", *_long("block_idx", "level"), F.md5("text").alias("text_md5"), F.md5("section_path").alias("path_md5"), "sec_anchor")


def block_anchors_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).where("type <> 'heading'").select("doc_id", *_long("block_idx", "ordinal"), "type", "pass_anchor")


def coded(docs: DataFrame) -> DataFrame:
    """The documents' lines with code, empty lines and fences by line number."""
    def line(x, i):
        return (
            F.when(i % 11 == 10, F.concat(F.lit("```\n"), x, F.lit("\n  ```"))).when(i % 6 == 0, F.concat(F.lit("const x = {"), x, F.lit("};")))
            .when(i % 6 == 3, F.lit(" ")).when(i % 6 == 4, F.concat(F.lit("    return foo("), x, F.lit(");"))).otherwise(x)
        )

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


def fence_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.fence_code(coded(_docs(spark, sf_dir))).select("doc_id", F.md5("text").alias("text_md5"), *_long("n_fenced"))


def selection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir)
    log = candidates.selection_log(found, candidates.select_pages(found))
    rows = log.select("doc_id", *_long("page_idx"), "selected_engine", "reason", "statuses", F.explode("scores").alias("engine", "score"))
    return rows.select("doc_id", "page_idx", "selected_engine", "reason", "engine", F.col("statuses")[F.col("engine")].alias("status"), F.round("score", 9).alias("score"))


def engine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.engine_counts(candidates.select_pages(_candidates(spark, sf_dir)))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as passages, ten a section; the score is the share of the letter e."""
    rows = structure.lines(_docs(spark, sf_dir)).where("line <> ''")
    e = F.length("line") - F.length(F.translate("line", "e", ""))
    return rows.select("doc_id", F.floor(F.col("line_no") / 10).alias("section"), F.col("line_no").cast("long").alias("passage"), F.concat_ws("-", "doc_id", "line_no").alias("passage_id"), F.size(F.split("line", " ")).cast("long").alias("n_tokens"), (e / F.length("line")).alias("score"))


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.neighbours(_passages(spark, sf_dir)).select("doc_id", "passage", "prev_id", "next_id")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.context_budget(_passages(spark, sf_dir), 300, 4).select("doc_id", "section", "passage", *_long("context_no"))


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.lines(_docs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("id"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("line")).cast("long").alias("end"))
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / 400).cast("int"))
    windows = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"), F.explode(starts).alias("k")).select("doc_id", F.col("k").cast("long").alias("id"), (F.col("k") * 400).cast("long").alias("start"), F.least(F.col("k") * 400 + 500, "n").cast("long").alias("end"))
    found = passages.overlaps(lines, windows, ["doc_id"])
    return found.select("doc_id", F.col("a").alias("line_no"), F.col("b").alias("window_no"), "n_shared")


def chunk_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunks(_docs(spark, sf_dir))
    return passages.length_percentiles(found, F.length("text"), [50, 90], "page_idx").select(*_long("page_idx", "n"), "p50", "p90")


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.length("text").alias("n"))
    new = docs.where("n % 7 <> 1 OR n IS NULL").select("doc_id", F.when(F.col("n") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return passages.snapshot_changes(docs.where("n % 3 <> 1 OR n IS NULL"), new, "doc_id", "text")


def adapt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Text", "SectionHeader", "Table", "ListItem", "Picture", "Form")))
    blocks = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        F.concat(F.lit("/page/"), F.floor(i / 10) + 1, F.lit("/b/"), i).alias("id"), F.get(kinds, i % 6).alias("block_type"), F.translate(x, "&<>", "").alias("html")))
    payloads = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(blocks.alias("blocks"))).alias("payload"))
    found = adapters.payload_blocks(payloads)
    return found.select("doc_id", *_long("page_idx", "block_no"), "block_id", "type", "asset", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (
    dup_heading_suffix, section_anchors, block_anchors, fence_code, selection_log, engine_counts, neighbors, context_budget, span_overlaps,
    chunk_length_percentiles, snapshot_changes, adapt_blocks, heading_anchors_whole, block_anchors_whole,
)}
_ANCHORS = f"""WITH RECURSIVE {_BLOCKS},
    h0 AS (SELECT doc_id, block_idx, length(regexp_extract(first, '^#+')) AS level, substr({_strip("regexp_replace(first, '^#+[[:space:]]+', '')")}, 1, 1) AS raw FROM blocks WHERE type = 'heading'),
    h1 AS (SELECT a.*, CASE WHEN raw = '' THEN 'heading' ELSE raw END AS name, (SELECT max(b.block_idx) FROM h0 b WHERE b.doc_id = a.doc_id AND b.block_idx < a.block_idx AND b.level < a.level) AS parent_idx FROM h0 a),
    h2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_idx, level, name ORDER BY block_idx) AS nth FROM h1),
    h3 AS (SELECT *, CASE WHEN nth = 1 THEN name ELSE name || '_' || (nth - 2) END AS text FROM h2),
    r AS (SELECT doc_id, block_idx, level, text, text AS path FROM h3 WHERE parent_idx IS NULL
        UNION ALL SELECT c.doc_id, c.block_idx, c.level, c.text, r.path || '>' || c.text FROM h3 c JOIN r ON c.doc_id = r.doc_id AND c.parent_idx = r.block_idx),
    kk AS (SELECT b.doc_id, b.block_idx, b.type, max(CASE WHEN b.type = 'heading' THEN b.block_idx END) OVER (PARTITION BY b.doc_id ORDER BY b.block_idx ROWS UNBOUNDED PRECEDING) AS at FROM blocks b),
    s AS (SELECT kk.*, coalesce(r.path, 'root') AS path, substr(sha256(kk.doc_id || coalesce(r.path, 'root')), 1, 32) AS sec_anchor,
        row_number() OVER (PARTITION BY kk.doc_id, kk.at, kk.type = 'heading' ORDER BY kk.block_idx) - 1 AS ordinal FROM kk LEFT JOIN r ON kk.doc_id = r.doc_id AND kk.at = r.block_idx)"""
_ANCHORS_WHOLE = _ANCHORS.replace(", 1, 1) AS raw FROM blocks", ", 1) AS raw FROM blocks")
_PASSAGES = f"{_RAW}, x AS (SELECT doc_id, no // 10 AS section, no AS passage, doc_id || '-' || no AS passage_id, len(string_split(line, ' ')) AS n_tokens, (length(line) - length(replace(line, 'e', '')))::DOUBLE / length(line) AS score FROM raw WHERE line <> '')"
SQL = {
    "dup_heading_suffix": f"{_ANCHORS} SELECT doc_id, block_idx, level, text, md5(path) AS path_md5 FROM r",
    "section_anchors": f"{_ANCHORS} SELECT doc_id, sec_anchor, min(block_idx) AS first_idx FROM s GROUP BY 1, 2",
    "block_anchors": f"{_ANCHORS} SELECT doc_id, block_idx, ordinal, type, substr(sha256(sec_anchor || type || ordinal), 1, 32) AS pass_anchor FROM s WHERE type <> 'heading'",
    "heading_anchors_whole": f"{_ANCHORS_WHOLE} SELECT r.doc_id, r.block_idx, r.level, md5(r.text) AS text_md5, md5(r.path) AS path_md5, s.sec_anchor FROM r JOIN s ON r.doc_id = s.doc_id AND r.block_idx = s.block_idx",
    "block_anchors_whole": f"{_ANCHORS_WHOLE} SELECT doc_id, block_idx, ordinal, type, substr(sha256(sec_anchor || type || ordinal), 1, 32) AS pass_anchor FROM s WHERE type <> 'heading'",
    "fence_code": f"""
        WITH {_RAW},
        v AS (SELECT doc_id, string_agg(CASE WHEN no % 11 = 10 THEN '```' || {_NL} || line || {_NL} || '  ```' WHEN no % 6 = 0 THEN 'const x = {{' || line || '}};' WHEN no % 6 = 3 THEN ' '
            WHEN no % 6 = 4 THEN '    return foo(' || line || ');' ELSE line END, {_NL} ORDER BY no) AS t FROM raw GROUP BY 1),
        w AS (SELECT doc_id, replace(replace(t, chr(13) || {_NL}, {_NL}), chr(13), {_NL}) AS t FROM v),
        a AS ({_LINES.format(t="t", f="w")}),
        b AS (SELECT *, {_strip("line")} AS s FROM a),
        f AS (SELECT *, sum((s LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS f FROM b),
        g AS (SELECT *, s NOT LIKE '```%' AND f % 2 = 0 AND s <> '' AS plain FROM f),
        i AS (SELECT *, sum((NOT plain)::INT) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS para FROM g),
        q AS (SELECT doc_id, min(no) AS no, plain, string_agg(line, {_NL} ORDER BY no) AS p FROM i GROUP BY doc_id, para, plain),
        {_JUDGED},
        o AS (SELECT *, plain AND {_IS_CODE} AS code, {_LANGUAGE} AS language FROM d)
        SELECT doc_id, md5(string_agg(CASE WHEN code THEN '```' || language || {_NL} || p || {_NL} || '```' ELSE p END, {_NL} ORDER BY no)) AS text_md5, sum(code::INT)::BIGINT AS n_fenced FROM o GROUP BY 1""",
    "selection_log": f"""
        SELECT doc_id, page_idx::BIGINT AS page_idx, selected_engine, reason, engine, CASE WHEN char_count > 0 THEN 'ok' ELSE 'empty' END AS status, round(score, 9) AS score
        FROM ({catalogue.SQL["page_selection"]}) JOIN (WITH {_CANDIDATES} SELECT * FROM scored) USING (doc_id, page_idx)""",
    "engine_counts": f"SELECT doc_id, selected_engine, count(*) AS n_pages FROM ({catalogue.SQL['page_selection']}) GROUP BY 1, 2",
    "neighbors": f"WITH {_PASSAGES} SELECT doc_id, passage, lag(passage_id) OVER w AS prev_id, lead(passage_id) OVER w AS next_id FROM x WINDOW w AS (PARTITION BY doc_id, section ORDER BY passage)",
    "context_budget": f"""
        WITH {_PASSAGES},
        b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, passage) <= 4),
        t AS (SELECT * FROM b QUALIFY sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY score DESC, section, passage ROWS UNBOUNDED PRECEDING) <= 300)
        SELECT doc_id, section, passage, row_number() OVER (PARTITION BY doc_id ORDER BY section, passage) AS context_no FROM t""",
    "span_overlaps": f"""
        WITH {_RAW},
        l AS (SELECT doc_id, no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(line) AS n FROM raw),
        w AS (SELECT doc_id, k, k * 400 AS s, least(k * 400 + 500, length(text)) AS e FROM documents, LATERAL (SELECT unnest(range(length(text) // 400 + 1)) AS k))
        SELECT l.doc_id, no AS line_no, k AS window_no, (least(l.s + n, w.e) - greatest(l.s, w.s))::BIGINT AS n_shared FROM l JOIN w ON l.doc_id = w.doc_id AND greatest(l.s, w.s) < least(l.s + n, w.e)""",
    "chunk_length_percentiles": f"""
        WITH c AS ({catalogue.SQL["char_chunks"].rsplit("SELECT doc_id, page AS page_idx", 1)[0]} SELECT page, length(text) AS n FROM t),
        o AS (SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY page) AS k FROM c)
        SELECT page::BIGINT AS page_idx, k AS n, max(CASE WHEN i = round_even((k - 1) * 50 / 100.0, 0) THEN n END)::DOUBLE AS p50, max(CASE WHEN i = round_even((k - 1) * 90 / 100.0, 0) THEN n END)::DOUBLE AS p90 FROM o GROUP BY 1, 2""",
    "snapshot_changes": """
        WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE length(text) % 3 <> 1 OR text IS NULL),
        n AS (SELECT doc_id, coalesce(CASE WHEN length(text) % 5 = 0 THEN text || '.' ELSE text END, '') AS text FROM documents WHERE length(text) % 7 <> 1 OR text IS NULL)
        SELECT doc_id, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id)""",
    "adapt_blocks": f"""
        WITH {_RAW},
        t AS (SELECT doc_id, no, {_strip("translate(line, '&<>', '')")} AS text, no % 6 AS k FROM raw)
        SELECT doc_id, (no // 10)::BIGINT AS page_idx, (no % 10)::BIGINT AS block_no, '/page/' || (no // 10 + 1) || '/b/' || no AS block_id,
            CASE WHEN text = '' AND k <> 2 THEN NULL ELSE ['para', 'heading', 'table', 'list', 'caption', 'unknown'][k + 1] END AS type,
            CASE k WHEN 2 THEN 'table_render' WHEN 4 THEN 'image' END AS asset, md5(text) AS text_md5 FROM t WHERE text <> '' OR k IN (2, 4)""",
}
