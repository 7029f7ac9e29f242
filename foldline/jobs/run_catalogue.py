"""Registered queries over engine payloads, distilled documents, routing, metrics, target checks and rankings, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions.text import WS
from foldline.jobs import catalogue, page_catalogue
from foldline.jobs.catalogue import _WS, _docs, _strip, engine_pages
from foldline.jobs.page_catalogue import _NL, _PAGES, _RAW
from foldline.jobs.passage_catalogue import _PASSAGES, _long, _passages
from foldline.operators import adapters, candidates, chunking, distiller, metrics, pages, passages, segments, structure, validation, verification
from foldline.sources.files import text_pages

FLAT_KINDS = ("text", "Title", "table", "list_item", "image", "image_caption", "code_block", "odd")


def _flat_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *_long("page_idx", "block_no"), "block_id", "type", "asset", F.md5("text").alias("text_md5"))


def flat_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, payload): the lines of each document as a flat list of blocks, ten a page; every eighth is an image without text."""
    kinds = F.array(*map(F.lit, FLAT_KINDS))
    block = lambda x, i: F.struct(F.floor(i / 10).alias("page_idx"), F.get(kinds, i % 8).alias("type"), F.when(i % 8 != 4, x).alias("text"))
    return docs.where("text IS NOT NULL").select("doc_id", F.to_json(F.transform(F.split("text", "\n", -1), block)).alias("payload"))


def adapt_flat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_rows(adapters.flat_blocks(flat_payloads(_docs(spark, sf_dir))))


def adapt_flat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    block = lambda x: F.struct(F.lit("text").alias("type"), F.array(F.struct(F.transform(F.split(x, " ", -1), lambda w: F.struct(w.alias("content"))).alias("spans"))).alias("lines"))
    page = lambda k: F.struct(k.alias("page_idx"), F.transform(F.slice(lines, k * 10 + 1, F.lit(10)), block).alias("preproc_blocks"))
    paged = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")), page)
    payloads = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(paged.alias("pdf_info"))).alias("payload"))
    return _flat_rows(adapters.flat_blocks(payloads))


def block_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.lines(_docs(spark, sf_dir))
    no = F.col("line_no")
    blocks = rows.select("doc_id", F.floor(no / 10).alias("page_idx"), F.when(no % 7 == 0, "heading").otherwise("para").alias("type"), F.col("line").alias("text"), (no % 2 == 0).alias("has_coords"), F.when(no % 6 == 0, "image").alias("asset"))
    found = candidates.block_signals(blocks, "doc_id", "page_idx")
    return found.select("doc_id", *_long("page_idx", "char_count", "block_count", "line_count", "heading_like_count", "asset_count"), F.round("duplicate_line_ratio", 9).alias("duplicate_line_ratio"), "has_coords")


def distill_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.lines(_docs(spark, sf_dir)).where("line <> ''")
    no = F.col("line_no")
    kind = F.when(no % 7 == 0, "heading").when(no % 5 == 1, "caption").otherwise("para")
    text = F.expr("CASE WHEN line_no % 7 = 0 THEN concat(repeat('#', line_no % 3), ' ', substring(line, 1, 1)) WHEN line_no % 2 = 0 THEN rtrim('.', line) ELSE concat(lower(substring(line, 1, 1)), substring(line, 2)) END")
    blocks = rows.select("doc_id", no.alias("block_no"), F.floor(no / 3).alias("page_idx"), F.lit(0).alias("page_no"), F.format_string("%05d", 9 - no % 3).alias("key"), kind.alias("type"), text.alias("text"))
    found = distiller.distill(blocks)
    return found.select("doc_id", *_long("block_idx", "page_idx"), "type", *_long("level"), "heading", "sec_anchor", "pass_anchor", *_long("start_off", "end_off"), F.md5("text").alias("text_md5"))


def routing_quick_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_pages(_docs(spark, sf_dir)).select("doc_id", F.col("page_idx").cast("int").alias("page_idx"), "engine", "text")
    quick = found.where("engine = 'marker'").select("doc_id", "page_idx", F.lit("pypdf").alias("engine"), F.expr("substring(text, 1, 60 + 40 * (page_idx % 3))").alias("text"))
    out = pages.route_with_quick_pass(found.unionByName(quick), ["marker", "mineru"], ["mineru", "pypdf"])
    counts = [F.col("char_counts")[e].cast("long").alias(f"{e}_chars") for e in ("marker", "mineru", "pypdf")]
    return out.select("doc_id", *_long("page_idx"), "extractor", "fallback_reason", *_long("quick_chars"), "scan_likely", *counts, F.array_join("fallback_chain", ",").alias("chain"), F.md5("text").alias("text_md5"))


def paged(docs: DataFrame) -> DataFrame:
    """The documents with a form feed instead of every tenth line end."""
    joined = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i == 0, "").when(i % 10 == 0, "\f").otherwise("\n"), x)), "")
    return docs.select("doc_id", joined.alias("text"))


def char_chunks_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunks(paged(_docs(spark, sf_dir)))
    return found.select("doc_id", *_long("page_idx", "chunk_no"), "chunk_id", F.md5("text").alias("text_md5"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = paged(_docs(spark, sf_dir))
    found = metrics.run_metrics(text_pages(docs), chunking.chunks(docs))
    return found.select("doc_id", *_long("pages"), F.round("non_empty_content_rate", 9).alias("non_empty_content_rate"), F.round("duplicate_line_rate", 9).alias("duplicate_line_rate"), *_long("chunk_count"), "char_length_p50", "char_length_p90")


TREE_KINDS = ("Text", "List", "Figure", "Code", "Table", "TableGroup")


def _targets(docs: DataFrame) -> DataFrame:
    """Six targets for each document, one of a type that is unknown."""
    text = lambda c: f"CAST({c} AS STRING)"
    some = "text IS NOT NULL"
    rows = [("single_block", "NULL", "'.'", "'ou'", "NULL", "doc_id % 2 = 0"), ("figure_linked", "NULL", "NULL", "NULL", "'th'", "false"), ("table_linked", "NULL", "NULL", "NULL", "'is'", "false"), ("code_merged", "NULL", "NULL", "'en'", "NULL", "false"), ("has_list", "NULL", "NULL", "NULL", "NULL", "false"), ("other", "NULL", "NULL", "NULL", "NULL", "false")]
    items = ", ".join(f"named_struct('target_no', {k}, 'type', '{r[0]}', 'starts_with', {text(r[1])}, 'ends_with', {text(r[2])}, 'contains', {text(r[3])}, 'caption', {text(r[4])}, 'has_list', {r[5]}, 'has_code', false)" for k, r in enumerate(rows))
    return docs.where(some).select("doc_id", F.explode(F.expr(f"array({items})")).alias("t")).select("doc_id", "t.*")


def _markdowns(docs: DataFrame) -> DataFrame:
    markdown = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "![x](a.png)").otherwise("|-|-|"))
    return docs.where("text IS NOT NULL").select("doc_id", markdown.alias("markdown"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a.png"))).otherwise(F.array().cast("array<string>")).alias("files"))


def _checked(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *_long("target_no"), "type", "passed")


def target_checks_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kinds = _docs(spark, sf_dir), F.array(*map(F.lit, TREE_KINDS))
    leaf = lambda x: F.struct(F.lit("Caption").alias("block_type"), F.substring(x, 1, 12).alias("html"))
    node = lambda x, i: F.struct(F.get(kinds, i % 6).alias("block_type"), F.concat(F.lit("<p>"), x, F.lit("</p>")).alias("html"), F.filter(F.array(leaf(x)), lambda _: i % 6 == 2).alias("children"))
    blocks = F.transform(F.transform(F.split("text", "\n", -1), lambda x: F.translate(x, "&<>", "")), node)
    payloads = docs.where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(F.array(F.struct(F.lit("Page").alias("block_type"), blocks.alias("children"))).alias("children"))).alias("payload"))
    return _checked(verification.check_tree_targets(_targets(docs), verification.tree_blocks(payloads), _markdowns(docs)))


def target_checks_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    blocks = adapters.flat_blocks(flat_payloads(docs)).withColumn("no", F.col("page_idx") * 10 + F.col("block_no"))
    return _checked(verification.check_flat_targets(_targets(docs), blocks, _markdowns(docs)))


def target_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.check_counts(target_checks_flat(spark, sf_dir), "type")


def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("source IS NOT NULL").select(F.col("source").alias("query_id"), "doc_id", "n_chars")
    at = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(at)).where("rank <= 100").select("query_id", "doc_id", "rank")
    good = docs.join(_docs(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id").select("query_id", "doc_id")
    both = passages.ranking_metrics(ranked, good, 100).join(passages.ranking_gain(ranked, good, 100), "query_id")
    return both.select("query_id", *[F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def _windows(docs: DataFrame, step: int, length: int) -> DataFrame:
    """(doc_id, id, start, end, score): windows of the texts; the score is how many of the letter e one has."""
    n = F.length("text")
    rows = docs.select("doc_id", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor(n / step).cast("int"))).alias("k"))
    rows = rows.select("doc_id", F.col("k").cast("long").alias("id"), (F.col("k") * step).cast("long").alias("start"), F.least(F.col("k") * step + length, "n").cast("long").alias("end"), "text")
    piece = F.expr("substring(text, start + 1, end - start)")
    return rows.select("doc_id", "id", "start", "end", (F.length(piece) - F.length(F.translate(piece, "e", ""))).cast("long").alias("score"))


def context_without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.drop_overlapping(_windows(_docs(spark, sf_dir), 400, 500)).select("doc_id", "id", "score")


def segment_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return passages.segment_lineage(_windows(docs, 400, 500), _windows(docs, 300, 300), ["doc_id"]).select("doc_id", "id", "successor", *_long("n_shared"))


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document that touch one of its windows with 40 letters e or more."""
    docs = _docs(spark, sf_dir)
    gold = structure.lines(docs).where("line <> ''").select("doc_id", F.col("line_no").alias("id"), "start", (F.col("start") + F.length("line")).alias("end"))
    found = passages.evidence_coverage(gold, _windows(docs, 400, 500).where("score >= 40"), ["doc_id"])
    return found.select("doc_id", F.round("coverage", 9).alias("coverage"))


def snapshot_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all documents to the labelled ones, with a word replaced."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    new = docs.join(_docs(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.replace("text", F.lit(" the "), F.lit(" a ")).alias("text"))
    changes = passages.snapshot_changes(docs, new, "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    rates = passages.churn_rates(changes, "lang")
    return rates.select("lang", *_long("n"), *[F.round(c, 9).alias(c) for c in ("added", "removed", "changed", "unchanged")])


def packed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _passages(spark, sf_dir).select("doc_id", "section", F.col("passage").alias("block_no"), "n_tokens")
    return segments.pack_passages(rows, 30, 60, 90).select("doc_id", *_long("section", "block_no", "passage"))


def document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    title = validation.first_filled(F.col("source"), F.substring_index("text", " ", 1), F.col("doc_id"))
    bad = F.concat(validation.document_violations("doc_id", "source", "lang", "text"), validation.range_violations(F.length("text") - 100, F.col("n_chars"), F.length("text")))
    return docs.select("doc_id", title.alias("title"), F.array_join(bad, "; ").alias("violations"))


def malformed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three lines of a document as a table, with a cell at each comma."""
    rows = structure.lines(_docs(spark, sf_dir)).select("doc_id", F.floor(F.col("line_no") / 3).alias("block_no"), "line_no", F.concat(F.lit("|"), F.translate("line", ",", "|"), F.lit("|")).alias("row"))
    tables = rows.groupBy("doc_id", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "row"))), lambda s: s["row"]), "\n").alias("text"))
    return validation.malformed_tables(tables).select("doc_id", *_long("block_no"), "malformed")


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_docs(spark, sf_dir), F.size(F.regexp_extract_all("text", F.lit(f"[^{WS}]+"), F.lit(0))), 100, "lang")


def secret_scan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a key made from its digest behind it; every second key is one character short."""
    line = lambda x, i: F.concat(x, F.lit(" AIza"), F.substring(F.sha2(x, 256), F.lit(1), F.lit(35) - i % 2))
    docs = _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))
    return chunking.secret_lines(docs).select("doc_id", *_long("line_no"))


QUERIES = {f.__name__: f for f in (
    adapt_flat_list, adapt_flat_pages, block_signals, distill_document, routing_quick_pass, char_chunks_paged, run_metrics, target_checks_tree, target_checks_flat, target_check_counts,
    ranking_quality, context_without_overlaps, segment_lineage, evidence_coverage, snapshot_churn, packed_passages, document_checks, malformed_tables, token_histogram, secret_scan_keys,
)}
_PAGED = f"{_RAW}, paged AS (SELECT doc_id, string_agg(CASE WHEN no = 0 THEN '' WHEN no % 10 = 0 THEN chr(12) ELSE {_NL} END || line, '' ORDER BY no) AS text FROM raw GROUP BY 1)"
_CHUNKS = f"WITH {_PAGED}, " + catalogue.SQL["char_chunks"].strip().removeprefix("WITH ").replace("FROM documents", "FROM paged")
_DISTILLED = page_catalogue.SQL["distill_ranges"].split("g AS (", 1)[1].rsplit("SELECT doc_id, block_no::BIGINT", 1)[0]


def _spans(name: str, step: int, length: int) -> str:
    return f"""{name} AS (SELECT doc_id, k AS id, k * {step} AS s, least(k * {step} + {length}, length(text)) AS e, length(substr(text, k * {step} + 1, {length})) - length(replace(substr(text, k * {step} + 1, {length}), 'e', '')) AS score
        FROM documents, LATERAL (SELECT unnest(range(length(text) // {step} + 1)) AS k))"""


_TARGET_ROWS = "('single_block', 0), ('figure_linked', 1), ('table_linked', 2), ('code_merged', 3), ('has_list', 4), ('other', 5)"
_MARKDOWN = "md AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN '![x](a.png)' ELSE '|-|-|' END AS md FROM documents WHERE text IS NOT NULL)"
_FLAT_CHECKS = f"""
        WITH {_RAW}, {_MARKDOWN},
        l AS (SELECT doc_id, no, no % 8 AS k, CASE WHEN no % 8 = 4 THEN '' ELSE line END AS t FROM raw),
        x AS (SELECT *, {_strip("t")} AS s, regexp_matches(t, '(?m)^[{_WS}*\\-\\x{{2022}}\\x{{F0A1}}]') AS bullet FROM l),
        f AS (SELECT doc_id, arg_min(s, no) FILTER (s LIKE '%.' AND contains(s, 'ou')) AS first, bool_or(k = 4) AS image, bool_or(k = 2) AS tab, bool_or(contains(t, 'en')) AS holds, bool_or(bullet) AS bullet FROM x GROUP BY 1),
        c AS (SELECT doc_id, target_no::BIGINT AS target_no, type, coalesce(CASE type WHEN 'single_block' THEN first IS NOT NULL AND (doc_id % 2 <> 0 OR regexp_matches(first, '^[*\\-\\x{{2022}}\\x{{F0A1}}]'))
            WHEN 'figure_linked' THEN image AND contains(md, 'th') WHEN 'table_linked' THEN tab AND contains(md, 'is') AND contains(md, '|') AND contains(md, '-|-')
            WHEN 'code_merged' THEN holds OR contains(md, 'en') WHEN 'has_list' THEN bullet OR regexp_matches(md, '(?m)^[{_WS}]*[*\\-][{_WS}]+') END, false) AS passed
            FROM md JOIN f USING (doc_id), (VALUES {_TARGET_ROWS}) v(type, target_no))"""
SQL = {
    "adapt_flat_list": f"""
        WITH {_RAW}, t AS (SELECT *, no % 8 AS k FROM raw)
        SELECT doc_id, (no // 10)::BIGINT AS page_idx, (no % 10)::BIGINT AS block_no, 'mineru_p' || (no // 10) || '_b' || (no % 10) AS block_id,
            ['para', 'heading', 'table', 'list', NULL, 'caption', 'code', 'unknown'][k + 1] AS type, CASE k WHEN 2 THEN 'table_render' WHEN 4 THEN 'image' END AS asset, md5(CASE WHEN k = 4 THEN '' ELSE line END) AS text_md5 FROM t""",
    "adapt_flat_pages": f"""
        WITH {_RAW}
        SELECT doc_id, (no // 10)::BIGINT AS page_idx, (no % 10)::BIGINT AS block_no, 'mineru_p' || (no // 10) || '_b' || (no % 10) AS block_id, 'para' AS type, NULL::VARCHAR AS asset,
            md5(array_to_string(list_filter(string_split(line, ' '), lambda x: x <> ''), ' ')) AS text_md5 FROM raw""",
    "block_signals": f"""
        WITH {_RAW}, l AS (SELECT *, {_strip("line")} AS s FROM raw),
        g AS (SELECT doc_id, (no // 10)::BIGINT AS page_idx, sum(length(regexp_replace(line, '[{_WS}]+', '', 'g')))::BIGINT AS char_count, count(*) AS block_count, count(*) FILTER (s <> '') AS line_count, count(DISTINCT s) FILTER (s <> '') AS d,
            sum((no % 7 = 0 OR line LIKE '#%')::INT)::BIGINT AS heading_like_count, sum((no % 6 = 0)::INT)::BIGINT AS asset_count, 2 * sum((no % 2 = 0)::INT) > count(*) AS has_coords FROM l GROUP BY 1, 2)
        SELECT doc_id, page_idx, char_count, block_count, line_count, heading_like_count, asset_count, round(CASE WHEN line_count = 0 THEN 0 ELSE (line_count - d) / line_count END, 9) AS duplicate_line_ratio, has_coords FROM g""",
    "distill_document": f"""
        WITH RECURSIVE {_RAW},
        b0 AS (SELECT doc_id, no, no // 3 AS page_idx, CASE WHEN no % 7 = 0 THEN 'heading' ELSE 'para' END AS type,
            CASE WHEN no % 7 = 0 THEN repeat('#', (no % 3)::INT) || ' ' || substr(line, 1, 1) WHEN no % 2 = 0 THEN rtrim(line, '.') ELSE lower(substr(line, 1, 1)) || substr(line, 2) END AS text FROM raw WHERE line <> ''),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, 9 - no % 3) - 1 AS block_no FROM b0),
        g AS ({_DISTILLED},
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS block_idx FROM s),
        h0 AS (SELECT doc_id, block_idx, greatest(1, length(regexp_extract(text, '^#*'))) AS level, trim(text, '# ') AS raw FROM k WHERE type = 'heading'),
        h1 AS (SELECT a.*, CASE WHEN raw = '' THEN 'heading' ELSE raw END AS name, (SELECT max(b.block_idx) FROM h0 b WHERE b.doc_id = a.doc_id AND b.block_idx < a.block_idx AND b.level < a.level) AS parent_idx FROM h0 a),
        h2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_idx, level, name ORDER BY block_idx) AS nth FROM h1),
        h3 AS (SELECT *, CASE WHEN nth = 1 THEN name ELSE name || '_' || (nth - 2) END AS text FROM h2),
        t AS (SELECT doc_id, block_idx, level, text, text AS path FROM h3 WHERE parent_idx IS NULL UNION ALL SELECT c.doc_id, c.block_idx, c.level, c.text, t.path || '>' || c.text FROM h3 c JOIN t ON c.doc_id = t.doc_id AND c.parent_idx = t.block_idx),
        kk AS (SELECT *, max(CASE WHEN type = 'heading' THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS at FROM k),
        o AS (SELECT kk.*, t.level, t.text AS heading, substr(sha256(kk.doc_id || coalesce(t.path, 'root')), 1, 32) AS sec_anchor, row_number() OVER (PARTITION BY kk.doc_id, kk.at, kk.type = 'heading' ORDER BY kk.block_idx) - 1 AS ordinal
            FROM kk LEFT JOIN t ON kk.doc_id = t.doc_id AND kk.at = t.block_idx)
        SELECT doc_id, block_idx, page_idx::BIGINT AS page_idx, type, CASE WHEN type = 'heading' THEN level::BIGINT END AS level, CASE WHEN type = 'heading' THEN heading END AS heading, sec_anchor,
            CASE WHEN type <> 'heading' THEN substr(sha256(sec_anchor || type || ordinal), 1, 32) END AS pass_anchor, s::BIGINT AS start_off, (s + length(text))::BIGINT AS end_off, md5(text) AS text_md5 FROM o""",
    "routing_quick_pass": f"""
        WITH {_PAGES},
        m AS (SELECT doc_id, page_idx, max(text) FILTER (engine = 'marker') AS a, max(text) FILTER (engine = 'mineru') AS b FROM p GROUP BY 1, 2),
        q AS (SELECT *, substr(a, 1, 60 + 40 * (page_idx % 3)) AS c FROM m),
        n AS (SELECT *, length({_strip("c")}) AS quick, length({_strip("a")}) AS na, length({_strip("b")}) AS nb FROM q),
        t AS (SELECT *, quick < 80 AS scan, CASE WHEN quick < 80 THEN b ELSE a END AS one, CASE WHEN quick < 80 THEN c ELSE b END AS two FROM n),
        r AS (SELECT *, CASE WHEN len(regexp_extract_all(one, '[^{_WS}]+')) >= 25 THEN 0 WHEN regexp_matches(one, '[^{_WS}]') THEN 1 ELSE 2 END AS r1, CASE WHEN len(regexp_extract_all(two, '[^{_WS}]+')) >= 25 THEN 0 WHEN regexp_matches(two, '[^{_WS}]') THEN 1 ELSE 2 END AS r2 FROM t),
        u AS (SELECT *, CASE WHEN scan THEN 'mineru' ELSE 'marker' END AS e1, CASE WHEN scan THEN 'pypdf' ELSE 'mineru' END AS e2 FROM r)
        SELECT doc_id, page_idx, CASE WHEN r1 <= r2 THEN e1 ELSE e2 END AS extractor, CASE WHEN r1 > r2 THEN 'primary extractor ''' || e1 || ''' returned low-content page ' || page_idx END AS fallback_reason,
            quick AS quick_chars, scan AS scan_likely, na AS marker_chars, nb AS mineru_chars, quick AS pypdf_chars, e1 || ',' || e2 AS chain, md5(CASE WHEN r1 <= r2 THEN one ELSE two END) AS text_md5 FROM u""",
    "char_chunks_paged": _CHUNKS,
    "run_metrics": f"""
        {_CHUNKS.rsplit("SELECT doc_id, page AS page_idx", 1)[0]},
        g AS (SELECT doc_id, string_split(text, chr(12)) AS pages, list_filter(list_transform(string_split(replace(text, chr(12), {_NL}), {_NL}), lambda x: lower({_strip("x")})), lambda x: length(x) >= 8) AS lines FROM paged WHERE text IS NOT NULL),
        z AS (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS k FROM t),
        y AS (SELECT doc_id, k, max(CASE WHEN i = round_even((k - 1) * 50 / 100.0, 0) THEN n END)::DOUBLE AS p50, max(CASE WHEN i = round_even((k - 1) * 90 / 100.0, 0) THEN n END)::DOUBLE AS p90 FROM z GROUP BY 1, 2)
        SELECT doc_id, len(pages)::BIGINT AS pages, round(len(list_filter(pages, lambda x: regexp_matches(x, '[^{_WS}]'))) / len(pages), 9) AS non_empty_content_rate, round((len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1), 9) AS duplicate_line_rate,
            coalesce(k, 0)::BIGINT AS chunk_count, coalesce(p50, 0.0) AS char_length_p50, coalesce(p90, 0.0) AS char_length_p90 FROM g LEFT JOIN y USING (doc_id)""",
    "target_checks_tree": f"""
        WITH {_RAW}, {_MARKDOWN},
        l AS (SELECT doc_id, no, no % 6 AS k, translate(line, '&<>', '') AS t FROM raw),
        h AS (SELECT *, '<p>' || t || '</p>' AS html, '<p>' || t || '</p>' || CASE WHEN k = 2 THEN substr(t, 1, 12) WHEN k = 5 THEN '<p>' || t || '</p>' ELSE '' END AS under FROM l),
        x AS (SELECT doc_id, no * 2 AS o, k, {_strip("t")} AS s FROM l UNION ALL SELECT doc_id, no * 2 + 1, 9, {_strip("substr(t, 1, 12)")} FROM l WHERE k = 2),
        f AS (SELECT doc_id, arg_min(k, o) FILTER (s LIKE '%.' AND contains(s, 'ou')) AS first FROM x GROUP BY 1),
        g AS (SELECT doc_id, bool_or(k = 2 AND contains(under, 'th')) AS figure, bool_or((k = 4 AND contains(html, 'is')) OR (k = 5 AND contains(under, 'is'))) AS tab, bool_or(k = 3 AND contains(t, 'en')) AS code, bool_or(k = 1) AS list FROM h GROUP BY 1)
        SELECT doc_id, target_no::BIGINT AS target_no, type, coalesce(CASE type WHEN 'single_block' THEN first IS NOT NULL AND (doc_id % 2 <> 0 OR first = 1) WHEN 'figure_linked' THEN figure AND contains(md, '](a.png)') AND doc_id % 3 = 0
            WHEN 'table_linked' THEN tab AND contains(md, '|') AND contains(md, '-|-') WHEN 'code_merged' THEN code WHEN 'has_list' THEN list END, false) AS passed
        FROM md JOIN f USING (doc_id) JOIN g USING (doc_id), (VALUES {_TARGET_ROWS}) v(type, target_no)""",
    "target_checks_flat": f"{_FLAT_CHECKS} SELECT * FROM c",
    "target_check_counts": f"{_FLAT_CHECKS} SELECT type, sum(passed::INT)::BIGINT AS passed, count(*) AS total FROM c GROUP BY 1",
    "ranking_quality": """
        WITH d AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source IS NOT NULL),
        g AS (SELECT query_id, doc_id, CASE WHEN r <= 100 THEN r END AS r FROM d JOIN labels USING (doc_id) WHERE quality = 1),
        s AS (SELECT query_id, count(r) / count(*) AS recall, coalesce(1 / min(r), 0.0) AS rr, coalesce(sum(1 / log2(r + 1)), 0.0) AS gain, count(*) AS n FROM g GROUP BY 1)
        SELECT query_id, round(recall, 9) AS recall, round(rr, 9) AS reciprocal_rank, round(gain / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, least(n, 100) + 1)) AS i)), 9) AS ndcg FROM s""",
    "context_without_overlaps": f"""
        WITH {_spans("w", 400, 500)}
        SELECT doc_id, id, score FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE a.doc_id = b.doc_id AND a.id <> b.id AND greatest(a.s, b.s) < least(a.e, b.e) AND (b.score > a.score OR (b.score = a.score AND b.id < a.id)))""",
    "segment_lineage": f"""
        WITH {_spans("a", 400, 500)}, {_spans("b", 300, 300)},
        j AS (SELECT a.doc_id, a.id, b.id AS other, least(a.e, b.e) - greatest(a.s, b.s) AS n FROM a JOIN b ON a.doc_id = b.doc_id AND greatest(a.s, b.s) < least(a.e, b.e)),
        r AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY n DESC, other) = 1)
        SELECT doc_id, id, other AS successor, n::BIGINT AS n_shared FROM a LEFT JOIN r USING (doc_id, id)""",
    "evidence_coverage": f"""
        WITH {_RAW}, {_spans("w", 400, 500)},
        o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM raw)
        SELECT doc_id, round(avg(EXISTS (SELECT 1 FROM w WHERE w.doc_id = o.doc_id AND score >= 40 AND greatest(w.s, o.s) < least(w.e, o.s + length(line)))::INT), 9) AS coverage FROM o WHERE line <> '' GROUP BY 1""",
    "snapshot_churn": """
        WITH n AS (SELECT doc_id, coalesce(replace(text, ' the ', ' a '), '') AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
        c AS (SELECT lang, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN n.text = coalesce(d.text, '') THEN 'unchanged' ELSE 'changed' END AS c FROM documents d LEFT JOIN n USING (doc_id))
        SELECT lang, count(*) AS n, 0.0::DOUBLE AS added, round(avg((c = 'removed')::INT), 9) AS removed, round(avg((c = 'changed')::INT), 9) AS changed, round(avg((c = 'unchanged')::INT), 9) AS unchanged FROM c GROUP BY 1""",
    "packed_passages": f"""
        WITH RECURSIVE {_PASSAGES},
        o AS (SELECT doc_id, section, passage AS block_no, n_tokens AS n, row_number() OVER (PARTITION BY doc_id, section ORDER BY passage) AS i FROM x),
        r AS (SELECT doc_id, section, block_no, n, i, n AS total, 0 AS p FROM o WHERE i = 1
            UNION ALL SELECT o.doc_id, o.section, o.block_no, o.n, o.i, CASE WHEN r.total >= 60 OR r.total + o.n > 90 THEN o.n ELSE r.total + o.n END, CASE WHEN r.total >= 60 OR r.total + o.n > 90 THEN r.p + 1 ELSE r.p END
            FROM r JOIN o ON r.doc_id = o.doc_id AND r.section = o.section AND o.i = r.i + 1),
        t AS (SELECT doc_id, section, p, sum(n) AS total FROM r GROUP BY 1, 2, 3),
        l AS (SELECT *, lag(total) OVER (PARTITION BY doc_id, section ORDER BY p) AS prev, max(p) OVER (PARTITION BY doc_id, section) AS top FROM t)
        SELECT doc_id, section::BIGINT AS section, block_no::BIGINT AS block_no, (CASE WHEN p = top AND p > 0 AND l.total < 30 AND l.total + prev <= 90 THEN p - 1 ELSE p END)::BIGINT AS passage FROM r JOIN l USING (doc_id, section, p)""",
    "document_checks": """
        SELECT doc_id, coalesce(nullif(source, ''), nullif(string_split(text, ' ')[1], ''), doc_id::VARCHAR) AS title,
            array_to_string(list_filter([CASE WHEN coalesce(source, '') = '' THEN 'empty source' END, CASE WHEN coalesce(lang, '') = '' THEN 'empty lang' END, CASE WHEN coalesce(text, '') = '' THEN 'empty text' END,
                CASE WHEN coalesce(length(text) - 100 < 0, true) THEN 'start below 0' END, CASE WHEN coalesce(n_chars < length(text) - 100, true) THEN 'end before start' END, CASE WHEN coalesce(n_chars > length(text), true) THEN 'end beyond text' END], lambda x: x IS NOT NULL), '; ') AS violations FROM documents""",
    "malformed_tables": f"""
        WITH {_RAW}, c AS (SELECT doc_id, no // 3 AS block_no, no, len(string_split(replace(line, ',', '|'), '|')) AS n FROM raw), h AS (SELECT *, first_value(n) OVER (PARTITION BY doc_id, block_no ORDER BY no) AS head FROM c)
        SELECT doc_id, block_no::BIGINT AS block_no, bool_or(abs(n - head) > 0.5 * head) AS malformed FROM h GROUP BY 1, 2""",
    "token_histogram": f"SELECT lang, (len(regexp_extract_all(text, '[^{_WS}]+')) // 100 * 100)::BIGINT AS low, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "secret_scan_keys": f"WITH {_RAW} SELECT doc_id, no AS line_no FROM raw WHERE no % 2 = 0 OR regexp_matches(line, 'AIza[A-Za-z0-9_-]{{35}}')",
}
