"""Registered queries over the given tables, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.operators import candidates, chunking, retrieval, structure

QUERY = "the retrieval of ranked then with inthere and the 2024"


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked_up(docs: DataFrame) -> DataFrame:
    """The documents' lines as Markdown by a fixed rule: headings, list items, table rows and fenced code by line number."""
    def line(x, i):
        k = i % 7
        return (
            F.when(k == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 7) % 3 + 1).cast("int")), F.lit(" "), x)).when(k == 3, F.concat(F.lit("- "), x))
            .when(k == 5, F.concat(F.lit("| "), x, F.lit(" |"))).when(k == 6, F.concat(F.lit("```\n"), x, F.lit("\n```"))).otherwise(x)
        )

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


def engine_pages(docs: DataFrame) -> DataFrame:
    """Pages of ten lines from two engines: one keeps all lines, the other leaves out every third."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    both = rows.withColumn("engine", F.explode(F.array(F.lit("marker"), F.lit("mineru")))).withColumn("page_idx", F.floor(F.col("no") / 10).cast("int"))
    kept = F.when((F.col("engine") == "marker") | (F.col("no") % 3 != 2), F.struct("no", "line"))
    grouped = both.groupBy("doc_id", "page_idx", "engine").agg(F.array_sort(F.collect_list(kept)).alias("x"))
    return grouped.select("doc_id", "page_idx", "engine", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = candidates.page_signals(engine_pages(_docs(spark, sf_dir)))
    return signals.withColumn("status", F.when(F.col("char_count") > 0, "ok").otherwise("empty"))


def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.top_k(_docs(spark, sf_dir), QUERY, 10, "doc_id", "text")
    return top.select("doc_id", F.round("score", 9).alias("score"))


def retrieval_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine_scores(_docs(spark, sf_dir), QUERY, "doc_id", "text").select("doc_id", F.round("score", 9).alias("score"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_counts(_docs(spark, sf_dir), "doc_id", "text")


def doc_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.doc_norms(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.round("norm", 9).alias("norm"))


def doc_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", structure.doc_anchor(F.col("doc_id")).alias("doc_anchor"))


def block_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.blocks(marked_up(_docs(spark, sf_dir)))
    return found.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "type", F.col("start_off").cast("long").alias("start_off"), F.col("end_off").cast("long").alias("end_off"))


def block_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(marked_up(_docs(spark, sf_dir))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.headings(structure.blocks(marked_up(_docs(spark, sf_dir))))
    return found.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), F.col("level").cast("long").alias("level"), F.col("parent_idx").cast("long").alias("parent_idx"), F.md5("section_path").alias("path_md5"))


def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunks(_docs(spark, sf_dir))
    return found.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_id", F.md5("text").alias("text_md5"))


def duplicate_line_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.duplicate_line_rate(_docs(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.round("duplicate_line_rate", 9).alias("duplicate_line_rate"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.secret_lines(_docs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _docs(spark, sf_dir).select("doc_id", "text", F.explode(F.expr("array(named_struct('start', -3, 'end', 40), named_struct('start', 40, 'end', 20), named_struct('start', 100, 'end', 2000))")).alias("s"))
    found = chunking.clamp_spans(spans.select("doc_id", "text", F.col("s.start").alias("start"), F.col("s.end").alias("end")))
    return found.select("doc_id", F.col("start_off").cast("long").alias("start_off"), F.col("end_off").cast("long").alias("end_off"), F.md5("passage").alias("passage_md5"))


def block_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end) of all blocks; the first begins 3 characters before the text, one that ends the text 40 after it."""
    found = structure.blocks(docs).select("doc_id", "block_idx", "start_off", "end_off")
    start = F.when(F.col("block_idx") == 0, F.lit(-3)).otherwise(F.col("start_off"))
    end = F.col("end_off") + F.when(F.col("end_off") == F.col("n"), 40).otherwise(0)
    return found.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", start.alias("start"), end.alias("end"))


def segment_block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked_up(_docs(spark, sf_dir))
    found = chunking.cut_spans(docs, block_spans(docs))
    return found.select("doc_id", "start_off", "end_off", F.md5("passage").alias("passage_md5"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("doc_id", "page_idx", "engine", F.col("char_count").cast("long").alias("char_count"), F.col("line_count").cast("long").alias("line_count"), F.round(candidates.score(), 9).alias("score"))


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.select_pages(_candidates(spark, sf_dir))


_TERMS = "regexp_extract_all(coalesce({c}, ''), '[a-zA-Z0-9]+')"
#: White space as in Python, for DuckDB's patterns.
_WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


_SCORES = f"""
    q AS (SELECT lower(t) AS term, count(*) AS n FROM (SELECT unnest({_TERMS.format(c="'" + QUERY + "'")}) AS t) GROUP BY 1),
    tf AS (SELECT doc_id, lower(t) AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format(c="text")}) AS t FROM documents) GROUP BY 1, 2),
    norm AS (SELECT doc_id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM tf GROUP BY 1),
    dot AS (SELECT doc_id, sum(tf * n)::DOUBLE AS dot FROM tf JOIN q USING (term) GROUP BY 1),
    scores AS (SELECT d.doc_id, round(coalesce(dot / (norm * (SELECT sqrt(sum(n * n)::DOUBLE) FROM q)), 0.0), 9) AS score
        FROM documents d LEFT JOIN norm USING (doc_id) LEFT JOIN dot USING (doc_id))"""
_LINES = "SELECT doc_id, unnest(string_split({t}, chr(10))) AS line, generate_subscripts(string_split({t}, chr(10)), 1) - 1 AS no FROM {f}"
_BLOCKS = f"""
    raw AS ({_LINES.format(t="text", f="documents")}),
    v AS (SELECT doc_id, string_agg(CASE no % 7 WHEN 0 THEN repeat('#', ((no // 7) % 3 + 1)::INT) || ' ' || line WHEN 3 THEN '- ' || line WHEN 5 THEN '| ' || line || ' |'
        WHEN 6 THEN '```' || chr(10) || line || chr(10) || '```' ELSE line END, chr(10) ORDER BY no) AS text FROM raw GROUP BY 1),
    l AS ({_LINES.format(t="text", f="v")}),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        sum((line LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS f FROM l),
    k AS (SELECT *, CASE WHEN line LIKE '```%' OR f % 2 = 1 THEN 'code' WHEN NOT regexp_matches(line, '[^{_WS}]') THEN 'blank'
        WHEN regexp_matches(line, '^#{{1,6}}[{_WS}]+.') THEN 'heading' WHEN line LIKE '|%' THEN 'table' WHEN regexp_matches(line, '^(- |[0-9]+\\.[{_WS}])') THEN 'list' ELSE 'para' END AS kind FROM o),
    g AS (SELECT *, CASE kind WHEN 'code' THEN 'code' || ((f + 1) // 2)::VARCHAR WHEN 'heading' THEN 'heading' || no::VARCHAR WHEN 'list' THEN 'text' WHEN 'para' THEN 'text' ELSE kind END AS grp FROM k),
    c AS (SELECT *, coalesce(grp <> lag(grp) OVER (PARTITION BY doc_id ORDER BY no), true)::INT AS change FROM g),
    i AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS island FROM c),
    m AS (SELECT *, max((kind = 'list')::INT) OVER (PARTITION BY doc_id, island ORDER BY no ROWS UNBOUNDED PRECEDING) AS listed FROM i WHERE kind <> 'blank'),
    b AS (SELECT doc_id, island, listed, CASE WHEN grp <> 'text' THEN kind WHEN listed = 1 THEN 'list' ELSE 'para' END AS type, min(start)::BIGINT AS start_off, max(start + length(line))::BIGINT AS end_off, arg_min(line, no) AS first
        FROM m GROUP BY 1, 2, 3, 4),
    blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_off) - 1 AS block_idx, type, start_off, end_off, first FROM b)"""
_CANDIDATES = f"""
    raw AS ({_LINES.format(t="text", f="documents")}),
    p AS (SELECT doc_id, (no // 10)::INT AS page_idx, engine, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (engine = 'marker' OR no % 3 <> 2), '') AS text
        FROM raw, (VALUES ('marker'), ('mineru')) e(engine) GROUP BY 1, 2, 3),
    s AS (SELECT doc_id, page_idx, engine, length(regexp_replace(text, '[{_WS}]+', '', 'g')) AS char_count,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS x, (text LIKE '#%')::INT AS h FROM p),
    scored AS (SELECT doc_id, page_idx, engine, char_count::BIGINT AS char_count, len(x)::BIGINT AS line_count,
        ln(1 + char_count) + 0.2 * ln(2) - 2.0 * CASE WHEN len(x) = 0 THEN 0 ELSE (len(x) - len(list_distinct(x))) / len(x) END + 0.2 * ln(1 + h) AS score FROM s)"""

QUERIES = {f.__name__: f for f in (
    retrieval_topk, retrieval_all_scores, term_frequency, doc_norms, doc_anchors, block_tokens, block_counts_by_type, section_paths,
    char_chunks, duplicate_line_rate, secret_scan, segment_spans, segment_block_spans, candidate_scores, page_selection,
)}
SQL = {
    "retrieval_topk": f"WITH {_SCORES} SELECT * FROM scores ORDER BY 2 DESC, 1 LIMIT 10",
    "retrieval_all_scores": f"WITH {_SCORES} SELECT * FROM scores",
    "term_frequency": f"WITH {_SCORES} SELECT * FROM tf",
    "doc_norms": f"WITH {_SCORES} SELECT doc_id, round(norm, 9) AS norm FROM norm",
    "doc_anchors": "SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 32) AS doc_anchor FROM documents",
    "block_tokens": f"WITH {_BLOCKS} SELECT doc_id, block_idx, type, start_off, end_off FROM blocks",
    "block_counts_by_type": f"WITH {_BLOCKS} SELECT type, count(*) AS n FROM blocks GROUP BY 1",
    "section_paths": f"""
        WITH RECURSIVE {_BLOCKS},
        h AS (SELECT doc_id, block_idx, length(regexp_extract(first, '^#+')) AS level, regexp_replace(regexp_replace(first, '^#+[{_WS}]+', ''), '[{_WS}]+$', '') AS text FROM blocks WHERE type = 'heading'),
        t AS (SELECT a.doc_id, a.block_idx, a.level, a.text, (SELECT max(b.block_idx) FROM h b WHERE b.doc_id = a.doc_id AND b.block_idx < a.block_idx AND b.level < a.level) AS parent_idx FROM h a),
        r AS (SELECT doc_id, block_idx, level, parent_idx, text AS path FROM t WHERE parent_idx IS NULL
            UNION ALL SELECT t.doc_id, t.block_idx, t.level, t.parent_idx, r.path || '>' || t.text FROM t JOIN r ON t.doc_id = r.doc_id AND t.parent_idx = r.block_idx)
        SELECT doc_id, block_idx, level, parent_idx, md5(path) AS path_md5 FROM r""",
    "char_chunks": f"""
        WITH s AS (SELECT doc_id, unnest(range(len(x))) AS page, {_strip("unnest(x)")} AS s FROM (SELECT doc_id, string_split(text, chr(12)) AS x FROM documents)),
        n AS (SELECT *, CASE WHEN length(s) <= 1200 THEN 1 ELSE ceil((length(s) - 1200) / 1080)::INT + 1 END AS n FROM s),
        p AS (SELECT doc_id, page, n, k, {_strip("substr(s, (k * 1080 + 1)::BIGINT, 1200)")} AS p FROM n, LATERAL (SELECT unnest(range(n)) AS k)),
        q AS (SELECT doc_id, page, p, row_number() OVER w - 1 AS no, count(*) OVER (PARTITION BY doc_id, page) AS n, lead(p) OVER w AS next FROM p WHERE p <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)),
        t AS (SELECT doc_id, page, no, CASE WHEN no = n - 2 AND length(next) < 250 THEN {_strip("p || chr(10) || next")} ELSE p END AS text FROM q WHERE NOT (no = n - 1 AND n > 1 AND length(p) < 250))
        SELECT doc_id, page AS page_idx, no AS chunk_no, doc_id || '-p' || lpad((page + 1)::VARCHAR, greatest(4, length((page + 1)::VARCHAR))::INT, '0') || '-c' || lpad((no + 1)::VARCHAR, greatest(3, length((no + 1)::VARCHAR))::INT, '0') AS chunk_id, md5(text) AS text_md5 FROM t""",
    "duplicate_line_rate": f"""
        WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: lower({_strip("x")})), lambda x: length(x) >= 8) AS x FROM documents)
        SELECT doc_id, len(x)::BIGINT AS n_lines, round((len(x) - len(list_distinct(x))) / greatest(len(x), 1), 9) AS duplicate_line_rate FROM x""",
    "secret_scan": f"WITH raw AS ({_LINES.format(t='text', f='documents')}) SELECT doc_id, no AS line_no FROM raw WHERE regexp_matches(line, 'AIza[A-Za-z0-9_-]{{35}}')",
    "segment_spans": f"""
        WITH c AS (SELECT doc_id, text, greatest(0, least(s, length(text))) AS s, e FROM documents, (VALUES (-3, 40), (40, 20), (100, 2000)) v(s, e)),
        d AS (SELECT doc_id, text, s, greatest(s, greatest(0, least(e, length(text)))) AS e FROM c)
        SELECT doc_id, s::BIGINT AS start_off, e::BIGINT AS end_off, md5(substr(text, s + 1, e - s)) AS passage_md5 FROM d WHERE regexp_matches(substr(text, s + 1, e - s), '[^{_WS}]')""",
    "segment_block_spans": f"""
        WITH {_BLOCKS},
        z AS (SELECT doc_id, text, CASE WHEN block_idx = 0 THEN 0 ELSE start_off END AS s, least(end_off, length(text)) AS e FROM blocks JOIN v USING (doc_id))
        SELECT doc_id, s::BIGINT AS start_off, e::BIGINT AS end_off, md5(substr(text, s + 1, e - s)) AS passage_md5 FROM z WHERE regexp_matches(substr(text, s + 1, e - s), '[^{_WS}]')""",
    "candidate_scores": f"WITH {_CANDIDATES} SELECT doc_id, page_idx, engine, char_count, line_count, round(score, 9) AS score FROM scored",
    "page_selection": f"""
        WITH {_CANDIDATES},
        z AS (SELECT doc_id, page_idx, max(CASE WHEN engine = 'marker' THEN score END) AS a, max(CASE WHEN engine = 'mineru' THEN score END) AS b,
            max(CASE WHEN engine = 'marker' THEN char_count END) AS na, max(CASE WHEN engine = 'mineru' THEN char_count END) AS nb FROM scored GROUP BY 1, 2),
        w AS (SELECT *, abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9) AS tied FROM z)
        SELECT doc_id, page_idx, CASE WHEN na = 0 AND nb = 0 THEN 'marker' WHEN nb = 0 THEN 'marker' WHEN na = 0 THEN 'mineru' WHEN a >= b THEN 'marker' ELSE 'mineru' END AS selected_engine,
            CASE WHEN na = 0 AND nb = 0 THEN 'all_empty_prefer_marker' WHEN na = 0 OR nb = 0 THEN 'only_one_ok' WHEN tied THEN 'score_tie_break_' || CASE WHEN a >= b THEN 'marker' ELSE 'mineru' END ELSE 'highest_score' END AS reason FROM w""",
}
