"""Registered queries over versioned tables, reruns and run records, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.jobs import catalogue
from foldline.jobs.catalogue import _BLOCKS, _WS, _docs, _strip, engine_pages, marked_up
from foldline.operators import chunking, runs, structure
from foldline.sources.tables import fresh_table, kept
from foldline.sources.versioned import VersionedTable


def versioned_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, then newer states and tombstones, then a late batch of older states, then a replay of the second."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    state = lambda rows, more, seq, gone: rows.select("doc_id", "lang", (F.col("n_chars") + more).alias("n_chars"), F.lit(seq).alias("seq"), F.lit(gone).alias("deleted"))
    newer = state(docs.where("doc_id % 3 = 0"), 1, 3, False).unionByName(state(docs.where("doc_id % 5 = 0"), 0, 3, True))
    table = VersionedTable(spark, fresh_table(spark, "versioned"), "doc_id", buckets=32)
    table.apply(state(docs, 0, 1, False), "w", 0)
    table.apply(newer, "w", 1)
    table.apply(state(docs.where("doc_id % 2 = 0"), 1000, 2, False), "late", 0)
    table.apply(newer, "w", 1)
    return table.read()


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the documents, once as they lie and once dealt anew: the tables must be the same."""
    def tables(docs: DataFrame) -> dict[str, DataFrame]:
        return {"blocks": structure.blocks(marked_up(docs)), "chunks": chunking.chunks(docs)}

    docs = _docs(spark, sf_dir)
    found = runs.run_diff(tables(docs), tables(docs.repartition("lang", "n_chars")))
    return found.select("name", "n_first", "n_second", "same")


def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each engine's pages, added up from three batches; an empty page counts as an error, and a page takes a hundredth of a second for each character."""
    pages = engine_pages(_docs(spark, sf_dir)).select("doc_id", F.col("engine").alias("run_id"), F.when(F.length("text") > 0, "ok").otherwise("error").alias("status"), (F.length("text") / F.lit(100.0)).alias("seconds"), "text")
    pages = kept(pages, "pages")
    batches = [pages.where(F.pmod("doc_id", F.lit(3)) == k) for k in range(3)]
    found = runs.run_record(runs.merged(*[runs.run_parts(b, b.where("text <> ''")) for b in batches]), least_content=0.9)
    rounded = [F.round(c, 6).alias(c) for c in ("seconds", "seconds_per_page", "p95_seconds_per_page", "failure_rate", "non_empty_content_rate", "duplicate_line_rate")]
    return found.select("run_id", "pages", "failures", "chunk_count", "char_length_p50", "char_length_p90", *rounded, *[F.col(f"gates.{g}").alias(f"gate_{g}") for g in ("reliable", "content", "duplicates")])


QUERIES = {f.__name__: f for f in (versioned_upserts, run_diff, run_record)}
SQL = {
    "versioned_upserts": """
        SELECT doc_id, lang, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 2 = 0 THEN 1000 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 5 <> 0""",
    "run_diff": f"""
        WITH {_BLOCKS} SELECT 'blocks' AS name, count(*) AS n_first, count(*) AS n_second, true AS same FROM blocks
        UNION ALL SELECT 'chunks', count(*), count(*), true FROM ({catalogue.SQL["char_chunks"]})""",
    "run_record": f"""
        WITH r AS (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        p AS (SELECT doc_id, engine AS run_id, no // 10 AS page, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (engine = 'marker' OR no % 3 <> 2), '') AS text FROM r, (VALUES ('marker'), ('mineru')) v(engine) GROUP BY 1, 2, 3),
        l AS (SELECT run_id, lower({_strip("line")}) AS line FROM (SELECT run_id, unnest(string_split(text, chr(10))) AS line FROM p)),
        d AS (SELECT run_id, sum(n - 1) AS again, sum(n) AS lines FROM (SELECT run_id, line, count(*) AS n FROM l WHERE length(line) >= 8 GROUP BY 1, 2) GROUP BY 1),
        f AS (SELECT run_id, count(*) AS pages, count(*) FILTER (text = '') AS failures, count(*) FILTER (text <> '') AS chunk_count, list_sort(list(length(text))) AS all_, list_sort(list(length(text)) FILTER (text <> '')) AS most,
            sum(length(text)) / 100.0 AS seconds, avg((regexp_matches(text, '[^{_WS}]'))::INT) AS content FROM p GROUP BY 1)
        SELECT run_id, pages, failures, chunk_count, most[round_even((chunk_count - 1) * 50 / 100.0, 0)::INT + 1]::DOUBLE AS char_length_p50, most[round_even((chunk_count - 1) * 90 / 100.0, 0)::INT + 1]::DOUBLE AS char_length_p90,
            round(seconds, 6)::DOUBLE AS seconds, round(seconds / pages, 6)::DOUBLE AS seconds_per_page, round(all_[round_even((pages - 1) * 95 / 100.0, 0)::INT + 1] / 100.0, 6)::DOUBLE AS p95_seconds_per_page,
            round(failures / pages, 6) AS failure_rate, round(content, 6) AS non_empty_content_rate, round(again / lines, 6) AS duplicate_line_rate,
            failures = 0 AS gate_reliable, content >= 0.9 AS gate_content, again / lines <= 0.3 AS gate_duplicates FROM f JOIN d USING (run_id)""",
}
