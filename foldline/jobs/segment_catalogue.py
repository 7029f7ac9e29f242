"""Registered queries over nearest vectors, lineage by text, splits, overlaps and JSON pages, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.jobs.catalogue import _WS, _docs, _strip, marked_up
from foldline.jobs.passage_catalogue import _ANCHORS_WHOLE
from foldline.operators import json_pages, lineage, segments, structure, validation, vectors
from foldline.sources import payloads
from foldline.sources.tables import fresh_table, kept

K = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _asked(rows: DataFrame) -> DataFrame:
    """The query set: every vector whose id is divisible by 100."""
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    found = vectors.nearest(_asked(rows), vectors.build_index(rows, "vec_id", "embedding"), K, exact=True)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def nearest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine of ten true neighbours without looking at all lists, over the whole query set."""
    rows = _vectors(spark, sf_dir)
    index, asked = vectors.build_index(rows, "vec_id", "embedding"), kept(_asked(rows), "asked")
    truth = kept(vectors.nearest(asked, index, K, exact=True).select("query_id", "id"), "truth")
    near = vectors.nearest(asked, index, K, probes=vectors.tuned_probes(asked, index, K)).select("query_id", "id", F.lit(1).alias("hit"))
    return truth.join(near, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.lit(K).cast("long").alias("k"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"))


def placed_vectors(rows: DataFrame) -> DataFrame:
    """The vectors as passages by their id: ten a section, ten sections a document, 20 to 79 tokens."""
    n = F.col("vec_id")
    return rows.select(
        F.floor(n / 100).alias("doc_id"), F.floor(n % 100 / 10).alias("section"), (n % 10).alias("passage"), n.alias("id"), (n % 60 + 20).alias("n_tokens"), "embedding",
    )


def retrieve_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    found = vectors.retrieve_passages(_asked(rows), vectors.build_index(rows, "vec_id", "embedding"), placed_vectors(rows), k=5, budget=400, exact=True)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "distance", "context_no")


def retrieve_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    places = placed_vectors(rows)
    means = kept(vectors.section_vectors(places, "doc_id", "section").select(vectors.section_key(F.col("doc_id"), F.col("section")).alias("id"), "v"), "means")
    found = vectors.retrieve_sections(_asked(rows), vectors.build_index(means, "id", "v"), vectors.build_index(rows, "vec_id", "embedding"), places, k=3, per_section=4, budget=400, exact=True)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "context_no")


def revised_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of each document as segments, and the same in reverse with every seventh gone and words added to every fifth."""
    rows = structure.lines(docs).where("line <> ''").select("doc_id", F.col("line_no").cast("long").alias("id"), F.col("line").alias("text"))
    text = F.when(F.col("id") % 5 == 1, F.concat("text", F.lit(" and two more"))).otherwise(F.col("text"))
    return rows, rows.where("id % 7 <> 3").select("doc_id", (1000000 - F.col("id")).alias("id"), text.alias("text"))


def text_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage.text_lineage(*revised_lines(_docs(spark, sf_dir)), 0.6)
    return found.select("doc_id", "id", "successor", F.round("similarity", 9).alias("similarity"))


def shaped_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, type, text): each document's lines as a table, as code, as a list, or as they are, in turn by id."""
    lines = F.split("text", "\n", -1)
    code = F.transform(lines, lambda x, i: F.when(i % 6 == 0, F.concat(F.lit("def f(): "), x)).when(i % 6 == 5, F.lit("")).otherwise(F.concat(F.lit("    "), x)))
    kind = F.element_at(F.array(*map(F.lit, ("table", "code", "list", "para"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    text = (
        F.when(F.col("type") == "table", F.concat(F.lit("| a | b |\n|---|---|\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("| "), x, F.lit(" |"))), "\n")))
        .when(F.col("type") == "code", F.array_join(code, "\n")).when(F.col("type") == "list", F.concat(F.lit("These are all:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")))
        .otherwise(F.col("text"))
    )
    return docs.withColumn("type", kind).select("doc_id", "type", text.alias("text"))


def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.split_blocks(shaped_blocks(_docs(spark, sf_dir)), most=60, special=60)
    return found.select("doc_id", "type", *[F.col(c).cast("long").alias(c) for c in ("piece_no", "start", "end", "n_tokens")], F.md5(F.concat("head", "body")).alias("text_md5"))


def line_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, section, passage, id, start, text, n_tokens): five lines a passage, five passages a section."""
    rows = structure.lines(docs).withColumn("passage", F.floor(F.col("line_no") / 5))
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    found = rows.groupBy("doc_id", "passage").agg(F.min("start").cast("long").alias("start"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    n = segments.token_count(F.col("text")).cast("long").alias("n_tokens")
    return found.select("doc_id", F.floor(F.col("passage") / 5).alias("section"), "passage", F.concat_ws("-", "doc_id", "passage").alias("id"), "start", "text", n)


def passage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.with_overlap(line_groups(_docs(spark, sf_dir)))
    return found.select("doc_id", "passage", "overlap_from", "overlap_start", "overlap_end", "overlap_tokens", F.md5("overlap_text").alias("overlap_md5"))


def _html(x):
    return F.concat(F.lit("<p>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;")), F.lit("</p><br/>"))


def _bbox(k):
    return F.array(F.lit(1.5), F.lit(0.0), F.lit(600.0) + k, F.lit(800.25))


def block_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, payload): each line a block, ten a page; pages come from ids, numbers, or are missing in turn; dimensions for even pages and one beyond the last."""
    lines = F.split("text", "\n", -1)
    page = lambda i: F.floor(i / 10).cast("int")
    block = lambda x, i: F.struct(F.when(i % 3 == 0, F.concat(F.lit("/page/"), page(i), F.lit("/Text/"), i)).alias("id"), F.when(i % 3 == 1, page(i)).alias("page"), _html(x).alias("html"))
    pages = F.transform(F.sequence(F.lit(0), page(F.size(lines) - 1) + 1), lambda k: F.struct((k * 2).cast("string").alias("key"), F.struct(_bbox(k).alias("bbox")).alias("value")))
    return docs.where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(F.transform(lines, block).alias("blocks"), F.map_from_entries(pages).alias("page_info"))).alias("payload"))


def page_tree_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, payload): ten lines a page, pages with their blocks below them; every fourth has no box."""
    lines = F.split("text", "\n", -1)
    block = lambda x: F.struct(_html(x).alias("html"))
    page = lambda k: F.struct(k.alias("page"), F.when(k % 4 != 3, _bbox(k)).alias("bbox"), F.transform(F.slice(lines, k * 10 + 1, F.lit(10)), block).alias("children"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")), page)
    return docs.where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(pages.alias("children"))).alias("payload"))


def nested_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, payload): ten lines a page under other keys at other depths, in an order that is not that of the alphabet."""
    lines = F.split("text", "\n", -1)
    of = lambda k, i: F.get(lines, k * 10 + i)
    page = lambda k: F.struct(
        F.struct(F.array(of(k, 2), of(k, 3)).alias("items"), of(k, 4).alias("html"), of(k, 5).alias("ignored")).alias("zone"), of(k, 1).alias("content"),
        F.array(F.struct(F.array(F.struct(of(k, 6).alias("latex"), of(k, 7).alias("text"))).alias("spans"))).alias("area"), of(k, 0).alias("text"), of(k, 8).alias("type"), k.alias("page_idx"),
    )
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")), page)
    return docs.where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(pages.alias("pdf_info"))).alias("payload"))


def _page_rows(found: DataFrame, *more: str) -> DataFrame:
    return found.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), *more, F.md5("text").alias("text_md5"))


def adapt_pages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(json_pages.block_pages(block_payloads(_docs(spark, sf_dir))), "width", "height")


def adapt_pages_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(json_pages.block_pages(page_tree_payloads(_docs(spark, sf_dir))), "width", "height")


def json_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(json_pages.listed_pages(nested_payloads(_docs(spark, sf_dir))))


def run_outputs(docs: DataFrame) -> DataFrame:
    """(run, path, length, content): the files that an engine might have left for each document: a JSON without pages, one with, and Markdown; every third document has no JSON with pages."""
    lines = F.split("text", "\n", -1)
    pages = F.to_json(F.transform(lines, lambda x: F.struct(x.alias("text"))))
    files = {"a.json": F.lit('{"pages": 1}'), "b_middle.json": F.when(F.col("doc_id") % 3 != 0, pages), "c_meta.json": F.concat(F.lit('["'), F.repeat(F.lit("x"), F.length("text")), F.lit('"]')), "d.md": F.lit("  "), "e.md": F.col("text")}
    each = F.array(*[F.struct(F.lit(k).alias("path"), v.alias("content")) for k, v in files.items()])
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("run"), F.explode(each).alias("f")).where("f.content IS NOT NULL AND (f.path <> 'c_meta.json' OR run % 3 = 1)")
    return rows.select("run", "f.path", F.length("f.content").cast("long").alias("length"), "f.content")


def payload_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = kept(run_outputs(_docs(spark, sf_dir)).drop("content"), "files")
    return payloads.largest_json(files).withColumnRenamed("path", "largest").join(payloads.preferred_json(files).withColumnRenamed("path", "preferred"), "run", "full_outer").select(F.col("run").alias("doc_id"), "largest", "preferred")


def loaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.loaded_pages(kept(run_outputs(_docs(spark, sf_dir)), "files"))
    return found.select(F.col("run").alias("doc_id"), F.col("page_idx").cast("long").alias("page_idx"), F.md5("text").alias("text_md5"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment tree of the marked-up documents: their heading sections, and as passages their other blocks. A document's version is the digest of its text."""
    docs = marked_up(_docs(spark, sf_dir).where("text IS NOT NULL"))
    found = kept(structure.anchored(structure.blocks(docs)), "anchored")
    rows = found.where("type <> 'heading'").select("doc_id", "section_path", F.col("pass_anchor").alias("anchor"), F.col("start_off").alias("start"), F.col("end_off").alias("end"), F.lit(1).alias("n_tokens"))
    return segments.segment_tree(found, rows, docs.select("doc_id", F.md5("text").alias("version")))


def segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _segments(spark, sf_dir)
    return found.select("doc_id", "segment_id", "parent_id", "type", F.md5("section_path").alias("path_md5"), *[F.col(c).cast("long").alias(c) for c in ("start", "end", "ordinal")])


def tree_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each document and kind, and how many of them break the tree."""
    tree = kept(_segments(spark, sf_dir), "tree")
    bad = segments.tree_violations(tree).select("doc_id", "segment_id", F.lit(1).alias("bad")).distinct()
    return tree.join(bad, ["doc_id", "segment_id"], "left").groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_bad"))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers behind the gates, and whether each holds, for groups of five lines with 20 to 60 tokens as bounds; observed in the job that writes the passages."""
    rows = line_groups(_docs(spark, sf_dir)).select(
        F.sha2("id", 256).alias("segment_id"), F.lit("PASSAGE").alias("type"), F.col("section").cast("string").alias("parent_id"), F.col("section").cast("string").alias("section_path"),
        F.col("id").alias("anchor"), "text", F.col("n_tokens").alias("token_count"),
    )
    facts = segments.write_gated(rows, fresh_table(spark, "gated"), least=20, most=60)
    gates = segments.gate_report(facts)
    return spark.createDataFrame([(*facts.values(), *gates.values())], ", ".join([f"{k} long" for k in facts] + [f"ok_{k} boolean" for k in gates]))


def output_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a parser would leave them: by their ids, some of an unsupported family, some whose pipeline failed, some of white space only; with the anchors that the rest have."""
    n = F.col("doc_id")
    docs = marked_up(_docs(spark, sf_dir).where("text IS NOT NULL")).withColumn("source", F.when(n % 13 == 0, "").otherwise(F.col("text")))
    docs = docs.withColumn("text", F.when((n % 13 == 0) | (n % 11 == 0) | (n % 7 == 0), "").when(n % 5 == 0, "\u2003 \n\t").otherwise(F.col("text")))
    family, pipeline = F.when(n % 11 == 0, "unsupported").otherwise("markdown"), F.when(n % 7 == 0, "failed").otherwise("ok")
    states = docs.select("doc_id", validation.output_state(family, F.col("source"), F.col("text"), pipeline).alias("s")).select("doc_id", "s.*")
    return states.join(validation.anchor_completeness(docs, structure.anchored(structure.blocks(docs))), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (nearest_exact, nearest_recall, retrieve_passages, retrieve_sections, text_lineage, split_blocks, passage_overlap, adapt_pages_flat, adapt_pages_tree, json_fragments, segment_tree, tree_checks, gate_report, payload_picks, loaded_pages, output_states)
}

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_HITS = f"""{_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0)"""


def _tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{_WS}]+'))"


_FIT = """SELECT query_id, vec_id, score, distance, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS context_no
        FROM (SELECT *, sum(20 + vec_id % 60) OVER (PARTITION BY query_id ORDER BY distance, score DESC, vec_id) AS total FROM {0}) WHERE total <= 400"""
_LINEAGE = f"""
    WITH o AS (SELECT doc_id, unnest(range(len(x))) AS id, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
    a AS (SELECT * FROM o WHERE text <> ''), b AS (SELECT doc_id, 1000000 - id AS id, CASE WHEN id % 5 = 1 THEN text || ' and two more' ELSE text END AS text FROM a WHERE id % 7 <> 3),
    am AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY id) - 1 AS k FROM a), bm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY id) - 1 AS k FROM b),
    ac AS (SELECT doc_id, text, min(id) AS first, count(*) AS n, list_distinct(regexp_extract_all(lower(text), '[^{_WS}]+')) AS w FROM a GROUP BY 1, 2),
    bc AS (SELECT doc_id, text, min(id) AS first, count(*) AS n, list_distinct(regexp_extract_all(lower(text), '[^{_WS}]+')) AS w FROM b GROUP BY 1, 2),
    p AS (SELECT *, CASE WHEN len(w1) = 0 AND len(w2) = 0 THEN 1.0 WHEN len(w1) = 0 OR len(w2) = 0 THEN 0.0 ELSE c / (len(w1) + len(w2) - c) END AS s FROM (
        SELECT ac.doc_id, ac.text AS t1, bc.text AS t2, ac.first AS f1, bc.first AS f2, ac.n AS n1, bc.n AS n2, ac.w AS w1, bc.w AS w2, len(list_intersect(ac.w, bc.w)) AS c FROM ac JOIN bc USING (doc_id))),
    g AS (SELECT doc_id, list_reduce(list_prepend({{'f1': -1::BIGINT, 'f2': -1::BIGINT, 'n1': 0::BIGINT, 'n2': 0::BIGINT, 's': 0.0::DOUBLE, 'out': []::STRUCT(f1 BIGINT, f2 BIGINT, a1 BIGINT, a2 BIGINT, t BIGINT, s DOUBLE)[]}},
            list({{'f1': f1, 'f2': f2, 'n1': n1, 'n2': n2, 's': s::DOUBLE, 'out': []::STRUCT(f1 BIGINT, f2 BIGINT, a1 BIGINT, a2 BIGINT, t BIGINT, s DOUBLE)[]}} ORDER BY s DESC, (t1 <> t2)::INT, f1, f2)),
        lambda x, y: {{'f1': -1::BIGINT, 'f2': -1::BIGINT, 'n1': 0::BIGINT, 'n2': 0::BIGINT, 's': 0.0::DOUBLE, 'out': list_concat(x.out, list_filter([{{'f1': y.f1, 'f2': y.f2,
            'a1': coalesce(list_sum(list_transform(list_filter(x.out, lambda z: z.f1 = y.f1), lambda z: z.t)), 0)::BIGINT, 'a2': coalesce(list_sum(list_transform(list_filter(x.out, lambda z: z.f2 = y.f2), lambda z: z.t)), 0)::BIGINT,
            't': least(y.n1 - coalesce(list_sum(list_transform(list_filter(x.out, lambda z: z.f1 = y.f1), lambda z: z.t)), 0), y.n2 - coalesce(list_sum(list_transform(list_filter(x.out, lambda z: z.f2 = y.f2), lambda z: z.t)), 0))::BIGINT,
            's': y.s}}], lambda z: z.t > 0))}}).out AS out FROM p WHERE s >= 0.6 GROUP BY 1),
    r AS (SELECT doc_id, u.*, unnest(range(u.t)) AS j FROM (SELECT doc_id, unnest(out) AS u FROM g)),
    m AS (SELECT r.doc_id, am.id, bm.id AS successor, r.s FROM r JOIN ac ON ac.doc_id = r.doc_id AND ac.first = r.f1 JOIN bc ON bc.doc_id = r.doc_id AND bc.first = r.f2
        JOIN am ON am.doc_id = r.doc_id AND am.text = ac.text AND am.k = r.a1 + r.j JOIN bm ON bm.doc_id = r.doc_id AND bm.text = bc.text AND bm.k = r.a2 + r.j)
    SELECT a.doc_id, a.id, m.successor, round(m.s, 9) AS similarity FROM a LEFT JOIN m USING (doc_id, id)"""


def _fold() -> str:
    """The greedy cut as a fold over a list of units {n, rank}; elements carry the state's fields too."""
    here = {(c, k): f"CASE WHEN y.rank = {k} THEN {v} ELSE x.{c}{k} END" for k in (1, 2, 3) for c, v in (("at", "x.i"), ("sum", "x.total"))}
    total, full = "(x.total + y.n)", "(x.i > x.start AND x.total + y.n - x.base > y.most)"
    good = {k: f"({here['at', k]} > x.start AND {total} - {here['sum', k]} <= y.most AND ({here['sum', k]} - x.base) * 2 >= y.most)" for k in (1, 2, 3)}
    pick = lambda c, last: f"CASE WHEN {good[3]} THEN {here[c, 3]} WHEN {good[2]} THEN {here[c, 2]} WHEN {good[1]} THEN {here[c, 1]} ELSE {last} END"
    to, upto = pick("at", "x.i"), pick("sum", "x.total")
    fields = ", ".join(f"'{c}{k}': {here[c, k]}" for k in (1, 2, 3) for c in ("at", "sum"))
    return f"""lambda x, y: {{'n': 0::BIGINT, 'rank': 0::BIGINT, 'most': y.most, 'pieces': CASE WHEN {full} THEN list_append(x.pieces, {{'a': x.start, 'b': {to}, 'n': {upto} - x.base}}) ELSE x.pieces END,
        'i': x.i + 1, 'total': {total}, 'start': CASE WHEN {full} THEN {to} ELSE x.start END, 'base': CASE WHEN {full} THEN {upto} ELSE x.base END, {fields}}}"""


_STATE = "'pieces': []::STRUCT(a BIGINT, b BIGINT, n BIGINT)[], 'i': 0::BIGINT, 'total': 0::BIGINT, 'start': 0::BIGINT, 'base': 0::BIGINT, " + ", ".join(f"'{c}{k}': {v}::BIGINT" for k in (1, 2, 3) for c, v in (("at", -1), ("sum", 0)))
_SENTENCE = f"(?s).+?(?:[.!?…]+[\"''”’)\\]]*[{_WS}]+|\\n[{_WS}]*|\\z)"
_SPLIT = f"""
    WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, 'table' AS type, '| a | b |' || chr(10) || '|---|---|' || chr(10) AS head, array_to_string(list_transform(x, lambda s: '| ' || s || ' |'), chr(10)) AS text FROM l WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 'code', '', array_to_string(list_transform(x, lambda s, i: CASE WHEN (i - 1) % 6 = 0 THEN 'def f(): ' || s WHEN (i - 1) % 6 = 5 THEN '' ELSE '    ' || s END), chr(10)) FROM l WHERE doc_id % 4 = 1
        UNION ALL SELECT doc_id, 'list', 'These are all:' || chr(10), array_to_string(list_transform(x, lambda s: '- ' || s), chr(10)) FROM l WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 'para', '', text FROM l WHERE doc_id % 4 = 3),
    c AS (SELECT *, head || text AS whole, {_tokens("head || text")} AS n, {_tokens("head")} AS hn FROM b WHERE head || text <> ''),
    u AS (SELECT *, CASE WHEN type = 'para' THEN regexp_extract_all(text, '{_SENTENCE}') ELSE regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') END AS raw FROM c WHERE n > 60),
    v AS (SELECT *, list_transform(raw, lambda s, i: {{'s': s, 'n': {_tokens("s")}, 'rank': CASE WHEN type <> 'code' THEN 1 WHEN s LIKE 'def %' THEN 3 WHEN i > 1 AND NOT regexp_matches(raw[i - 1], '[^{_WS}]') THEN 2 ELSE 1 END}}) AS us FROM u),
    w AS (SELECT doc_id, type, head, hn, flatten(list_transform(us, lambda z: CASE WHEN z.n <= 60 OR type IN ('table', 'list') THEN [z]
        ELSE list_transform(regexp_extract_all(z.s, '[{_WS}]*[^{_WS}]+[{_WS}]*'), lambda s, i: {{'s': s, 'n': 1::BIGINT, 'rank': CASE WHEN i = 1 THEN z.rank ELSE 0 END}}) END)) AS us FROM v),
    f AS (SELECT *, list_reduce(list_prepend({{'n': 0::BIGINT, 'rank': 0::BIGINT, 'most': greatest(60 - hn, 1)::BIGINT, {_STATE}}}, list_transform(us, lambda z: {{'n': z.n::BIGINT, 'rank': z.rank::BIGINT, 'most': greatest(60 - hn, 1)::BIGINT, {_STATE}}})), {_fold()}) AS r FROM w),
    p AS (SELECT doc_id, type, head, hn, unnest(range(len(ps))) AS piece_no, unnest(ps) AS p, us FROM (SELECT *, list_append(r.pieces, {{'a': r.start, 'b': r.i, 'n': r.total - r.base}}) AS ps FROM f)),
    q AS (SELECT *, array_to_string(list_transform(us[p.a + 1:p.b], lambda z: z.s), '') AS body FROM p)
    SELECT doc_id, type, piece_no::BIGINT AS piece_no, (length(head) + coalesce(sum(length(body)) OVER (PARTITION BY doc_id, type ORDER BY piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
        (length(head) + sum(length(body)) OVER (PARTITION BY doc_id, type ORDER BY piece_no))::BIGINT AS "end", (p.n + hn)::BIGINT AS n_tokens, md5(head || body) AS text_md5 FROM q
    UNION ALL SELECT doc_id, type, 0, 0, length(whole), n, md5(whole) FROM c WHERE n <= 60"""


def _trimmed(c: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_PAGED = f"""l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS raw, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
    t AS (SELECT doc_id, i, n, {_trimmed("raw || chr(10) || chr(10)")} AS x FROM l)"""


def _hash(*parts: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')" for x in parts) + ")"


_TREE = f"""{_ANCHORS_WHOLE},
    d AS (SELECT doc_id, md5(text) AS version FROM v), x AS (SELECT s.*, b.start_off, b.end_off FROM s JOIN blocks b ON b.doc_id = s.doc_id AND b.block_idx = s.block_idx),
    sec AS (SELECT x.doc_id, x.path, x.sec_anchor AS anchor, min(x.start_off) AS st, max(x.end_off) AS en, arg_min(h3.parent_idx, x.block_idx) FILTER (x.type = 'heading') AS parent_idx
        FROM x LEFT JOIN h3 ON h3.doc_id = x.doc_id AND h3.block_idx = x.block_idx WHERE x.path <> 'root' GROUP BY 1, 2, 3),
    seen AS (SELECT doc_id, 'root' AS path, substr(sha256(doc_id || 'root'), 1, 32) AS anchor, 0 AS st, (SELECT coalesce(max(end_off), 0) FROM x WHERE x.doc_id = d.doc_id) AS en, NULL::VARCHAR AS up FROM d
        UNION ALL SELECT sec.doc_id, sec.path, anchor, st, en, coalesce(r.path, 'root') FROM sec LEFT JOIN r ON r.doc_id = sec.doc_id AND r.block_idx = sec.parent_idx),
    q AS (SELECT seen.*, {_hash("seen.doc_id", "version", "'SECTION'", "path", "anchor", "st", "en")} AS id FROM seen JOIN d USING (doc_id)),
    p AS (SELECT x.doc_id, path, substr(sha256(sec_anchor || type || ordinal), 1, 32) AS anchor, start_off AS st, end_off AS en, version FROM x JOIN d USING (doc_id) WHERE type <> 'heading'),
    w AS (SELECT q.doc_id, q.id, u.id AS parent_id, 'SECTION' AS type, q.path, q.anchor, q.st, q.en FROM q LEFT JOIN q u ON u.doc_id = q.doc_id AND u.path = q.up
        UNION ALL SELECT p.doc_id, {_hash("p.doc_id", "version", "'PASSAGE'", "p.path", "p.anchor", "p.st", "p.en")}, u.id, 'PASSAGE', p.path, p.anchor, p.st, p.en FROM p LEFT JOIN q u ON u.doc_id = p.doc_id AND u.path = p.path)"""
SQL = {
    "segment_tree": f"""
        {_TREE} SELECT doc_id, id AS segment_id, parent_id, type, md5(path) AS path_md5, st::BIGINT AS start, en::BIGINT AS "end",
            row_number() OVER (PARTITION BY doc_id, parent_id, type ORDER BY st, path, anchor, id) - 1 AS ordinal FROM w""",
    "tree_checks": f"{_TREE} SELECT doc_id, type, count(*) AS n, 0::BIGINT AS n_bad FROM w GROUP BY 1, 2",
    "gate_report": f"""
        WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
        p AS (SELECT doc_id, i // 5 AS passage, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY 1, 2),
        c AS (SELECT count(*) AS passages, 0::BIGINT AS sections, count(*) FILTER (NOT regexp_matches(text, '[^{_WS}]')) AS empty, count(*) FILTER ({_tokens("text")} NOT BETWEEN 20 AND 60) AS out_of_bounds, count(*) AS normal,
            count(*) FILTER (NOT regexp_matches(regexp_replace(text, '[{_WS}]+$', ''), '[.!?…:;|`}}\\])"''”’]$|^$')) AS mid_sentence, 0::BIGINT AS incomplete FROM p)
        SELECT *, empty = 0 AS ok_no_empty, true AS ok_complete, normal = 0 OR (normal - out_of_bounds) / greatest(normal, 1) >= 0.95 AS ok_bounds, mid_sentence / greatest(normal, 1) <= 0.005 AS ok_sentences FROM c""",
    "output_states": """
        WITH d AS (SELECT doc_id, doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 AS bare FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, NOT bare AS has_textual_content, bare AS degraded_output, CASE WHEN doc_id % 7 = 0 THEN 'pdf_pipeline_failed' WHEN doc_id % 11 = 0 THEN 'unsupported_content_type' WHEN doc_id % 13 = 0 THEN 'empty_input'
            WHEN doc_id % 5 = 0 THEN 'no_textual_content' END AS degraded_reason, CASE WHEN bare THEN 'document_only' ELSE 'full' END AS anchor_completeness FROM d""",
    "payload_picks": """
        WITH f AS (SELECT doc_id, length(text) AS n, len(string_split(text, chr(10))) AS k, len(to_json(list_transform(string_split(text, chr(10)), lambda x: {'text': x}))::VARCHAR) AS j FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND j >= 12 THEN 'b_middle.json' ELSE 'a.json' END AS largest, CASE WHEN doc_id % 3 <> 0 THEN 'b_middle.json' WHEN doc_id % 3 = 1 AND n + 4 > 12 THEN 'c_meta.json' ELSE 'a.json' END AS preferred FROM f""",
    "loaded_pages": f"""
        WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 2))
        SELECT doc_id, i AS page_idx, md5({_strip("raw")}) AS text_md5 FROM l
        UNION ALL SELECT doc_id, i, md5({_strip("raw")}) FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 1))
        UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE doc_id % 3 = 0 AND regexp_matches(text, '[^{_WS}]')""",
    "nearest_exact": f"WITH {_HITS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {K}",
    "nearest_recall": f"SELECT count(*) AS n_queries, {K}::BIGINT AS k, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "retrieve_passages": f"""
        WITH {_HITS}, h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5),
        x AS (SELECT query_id, vec_id + d AS vec_id, score, abs(d) AS distance FROM h, (SELECT unnest([-1, 0, 1]) AS d) WHERE vec_id % 10 + d BETWEEN 0 AND 9),
        y AS (SELECT * FROM x SEMI JOIN e USING (vec_id) QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY distance, score DESC) = 1)
        {_FIT.format("y").replace("distance, row", "distance::BIGINT AS distance, row")}""",
    "retrieve_sections": f"""
        WITH {_HITS}, d AS (SELECT vec_id // 10 AS sec, unnest(range(1, len(v) + 1)) AS k, unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM e),
        m AS (SELECT sec, list(x ORDER BY k) AS v FROM (SELECT sec, k, avg(x) AS x FROM d GROUP BY 1, 2) GROUP BY 1),
        r AS (SELECT q.vec_id AS query_id, sec, round(list_cosine_similarity(q.v, m.v), 6) AS score FROM e q, m WHERE q.vec_id % 100 = 0),
        c AS (SELECT query_id, sec FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, (sec // 10)::VARCHAR || '/' || (sec % 10)::VARCHAR) <= 3),
        z AS (SELECT s.query_id, s.vec_id, s.score, 0 AS distance FROM s JOIN c ON c.query_id = s.query_id AND s.vec_id // 10 = c.sec QUALIFY row_number() OVER (PARTITION BY s.query_id, c.sec ORDER BY s.score DESC, s.vec_id) <= 4)
        SELECT query_id, vec_id, score, context_no FROM ({_FIT.format("z")})""",
    "text_lineage": _LINEAGE,
    "split_blocks": _SPLIT,
    "passage_overlap": f"""
        WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
        o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
        p AS (SELECT doc_id, i // 5 AS passage, min(off) AS start, string_agg(line, chr(10) ORDER BY i) AS text FROM o GROUP BY 1, 2),
        s AS (SELECT doc_id, passage, unnest(range(len(x))) AS k, unnest(x) AS s FROM (SELECT doc_id, passage, regexp_extract_all(text, '{_SENTENCE}') AS x FROM p)),
        c AS (SELECT *, sum({_tokens("s")}) OVER (PARTITION BY doc_id, passage ORDER BY k DESC) AS n FROM s),
        t AS (SELECT c.doc_id, c.passage, max(n) AS n, sum(length(s)) AS chars FROM c JOIN p USING (doc_id, passage) WHERE n <= floor({_tokens("p.text")} * 0.10 + 1e-9) GROUP BY 1, 2 HAVING max(n) > 0),
        q AS (SELECT p.*, t.n, t.chars FROM p JOIN t USING (doc_id, passage))
        SELECT p.doc_id, p.passage, q.doc_id::VARCHAR || '-' || q.passage::VARCHAR AS overlap_from, (q.start + length(q.text) - q.chars)::BIGINT AS overlap_start, (q.start + length(q.text))::BIGINT AS overlap_end, q.n::BIGINT AS overlap_tokens,
            md5(right(q.text, q.chars::BIGINT)) AS overlap_md5 FROM p LEFT JOIN q ON q.doc_id = p.doc_id AND q.passage = p.passage - 1 AND q.passage // 5 = p.passage // 5""",
    "adapt_pages_flat": f"""
        WITH {_PAGED}, b AS (SELECT doc_id, i // 10 AS page_idx, {_strip("string_agg(x, chr(10) ORDER BY i)")} AS text FROM t WHERE i % 3 < 2 AND x <> '' GROUP BY 1, 2),
        d AS (SELECT doc_id, unnest(range((max(n) - 1) // 10 + 2)) AS k FROM t GROUP BY 1)
        SELECT coalesce(b.doc_id, d.doc_id) AS doc_id, coalesce(b.page_idx, 2 * d.k) AS page_idx, CASE WHEN d.k IS NOT NULL THEN 600.0::DOUBLE + d.k - 1.5 END AS width, CASE WHEN d.k IS NOT NULL THEN 800.25::DOUBLE END AS height, md5(coalesce(text, '')) AS text_md5
        FROM b FULL JOIN d ON d.doc_id = b.doc_id AND 2 * d.k = b.page_idx""",
    "adapt_pages_tree": f"""
        WITH {_PAGED} SELECT doc_id, i // 10 AS page_idx, CASE WHEN (i // 10) % 4 <> 3 THEN 600.0::DOUBLE + i // 10 - 1.5 END AS width, CASE WHEN (i // 10) % 4 <> 3 THEN 800.25::DOUBLE END AS height,
            md5(coalesce({_strip("string_agg(x, chr(10) ORDER BY i) FILTER (x <> '')")}, '')) AS text_md5 FROM t GROUP BY 1, 2, 3, 4""",
    "json_fragments": f"""
        WITH {_PAGED}, f AS (SELECT doc_id, i // 10 AS page_idx, [0, 1, 3, 4, 2, NULL, 6, 5][i % 10 + 1] AS o, {_strip("raw")} AS x FROM l WHERE i % 10 < 8)
        SELECT p.doc_id, p.page_idx, md5(coalesce({_strip("regexp_replace(f.text, '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")}, '')) AS text_md5 FROM (SELECT DISTINCT doc_id, i // 10 AS page_idx FROM l) p
        LEFT JOIN (SELECT doc_id, page_idx, string_agg(x, chr(10) ORDER BY o) AS text FROM f WHERE o IS NOT NULL AND x <> '' GROUP BY 1, 2) f USING (doc_id, page_idx)""",
}
