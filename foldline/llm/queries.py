"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm._shared import written
from foldline.llm.bpe import bpe_encode
from foldline.llm.conversation_trie import conversation_trie
from foldline.llm.exact_dedup import exact_dedup
from foldline.llm.license_scan import judged, license_scan
from foldline.llm.line_dedup import line_dedup
from foldline.llm.lm_scoring import lm_scores
from foldline.llm.merkle import merkle_manifest
from foldline.llm.minhash import near_duplicates
from foldline.llm.mixing import mix
from foldline.llm.pii import KINDS, MORE_KINDS, find_private
from foldline.llm.quality_classifier import classify
from foldline.llm.quality_rules import base_failed, fitted, text_stats, with_posterior
from foldline.llm.substring_dedup import substring_dedup


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), run_lines=2, run_words=50)
    return out.select(
        "doc_id", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(documents(spark, sf_dir).select("doc_id", text_stats(F.col("text")).alias("stats")), "stats")
    s, good = F.col("stats"), F.col("posterior")
    return with_posterior(stats, fitted(stats)).select(
        "doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"), (~base_failed(s) & (good >= 0.5)).alias("kept"), F.round(good, 6).alias("posterior"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), shingle=5, percent=85)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "kept", F.round("quality", 6).alias("quality"), F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(documents(spark, sf_dir), vocabulary(), decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_private(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.transform(F.filter("spans", lambda s: s["kind"].isin(*KINDS)), text)
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    return out.select(
        "doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(F.transform("spans", text), terms), ",").alias("spans"), *map(count, MORE_KINDS), F.size("terms").cast("long").alias("n_terms"),
        F.size("spans").cast("long").alias("n_private"), (F.size("spans") > 0).alias("flagged"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle_manifest(documents(spark, sf_dir), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(license_scan(documents(spark, sf_dir)))
    base = F.filter("places", lambda p: p["kind"] == "base")
    words = F.transform(base, lambda p: p["word"])
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
        F.size("expressions").cast("long").alias("n_expressions"),
    )


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_lm_scoring, op3_substring_dedup, op4_quality_rules, op5_minhash, op6_exact_dedup, op7_mixing, op8_quality_classifier, op9_bpe, op10_pii, op11_conversation_trie, op12_merkle_manifest, op13_license_scan)}
#: Words of a text; its lines with a word, without outer white space, in order.
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: DuckDB has no crc32: byte by byte, eight steps of the polynomial each.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1)))))"""
SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
        k AS (SELECT doc_id, no, trim(line, E' \t\n\x0b\x0c\r') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS p FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        w AS (SELECT a.doc_id, a.p, a.no AS no1, b.no AS no2, a.line || chr(10) || b.line AS run FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.p = a.p + 1),
        f AS (SELECT run, min(doc_id) AS doc_id FROM w GROUP BY 1), g AS (SELECT w.run, w.doc_id, min(p) AS p FROM w JOIN f USING (run, doc_id) GROUP BY 1, 2),
        d AS (SELECT w.doc_id, unnest([no1, no2]) AS no FROM w JOIN g USING (run) WHERE w.doc_id > g.doc_id OR (w.doc_id = g.doc_id AND w.p >= g.p + 2)),
        s AS (SELECT doc_id, no, line FROM k WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50), s1 AS (SELECT line, min(doc_id) AS doc_id FROM s GROUP BY 1),
        s2 AS (SELECT line, doc_id, min(no) AS no FROM s JOIN s1 USING (line, doc_id) GROUP BY 1, 2),
        x AS (SELECT doc_id, no FROM d UNION SELECT s.doc_id, s.no FROM s JOIN s2 USING (line) WHERE s.doc_id > s2.doc_id OR s.no > s2.no),
        t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (x.no IS NULL) AS kept,
                coalesce(string_agg(x.no::VARCHAR, ',' ORDER BY x.no), '') AS removed, count(x.no) AS n FROM l LEFT JOIN x USING (doc_id, no) GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN t USING (doc_id)""",
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op11_conversation_trie": r"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
                strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS key, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, CRC % 9 AS h, list(sha256(key) ORDER BY pos) AS keys, list(bytes ORDER BY pos) AS bytes FROM t GROUP BY 1),
        r AS (SELECT c.conv_id, coalesce(b.keys[1:c.h], []) || c.keys[c.h + 1:] AS keys, coalesce(b.bytes[1:c.h], []) || c.bytes[c.h + 1:] AS bytes
            FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
        p AS (SELECT conv_id, d, sha256(array_to_string(keys[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(keys[1:d - 1], ',')) END AS up,
                CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS b, len(keys) = d AS last FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM r)),
        n AS (SELECT d, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS saved,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM p GROUP BY 1, 2),
        x AS (SELECT n.*, coalesce(m.c, 0) AS n_children FROM n LEFT JOIN (SELECT d, up, count(*) AS c FROM n WHERE d > 0 GROUP BY 1, 2) m ON m.d = n.d + 1 AND m.up = n.k),
        below AS (SELECT p.d, p.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(x.saved) AS saved FROM x JOIN p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY 1, 2)
        SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
        FROM x JOIN below b USING (d, k) LEFT JOIN n u ON u.d = x.d - 1 AND u.k = x.up""".replace("CRC", _CRC.format("conv_id")),
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, coalesce(CRC % 3 = 0, false) AS bad,
                V(doc_id) || V(source) || V(lang) || V(n_chars) AS head, text FROM documents),
        l AS (SELECT doc_id, tree, sha256(head || V(text)) AS leaf, sha256(head || CASE WHEN bad THEN V(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) ELSE V(text) END) AS now FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        low(tree, level, nodes) AS (SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY 1
            UNION ALL SELECT tree, level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], ''))) FROM low WHERE len(nodes) > 1),
        sub AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low WHERE len(nodes) = 1),
        up(level, nodes) AS (SELECT 0, list(subroot ORDER BY pos) FROM sub
            UNION ALL SELECT level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], ''))) FROM up WHERE len(nodes) > 1),
        levels AS (SELECT p.doc_id, p.tree, p.pos, p.leaf, p.now, low.level, (p.pos // (8 ** low.level)::BIGINT)::BIGINT AS ix, nodes FROM p JOIN low USING (tree) WHERE len(nodes) > 1
            UNION ALL SELECT p.doc_id, p.tree, p.pos, p.leaf, p.now, 1000 + up.level, (sub.pos // (8 ** up.level)::BIGINT)::BIGINT, nodes FROM p JOIN sub USING (tree) CROSS JOIN up WHERE len(nodes) > 1),
        s AS (SELECT *, array_to_string(nodes[8 * (ix // 8) + 1:ix], '') AS before, array_to_string(nodes[ix + 2:8 * (ix // 8) + 8], '') AS after FROM levels),
        f AS (SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256,
                list_reduce(list_prepend({'b': '', 'a': any_value(now)}, list({'b': before, 'a': after} ORDER BY level)), lambda x, y: {'b': '', 'a': sha256(y.b || x.a || y.a)}).a AS folded_root FROM s GROUP BY 1, 2)
        SELECT p.doc_id, p.leaf, sub.subroot, r.root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, coalesce(f.folded_root, p.now) AS folded_root, coalesce(f.folded_root, p.now) = r.root AS verified
        FROM p JOIN sub USING (tree) CROSS JOIN (SELECT nodes[1] AS root FROM up WHERE len(nodes) = 1) r LEFT JOIN f ON f.tree = p.tree AND f.pos = p.pos""".replace("CRC", _CRC.format("doc_id")),
}
SQL["op12_merkle_manifest"] = re.sub(r"V\((\w+|translate\([^()]*\))\)", r"coalesce(strlen((\1)::VARCHAR)::VARCHAR || ':' || (\1)::VARCHAR, '-')", SQL["op12_merkle_manifest"])
