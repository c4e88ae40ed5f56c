"""Queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quaystone.llm import ann, bpe, fingerprint, langid, neardup, packing, runs, secrets, shard, tokencount, topk, warc, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten.whiten(vectors, whiten.fit(vectors))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.periodic_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = (
    op1_exact_top_k, op2_near_dedup, op3_bpe_round_trip, op4_secret_scan, op5_token_counts, op6_shards_by_bytes, op7_language_id, op8_warc_bundles, op9_best_fit_packing, op10_nearest_neighbours,
    op11_embedding_whitening, op12_document_fingerprints, op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL


#: The same results in DuckDB, where SQL can express them on whole tables.
SQL = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op2_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
        r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
        c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id""",
    "op4_secret_scan": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS (SELECT * FROM (VALUES
            ('assign', 0, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
            ('access', 1, 'AKIA[A-Z0-9]{16,}'), ('hex', 2, '[0-9a-f]{24,}'), ('entropy_hex', 3, '[A-Za-z0-9+/_-]{24,}'), ('entropy_base64', 4, '[A-Za-z0-9+/_-]{24,}')) v(kind, k, re)),
        m AS (SELECT doc_id, kind, k, re, regexp_extract_all(t, re) AS found, string_split_regex(t, re) AS gaps FROM d, p),
        x AS (SELECT doc_id, kind, k, re, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM m),
        y AS (SELECT doc_id, kind, k, re, found[i] AS word, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS a FROM x),
        h AS (SELECT *, list_filter(range(0, length(word) - 23), lambda j: list_aggregate(string_split(substring(word, CAST(j + 1 AS INTEGER), 24), ''), 'entropy') >= CASE kind WHEN 'entropy_hex' THEN 3.0 ELSE 3.9 END - 1e-10) AS hot FROM y
              WHERE k > 2 AND (k = 4 OR regexp_full_match(word, '[0-9a-fA-F]+')) AND regexp_matches(word, '[0-9]') AND NOT regexp_matches(word, '^[0-9]+$') AND NOT regexp_matches(word, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AND NOT regexp_matches(word, '(?i)example|dummy|placeholder')),
        s AS (SELECT doc_id, kind, k, a, a + length(word) AS z FROM y WHERE k IN (1, 2) OR k = 0 AND length(regexp_extract(word, re, 2)) >= 6
              UNION ALL SELECT doc_id, kind, k, a + hot[1], a + hot[-1] + 24 FROM h WHERE len(hot) > 0)
        SELECT d.doc_id, count(CASE WHEN k = 0 THEN 1 END) AS n_assign, count(CASE WHEN k = 1 THEN 1 END) AS n_access, count(CASE WHEN k = 2 THEN 1 END) AS n_hex,
               sha256(coalesce(string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, k) FILTER (k IS NOT NULL), '') AS spans
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    "op8_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p),
        d AS (
            SELECT *, list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
                (strpos('0123456789abcdef', substr(sha1(html), CAST(i // 4 + 1 AS INTEGER), 1)) - 1) * 16
                + greatest(strpos('0123456789abcdef', substr(sha1(html) || '0', CAST(i // 4 + 2 AS INTEGER), 1)) - 1, 0)
            ) // CAST(power(2, 3 - i % 4) AS INTEGER) % 32 AS INTEGER), 1)) AS letters FROM f
        )
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
        FROM d""",
}
