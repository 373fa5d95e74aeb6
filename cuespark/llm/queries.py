"""The queries over these operators, one for each, with the DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuespark.llm import decontaminate, embedding_dedup, filter_audit, hnsw, html, jaccard, line_dedup, merkle, packing, quality, sharding, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_blockwise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(_table(spark, sf_dir, "embeddings"))


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(_table(spark, sf_dir, "documents"))


def op10_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def op11_small_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbour_rows(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_rule_ensemble, op2_blockwise_suffixes, op3_link_graph, op4_ngram_jaccard, op5_block_rules, op6_rotated_codes, op7_external_shuffle, op8_cgk_decontamination, op9_hilbert_packing, op10_minhash_lines, op11_small_worlds, op12_filter_audit, op13_merkle_manifest)
}

ORACLE_SQL: dict[str, str] = {
    "op12_filter_audit": """
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        first_ids AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        flags AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
                + (CASE WHEN 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 10 * length(x.t) THEN 4 ELSE 0 END)
                + (CASE WHEN regexp_matches(x.t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN x.doc_id > f.least THEN 16 ELSE 0 END) AS m
            FROM texts x JOIN first_ids f ON f.t = x.t LEFT JOIN marks k ON k.doc_id = x.doc_id),
        counts AS (SELECT part, good, toxic, m, count(*) AS n FROM flags GROUP BY ALL),
        letters AS (SELECT i, substr('ABCDE', i + 1, 1) AS c, 1 << i AS bit FROM (SELECT CAST(range AS INTEGER) AS i FROM range(5))),
        orders AS (
            SELECT [a, b, c, d, e] AS o FROM range(5) x(a), range(5) y(b), range(5) z(c), range(5) v(d), range(5) u(e)
            WHERE len(list_distinct([a, b, c, d, e])) = 5),
        steps AS (
            SELECT list_aggregate(list_transform(o, lambda k: substr('ABCDE', CAST(k AS INTEGER) + 1, 1)), 'string_agg', '') AS filter_order, CAST(s AS INTEGER) AS step,
                CAST(2 ** o[s] AS INTEGER) AS bit, CAST(coalesce(list_sum(list_transform(o[1:s - 1], lambda k: 2 ** k)), 0) AS INTEGER) AS seen
            FROM orders, range(1, 6) r(s)),
        found AS (
            SELECT part, filter_order, step, bit,
                sum(CASE WHEN m & (bit | seen) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN m & bit <> 0 AND m & seen = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN m & bit <> 0 AND m & seen <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN m & bit <> 0 AND m & seen = 0 AND good THEN n ELSE 0 END) AS good_lost,
                sum(CASE WHEN m & bit <> 0 AND m & seen = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
            FROM counts, steps GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM found""",
    "op13_merkle_manifest": """
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, n_chars, source, text,
                list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(8 * strlen(CAST(doc_id AS VARCHAR)))), lambda a, i:
                    (CASE WHEN (xor(a, CASE WHEN i % 8 = 0 THEN ord(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END)) & 1 = 1
                     THEN xor((xor(a, CASE WHEN i % 8 = 0 THEN ord(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END)) >> 1, 3988292384)
                     ELSE (xor(a, CASE WHEN i % 8 = 0 THEN ord(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END)) >> 1 END)) AS crc
            FROM documents),
        framed AS (
            SELECT doc_id, lang, xor(crc, 4294967295) % 7 = 0 AS struck, n_chars,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM fields),
        leaves AS (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                sha256(head || coalesce(strlen(CAST(n_chars + CAST(coalesce(struck, false) AS INTEGER) AS VARCHAR)) || ':' || (n_chars + CAST(coalesce(struck, false) AS INTEGER)), '-') || tail) AS tampered
            FROM framed),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS part
            FROM leaves),
        nodes AS (
            SELECT part, n, 0 AS lvl, k, leaf AS h FROM placed
            UNION ALL
            SELECT part, n, lvl + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)) FROM nodes WHERE (1 << lvl) < n GROUP BY part, n, lvl, k // 2),
        subroots AS (SELECT part, h FROM nodes WHERE (1 << lvl) >= n),
        tops AS (
            SELECT 0 AS lvl, part - 1 AS k, (SELECT count(*) FROM subroots) AS n, h FROM subroots
            UNION ALL
            SELECT lvl + 1, k // 2, n, sha256(string_agg(h, '' ORDER BY k)) FROM tops WHERE (1 << lvl) < n GROUP BY lvl, k // 2, n),
        folds AS (
            SELECT doc_id, leaf, part, k, n, 0 AS lvl, tampered AS h, '' AS seen FROM placed
            UNION ALL
            SELECT f.doc_id, f.leaf, f.part, f.k // 2, f.n, f.lvl + 1,
                sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.k % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), f.seen || coalesce(s.h, '')
            FROM folds f LEFT JOIN nodes s ON s.part = f.part AND s.lvl = f.lvl AND s.k = xor(f.k, 1) WHERE (1 << f.lvl) < f.n),
        over_parts AS (
            SELECT doc_id, leaf, part, part - 1 AS k, 0 AS lvl, h, seen FROM folds WHERE (1 << lvl) >= n
            UNION ALL
            SELECT f.doc_id, f.leaf, f.part, f.k // 2, f.lvl + 1,
                sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.k % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), f.seen || coalesce(s.h, '')
            FROM over_parts f LEFT JOIN tops s ON s.lvl = f.lvl AND s.k = xor(f.k, 1) WHERE (1 << f.lvl) < (SELECT count(*) FROM subroots)),
        roots AS (SELECT h FROM tops WHERE (1 << lvl) >= n)
        SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.seen) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM over_parts f JOIN subroots s ON s.part = f.part, roots r WHERE (1 << f.lvl) >= (SELECT count(*) FROM subroots)""",
}
