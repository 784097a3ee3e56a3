"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import (
    embedding_dedup,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    secret_scan,
    sharding,
    topk,
    toxicity,
    warc,
)
from quillmark.llm.shared import materialize
from quillmark.session import read_table, scratch_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(codes, codes.where("vec_id % 50 = 0"), k=5)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = materialize(
        mixing.mix(_table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id()), "mixed")
    ordered = materialize(mixing.training_order(mixed.select("row", "doc_id", "occurrences")), "training-order")
    read = ordered.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("copy", "position"))).alias("reads"))
    return mixed.join(read, "row", "left").select(
        "doc_id", "size", "source_size", "target", "taken", "source",
        F.coalesce(F.transform("reads", lambda o: o["position"]), F.array().cast("array<double>")).alias("positions"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).drop("position")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    pages = _table(spark, sf_dir, "pages")
    warc.write_archives(warc.archive_records(pages), path, records_per_file=warc.records_for(pages))
    headers = materialize(warc.read_archives(spark, path, with_payload=False), "warc-headers")
    records = warc.resolve_revisits(headers, sent=warc.MAX_SENT)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.balanced_shards(_table(spark, sf_dir, "documents"), n_shards=16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op3: the base patterns."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op5: sizes and targets."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def shard_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op8: all but the checksum."""
    return op8_byte_shards(spark, sf_dir).select("doc_id", "size", "shard", "slot")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_dedup, op2_exact_topk, op3_secret_scan, op4_ngram_jaccard_join, op5_source_mix,
        op6_best_fit_packing, op7_warc_revisits, op8_byte_shards, op9_line_dedup, op10_toxicity,
        secret_base_spans, mix_targets, shard_cuts,
    )}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses over whole tables."""
    return {
        "secret_base_spans": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            p(k, kind, pattern, least) AS (VALUES
                (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
                (1, 'access', '()(AKIA[A-Z0-9]+)', 20), (2, 'hex', '()([0-9a-f]{24,})', 24)),
            m AS (SELECT doc_id, k, kind, least, regexp_extract_all(t, pattern, 0) AS whole, regexp_extract_all(t, pattern, 2) AS tested, regexp_split_to_array(t, pattern) AS rest
                  FROM d, p WHERE regexp_matches(t, pattern)),
            i AS (SELECT doc_id, k, kind, least, len(whole[n]) AS size, len(tested[n]) AS length,
                         list_sum(list_transform(rest[1:n], lambda x: len(x))) + coalesce(list_sum(list_transform(whole[1:n - 1], lambda x: len(x))), 0) AS start
                  FROM m, unnest(range(1, len(whole) + 1)) AS u(n)),
            s AS (SELECT doc_id, k, start, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + size AS BIGINT)) AS span FROM i WHERE length >= least)
            SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   sha256(coalesce(string_agg(span, ',' ORDER BY start, k), '')) AS base_sha256
            FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
        "mix_targets": r"""
            WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
            s AS (SELECT source, sum(size) AS source_size, [5.0E0, 2.0E0, 1.0E0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
            f AS (SELECT *, 2.0E0 * source_size / weight AS fills_at FROM s),
            -- the level that makes min(cap, level * weight) add up: each source's filling point tried as the last that is full
            t AS (SELECT a.fills_at AS tried, sum(least(2.0E0 * b.source_size, a.fills_at * b.weight)) AS given FROM f AS a, f AS b GROUP BY a.fills_at),
            g AS (SELECT 1.5E0 * sum(source_size) AS goal FROM f),
            low AS (SELECT coalesce(max(tried), 0.0E0) AS tried, coalesce(max(given), 0.0E0) AS given FROM t, g WHERE given <= goal),
            v AS (SELECT low.tried + (goal - low.given) / (SELECT sum(weight) FROM f WHERE fills_at > low.tried) AS level FROM low, g)
            SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(least(2.0E0 * source_size, level * weight), 3) AS target
            FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source, v""",
        "shard_cuts": """
            WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size FROM documents),
            p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size) - size AS start, sum(size) OVER () AS total FROM d),
            s AS (SELECT doc_id, size, CAST(start * 16 // total AS INTEGER) AS shard FROM p)
            SELECT doc_id, CAST(size AS BIGINT) AS size, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot FROM s""",
        "op1_embedding_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE len(x) > 0 AND list_dot_product(x, x) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
                  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.93),
            r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
            c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
            k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
            SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON c.vec_id = k.vec_id""",
        "op4_ngram_jaccard_join": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
            c AS (SELECT doc_id, g, min(doc_id) OVER (PARTITION BY g) AS class_id, count(*) OVER (PARTITION BY g) AS n_copies FROM s),
            e AS (SELECT doc_id, len(g) AS n, n_copies, unnest(g) AS x FROM c WHERE doc_id = class_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(b.n_copies) AS copies, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
                  FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b, copies FROM p WHERE k >= 0.8E0 * (na + nb - k) - 1e-9),
            r(a, b) AS (SELECT class_id, class_id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
            q AS (SELECT a, min(b) AS group_id FROM r GROUP BY a), m AS (SELECT a, sum(copies) AS links FROM l GROUP BY a)
            SELECT c.doc_id, c.class_id, c.n_copies, CAST(coalesce(m.links, 0) + c.n_copies - 1 AS BIGINT) AS n_links, q.group_id, c.doc_id = q.group_id AS kept
            FROM c JOIN q ON q.a = c.class_id LEFT JOIN m ON m.a = c.class_id""",
        "op2_exact_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS code
                       FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.code, v.code) AS BIGINT) AS score
                  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.code) = len(q.code) WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
        "op7_warc_revisits": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
            g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
            FROM g""",
        "op9_line_dedup": r"""
            WITH l AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(b.key) AS n_dropped,
                   sha256(coalesce(string_agg(CASE WHEN b.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
            FROM k LEFT JOIN b USING (key) GROUP BY doc_id""",
    }
