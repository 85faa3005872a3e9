"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, dart_minhash, decontaminate, filter_audit, license_scan, line_dedup, pfair_mix, pii, piece_codec, quality, token_counts, toxicity, warc
from .common import table


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("found")


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("passages")


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", *quality.MEASURES[:5], "base_failed", "kept")


def op6_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights: no table states any, so each source gets the operator's default, the square root of its size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source"))
    return pfair_mix.mix(docs)


def op10_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, sf_dir, "conversations")).drop("digest")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc_capture_index, op2_dart_minhash, op3_pii_crf, op4_toxic_segments, op5_adaptive_quality, op6_license_digest, op7_site_line_dedup, op8_pretoken_counts, op9_pfair_mix, op10_template_decontam, op11_conversation_trie, op12_filter_audit, op13_piece_codec)
    return {f.__name__: f for f in own}


_OP1 = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, max(page_id) OVER (PARTITION BY b) AS first FROM p),
    bits AS (SELECT *, list_transform(range(0, 160, 5), lambda i: CAST(substr(
                 array_to_string(list_transform(range(1, 41), lambda k: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(hex, k, 1)) - 1) + 1, 4)), ''), i + 1, 5) AS VARCHAR)) AS five FROM d)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(five, lambda f: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + 16 * CAST(substr(f, 1, 1) AS INT) + 8 * CAST(substr(f, 2, 1) AS INT) + 4 * CAST(substr(f, 3, 1) AS INT) + 2 * CAST(substr(f, 4, 1) AS INT) + CAST(substr(f, 5, 1) AS INT), 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM bits
"""

_OP7 = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
    pages AS (SELECT DISTINCT host, text FROM d WHERE text IS NOT NULL),
    totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
    own AS (SELECT host, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda s: trim(s)))) AS line FROM pages),
    hits AS (SELECT host, line, count(*) AS n FROM own WHERE line <> '' GROUP BY host, line HAVING count(*) >= 2),
    bad AS (SELECT hits.host, list(line) AS lines FROM hits JOIN totals ON hits.host = totals.host WHERE n > 0.05 * pages GROUP BY hits.host)
    SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
        CAST(coalesce(len(list_filter(ls, lambda s: list_contains(coalesce(bad.lines, []), trim(s)))), 0) AS BIGINT) AS n_dropped,
        CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(ls, lambda s: NOT list_contains(coalesce(bad.lines, []), trim(s))), chr(10)) END AS text
    FROM d LEFT JOIN bad ON d.host = bad.host
"""

_OP9 = """
    WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
    roots AS (SELECT src, n, CAST(floor(sqrt(n) * 1000) AS BIGINT) AS r FROM counts),
    target AS (SELECT src, n, greatest(1, 1000 * r // (SELECT CAST(sum(r) AS BIGINT) FROM roots)) AS q FROM roots),
    ranked AS (SELECT src, n, q, row_number() OVER (ORDER BY q, src) AS i FROM target),
    w AS (SELECT list(q ORDER BY i) AS qs, CAST(sum(q) AS BIGINT) AS total FROM ranked),
    sched(t, done, pick) AS (
        SELECT CAST(-1 AS BIGINT), (SELECT list_transform(qs, lambda q: CAST(0 AS BIGINT)) FROM w), CAST(0 AS BIGINT)
        UNION ALL
        SELECT t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
            SELECT t, done, list_min(list_transform(list_filter(range(1, len(done) + 1), lambda i: done[i] < qs[i] AND done[i] * total // qs[i] <= t + 1),
                                                    lambda i: ((done[i] + 1) * total + qs[i] - 1) // qs[i] * 100000 + i)) % 100000 AS p, total
            FROM sched, w) WHERE t + 1 < total),
    slots AS (SELECT src, q, t AS slot, row_number() OVER (PARTITION BY src ORDER BY t) - 1 AS turn FROM sched JOIN ranked ON pick = i WHERE t >= 0),
    ends AS (SELECT min((n + 15) // 16 // k.q * total + slot) AS horizon FROM ranked k JOIN w ON true JOIN slots s ON s.src = k.src AND s.turn = (n + 15) // 16 % k.q),
    placed AS (SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '')
            ORDER BY (((doc_id % 1000003) + 1000003) % 1000003 * 7919 + 104729) % 1000003, doc_id) - 1 AS rk FROM documents)
    SELECT doc_id, source, rk // 16 AS block, rk % 16 AS place,
        rk // 16 // s.q * total + s.slot AS slot,
        rk // 16 // s.q * total + s.turn * total // s.q AS release,
        rk // 16 // s.q * total + ((s.turn + 1) * total + s.q - 1) // s.q AS deadline,
        rk // 16 // s.q * total + s.slot < horizon AS in_mix
    FROM placed JOIN ranked k ON placed.src = k.src JOIN slots s ON s.src = k.src AND s.turn = rk // 16 % k.q JOIN w ON true JOIN ends ON true
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_capture_index": _OP1, "op6_license_digest": license_scan.oracle(), "op7_site_line_dedup": _OP7, "op9_pfair_mix": _OP9, "op11_conversation_trie": conversation_trie.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
