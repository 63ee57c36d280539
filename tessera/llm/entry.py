"""Queries of this subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, fingerprints, licenses, near_dedup, packing, quality, suffix_dedup, topk, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: op2 asks for floor(64 x) of every component.
SCALE = 64.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, 2048)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"), SCALE)
    return topk.top_k(vectors.filter(F.col("vec_id") % 20 == 0), vectors, 20)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_maximal(table(spark, sf_dir, "conversations"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_report(table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.next_likeness(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


OPERATORS = (op1_best_fit_packing, op2_exact_topk, op3_chat_format, op4_quality_classifier, op5_license_scan, op6_near_dedup, op7_suffix_dedup, op8_arc_to_warc, op9_fingerprints, op10_byte_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

#: Every shingle meets its equals, and links are followed until they reach nothing new.
_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))
), reached AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), smallest AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN smallest ON doc_id = x
"""

#: Bytes as pairs of hexadecimal digits: every window of 200, those that occur again, and the runs that they cover.
_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
again AS (SELECT r, i FROM windows SEMI JOIN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1) USING (m)),
fresh AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS f FROM again),
runs AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT r, i, sum(f) OVER (PARTITION BY r ORDER BY i) AS k FROM fresh) GROUP BY r, k),
parts AS (
  SELECT runs.r, lo, hi, substring(h, 2 * coalesce(lag(hi) OVER (PARTITION BY runs.r ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY runs.r ORDER BY lo), 0))) AS before
  FROM runs JOIN d USING (r)
), texts AS (SELECT r, sum(hi - lo) AS removed, count(*) AS n, max(hi) AS last, string_agg(before, '' ORDER BY lo) AS kept FROM parts GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN texts USING (r)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html AND p.n >= 100
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": _TOPK, "op3_chat_format": chat.ORACLE, "op5_license_scan": licenses.ORACLE, "op6_near_dedup": _NEAR, "op7_suffix_dedup": _REPEATS, "op8_arc_to_warc": _WARC}
