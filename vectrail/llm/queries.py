"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrail.llm import fingerprints, langid, mixing, packing, pii, quality, secret_scan, sharding, simhash, toxicity
from vectrail.session import table

SHARDS = [f"shard-{i:02d}" for i in range(sharding.N_SHARDS)]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "whole", "extra"
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_pii": op2_pii,
        "op3_fingerprints": op3_fingerprints,
        "op4_sharding": op4_sharding,
        "op5_mixing": op5_mixing,
        "op6_langid": op6_langid,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_toxicity": op10_toxicity,
    }


def _op4_sql() -> str:
    owner = sharding.fill_table(SHARDS)
    return f"""
WITH placed AS (
  SELECT doc_id,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST({owner}[slot + 1] AS VARCHAR), 2, '0') AS shard FROM placed"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY source_key),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM r),
t AS (SELECT source_key, source_size, least(cap, max(share) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT doc_id, size, source_size, target, whole,
             floor(target + 0.5)::BIGINT - whole * source_size AS left_words,
             (sum(size) OVER (PARTITION BY source_key ORDER BY k, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before_words
      FROM d JOIN p USING (source_key)),
e AS (SELECT *, greatest(0, least(size, left_words - before_words))::BIGINT AS extra FROM c)
SELECT doc_id, size, source_size, target, (whole * size + extra)::BIGINT AS taken, whole, extra FROM e
"""


def oracle_sql() -> dict:
    return {"op4_sharding": _op4_sql(), "op5_mixing": OP5_SQL}
