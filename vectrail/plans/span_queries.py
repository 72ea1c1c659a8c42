"""Queries whose selections depend on order, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions.records import json_scalars
from vectrail.operators import backends, spans
from vectrail.session import parts_for, table
from vectrail.streaming import streams

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "number": r"[0-9]{6,}"}


def redact_documents(s, d):
    docs = table(s, d, "documents").withColumn("spans", spans.select_spans(spans.regex_spans(F.col("text"), PATTERNS)))
    docs = docs.withColumn("redacted", spans.redact(F.col("text"), F.col("spans")))
    return docs.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.md5("redacted").alias("digest"))


def paragraph_packs(s, d):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    packs = table(s, d, "documents").select("doc_id", F.posexplode(spans.pack_paragraphs(text, 900)).alias("pos", "pack"))
    return packs.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("pack").cast("long").alias("n_chars"), F.md5("pack").alias("digest"))


def clause_packs(s, d):
    packs = table(s, d, "documents").select("doc_id", F.posexplode(spans.pack_clauses(F.col("text"))).alias("pos", "pack"))
    return packs.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("pack").cast("long").alias("n_chars"), F.md5("pack").alias("digest"))


def json_scalar_sets(s, d):
    return table(s, d, "events").select("event_id", F.array_join(json_scalars(F.col("props")), ",").alias("scalars"))


def interval_matches(s, d):
    """Line quantities as predicted spans against the spans of the line before, within an order."""
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("id"), F.col("l_quantity").alias("start"))
    pred = li.withColumn("end", F.col("start") + 5)
    gold = li.withColumn("id", F.col("id") + 100).withColumn("start", F.col("start") + 2).withColumn("end", F.col("start") + 6)
    return spans.greedy_interval_match(pred, gold, ["l_orderkey"], parts_for(li)).select("l_orderkey", "pred_id", "gold_id", "overlap")


def encode_outputs(s, d):
    e = backends.encode(table(s, d, "benchmark"), ("dense", "sparse", "multivector"))
    return e.select("item_id", F.size("dense").cast("long").alias("dims"), F.size("sparse").cast("long").alias("n_sparse"), F.size("multivector").cast("long").alias("n_vectors"))


def score_pairs(s, d):
    q = table(s, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    items = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return backends.score(q, items, top=5).select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


SCORE_SQL = """WITH s AS (SELECT b.item_id AS query_id, d.doc_id AS item_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), regexp_extract_all(lower(d.text), '[a-z0-9]+')))::DOUBLE / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 1)
 + CASE WHEN contains(lower(d.text), lower(b.text)) THEN 0.35 ELSE 0 END, 6) AS score FROM benchmark b, documents d WHERE b.item_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS n FROM s) SELECT query_id, item_id, score, n - 1 AS rank FROM r WHERE n <= 5"""


def stream_windowed_counts(s, d):
    t = streams.drain(streams.windowed_counts(streams.events_stream(s, d)), "complete")
    return t.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_sequence_gaps(s, d):
    e = streams.events_stream(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return streams.drain(streams.classify_sequence(e, "user_id", "k", "event_id"), "append").select(F.col("item").alias("event_id"), "kind")


def stream_token_bucket(s, d):
    return streams.drain(streams.token_bucket(streams.events_stream(s, d), "user_id", "ts"), "append").groupBy(F.col("key").alias("user_id")).agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"))


def _bucket_sql() -> str:
    from vectrail.plans.table_queries import QUERIES as tables

    return tables["token_bucket"][1]


QUERIES = {
    "redact_documents": (redact_documents, None),
    "paragraph_packs": (paragraph_packs, None),
    "clause_packs": (clause_packs, None),
    "json_scalar_sets": (json_scalar_sets, "SELECT event_id, lower(props::JSON->>'$.k') AS scalars FROM events"),
    "greedy_interval_matches": (interval_matches, None),
    "encode_outputs": (encode_outputs, "SELECT item_id, 64::BIGINT AS dims, len(list_distinct(list_transform(t, lambda x: CAST('0x' || substr(sha256(x), 63, 2) AS INT) % 64))) AS n_sparse, len(t) AS n_vectors FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)"),
    "score_pairs": (score_pairs, SCORE_SQL),
    "stream_windowed_counts": (stream_windowed_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "stream_sequence_gaps": (stream_sequence_gaps, "WITH e AS (SELECT *, (props::JSON->>'$.k')::BIGINT AS k FROM events), w AS (SELECT event_id, k, max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e) SELECT event_id, CASE WHEN seen IS NULL THEN 'first' WHEN k <= seen THEN 'dropped' WHEN k > seen + 1 THEN 'gap' ELSE 'ok' END AS kind FROM w"),
    "stream_token_bucket": (stream_token_bucket, _bucket_sql()),
}
