"""Queries over ``embeddings``: searches, late interaction, quantisation, scalar vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.operators import blocks as B
from vectrail.operators import ranking as R
from vectrail.session import table


def _emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def _queries(e: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50."""
    return e.where(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label")
    )


def _r(x, n=6):
    return F.round(x, n)


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


Q_SQL = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS query_label FROM embeddings WHERE vec_id % 50 = 0)"
COS = "round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6)"
DOT = "round(list_dot_product(qv, embedding::DOUBLE[]), 6)"


def knn_cosine(spark, d):
    e = _emb(spark, d)
    return _hits(B.matrix_knn(_queries(e), e, 5))


def _knn_sql(expr: str, k: int, tie: str = "vec_id", first: int = -1, where: str = "", alias: str = "score") -> str:
    return f"""WITH {Q_SQL}, s AS (SELECT query_id, vec_id, {expr} AS score FROM q, embeddings {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS n FROM s)
SELECT query_id, vec_id, score AS {alias}, n + {first} AS rank FROM r WHERE n <= {k}"""


def knn_dot(spark, d):
    e = _emb(spark, d)
    return _hits(B.matrix_knn(_queries(e), e, 10, B.dots))


def knn_ties_last(spark, d):
    e = _emb(spark, d)
    return _hits(B.matrix_knn(_queries(e), e, 10, ties="desc", digits=1))


def knn_filtered(spark, d):
    e = _emb(spark, d)
    return _hits(B.matrix_knn(_queries(e), e.where(F.col("label") == 3), 5))


def knn_threshold(spark, d):
    """The nearest rows above a threshold; a table of fewer than two rows has none."""
    e = _emb(spark, d)
    q = _queries(e)
    if e.limit(2).count() < 2:
        q = q.where(F.lit(False))
    return _hits(B.matrix_knn(q, e, 5, others=True, above=0.3))


def _part(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.withColumn(column, F.slice(column, 1, n))


def two_stage_knn(spark, d):
    """Nearest by the first 16 dimensions, then ordered by all of them."""
    e = _emb(spark, d)
    hits = B.matrix_knn(_part(_queries(e), "query", 16), _part(e, "embedding", 16), 20).select("query_id", "vec_id")
    full = hits.join(_queries(e), "query_id").join(e, "vec_id").withColumn("score", _r(V.cosine(F.col("query"), F.col("embedding"))))
    return _hits(R.top_k(full, ["query_id"], [F.desc("score"), F.asc("vec_id")], 5))


TWO_STAGE_SQL = f"""WITH {Q_SQL}, s AS (SELECT query_id, vec_id, qv, embedding::DOUBLE[] AS v,
 round(list_cosine_similarity(qv[1:16], (embedding::DOUBLE[])[1:16]), 6) AS s1 FROM q, embeddings),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, vec_id) AS n1 FROM s),
b AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, v), 6) AS score FROM a WHERE n1 <= 20),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM b)
SELECT query_id, vec_id, score, n - 1 AS rank FROM c WHERE n <= 5"""


def item_blocks(e: DataFrame, name: str, run: int, block: int) -> DataFrame:
    """Items (runs of ``run`` consecutive vec_ids) by blocks of ``block`` item ids: the item of each vector, and the vectors end to end."""
    item = F.floor(F.col("vec_id") / run).cast("long")
    rows = e.where("embedding is not null").select(item.alias("item"), "vec_id", "embedding")
    held = rows.groupBy(F.floor(F.col("item") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("item", "vec_id", "embedding"))).alias("v"))
    return held.select(F.transform("v", lambda x: x["item"]).alias(f"{name}_items"), F.flatten(F.transform("v", lambda x: x["embedding"])).alias(f"{name}_values"))


def item_scores(e: DataFrame, run: int = 8) -> DataFrame:
    """(query_item, doc_item, score, by_length): items whose id is divisible by 50 against all items, block by block.

    All vectors take part. ``score`` sums each query vector's best inner product;
    ``by_length`` is the mean of its best cosine.
    """
    q = item_blocks(e.where(F.floor(F.col("vec_id") / run) % 50 == 0), "q", run, 50 * 16)
    pairs = R.against(q, item_blocks(e, "d", run, 128))

    def score(batches):
        import numpy as np
        import pandas as pd

        def read(ids, values):
            items, first = np.unique(ids, return_index=True)
            v = np.asarray(values, dtype="float64").reshape(len(ids), -1)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return items, first, v, np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

        for batch in batches:
            for r in batch.itertuples(index=False):
                qi, qf, qv, qu = read(r.q_items, r.q_values)
                di, df, dv, du = read(r.d_items, r.d_values)
                best = lambda a, b: np.add.reduceat(np.maximum.reduceat(a @ b.T, df, axis=1), qf, axis=0)  # noqa: B023, E731
                length = np.diff(np.append(qf, len(qv)))[:, None]
                yield pd.DataFrame(
                    {"query_item": np.repeat(qi, len(di)), "doc_item": np.tile(di, len(qi)), "score": best(qv, dv).ravel(), "by_length": (best(qu, du) / length).ravel()}
                )

    found = pairs.mapInPandas(score, "query_item long, doc_item long, score double, by_length double")
    return found.withColumns({"score": _r(F.col("score")), "by_length": _r(F.col("by_length"))})


def maxsim_items(spark, d):
    return item_scores(_emb(spark, d))


def maxsim_items_retrieval(spark, d):
    top = R.top_k(maxsim_items(spark, d), ["query_item"], [F.desc("score"), F.asc("doc_item")], 3)
    return top.select("query_item", "doc_item", "score", F.col("rank").cast("long").alias("rank"))


ITEM_SQL = """v AS (SELECT vec_id // 8 AS item, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.item AS query_item, b.item AS doc_item, a.vec_id, max(list_dot_product(a.v, b.v)) AS best, max(list_cosine_similarity(a.v, b.v)) AS cosine FROM v a, v b WHERE a.item % 50 = 0 GROUP BY 1, 2, 3),
s AS (SELECT query_item, doc_item, round(sum(best), 6) AS score, round(sum(cosine) / count(*), 6) AS by_length FROM p GROUP BY 1, 2)"""


def label_scores(e: DataFrame) -> DataFrame:
    """(query_label, doc_label, score, by_length): a label's query rows (ids divisible by 50) against all rows of each label.

    Each query vector's best inner product and best cosine with a label's vectors are
    maxima that tasks take before the shuffle; they are summed, and averaged.
    """
    q = _queries(e)
    best = B.group_best(q, e, {"dot": B.dots, "cosine": B.cosines}, "label").join(q.select("query_id", "query_label"), "query_id")
    return best.groupBy("query_label", F.col("label").alias("doc_label")).agg(_r(F.sum("dot")).alias("score"), _r(F.sum("cosine") / F.count("*")).alias("by_length"))


MV_SQL = f"""{Q_SQL}, p AS (SELECT query_id, query_label, label AS doc_label, max(list_dot_product(qv, embedding::DOUBLE[])) AS best, max(list_cosine_similarity(qv, embedding::DOUBLE[])) AS cosine FROM q, embeddings GROUP BY 1, 2, 3),
s AS (SELECT query_label, doc_label, round(sum(best), 6) AS score, round(sum(cosine) / count(*), 6) AS by_length FROM p GROUP BY 1, 2)"""


def maxsim_pairs(spark, d):
    return label_scores(_emb(spark, d)).select("query_label", "doc_label", "score")


def maxsim_by_length(spark, d):
    return label_scores(_emb(spark, d)).select("query_label", "doc_label", F.col("by_length").alias("score"))


def maxsim_retrieval(spark, d):
    return R.top_k(maxsim_pairs(spark, d), ["query_label"], [F.desc("score"), F.asc("doc_label")], 3).select("query_label", "doc_label", "score", F.col("rank").cast("long").alias("rank"))


def _mean_vectors(rows: DataFrame, name: str) -> DataFrame:
    """One row a label: the mean of its vectors, by positions."""
    each = rows.select(F.col("label").alias(f"{name}_label"), F.posexplode("embedding").alias("pos", "x")).groupBy(f"{name}_label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    held = each.groupBy(f"{name}_label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return held.select(f"{name}_label", F.transform("v", lambda x: x["m"]).alias(f"{name}_mean"))


def maxsim_rerank(spark, d):
    """Late interaction for the four other labels whose mean vectors are nearest to that of the query rows."""
    e = _emb(spark, d)
    pairs = _mean_vectors(e.where("vec_id % 50 = 0"), "query").crossJoin(F.broadcast(_mean_vectors(e, "doc")))  # one row a label
    coarse = pairs.where("query_label != doc_label").withColumn("coarse", _r(V.dot(F.col("query_mean"), F.col("doc_mean"))))
    near = R.top_k(coarse, ["query_label"], [F.desc("coarse"), F.asc("doc_label")], 4).select("query_label", "doc_label")
    return label_scores(e).join(near, ["query_label", "doc_label"], "left_semi").select("query_label", "doc_label", "score")


RERANK_SQL = f"""WITH {MV_SQL}, x AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
a AS (SELECT label AS query_label, pos, avg(x) AS m FROM x WHERE vec_id % 50 = 0 GROUP BY 1, 2), b AS (SELECT label AS doc_label, pos, avg(x) AS m FROM x GROUP BY 1, 2),
c AS (SELECT query_label, doc_label, round(sum(a.m * b.m), 6) AS coarse FROM a JOIN b USING (pos) WHERE query_label <> doc_label GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY coarse DESC, doc_label) AS n FROM c)
SELECT query_label, doc_label, score FROM s JOIN n USING (query_label, doc_label) WHERE n <= 4"""


def _both(q, d):
    return 0.6 * B.cosines(q, d) + 0.4 * B.dots(q.clip(min=0), d.clip(min=0))


def hybrid_weighted(spark, d):
    """0.6 * cosine + 0.4 * inner product of the positive parts; a zero weight would be skipped."""
    e = _emb(spark, d)
    return _hits(B.matrix_knn(_queries(e), e, 5, _both))


HYBRID_SQL = _knn_sql("round(0.6 * list_cosine_similarity(qv, embedding::DOUBLE[]) + 0.4 * list_dot_product(list_transform(qv, lambda x: greatest(x, 0)), list_transform(embedding::DOUBLE[], lambda x: greatest(x, 0))), 6)", 5)


def _lists(spark, d, k=10):
    e = _emb(spark, d)
    q = _queries(e)
    a = B.matrix_knn(q, e, k)
    b = B.matrix_knn(_part(q, "query", 32), _part(e, "embedding", 32), k, B.dots)
    return a, b


LISTS_SQL = f"""{Q_SQL}, s AS (SELECT query_id, vec_id, {COS} AS s1, round(list_dot_product(qv[1:32], (embedding::DOUBLE[])[1:32]), 6) AS s2 FROM q, embeddings),
a AS (SELECT query_id, vec_id, n - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, vec_id) AS n FROM s) WHERE n <= 10),
b AS (SELECT query_id, vec_id, n - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, vec_id) AS n FROM s) WHERE n <= 10)"""


def rrf_fuse(spark, d):
    return fused(_lists(spark, d))


def fused(lists) -> DataFrame:
    """The first ten of both lists by reciprocal ranks."""
    fused = R.rrf(list(lists), ["query_id"], "vec_id").withColumn("fused", F.round("fused", 9))
    return R.top_k(fused, ["query_id"], [F.desc("fused"), F.asc("first_seen")], 10).select("query_id", "vec_id", "fused", F.col("rank").cast("long").alias("rank"))


RRF_SQL = f"""WITH {LISTS_SQL},
u AS (SELECT query_id, vec_id, rank, 0 AS l FROM a UNION ALL SELECT query_id, vec_id, rank, 1 FROM b),
f AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS fused, min(l * 1000000 + rank) AS seen FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen) AS n FROM f)
SELECT query_id, vec_id, fused, n - 1 AS rank FROM r WHERE n <= 10"""


def hybrid_pool(spark, d):
    return pooled(_lists(spark, d))


def pooled(lists) -> DataFrame:
    """Both lists joined in order, first occurrences kept."""
    return R.ordered_union(list(lists), ["query_id"], "vec_id").select("query_id", "vec_id", F.col("position").cast("long").alias("position"))


POOL_SQL = f"""WITH {LISTS_SQL},
u AS (SELECT query_id, vec_id, rank AS place FROM a UNION ALL SELECT query_id, vec_id, 1000000 + rank FROM b),
f AS (SELECT query_id, vec_id, min(place) AS place FROM u GROUP BY 1, 2)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY place, vec_id) - 1 AS position FROM f"""


def full_outer_pool(spark, d):
    """Dense and late ranks side by side, -1 where a list lacks the row, with the fused score."""
    a, b = _lists(spark, d)
    joined = a.select("query_id", "vec_id", F.col("rank").alias("dense_rank")).join(
        b.select("query_id", "vec_id", F.col("rank").alias("late_rank")), ["query_id", "vec_id"], "full"
    )
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c) + 1), F.lit(0.0))
    return joined.select("query_id", "vec_id", F.coalesce(F.col("dense_rank"), F.lit(-1)).cast("long").alias("dense_rank"), F.coalesce(F.col("late_rank"), F.lit(-1)).cast("long").alias("late_rank"), F.round(part("dense_rank") + part("late_rank"), 9).alias("fusion_score"))


OUTER_SQL = f"""WITH {LISTS_SQL}
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.vec_id) AS vec_id, coalesce(a.rank, -1) AS dense_rank, coalesce(b.rank, -1) AS late_rank,
 round(coalesce(1.0::DOUBLE / (61 + a.rank), 0) + coalesce(1.0::DOUBLE / (61 + b.rank), 0), 9) AS fusion_score
FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id"""


def exemplar_retrieval(spark, d):
    """The best row of each label for each query, of the labels in a catalogue (those below 6)."""
    e = _emb(spark, d)
    catalog = e.where(F.col("label") < 6)
    best = B.group_best(_queries(e), catalog, {"score": B.cosines}, "label")
    return best.select("query_id", "label", F.col("score_at").alias("vec_id"), _r(F.col("score")).alias("score"))


EXEMPLAR_SQL = f"""WITH {Q_SQL}, s AS (SELECT query_id, label, vec_id, {COS} AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, label, vec_id, score FROM r WHERE n = 1 AND label < 6"""


def _per_value(spark, d, column, alias, kind):
    e = _emb(spark, d)
    return e.select("vec_id", F.posexplode(column(F.col("embedding"))).alias("pos", alias)).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col(alias).cast(kind).alias(alias))


def quantize_int8(spark, d):
    return _per_value(spark, d, V.quantize_int8, "value", "long")


def quantize_uint8(spark, d):
    return _per_value(spark, d, V.quantize_uint8, "value", "long")


U = "SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos, embedding::DOUBLE[] AS v FROM embeddings"
INT8_SQL = f"SELECT vec_id, pos, round_even(x / CASE WHEN m = 0 THEN 1 ELSE m END * 127, 0)::BIGINT AS value FROM (SELECT *, list_max(list_transform(v, lambda y: abs(y))) AS m FROM ({U}))"
UINT8_SQL = f"SELECT vec_id, pos, CASE WHEN list_max(v) = list_min(v) THEN 0 ELSE round_even((x - list_min(v)) / (list_max(v) - list_min(v)) * 255, 0) END::BIGINT AS value FROM ({U})"


def binary_quantize(spark, d):
    return _emb(spark, d).select("vec_id", V.binary_text(F.col("embedding")).alias("bits"), V.packed_binary(F.col("embedding")).alias("packed"))


BIN_SQL = """WITH b AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings)
SELECT vec_id, bits, list_aggregate(list_transform(range(8), lambda k: upper(printf('%02x', list_sum(list_transform(range(8), lambda j: CASE WHEN substr(bits, (k * 8 + j + 1)::INT, 1) = '1' THEN (1 << (7 - j)::INT) ELSE 0 END))::INT))), 'string_agg', '') AS packed FROM b"""


def l2_normalise(spark, d):
    return _per_value(spark, d, lambda c: F.transform(V.unit(c), lambda x: F.round(x, 6)), "value", "double")


UNIT_SQL = f"SELECT vec_id, pos, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS value FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM ({U}))"


def gray_bucket(spark, d):
    bits = F.transform(F.slice("embedding", 1, 8), lambda x: F.when(x > 0, 1).otherwise(0))
    return _emb(spark, d).select("vec_id", V.gray_bucket(bits).cast("long").alias("bucket"))


GRAY_SQL = """SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:8], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::BIGINT)),
 lambda g, b: g * 2 + xor(b, g & 1)) AS bucket FROM embeddings"""


def dense_to_sparse(spark, d):
    e = _emb(spark, d).select("vec_id", F.explode(V.to_sparse(F.col("embedding"))).alias("p"))
    return e.select("vec_id", F.col("p.index").cast("long").alias("pos"), F.round(F.col("p.value").cast("double"), 6).alias("value"))


def log_saturation(spark, d):
    return _per_value(spark, d, lambda c: F.transform(c, lambda x: F.round(V.log_saturation(x.cast("double")), 6)), "value", "double")


def sigmoid(spark, d):
    return _per_value(spark, d, lambda c: F.transform(c, lambda x: F.round(V.sigmoid(x.cast("double") * 10), 6)), "value", "double")


#: Bucket and sign of each of 64 dimensions, from a rule.
SKETCH = [((i * 37 + 11) % 16, 1 if (i * 53 + 7) % 11 % 2 else -1) for i in range(64)]


def count_sketch(spark, d):
    e = _emb(spark, d).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    at = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("sign")) for b, s in SKETCH))
    moved = e.withColumn("at", at[F.col("pos")])
    return moved.groupBy("vec_id", F.col("at.bucket").cast("long").alias("bucket")).agg(F.round(F.sum(F.col("x").cast("double") * F.col("at.sign")), 6).alias("value"))


SKETCH_SQL = f"SELECT vec_id, {[b for b, _ in SKETCH]}[pos + 1]::BIGINT AS bucket, round(sum(x * {[s for _, s in SKETCH]}[pos + 1]), 6) AS value FROM ({U}) GROUP BY 1, 2"


def ams_projection(spark, d):
    signs = F.array(*(F.lit(float(s)) for _, s in SKETCH))
    return _emb(spark, d).select("vec_id", _r(V.dot(F.col("embedding"), signs)).alias("value"))


AMS_SQL = f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {[float(s) for _, s in SKETCH]}), 6) AS value FROM embeddings"


def mean_pooling(spark, d):
    e = _emb(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


def sparse_max_pool(spark, d):
    e = _emb(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.max(F.col("x").cast("double")).alias("value")).where("value > 0").withColumn("value", F.round("value", 6))


def vector_blend(spark, d):
    """0.7 * a label's first vector + 0.3 * the label's mean."""
    e = _emb(spark, d)
    x = e.select("label", "vec_id", F.posexplode("embedding").alias("pos", "x"))
    mean = x.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return x.join(first, ["label", "vec_id"], "left_semi").join(mean, ["label", "pos"]).select("label", F.col("pos").cast("long").alias("pos"), F.round(0.7 * F.col("x").cast("double") + 0.3 * F.col("mean"), 6).alias("value"))


BLEND_SQL = """WITH u AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS mean FROM u GROUP BY 1, 2), f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1)
SELECT u.label, u.pos, round(0.7 * x + 0.3 * mean, 6) AS value FROM u JOIN f USING (label, vec_id) JOIN m ON m.label = u.label AND m.pos = u.pos"""


def _metrics(spark, d, k=10):
    """Per query: ranked hits with relevance (same label, the query itself left out)."""
    e = _emb(spark, d)
    q = _queries(e)
    found = B.matrix_knn(q, e, k, others=True, first=1)
    hits = found.join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "query_label"), "query_id")
    relevant = e.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("n_relevant"))
    return hits.withColumn("rel", (F.col("label") == F.col("query_label")).cast("int")).join(relevant, "query_label").where("n_relevant > 0")


def ndcg_mrr_recall(spark, d):
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = _metrics(spark, d).groupBy("query_id", "n_relevant").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum("rel").alias("hits")
    )
    return per.select("query_id", F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"))


METRIC_SQL = f"""{Q_SQL}, s AS (SELECT query_id, query_label, vec_id, label, {COS} AS score FROM q, embeddings WHERE vec_id <> query_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10),
n AS (SELECT label AS query_label, count(*) - 1 AS n_relevant FROM embeddings GROUP BY 1),
p AS (SELECT query_id, n_relevant, sum(CASE WHEN label = query_label THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
 min(CASE WHEN label = query_label THEN rank END) AS first_hit, sum(CASE WHEN label = query_label THEN 1 ELSE 0 END) AS hits
 FROM h JOIN n USING (query_label) WHERE n_relevant > 0 GROUP BY 1, 2),
m AS (SELECT query_id, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_relevant), 6) AS ndcg,
 round(coalesce(1.0 / first_hit, 0), 6)::DOUBLE AS mrr, round(hits / n_relevant, 6) AS recall, CASE WHEN first_hit = 1 THEN 1 ELSE 0 END AS hit1, CASE WHEN first_hit <= 5 THEN 1 ELSE 0 END AS hit5 FROM p)"""


def metric_macro_average(spark, d):
    m = ndcg_mrr_recall(spark, d)
    hits = _metrics(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    m = m.join(hits, "query_id")
    return m.agg(
        F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg(F.coalesce((F.col("first") == 1).cast("int"), F.lit(0))), 4).alias("hit_1"), F.round(F.avg(F.coalesce((F.col("first") <= 5).cast("int"), F.lit(0))), 4).alias("hit_5"),
    )


QUERIES = {
    "knn_cosine_topk": (knn_cosine, _knn_sql(COS, 5)),
    "knn_dot_rank0": (knn_dot, _knn_sql(DOT, 10)),
    "knn_ties_highest_first": (knn_ties_last, _knn_sql("round(list_cosine_similarity(qv, embedding::DOUBLE[]), 1)", 10, "vec_id DESC")),
    "knn_equality_prefilter": (knn_filtered, _knn_sql(COS, 5, where="WHERE label = 3")),
    "knn_similarity_threshold": (knn_threshold, f"""WITH {Q_SQL}, s AS (SELECT query_id, vec_id, {COS} AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s WHERE score > 0.3) SELECT query_id, vec_id, score, n - 1 AS rank FROM r WHERE n <= 5"""),
    "two_stage_knn": (two_stage_knn, TWO_STAGE_SQL),
    "maxsim_items": (maxsim_items, f"WITH {ITEM_SQL} SELECT query_item, doc_item, score, by_length FROM s"),
    "maxsim_items_retrieval": (maxsim_items_retrieval, f"WITH {ITEM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_item ORDER BY score DESC, doc_item) AS n FROM s) SELECT query_item, doc_item, score, n - 1 AS rank FROM r WHERE n <= 3"),
    "maxsim_pairs": (maxsim_pairs, f"WITH {MV_SQL} SELECT query_label, doc_label, score FROM s"),
    "maxsim_len_norm": (maxsim_by_length, f"WITH {MV_SQL} SELECT query_label, doc_label, by_length AS score FROM s"),
    "maxsim_retrieval": (maxsim_retrieval, f"WITH {MV_SQL}, r AS (SELECT query_label, doc_label, score, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, doc_label) AS n FROM s) SELECT query_label, doc_label, score, n - 1 AS rank FROM r WHERE n <= 3"),
    "maxsim_rerank": (maxsim_rerank, RERANK_SQL),
    "hybrid_weighted": (hybrid_weighted, HYBRID_SQL),
    "rrf_fuse": (rrf_fuse, RRF_SQL),
    "hybrid_pool": (hybrid_pool, POOL_SQL),
    "hybrid_full_outer_pool": (full_outer_pool, OUTER_SQL),
    "exemplar_retrieval": (exemplar_retrieval, EXEMPLAR_SQL),
    "quantize_int8": (quantize_int8, INT8_SQL),
    "quantize_uint8": (quantize_uint8, UINT8_SQL),
    "quantize_binary": (binary_quantize, BIN_SQL),
    "l2_normalise": (l2_normalise, UNIT_SQL),
    "gray_bucket": (gray_bucket, GRAY_SQL),
    "dense_to_sparse": (dense_to_sparse, f"SELECT vec_id, pos, round(x, 6) AS value FROM ({U}) WHERE x > 0"),
    "log_saturation": (log_saturation, f"SELECT vec_id, pos, round(ln(1 + greatest(x, 0)), 6) AS value FROM ({U})"),
    "sigmoid": (sigmoid, f"SELECT vec_id, pos, round(1 / (1 + exp(-x * 10)), 6) AS value FROM ({U})"),
    "count_sketch": (count_sketch, SKETCH_SQL),
    "ams_projection": (ams_projection, AMS_SQL),
    "mean_pooling": (mean_pooling, "SELECT label, pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2"),
    "sparse_max_pool": (sparse_max_pool, "SELECT label, pos, round(max(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2 HAVING max(x) > 0"),
    "vector_blend": (vector_blend, BLEND_SQL),
    "ndcg_mrr_recall": (ndcg_mrr_recall, f"WITH {METRIC_SQL} SELECT query_id, ndcg, mrr, recall FROM m"),
    "metric_macro_average": (metric_macro_average, f"WITH {METRIC_SQL} SELECT round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr, round(avg(recall), 4) AS recall, round(avg(hit1), 4) AS hit_1, round(avg(hit5), 4) AS hit_5 FROM m"),
}
