"""Blocked searches, places in an order and token buckets against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import blocks, ranking, tables


def _vectors(n, seed):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in rng.integers(-2, 3, 6)] for _ in range(n)]


def _cosine(a, b):
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / scale), 6) if scale else 0.0


@pytest.mark.parametrize("ties", ["asc", "desc"])
@pytest.mark.parametrize("size", [1 << 20, 100])
def test_matrix_knn_against_brute_force(spark, monkeypatch, ties, size):
    """Small whole numbers, so many scores are equal; blocks of two rows and of all."""
    monkeypatch.setattr(blocks, "ROW_BYTES", size)
    monkeypatch.setattr(blocks, "QUERY_BYTES", size)
    d, q = _vectors(90, 1), _vectors(7, 2)
    rows = spark.createDataFrame(list(enumerate(d)), "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(list(enumerate(q)), "query_id long, query array<double>")
    got = blocks.matrix_knn(queries, rows, 5, ties=ties, others=True, above=-0.2)
    sign = -1 if ties == "desc" else 1
    want = []
    for i, x in enumerate(q):
        scored = [(-_cosine(x, y), sign * j) for j, y in enumerate(d) if j != i and _cosine(x, y) > -0.2]
        want += [(i, sign * j, -s, r) for r, (s, j) in enumerate(sorted(scored)[:5])]
    assert sorted(tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()) == sorted(want)


def test_matrix_knn_odd_rows(spark):
    """Null vectors have no neighbours and are none, null values count as 0, short vectors end in zeros, empty tables give nothing."""
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 2.0]), (5, [])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, query array<double>")
    got = blocks.matrix_knn(queries, rows, 9, blocks.dots).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(1, 0, 4, 2.0), (1, 1, 1, 1.0), (1, 2, 3, 1.0), (1, 3, 5, 0.0)]
    assert blocks.matrix_knn(queries, rows.limit(0), 9).count() == 0
    assert blocks.matrix_knn(queries.limit(0), rows, 9).count() == 0


def test_large_query_sets_are_paired_by_partition(spark):
    a = spark.range(5).select(F.col("id").alias("query_id"), F.repeat(F.lit("x"), 1000).alias("body"))
    b = spark.range(4).select(F.col("id").alias("vec_id"))
    for most, size, broadcast in ((10, 1 << 20, True), (3, 1 << 20, False), (10, 2000, False)):
        joined = ranking.against(a, b, most, size)
        assert joined.count() == 20
        assert ("Broadcast" in joined._jdf.queryExecution().executedPlan().toString()) == broadcast


def test_group_best_against_brute_force(spark):
    d, q = _vectors(60, 3), _vectors(5, 4)
    rows = spark.createDataFrame([(i, i % 4, v) for i, v in enumerate(d)] + [(99, None, d[0])], "vec_id long, label int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(list(enumerate(q)), "query_id long, query array<double>")
    got = {(r.query_id, r.label): (round(r.s, 6), r.s_at) for r in blocks.group_best(queries, rows, {"s": blocks.cosines}, "label").collect()}
    want = {}
    for i, x in enumerate(q):
        for label in range(4):
            s, j = min((-_cosine(x, y), j) for j, y in enumerate(d) if j % 4 == label)
            want[i, label] = (-s, j)
    assert got == want


def test_values_at_against_sorted_lists(spark):
    """A hot group with repeated values, a small one, one of nulls, a null key and an empty table."""
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.integers(0, 40, 3000)] + [("hot", float(x)) for x in rng.normal(10, 3, 3000)]
    rows += [("few", 3.0), ("few", 1.0), ("few", None), ("none", None), (None, 7.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    places = {"first": F.lit(0), "mid": F.floor(F.lit(0.5) * (F.col("n") - 1)), "late": F.floor(F.lit(0.95) * (F.col("n") - 1)), "out": F.col("n")}
    got = {r.k: r for r in ranking.values_at(df, "k", "v", places).collect()}
    assert set(got) == {"hot", "few", "none", None}
    for k, r in got.items():
        v = sorted(x for key, x in rows if key == k and x is not None)
        at = lambda p: v[p] if 0 <= p < len(v) else None  # noqa: B023, E731
        n = len(v)
        assert (r.n, r.first, r.mid, r.late, r.out) == (n, at(0), at(int(0.5 * (n - 1))) if n else None, at(int(0.95 * (n - 1))) if n else None, None)
    assert ranking.values_at(df.limit(0), "k", "v", places).count() == 0


def test_bucket_passes_against_plain_python(spark):
    day = 86_400_000_000
    rng = np.random.default_rng(6)
    rows = [(int(k) if k else None, int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 60 * day, 400), strict=True))]
    got = {r.k: (r.n, r.passed) for r in tables.bucket_passes(spark.createDataFrame(rows, "k long, at long, i long"), "k", "at", "i").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        left, last, passed = 3.0, None, 0
        times = sorted(r[1] for r in rows if r[0] == k)
        for t in times:
            left = min(3.0, left + ((t - last) / day if last is not None else 0.0))
            last = t
            if left >= 1:
                left, passed = left - 1, passed + 1
        want[k] = (len(times), passed)
    assert got == want
    assert tables.bucket_passes(spark.createDataFrame([], "k long, at long, i long"), "k", "at", "i").count() == 0
