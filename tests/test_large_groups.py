"""Queries on tables with many equal rows, on folders of files, and what one task or worker holds."""

import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.compare import assert_same, most_rows
from vectrail import session
from vectrail.operators import blocks, spans
from vectrail.plans import registry


def test_attribute_recommender_compares_names_not_parts(spark, tmp_path):
    """Few names of very many parts: rows of the plan grow with the parts, not with their pairs."""
    words = ["old", "new", "red", "ring", "gear"]
    named = [" ".join(x) for x in itertools.product(words[:3], words[3:])] + ["ring ring", "bolt"]
    parts = [(i, named[i * i % len(named)]) for i in range(2000)] + [(7, "red"), (3000, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    frame = registry.queries()["attribute_recommender"](spark, str(tmp_path))
    bags = defaultdict(Counter)
    for k, name in parts:
        if name is not None:
            bags[k].update(name.split(" "))
    df = Counter(t for b in bags.values() for t in b)
    w = {k: {t: n * math.log(len(bags) / df[t]) for t, n in b.items()} for k, b in bags.items()}
    u = {k: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for k, v in w.items()}
    want = []
    for q in (k for k in u if k % 50 == 0):
        scored = sorted((-round(sum(x * u[q][t] for t, x in v.items() if t in u[q]), 6), k) for k, v in u.items() if k != q and u[q].keys() & v.keys())
        want += [(q, k, -s, i) for i, (s, k) in enumerate(scored[:5])]
    assert sorted(tuple(r) for r in frame.collect()) == sorted(want)
    assert most_rows(registry.queries()["attribute_recommender"](spark, str(tmp_path))) < 3 * len(parts)


def test_greedy_interval_match_reads_many_keys_a_call(spark):
    """Against brute force over repeated ids, and without a Python call for each key."""
    rng = random.Random(5)
    side = lambda n: [(rng.randrange(40), f"k{rng.randrange(2)}", rng.randrange(6), float(a := rng.randrange(9)), a + float(rng.randrange(1, 6))) for _ in range(n)]
    pred, gold = side(400), side(400)
    schema = "doc long, part string, id long, start double, end double"
    found = spans.greedy_interval_match(spark.createDataFrame(pred, schema).repartition(3), spark.createDataFrame(gold, schema), ["doc", "part"])
    pairs = defaultdict(list)
    for (*k, p, ps, pe), (*h, g, gs, ge) in itertools.product(pred, gold):
        if k == h and min(pe, ge) > max(ps, gs):
            pairs[tuple(k)].append((p, ps, pe, g, gs, ge, min(pe, ge) - max(ps, gs)))
    want = []
    for key, rows in pairs.items():
        first = {p: min(r[1] for r in rows if r[0] == p) for p in {r[0] for r in rows}}
        claimed, used = set(), set()
        for r in sorted(rows, key=lambda r: (first[r[0]], r[0], -r[6], r[3], r)):
            if r[0] not in claimed and r[3] not in used:
                claimed.add(r[0])
                used.add(r[3])
                want.append((*key, r[0], r[3], r[6]))
    assert sorted(tuple(r) for r in found.select("doc", "part", "pred_id", "gold_id", "overlap").collect()) == sorted(want)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_token_span_means_deals_tasks_by_rows(spark, tmp_path, monkeypatch):
    """A task's lines stay bounded as the table grows; adaptive execution does not join them again."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    lines = spark.range(9000).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 + 1 AS int) AS l_linenumber", "cast(id AS double) AS l_extendedprice", "cast(id % 50 AS double) AS l_quantity", "substr('ANR', cast(id * id % 3 + 1 AS int), 1) AS l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    frame = registry.queries()["token_span_means"](spark, str(tmp_path))
    assert frame.rdd.getNumPartitions() >= 18
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert_same(frame, con, registry.oracle_sql()["token_span_means"])


@pytest.mark.parametrize("name", ["stream_strip_blocks", "stream_windowed_counts", "stream_sequence_gaps", "stream_token_bucket"])
def test_streams_of_folders_of_files(spark, sf_dir, tmp_path, name):
    """Tables that are folders of several files are streamed whole."""
    con = duckdb.connect()
    for t in ("conversations", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert_same(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])


def test_block_pairs_meet_few_values_at_once(spark, monkeypatch):
    """What is worked out at once is bounded, however many queries a block has, and the neighbours are the same."""
    rows = spark.range(0, 60, 1, 1).selectExpr("id AS vec_id", "array(cast(id % 7 AS double), cast(id % 5 AS double), 1D) AS embedding")
    queries = rows.selectExpr("vec_id AS query_id", "embedding AS query")
    found = lambda measure: sorted(map(tuple, blocks.matrix_knn(queries, rows, 4, measure).collect()))
    whole = found(blocks.dots)
    monkeypatch.setattr(blocks, "TILE", 120, raising=False)

    def few(q, d):
        if len(q) * len(d) > 120:
            raise ValueError("too many values at once")
        return q @ d.T

    assert found(few) == whole


def test_ablation_searches_each_list_once(spark, sf_dir, monkeypatch):
    calls, search = [], blocks.matrix_knn
    monkeypatch.setattr(blocks, "matrix_knn", lambda *a, **b: calls.append(1) or search(*a, **b))
    assert registry.queries()["retrieval_ablation"](spark, sf_dir).count() == 4
    assert len(calls) == 2
