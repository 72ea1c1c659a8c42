"""Spark results against DuckDB's, rows in any order, columns by name."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def shown(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if isinstance(v, float) else repr(v)

    return sorted(tuple(shown(r[i]) for i in order) for r in found)


def assert_same(frame, con, sql):
    got = frame.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, [tuple(r) for r in got]) == rows(names, want)


def most_rows(frame):
    """The largest number of rows that one operator of the frame's plan gives; runs the frame."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.queryExecution().executedPlan().executeCollect()
    most, open_ = 0, [plan]
    while open_:
        node = open_.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        elif kind == "ReusedExchangeExec":
            continue
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return most
