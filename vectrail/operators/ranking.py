"""Similarity joins, rankings and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query rows, and their bytes as text, that may be broadcast to every task; more are joined block by block.
MOST_QUERIES, MOST_BYTES = 20_000, 128 << 20


def against(queries: DataFrame, rows: DataFrame, most: int = MOST_QUERIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Each query beside every row: the pairs of an exact search over a stated query set.

    The queries are broadcast where their measured number and size allow it, so the
    rows are never shuffled; beyond that Spark pairs the partitions of both sides in
    blocks.
    """
    size = queries.limit(most + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    few = size[0] <= most and size[1] <= most_bytes
    return rows.crossJoin(F.broadcast(queries) if few else queries.hint("shuffle_replicate_nl"))


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank", first: int = 0) -> DataFrame:
    """The first ``k`` rows of each group with their rank, counted from ``first``.

    The filter on the rank lets Spark cut every partition to ``k`` rows a group
    before the shuffle.
    """
    ranked = scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1 + first)


def knn(queries: DataFrame, rows: DataFrame, score: Column, k: int, *, query_id: str, row_id: str, ties: str = "asc") -> DataFrame:
    """Exact nearest rows of each query by ``score`` (columns of both sides), ties by row id."""
    scored = against(queries, rows).withColumn("score", score)
    tie = F.asc(row_id) if ties == "asc" else F.desc(row_id)
    return top_k(scored.select(query_id, row_id, "score"), [query_id], [F.desc("score"), tie], k)


#: Ranges that a group's distinct values are cut into.
RANGES = 256


def values_at(rows: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """For each group its number ``n`` of values and the value at each place of their ascending order, exactly.

    ``places`` are 0-based expressions over ``n``; a place outside gives null, as does
    a group without values (``n`` 0). Values are counted first, so repeated ones are
    one row; the counts are cut into ranges by approximate quantiles, and only the
    range that holds a place is ordered. No group is collected.
    """
    held = rows.where(F.col(value).isNotNull())
    counts = held.groupBy(by, value).agg(F.count("*").alias("__n"))
    cuts = counts.groupBy(by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("__cuts"), F.sum("__n").alias("n"))
    within = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    same = lambda a, b: F.col(f"{a}.{by}").eqNullSafe(F.col(f"{b}.{by}"))
    ranged = counts.alias("a").join(cuts.alias("b"), same("a", "b")).select(f"a.{by}", value, "__n", within.alias("__range"))
    upto = F.sum("__in").over(Window.partitionBy(by).orderBy("__range"))  # at most RANGES rows a group
    ranges = ranged.groupBy(by, "__range").agg(F.sum("__n").alias("__in")).withColumn("__upto", upto)
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), p.cast("long").alias("at")) for n, p in places.items())))
    wanted = cuts.select(by, at.alias("w")).select(by, F.col("w.name").alias("__name"), F.col("w.at").alias("__at"))
    inside = (F.col("__at") >= F.col("__upto") - F.col("__in")) & (F.col("__at") < F.col("__upto"))
    hit = wanted.alias("a").join(ranges.alias("b"), same("a", "b") & inside).select(f"a.{by}", "__name", "__at", "__range", (F.col("__upto") - F.col("__in")).alias("__before"))
    near = ranged.alias("a").join(hit.alias("b"), same("a", "b") & (F.col("a.__range") == F.col("b.__range"))).select(f"a.{by}", value, "__n", "__name", "__at", "__before")
    last = F.col("__before") + F.sum("__n").over(Window.partitionBy(by, "__name").orderBy(value))
    found = near.withColumn("__last", last).where("__last > __at").groupBy(by).agg(*(F.min(F.when(F.col("__name") == n, F.col(value))).alias(n) for n in places))
    groups = rows.select(by).distinct()
    out = groups.alias("a").join(cuts.alias("b"), same("a", "b"), "left").select(f"a.{by}", F.coalesce("n", F.lit(0)).alias("n"))
    return out.alias("a").join(found.alias("b"), same("a", "b"), "left").select(f"a.{by}", "n", *places)


def rrf(lists: list[DataFrame], by: list[str], item: str, rank: str = "rank", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists with ranks from 0."""
    parts = [x.select(*by, item, (1.0 / (F.col(rank) + 1 + k)).alias("part"), F.lit(i).alias("list"), rank) for i, x in enumerate(lists)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*by, item).agg(
        F.sum("part").alias("fused"), F.min(F.col("list") * 1_000_000 + F.col(rank)).alias("first_seen")
    )


def ordered_union(lists: list[DataFrame], by: list[str], item: str, rank: str = "rank") -> DataFrame:
    """Union of lists, first occurrences kept, with their position in the joint order."""
    whole = None
    for i, x in enumerate(lists):
        part = x.select(*by, item, (F.lit(i) * 1_000_000 + F.col(rank)).alias("place"))
        whole = part if whole is None else whole.unionByName(part)
    first = whole.groupBy(*by, item).agg(F.min("place").alias("place"))
    return first.select(
        *by, item, (F.row_number().over(Window.partitionBy(*by).orderBy("place", item)) - 1).alias("position")
    )


def attach_scores(candidates: DataFrame, scores: DataFrame, on: list[str], score: str, rank: str) -> DataFrame:
    """Left join of rerank scores; a missing score counts as 0, best first."""
    joined = candidates.join(scores, on, "left").withColumn(score, F.coalesce(score, F.lit(0.0)))
    return joined.withColumn(rank, F.row_number().over(Window.partitionBy(on[0]).orderBy(F.desc(score), *on[1:])) - 1)


#: Rows of one group that a scorer gets at once.
SCORED_ROWS = 1024


def grouped_scores(pairs: DataFrame, score, *, by: tuple[str, ...] = ("query", "query_id", "instruction"), item: str = "doc", place: str = "place") -> DataFrame:
    """``pairs`` with a ``score`` of each, which ``score(key, items)`` gives for the items of one group at a time.

    Rows of equal ``by`` columns are a group, nulls included; ``place`` numbers the
    rows, and by it the input's order comes back. A group of very many rows is dealt
    to calls of at most about ``SCORED_ROWS`` neighbouring places.
    """
    import pandas as pd

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(place)
        return rows.drop(columns="__part").assign(score=[float(x) for x in score(key[: len(by)], rows[item].tolist())])

    dealt = pairs.withColumn("__part", F.floor(F.col(place) / SCORED_ROWS))
    fields = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return dealt.groupBy(*by, "__part").applyInPandas(run, f"{fields}, score double")
