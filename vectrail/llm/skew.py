"""Joins by a key of which a few values may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def _split(found: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    hot = F.col("n") >= max(2.0, total * HOT_SHARE)
    return found.where(hot).drop("n"), found.where(~hot).drop("n")


def join_counted(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``found`` (one row a ``key``, and ``n``: how many of the ``total`` rows have it).

    Rows of hot keys are not shuffled: their side of ``found``, of at most
    1 / HOT_SHARE rows whatever the size of the input, is broadcast. Others are
    joined by shuffles, in which no key is large.
    """
    hot, cold = _split(found, total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def without_counted(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` whose key is not in ``found``, which is as in ``join_counted``."""
    hot, cold = _split(found, total)
    return rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.select(key), key, "left_anti")
