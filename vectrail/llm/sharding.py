"""Sharding by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own
(``offset + j * skip``); the shards take turns claiming the next free slot of
their order until the table is full. Every shard ends with as many slots as any
other, give or take one, and adding or losing a shard moves few slots. The table
has a fixed number of rows, so it is broadcast and placement is one hash lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 8191
N_SHARDS = 64


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the owning shard for each of ``size`` slots; ``size`` must be prime."""
    if not is_prime(size):
        raise ValueError(f"the table size must be prime: {size}")
    if not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least and no more than slots")
    at = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner = [-1] * size
    free = size
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 32 bits of its text's MD5, modulo the table size; null counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (string); no shuffle.

    Equal keys share a shard, so the key should be a row's id rather than a hot
    attribute. Null keys go where the empty text goes; an empty table gives an
    empty result; columns of ``df`` named ``slot`` or ``shard`` are replaced.
    """
    spark = df.sparkSession
    rows = [(slot, shards[i]) for slot, i in enumerate(fill_table(shards, size))]
    placement = spark.createDataFrame(rows, "slot int, shard string")
    keyed = df.drop("shard").withColumn("slot", slot_of(F.col(key), size))
    return keyed.join(F.broadcast(placement), "slot").select(*keyed.columns, "shard")
