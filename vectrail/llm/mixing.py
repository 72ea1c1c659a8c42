"""Mixing sources to target weights by capped water-filling.

The budget (all words) is shared among sources by weight. A source whose share
exceeds ``max_epochs`` times its size is clamped there and the excess goes to the
others by weight, until none is above. In order of cap / weight the clamped
sources are a prefix, so the water level is the largest, over prefixes, of (budget
left) / (weight left); one window over the sources' totals finds it.

A source that should give ``e`` epochs gives every document ``floor(e)`` whole
times. The rest is taken in a seeded order (MD5 of seed and doc_id) until the
target is met; the document on the boundary gives only its first words. The
running sum is taken in two levels, within (source, hash bucket) and over the
buckets' totals, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.text import WORD, words
from vectrail.session import checkpointed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hex digits of the order key that name a bucket: 4,096 buckets for each source.
BUCKET_DIGITS = 3


def _source_key(source: Column) -> Column:
    """Sorts as the source's code points do, null last; never null."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def water_levels(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` for each row of ``totals`` (source_key, source_size).

    There is one row a source; these windows see nothing larger.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        totals.withColumn("rank", F.row_number().over(Window.orderBy("source_key")) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every).cast("double")
    clamped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    return (
        ranked.withColumn("share", (budget - clamped) / F.sum("weight").over(onward))
        .withColumn("level", F.max("share").over(every))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .select("source_key", "source_size", "target")
    )


def mix_plan(
    docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, whole, extra, taken, and the ``carry`` columns.

    ``whole`` is the number of whole repetitions, ``extra`` the words of a further
    one, ``taken`` = whole * size + extra. Null and empty texts have size 0 and
    give nothing; very long ones are counted whole. A null source is a source, last
    in order. Rows that share a doc_id are separate documents; their order is by
    size, and equal ones are interchangeable. Documents without a doc_id are placed
    by their texts. An empty table gives no rows; further columns are not read.
    """
    # a document without an id is placed by its text
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name))
    rows = checkpointed(
        docs.select(
            "doc_id",
            "source",
            _source_key(F.col("source")).alias("source_key"),
            F.size(words(F.col("text"))).cast("long").alias("size"),
            key.alias("order_key"),
            *carry,
        ).withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    )
    buckets = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    levels = water_levels(
        rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, max_epochs
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    starts = (
        buckets.withColumn(
            "bucket_start",
            F.sum("bucket_size").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("bucket_size"),
        )
        .join(levels, "source_key")
        .withColumn("whole", epochs.cast("long"))
        .withColumn("left", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
        .drop("bucket_size")
    )
    within = Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size")
    running = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    extra = F.greatest(
        F.lit(0).cast("long"),
        F.least(F.col("size"), F.col("left") - F.col("bucket_start") - F.col("running") + F.col("size")),
    )
    return (
        rows.withColumn("running", running)
        .join(starts, ["source_key", "bucket"])
        .withColumn("extra", extra)
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "extra", "taken", *carry)
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as its plan has it, columns as they were.

    A document on a source's boundary gives its first words once; ``n_chars``
    follows. Documents of size 0 give nothing. Rows equal in id, source and text
    are interchangeable: their repetitions are summed and come from one of them. An
    empty table stays empty; further columns are kept.
    """
    names = docs.columns
    body = F.coalesce(F.col("text"), F.lit(""))
    # 128 bits that name a row's id, source and text
    keys = {
        "row_key_1": F.xxhash64("doc_id", "source", body),
        "row_key_2": F.xxhash64(body, "source", "doc_id", F.lit("row")),
    }
    keyed = docs.withColumns(keys)
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    plan = (
        mix_plan(keyed, weights, max_epochs, seed, tuple(keys))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("size") > 0, F.col("whole") + (F.col("extra") == F.col("size")).cast("long")).otherwise(0)).alias("copies"),
            F.coalesce(F.max(F.when(partial, F.col("extra"))), F.lit(0)).alias("first_words"),
        )
        .where((F.col("copies") > 0) | (F.col("first_words") > 0))
    )
    cut = F.array_repeat(F.lit(0).cast("long"), F.col("copies").cast("int"))
    cut = F.concat(cut, F.when(F.col("first_words") > 0, F.array("first_words")).otherwise(F.array().cast("array<bigint>")))
    space = r"[\x20\x09-\x0D]"
    pattern = F.concat(F.lit(f"^(?:{space}*+{WORD}+){{"), F.col("__cut").cast("string"), F.lit("}+"))
    first = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))
    mixed = (
        keyed.dropDuplicates(list(keys))
        .join(plan, list(keys))
        .withColumn("__cut", F.explode(cut))
        .withColumn("text", F.when(F.col("__cut") > 0, first).otherwise(F.col("text")))
    )
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        mixed = mixed.withColumn("n_chars", F.when(F.col("__cut") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return mixed.select(*names)
