"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.session import stored_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """One of the input tables, a file or a folder of files, as a stream.

    A streamed path must be a folder unless it is a pattern, so the table's is one.
    """
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with a zoned timestamp."""
    stream = table_stream(spark, sf_dir, "events", EVENTS)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window and verb, under a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


def classify_sequence(stream: DataFrame, key: str, seq: str, item: str) -> DataFrame:
    """Each chunk of a keyed stream as first, ok, gap or dropped, by the highest number seen before it.

    The state of a key is that number; chunks of a batch are taken in order of item.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(item)
        kinds = []
        for n in rows[seq].tolist():
            if seen is None:
                kinds.append("first")
            elif n <= seen:
                kinds.append("dropped")
            else:
                kinds.append("gap" if n > seen + 1 else "ok")
            seen = n if seen is None else max(seen, n)
        state.update((int(seen),))
        yield pd.DataFrame({"key": k[0], "item": rows[item].tolist(), "kind": kinds})

    return stream.groupBy(key).applyInPandasWithState(
        step, "key bigint, item bigint, kind string", "seen bigint", "append", GroupStateTimeout.NoTimeout
    )


def token_bucket(stream: DataFrame, key: str, at: str, capacity: float = 3.0, per_day: float = 1.0) -> DataFrame:
    """Requests that a bucket of ``capacity`` lets pass, refilled over time; state: tokens left and when."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (capacity, None)
        passed = n = 0
        for t in sorted(pd.concat(list(batches))[at].tolist()):
            now = pd.Timestamp(t).value / 86_400e9
            left = min(capacity, left + (now - last) * per_day) if last is not None else left
            n, last = n + 1, now
            if left >= 1:
                left, passed = left - 1, passed + 1
        state.update((float(left), float(last)))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "passed": [passed]})

    return stream.groupBy(key).applyInPandasWithState(
        step, "key bigint, n bigint, passed bigint", "left double, last double", "append", GroupStateTimeout.NoTimeout
    )


def strip_piece(inside: bool, held: str, piece: str, opened: str = "<think>", closed: str = "</think>") -> tuple[str, bool, str]:
    """What a piece of text shows outside of marked blocks, whether a block is open after it, and an end that may be half a mark.

    A closing mark without an opening one is hidden too.
    """
    parts = re.split(f"({re.escape(opened)}|{re.escape(closed)})", held + piece)
    shown = []
    for text, mark in zip(parts[::2], [*parts[1::2], None], strict=True):
        if mark is None:
            starts = [m[:n] for m in (opened, closed) for n in range(1, len(m))]
            held = max((x for x in starts if text.endswith(x)), key=len, default="")
            text = text.removesuffix(held)
        if not inside:
            shown.append(text)
        inside = inside if mark is None else mark == opened
    return "".join(shown), inside, held


def strip_blocks(stream: DataFrame, key: str, item: str, text: str) -> DataFrame:
    """(key, item, shown): pieces of keyed texts in order of item, without marked blocks that may begin and end in any piece.

    The state of a key is whether a block is open, and the few characters that may be half a mark.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, held = state.get if state.exists else (False, "")
        rows = pd.concat(list(batches)).sort_values(item)
        shown = []
        for piece in rows[text].tolist():
            out, inside, held = strip_piece(inside, held, piece or "")
            shown.append(out)
        state.update((bool(inside), held))
        yield pd.DataFrame({"key": k[0], "item": rows[item].tolist(), "shown": shown})

    return stream.groupBy(key).applyInPandasWithState(
        step, "key bigint, item bigint, shown string", "inside boolean, held string", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there through the stream, written as Parquet in the shared folder and read again.

    The stream's checkpoint is there too. In mode ``complete`` a batch's result
    takes the place of the one before.
    """
    spark = stream.sparkSession
    out = stored_path(spark)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}-checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
