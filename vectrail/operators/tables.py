"""Table operations: insert-or-update, projections by a field map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source``, and those of ``target`` whose keys it lacks."""
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def project_fields(df: DataFrame, field_map: dict) -> DataFrame:
    """``id`` and ``text`` from a map with id_field, input_field, carry and input_type; other keys are refused."""
    known = {"id_field", "input_field", "carry", "input_type"}
    if unknown := set(field_map) - known:
        raise ValueError(f"unknown field map keys: {sorted(unknown)}")
    if field_map.get("input_type", "text") not in ("text", "document"):
        raise ValueError("input_type is text or document")
    if not field_map.get("input_field"):
        raise ValueError("input_field is missing")
    key = F.col(field_map["id_field"]).cast("string") if field_map.get("id_field") else F.lit(None).cast("string")
    return df.select(key.alias("id"), F.col(field_map["input_field"]).alias("text"), *field_map.get("carry", []))


def bucket_passes(rows: DataFrame, key: str, at: str, tie: str, capacity: float = 3.0, per_day: float = 1.0) -> DataFrame:
    """(key, n, passed): each key's requests in order of ``at`` (microseconds), and how many a token bucket lets pass.

    Keys are dealt to partitions and sorted there (with spills); a task reads its rows
    in that order and keeps one bucket, so no key's rows are held together.
    """

    def run(batches):
        import pyarrow as pa

        key_now, any_row = None, False
        left, last, n, passed = capacity, None, 0, 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not any_row or k != key_now:
                    if any_row:
                        out.append((key_now, n, passed))
                    key_now, any_row = k, True
                    left, last, n, passed = capacity, None, 0, 0
                if t is not None:
                    left = min(capacity, left + ((t - last) / 86_400_000_000.0 * per_day if last is not None else 0.0))
                    last = t
                n += 1
                if left >= 1:
                    left, passed = left - 1, passed + 1
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.column(0).type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=[key, "n", "passed"])
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([key_now], batch.column(0).type), pa.array([n], pa.int64()), pa.array([passed], pa.int64())], names=[key, "n", "passed"])

    dealt = rows.select(key, at, tie).repartition(key).sortWithinPartitions(key, at, tie)
    return dealt.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, n long, passed long")
