"""Exact searches over vectors as products of matrices, block by block.

Rows are packed into blocks where they are, so nothing is shuffled; each block of
queries meets each block of rows, and what a pair of blocks gives is small (its best
rows a query, or a best value a group). Spark ranks what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vectrail.operators import ranking as R

#: Bytes of vectors in a block of rows and in one of queries.
ROW_BYTES, QUERY_BYTES = 2 << 20, 1 << 19
#: Values of a pair of blocks that are worked out at once.
TILE = 1 << 19


def dots(q, d):
    """Inner products of all rows of two matrices."""
    return q @ d.T


def cosines(q, d):
    """Cosines of all rows of two matrices; a zero norm gives 0."""
    import numpy as np

    scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]
    return np.divide(q @ d.T, scale, out=np.zeros_like(scale), where=scale > 0)


def packed(rows: DataFrame, vector: str, columns: list[str], prefix: str, size: int, down: bool = False) -> DataFrame:
    """Blocks of at most ``size`` bytes of vectors: their ``columns`` as arrays, ordered by them, and the values as doubles end to end.

    Rows without a vector are left out; a null value is 0, and shorter vectors of a
    block are filled up with zeros.
    """
    held = rows.where(F.col(vector).isNotNull()).select(*columns, F.col(vector).alias("__v"))
    types = dict(held.dtypes)
    order = [(c, "descending" if down else "ascending") for c in columns]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            sorted_rows = pc.sort_indices(batch.select(columns), sort_keys=order)
            step = max(1, size // (8 * max(pc.max(pc.list_value_length(batch.column("__v"))).as_py(), 1)))
            for i in range(0, batch.num_rows, step):
                part = batch.take(sorted_rows.slice(i, step))  # only these are held as doubles
                v = part.column("__v")
                length = v.value_lengths().to_numpy()
                m = np.zeros((len(length), max(int(length.max()), 1)))
                m[np.arange(m.shape[1])[None, :] < length[:, None]] = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False).astype("float64"), copy=False, nan=0.0)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([m.shape[1]], pa.int32()), pa.array([memoryview(m).cast("B")], pa.binary())], names=names)

    names = [*(prefix + c for c in columns), prefix + "dims", prefix + "values"]
    fields = ", ".join([*(f"`{prefix}{c}` array<{types[c]}>" for c in columns), f"{prefix}dims int", f"{prefix}values binary"])
    return held.mapInArrow(run, fields)


def block_pairs(queries: DataFrame, rows: DataFrame, made: Callable, schema: str, *, query: str, vector: str, query_columns: list[str], row_columns: list[str], down: bool = False) -> DataFrame:
    """What ``made(query columns, query matrix, row columns, row matrix)`` gives, as a dict of columns, for each pair of blocks.

    Columns are dicts of arrays; a block's rows are ordered by their columns. Queries
    are met a few at a time (``TILE`` values), so what a worker holds beside Spark's
    batch of blocks does not grow with the tables. The blocks of the queries are
    broadcast while their measured size allows it, else Spark pairs the partitions of
    both sides.
    """
    q = packed(queries, query, query_columns, "q_", QUERY_BYTES)
    d = packed(rows, vector, row_columns, "d_", ROW_BYTES, down)

    shown = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def read(batch, n, prefix, columns):
            # views of the batch; nothing is copied
            dims, values = batch.column(prefix + "dims")[n].as_py(), batch.column(prefix + "values")[n].as_buffer()
            m = np.frombuffer(values).reshape(-1, dims)
            return {c: batch.column(prefix + c)[n].values.to_numpy(zero_copy_only=False) for c in columns}, m

        for batch in batches:
            for n in range(batch.num_rows):
                (qc, qm), (dc, dm) = read(batch, n, "q_", query_columns), read(batch, n, "d_", row_columns)
                wide = max(qm.shape[1], dm.shape[1])
                qm, dm = (m if m.shape[1] == wide else np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (qm, dm))
                step = max(1, TILE // len(dm))
                outs = [made({c: v[i : i + step] for c, v in qc.items()}, qm[i : i + step], dc, dm) for i in range(0, len(qm), step)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[f.name] for o in outs]), f.type, from_pandas=True) for f in shown], schema=shown)

    return R.against(q, d).mapInArrow(run, schema)


def rounded(values, digits: int):
    """Half away from zero, as SQL's ``round``."""
    import numpy as np

    scale = 10.0**digits
    return np.sign(values) * np.floor(np.abs(values) * scale + 0.5) / scale


def best(values, k: int):
    """Row and column numbers of the ``k`` largest of each row; of equal values the first ones."""
    import numpy as np

    n = values.shape[1]
    if n <= k:
        taken = np.ones(values.shape, dtype=bool)
    else:
        least = np.partition(values, n - k, axis=1)[:, n - k, None]
        above, even = values > least, values == least
        taken = above | (even & (np.cumsum(even, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(taken & (values > -np.inf))


def matrix_knn(
    queries: DataFrame, rows: DataFrame, k: int, measure: Callable = cosines, *, query: str = "query", vector: str = "embedding", query_id: str = "query_id",
    row_ids: tuple[str, ...] = ("vec_id",), ties: str = "asc", digits: int = 6, others: bool = False, above: float | None = None, name: str = "score", first: int = 0,
) -> DataFrame:
    """The ``k`` rows of the largest ``measure`` for each query, exactly: query id, row ids, the rounded score and its rank.

    Equal rounded scores go by the row ids. ``others`` leaves out a row of the query's
    own id, ``above`` rows that score no more than it. Each pair of blocks gives at
    most ``k`` rows a query, so the ranking shuffles little beside the rows read.
    Rows (and queries) without a vector have no neighbours.
    """
    ids = list(row_ids)
    types = dict(rows.dtypes) | dict(queries.dtypes)

    def made(qc, q, dc, d):
        import numpy as np

        s = rounded(measure(q, d), digits)
        if others:
            s = np.where(qc[query_id][:, None] == dc[ids[0]][None, :], -np.inf, s)
        if above is not None:
            s = np.where(s > above, s, -np.inf)
        i, j = best(s, k)
        return {query_id: qc[query_id][i], **{c: dc[c][j] for c in ids}, name: s[i, j]}

    fields = ", ".join(f"`{c}` {types[c]}" for c in (query_id, *ids))
    found = block_pairs(queries, rows, made, f"{fields}, {name} double", query=query, vector=vector, query_columns=[query_id], row_columns=ids, down=ties == "desc")
    order: list[Column] = [F.desc(c) if ties == "desc" else F.asc(c) for c in ids]
    return R.top_k(found.withColumn(name, F.round(name, digits)), [query_id], [F.desc(name), *order], k, first=first)


def group_best(queries: DataFrame, rows: DataFrame, measures: dict[str, Callable], group: str, *, query: str = "query", vector: str = "embedding", query_id: str = "query_id", row_id: str = "vec_id") -> DataFrame:
    """Each query's largest value of each measure in each group of rows, and the first row (``<name>_at``) that has it.

    The value is rounded to 6 digits before rows are compared, so equal ones go by
    the row's id; it is not rounded in the result.
    """
    types = dict(rows.dtypes) | dict(queries.dtypes)

    def made(qc, q, dc, d):
        import numpy as np

        order = np.lexsort((dc[row_id], dc[group]))
        groups, first = np.unique(dc[group][order], return_index=True)
        out = {query_id: np.repeat(qc[query_id], len(groups)), group: np.tile(groups, len(q))}
        for name, measure in measures.items():
            s = measure(q, d[order])
            shown = rounded(s, 6)
            stop = [*first[1:], len(order)]
            at = np.stack([a + np.argmax(shown[:, a:b], axis=1) for a, b in zip(first, stop, strict=True)], axis=1)
            out |= {name: np.maximum.reduceat(s, first, axis=1).ravel(), f"{name}_at": dc[row_id][order][at].ravel()}
        return out

    values = ", ".join(f"`{n}` double, `{n}_at` {types[row_id]}" for n in measures)
    found = block_pairs(
        queries, rows.where(F.col(group).isNotNull()), made, f"`{query_id}` {types[query_id]}, `{group}` {types[group]}, {values}", query=query, vector=vector, query_columns=[query_id], row_columns=[row_id, group]
    )
    most = [F.max(n).alias(n) for n in measures]
    at = [F.max_by(f"{n}_at", F.struct(F.round(n, 6), -F.col(f"{n}_at"))).alias(f"{n}_at") for n in measures]
    return found.groupBy(query_id, group).agg(*most, *at)
