"""Near-duplicates by SimHash and a binary-trie self-join.

A fingerprint has 64 bits; two link at ``MAX_BITS`` differing bits or fewer. Six
blocks of bits are named, and in a linked pair at least two blocks agree wholly,
so each fingerprint goes to 15 tries, one for each two blocks, rooted at the value
of those blocks. Every trie is joined with itself from its root: pairs of nodes
descend together, a step to unlike children spends one bit, and a pair that has
spent more than the budget is dropped with all below it. The pairs at the leaves
are the links. All pairs of nodes of one level are NumPy arrays, so many tries
descend at once.

Only distinct fingerprints take part. A trie with very many of them is rooted anew:
its bits are dealt to five classes, of which one at least agrees in a linked pair,
so each of its fingerprints goes to five tries, and so on until none is crowded;
the work grows with the fingerprints, not with their square. A task returns the links of its tries as stars (one edge for each fingerprint that is linked at
most), which connect what the links connect; the components of these edges are
found in DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.components import connected_components
from vectrail.llm.skew import join_counted, without_counted
from vectrail.session import checkpointed

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Widths of the blocks from the lowest bit up; pairs of MAX_BITS + 2 blocks agree.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Distinct fingerprints of one trie that a task joins; one with more is rooted anew.
TRIE_ROWS = 1024
#: How bits are dealt to five classes at each further root: weights of the base-5 digits of a bit's number.
DEALS = ((1, 0, 0), (0, 1, 0), (1, 1, 1), (1, 2, 3), (1, 4, 2), (2, 1, 3), (1, 3, 4), (3, 1, 1))
#: Rows that a task joins at once, and pairs that it keeps at once.
BLOCK_ROWS, BLOCK_PAIRS = 100_000, 500_000


def simhash(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text; see ``fingerprints``."""
    words = (raw or b"").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    if not hashes:
        hashes = [digest(text, SEED)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([simhash(x) for x in batch.to_pylist()], pa.int64())


def fingerprints(text: Column) -> Column:
    """SimHash of whole texts as a long (its 64 bits, signed).

    A-Z are lower-cased, words are split at ASCII white space, and each window of
    four words, joined by single spaces and repeats counted, is hashed by XXH64
    with seed 42; a text of fewer words is one window. A bit is 1 if it is set in
    over half of the hashes. Null, empty and blank texts have fingerprint zero.
    """
    return F.arrow_udf(_fingerprints, "long")(F.coalesce(text, F.lit("")).cast("binary"))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def rotations() -> list[tuple[int, ...]]:
    """(shift, width, shift, width) of every two blocks."""
    at = [(sum(BLOCKS[:i]), n) for i, n in enumerate(BLOCKS)]
    return [(*at[i], *at[j]) for i in range(len(at)) for j in range(i + 1, len(at))]


def _tries(fp: Column) -> Column:
    """Keys of the tries that a fingerprint is in."""
    part = lambda shift, n: F.shiftrightunsigned(fp, shift).bitwiseAND((1 << n) - 1)
    return F.array(
        *(
            F.lit(r << 32).cast("long") + F.shiftleft(part(a, n), 11) + part(b, m)
            for r, (a, n, b, m) in enumerate(rotations())
        )
    )


def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits, in each range [start, end) of ``fps``, sorted within it.

    A node is a range of leaves that share their first bits.
    """
    ones: dict[int, np.ndarray] = {}

    def split(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in ones:
            set_bits = (fps >> np.uint64(bit)) & np.uint64(1)
            ones[bit] = np.concatenate(([0], np.cumsum(set_bits, dtype=np.int32)))
        return hi - (ones[bit][hi] - ones[bit][lo])

    wide = ends - starts > 1
    a = (starts[wide].astype(np.int32), ends[wide].astype(np.int32))
    todo = [(63, *a, *a, np.zeros(len(a[0]), np.int8))]
    while todo:
        bit, alo, ahi, blo, bhi, spent = todo.pop()
        while len(alo):
            if len(alo) > BLOCK_PAIRS:
                half = len(alo) // 2
                todo.append((bit, *(x[half:] for x in (alo, ahi, blo, bhi, spent))))
                alo, ahi, blo, bhi, spent = (x[:half] for x in (alo, ahi, blo, bhi, spent))
            leaf = (ahi - alo == 1) & (bhi - blo == 1)
            if leaf.any():
                i, j = alo[leaf], blo[leaf]
                near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
                yield i[near], j[near]
                alo, ahi, blo, bhi, spent = (x[~leaf] for x in (alo, ahi, blo, bhi, spent))
                if not len(alo):
                    break
            amid, bmid, other = split(bit, alo, ahi), split(bit, blo, bhi), alo != blo
            like = [(alo, amid, blo, bmid), (amid, ahi, bmid, bhi)]
            unlike = [(alo, amid, bmid, bhi, slice(None)), (amid, ahi, blo, bmid, other)]
            rows = [(*x, spent) for x in like] + [(*(y[k] for y in x), spent[k] + 1) for *x, k in unlike]
            alo, ahi, blo, bhi, spent = (np.concatenate(x) for x in zip(*rows, strict=True))
            keep = (ahi > alo) & (bhi > blo) & (spent <= budget)
            alo, ahi, blo, bhi, spent = (x[keep] for x in (alo, ahi, blo, bhi, spent))
            bit -= 1


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lower ``label`` (a forest of smaller indexes) until the ends of every pair share one."""
    while True:
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def classes(deal: tuple[int, int, int]) -> list[int]:
    """Masks (as signed longs) of the bits of each of the five classes."""
    masks = [0] * (MAX_BITS + 1)
    for bit in range(64):
        digits = bit % 5, bit // 5 % 5, bit // 25
        masks[sum(w * x for w, x in zip(deal, digits, strict=True)) % 5] |= 1 << bit
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (trie, fp), sorted so; out: star edges (a, b)."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(rows.shape[1], bool)
        new[1:] = rows[0, 1:] != rows[0, :-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], rows.shape[1])
        fps = rows[1].view(np.uint64)
        # the sort was of signed values
        order = np.lexsort((fps, np.cumsum(new)))
        fps = fps[order]
        label = np.arange(len(fps), dtype=np.int32)
        for i, j in trie_pairs(fps, starts, ends):
            _settle(label, i, j)
        moved = np.flatnonzero(label != np.arange(len(label)))
        signed = fps.view(np.int64)
        return pa.record_batch([pa.array(signed[moved]), pa.array(signed[label[moved]])], ["a", "b"])

    size = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        size += len(batch)
        if size < BLOCK_ROWS:
            continue
        rows = np.concatenate(held, axis=1)
        last = int((rows[0] != rows[0, -1]).nonzero()[0].max(initial=-1)) + 1  # the last trie may go on
        if last:
            yield links(rows[:, :last])
        held, size = [rows[:, last:]], rows.shape[1] - last
    if size:
        yield links(np.concatenate(held, axis=1))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the fingerprints ``fp`` of ``distinct`` as all their links do."""
    units = distinct.select(F.explode(_tries(F.col("fp"))).alias("trie"), "fp")
    rows, done = (MAX_BITS + 2) * (MAX_BITS + 1) // 2 * distinct.count(), []
    for deal in DEALS:
        crowded = checkpointed(units.groupBy("trie").agg(F.count("*").alias("n")).where(F.col("n") > TRIE_ROWS))
        over = crowded.agg(F.sum("n")).first()[0]
        if not over:
            break
        done.append(without_counted(units, crowded, "trie", rows))
        # equal hashes of unlike tries only add pairs to look at
        roots = F.array(*(F.xxhash64("trie", F.lit(mask), F.col("fp").bitwiseAND(F.lit(mask))) for mask in classes(deal)))
        units = checkpointed(join_counted(units, crowded, "trie", rows).select(F.explode(roots).alias("trie"), "fp"))
        rows = over * (MAX_BITS + 1)
    for part in done:
        units = units.unionByName(part)
    return units.repartition("trie").sortWithinPartitions("trie", "fp").mapInArrow(_join_tries, "a long, b long").distinct()


def label_fingerprints(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp, ...), checkpointed, with ``root``, the smallest fingerprint that links reach."""
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach; null ids are passed
    over, and it is null where a component has no other. Null, empty and blank texts
    have fingerprint zero and link like any other; very long texts count whole.
    Repeated rows are returned each; an empty table gives none. Further columns,
    whatever their names, are not read.
    """
    hashed = checkpointed(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    distinct = checkpointed(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    rooted = checkpointed(label_fingerprints(distinct))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    counted = rooted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    labels = checkpointed(join_counted(rooted.select("root", "fp", F.col("n").alias("copies")), smallest, "root", counted[0]))
    labels = labels.select("fp", "component_id", F.col("copies").alias("n"))
    return join_counted(hashed, labels, "fp", counted[1]).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest doc_id, then of the least text hash.

    Null ids come after all others. Null, empty and blank texts are one component.
    Where equal rows repeat, one stays; an empty table stays empty. Columns, further
    ones too, as they were.
    """
    names = docs.columns
    body = F.coalesce(F.col("text"), F.lit(""))
    # 128 bits that name a row's id and text
    keys = {"row_key_1": F.xxhash64("doc_id", body), "row_key_2": F.xxhash64(body, "doc_id", F.lit("row"))}
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *(k.alias(n) for n, k in keys.items()))
    hashed = docs.select(fingerprints(F.col("text")).alias("fp"), first.alias("first"))
    distinct = checkpointed(hashed.groupBy("fp").agg(F.min("first").alias("first")))
    chosen = label_fingerprints(distinct).groupBy("root").agg(F.min("first").alias("first")).select("first.row_key_1", "first.row_key_2")
    return docs.withColumns(keys).join(chosen, list(keys), "left_semi").dropDuplicates(list(keys)).select(*names)
