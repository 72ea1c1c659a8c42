"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds, for every context of up to
``ORDER`` bytes, how often each byte followed it in all labelled texts. A byte costs
-log2 of its share in the longest known context; a byte unseen there costs the
context's escape, then what the next shorter context charges (escape of method C:
distinct / (total + distinct); a context never seen costs nothing to leave), and
after the empty context one of 256. The statistics are frozen, so a byte's cost
depends on it and the bytes before it alone. A text goes to the language with the
shortest code. Letters A-Z count as a-z; all other bytes are told apart.

Counting is sparse: tasks count whole texts, Spark adds up, and a leaf (context and
byte) that makes up less than ``LEAST_SHARE`` of its language's bytes is not in the
tree, at any size of the input. So a language has at most 1 / LEAST_SHARE leaves of
each order, and the model is bounded by that times the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.session import checkpointed

#: Bytes of the longest context; a code is a context and a byte in 32 bits.
ORDER = 3
#: Share of a language's bytes from which a leaf is in its tree.
LEAST_SHARE = 1 / (1 << 18)
#: Bytes that are scored, and counted, at once; distinct codes that a task counts before it sends them on.
BLOCK, COUNT_BLOCK, MOST_CODES = 1 << 19, 1 << 21, 1 << 21
#: Slots of a worker's cache of code lengths, and values in it.
CACHE_BITS, CACHE_VALUES = 20, 1 << 24
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame) -> DataFrame:
    """(lang, raw) of all documents that are learned from: labelled, with a text, not held out."""
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    return docs.where(known).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("raw"))


def coded_blocks(texts: list[bytes], most: int, order: int = ORDER) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts' places, where each begins, codes) of about ``most`` bytes of whole texts at once.

    Every byte of every text has one code, of it and the ``order`` bytes before it;
    those before a text's first are line ends. Empty texts have none.
    """
    pad = b"\n" * order
    block: list[tuple[int, bytes]] = []

    def coded() -> tuple[list[int], np.ndarray, np.ndarray]:
        s = np.frombuffer(b"".join(x for _, x in block), np.uint8)
        codes = np.zeros(len(s) - order, np.uint32)
        for k in range(order + 1):
            codes |= s[k : len(s) - order + k].astype(np.uint32) << np.uint32(8 * (order - k))
        sizes = np.array([len(x) for _, x in block])
        inside = np.ones(len(codes), bool)  # not of the end of one piece and the start of the next
        inside[(np.cumsum(sizes)[:-1, None] - 1 - np.arange(order)).ravel()] = False
        return [i for i, _ in block], np.cumsum([0, *(sizes[:-1] - order)]), codes[inside]

    held = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        text = pad + text.lower()
        for at in range(0, len(text) - order, most):
            piece = text[at : at + most + order]
            if held + len(piece) > most and block:
                yield coded()
                block, held = [], 0
            block.append((i, piece))
            held += len(piece)
    if block:
        yield coded()


def code_counts(known: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each byte followed each context in all whole texts of a language."""

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, sums = added(parts)
                for at in range(0, len(codes), 100_000):
                    part = codes[at : at + 100_000].astype(np.int64)
                    yield pa.record_batch([pa.array([lang] * len(part)), pa.array(part), pa.array(sums[at : at + 100_000])], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(raw)
            for lang, found in texts.items():
                for _, _, codes in coded_blocks(found, COUNT_BLOCK, order):
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                    size += len(held[lang][-1][0])
                    if size > MOST_CODES:
                        for known_lang in held:
                            held[known_lang] = [added(held[known_lang])]
                        size = sum(len(x[0][0]) for x in held.values())
                        if size > MOST_CODES // 2:
                            yield from out()
                            size = 0
        yield from out()

    return known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value or 0, whether there) of each of ``wanted`` among sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return np.where(there, values[at], 0.0), there


class ContextTree:
    """One language's frozen code lengths: by order the leaves' and the contexts' codes, sorted, with their bits."""

    def __init__(self, leaves: list[tuple[np.ndarray, np.ndarray]]):
        """``leaves[k]``: codes of k + 1 bytes and their counts."""
        self.orders = []
        for codes, n in leaves:
            order = np.argsort(codes)
            codes, n = codes[order].astype(np.uint32), n[order].astype(float)
            contexts, of, distinct = np.unique(codes >> np.uint32(8), return_inverse=True, return_counts=True)
            whole = np.bincount(of, n, len(contexts)) + distinct
            self.orders.append((codes, np.log2(whole[of]) - np.log2(n), contexts, np.log2(whole) - np.log2(distinct)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of codes of the longest context."""
        cost = np.full(len(codes), 8.0)
        for k, (leaves, bits, contexts, escapes) in enumerate(self.orders):
            low = codes & np.uint32((1 << 8 * (k + 1)) - 1)
            escape, _ = _look_up(contexts, escapes, low >> np.uint32(8))
            found, there = _look_up(leaves, bits, low)
            cost = np.where(there, found, escape + cost)
        return cost


class CodeLengths:
    """Code lengths of texts under every language's tree; a worker keeps those of the codes that it has met."""

    def __init__(self, trees: dict[str, ContextTree], order: int = ORDER):
        self.langs, self.order = sorted(trees), order
        self.trees = [trees[lang] for lang in self.langs]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("slot_code", "slot_row", "rows", "used")}

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """[codes, languages] bits, from the cache where a slot holds the code."""
        if not hasattr(self, "rows") or self.used >= len(self.rows) - BLOCK:
            self.slot_code = np.zeros(1 << CACHE_BITS, np.uint32)
            self.slot_row = np.full(1 << CACHE_BITS, -1, np.int32)
            self.rows = np.zeros((max(CACHE_VALUES // max(1, len(self.langs)), 2 * BLOCK), len(self.langs)), np.float32)
            self.used = 0
        slots = (codes * np.uint32(2654435761)) >> np.uint32(32 - CACHE_BITS)
        row = np.where(self.slot_code[slots] == codes, self.slot_row[slots], -1)
        missed = np.flatnonzero(row < 0)
        if len(missed):
            new, of = np.unique(codes[missed], return_inverse=True)
            at = self.used + np.arange(len(new), dtype=np.int32)
            self.rows[at] = np.stack([t.bits(new) for t in self.trees], 1)
            where = (new * np.uint32(2654435761)) >> np.uint32(32 - CACHE_BITS)
            # one code a slot: of several the last written stays, in both arrays
            self.slot_row[where] = at
            self.slot_code[where] = new[self.slot_row[where] - self.used]
            row[missed] = at[of]
            self.used += len(new)
        return self.rows[row]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """[texts, languages] code lengths of whole texts."""
        out = np.zeros((len(texts), len(self.langs)))
        for places, starts, codes in coded_blocks(texts, BLOCK, self.order):
            np.add.at(out, places, np.add.reduceat(self._rows(codes), starts, axis=0, dtype=np.float64))
        return out

    def best(self, raw: list[bytes | None]) -> tuple[list[str], np.ndarray, list[float | None]]:
        """(language, posterior at equal priors, bits a byte) of each text; unknown, 0 and null for null ones."""
        known = [i for i, x in enumerate(raw) if x is not None and self.langs]
        lang, score, rate = [UNKNOWN] * len(raw), np.zeros(len(raw)), [None] * len(raw)
        if known:
            bits = self.bits([raw[i] for i in known])
            least = bits.min(1)
            score[known] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            for j, i in enumerate(known):
                lang[i], rate[i] = self.langs[bits[j].argmin()], float(least[j] / max(1, len(raw[i])))
        return lang, score, rate


def _lettered(text: Column) -> Column:
    """The bytes of a text with a letter, else null."""
    return F.when(text.rlike(r"\p{L}"), text.cast("binary"))


def predict(docs: DataFrame, model: CodeLengths) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte for each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. The score is the winner's posterior at equal priors. Ties go to the
    language that sorts first. Very long texts are scored whole, in blocks.
    Repeated rows are scored each, and an empty table gives no rows. Further
    columns, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _lettered(F.col("text")).alias("raw"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, value, rate = shared.value.best(batch.column(2).to_pylist())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(value, pa.float64()), pa.array(rate, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double"
    return rows.mapInArrow(score, schema)


def train(docs: DataFrame, order: int = ORDER, least_share: float = LEAST_SHARE) -> CodeLengths:
    """The model of all labelled documents that are not held out, each whole.

    What reaches the driver are the trees' leaves: of each order at most
    1 / ``least_share`` a language.
    """
    counts = checkpointed(code_counts(labelled(docs), order))
    totals = counts.groupBy("lang").agg((F.sum("n") * least_share).alias("least"))  # one row a language
    levels = F.array(*(F.struct(F.lit(k).alias("k"), F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("low")) for k in range(order + 1)))
    leaves = (
        counts.select("lang", "n", F.explode(levels).alias("x"))
        .groupBy("lang", F.col("x.k").alias("k"), F.col("x.low").alias("code"))
        .agg(F.sum("n").alias("n"))
        .join(F.broadcast(totals), "lang")
        .where(F.col("n") >= F.col("least"))
    )
    found = leaves.select("lang", "k", "code", "n").toArrow().combine_chunks()
    langs = found["lang"].combine_chunks().dictionary_encode() if len(found) else None
    which = langs.indices.to_numpy() if langs is not None else None
    k, codes, n = (found[c].to_numpy() for c in ("k", "code", "n"))
    trees = {}
    for i, lang in enumerate(langs.dictionary.to_pylist() if langs is not None else []):
        mine = which == i
        trees[lang] = ContextTree([(codes[mine & (k == level)], n[mine & (k == level)]) for level in range(order + 1)])
    return CodeLengths(trees, order)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled part of ``docs`` and predict every row; see ``predict``."""
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Documents whose language is identified with at least this score; columns as they were.

    Null texts and texts without a letter go, and without labels all do. Repeated
    rows stay or go alike; an empty table stays empty; further columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(shared.value.best(batch.to_pylist())[1], pa.float64())

    return docs.where(F.arrow_udf(score, "double")(_lettered(F.col("text"))) >= least_score)
