"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of whole documents, so words are labelled first: in toxic documents a
word is tagged if it, or a beginning of it, is found in toxic documents far more
often than in clean ones; in clean documents none is. A two-tag chain over runs of
``CHAIN`` words learns weights of words, of their beginnings and of neighbouring
tags from these. Forward-backward gives every word's chance of being toxic; words of
half or more are the offending spans. Their expected number and density, through a
logistic fit on documents that the chain was not trained on, give the document's
score.

The model is fitted on a bounded number of labelled documents, each whole. Spark
counts their features and cuts them into chains; the driver gets the features that
tell, the chains that hold one, and for chains without any their number by length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.session import checkpointed, stored

CHAIN = 64
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6, 7, 8)
#: The training sample: so many documents of each label at most, whole texts of any length.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: A word is tagged by a feature that is so many times likelier in toxic documents, with
#: so large a log-likelihood ratio (30: found in seven, all toxic, where a tenth is).
LEAST_LIFT, LEAST_RATIO = 4.0, 30.0
#: A feature is learned from with a ratio of so much.
LEARN_RATIO = 12.0
PREDICT_FROM = 0.3
CACHE_WORDS = 300_000
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(word: str) -> list[str]:
    """The lower-cased word, and its beginnings that are shorter than it."""
    word = word.lower()
    return ["=" + word, *(word[:n] for n in STEMS if n < len(word))]


def forward_backward(
    odds: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, times: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Chances of tag 1 [chains, CHAIN], and summed chances of tag pairs [2, 2].

    ``odds``: each word's score of tag 1 against tag 0; ``transitions``: scores of
    (tag, next tag); ``times``: how often each chain counts in the sums.
    """
    times = np.ones(len(odds)) if times is None else times
    n, width = odds.shape
    emit = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -30, 30))], -1)
    move = np.exp(np.clip(transitions, -30, 30))
    within = np.arange(width) < lengths[:, None]
    alpha, beta = np.zeros((width, n, 2)), np.ones((width, n, 2))
    alpha[0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        a = (alpha[t - 1] @ move) * emit[:, t]
        alpha[t] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        ahead = beta[t + 1] * emit[:, t + 1]
        b = ahead @ move.T
        live = within[:, t + 1]
        beta[t] = np.where(live[:, None], b / b.sum(1, keepdims=True), 1.0)
        joint = alpha[t][:, :, None] * move * ahead[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += np.einsum('nab,n->ab', joint[live], times[live])
    chance = alpha * beta
    chance = (chance[:, :, 1] / chance.sum(2)).T
    return np.where(within, chance, 0.0), pairs


class _Scores(dict):
    """Score of each word seen, by the weights of its features."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        get = self.weights.get
        self[word] = found = sum(get(f, 0.0) for f in features(word))
        return found


class ToxicChain:
    """Weights of features, a bias, transitions, and the logistic fit of document scores."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray):
        self.weights, self.bias, self.transitions = weights, bias, transitions
        self.document = np.array([-4.0, 1.0, 1.0, 1.0])
        plain = np.full((CHAIN + 1, CHAIN), bias)
        chance, _ = forward_backward(plain, np.arange(CHAIN + 1), transitions)
        #: expected toxic words of a chain of each length without features
        self.plain = chance.sum(1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "scores"}

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Document features [texts, 4], and for each text its words' chances (empty where no word has a feature)."""
        if not hasattr(self, "scores"):
            self.scores = _Scores(self.weights)
        score = self.scores.__getitem__
        totals, sizes = np.zeros(len(texts)), np.zeros(len(texts))
        most = np.zeros(len(texts))
        chances: list[np.ndarray] = [np.empty(0)] * len(texts)
        rows, lengths, of = [], [], []
        for i, text in enumerate(texts):
            words = _WORD.findall(text)
            sizes[i] = len(words)
            found = np.fromiter(map(score, words), np.float64, len(words))
            tail = len(words) % CHAIN
            chains = np.pad(found, (0, (CHAIN - tail) % CHAIN)).reshape(-1, CHAIN)
            live = np.flatnonzero(chains.any(1))
            if len(live):
                n = np.full(len(chains), CHAIN)
                if tail:
                    n[-1] = tail
                chances[i] = np.zeros(chains.shape)
                rows.append(chains[live])
                lengths.append(n[live])
                of.extend((i, k) for k in live.tolist())
                totals[i] += self.plain[np.delete(n, live)].sum()
            else:
                totals[i] += self.plain[CHAIN] * (len(words) // CHAIN) + self.plain[tail]
        if rows:
            every, n = np.concatenate(rows), np.concatenate(lengths)
            for at in range(0, len(every), 20_000):
                part, _ = forward_backward(every[at : at + 20_000] + self.bias, n[at : at + 20_000], self.transitions)
                for (i, k), chance in zip(of[at : at + 20_000], part, strict=True):
                    chances[i][k] = chance
                    totals[i] += chance.sum()
                    most[i] = max(most[i], chance.max())
        size = np.maximum(sizes, 1)
        found = np.stack([np.ones(len(texts)), np.log1p(totals), np.sqrt(totals / size), most], 1)
        return found, [c.ravel()[: int(m)] if c.size else c for c, m in zip(chances, sizes, strict=True)]

    def scores_of(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(found @ self.document, -40, 40)))

    def fit_documents(self, x: np.ndarray, labels: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> None:
        """Newton steps of a logistic regression over the features that ``tag`` gives of documents."""
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            slope = x.T @ (p - labels) + ridge * w
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.document = w


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(toxic, part, text) of labelled documents that are not held out; None where there are no such labels.

    Of each label the first by a hash of doc_id, up to its bound, each a whole text.
    ``part`` 0 is for the document fit, others for the chain. Ids are drawn before
    texts are joined: those of a share of the label that holds about twice its bound.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 40)) / float(1 << 40)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", "toxic", place.alias("place"))
    bound = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, 2 * bound[y] / counts[y]) for y in bound if counts.get(y)}
    if not share:
        return None
    near = lambda limit: F.col("place") < F.when(F.col("toxic") == 1, limit.get(1, 0.0)).otherwise(limit.get(0, 0.0))
    drawn = known.where(near(share)).select("toxic", "place").collect()  # about twice the bounds
    limit = {}
    for y in share:
        places = sorted(r["place"] for r in drawn if r["toxic"] == y)
        limit[y] = places[bound[y]] if len(places) > bound[y] else share[y]
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)).alias("part")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    # as many rows as the sample has
    return stored(texts.join(F.broadcast(known.where(near(limit))), "doc_id").select("toxic", part, "text"))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = sorted(counts[0].keys() | counts[1].keys())
        found = pa.record_batch(
            [pa.array(names, pa.string()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))],
            ["feature", "in_toxic", "in_clean"],
        )
        counts[0].clear(), counts[1].clear()
        return found

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({f for w in set(_WORD.findall(text)) for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out()
    yield out()


def feature_evidence(chain_part: DataFrame) -> tuple[list[str], set[str]]:
    """(features that the chain learns from, sorted; those that tag a word) from the documents of each label that hold them.

    A feature's evidence is its lift in toxic documents and its log-likelihood
    ratio. Whole words of clean documents that share a telling beginning are learned
    from too, as they may tell against it.
    """
    total = {r["toxic"]: r["count"] for r in chain_part.groupBy("toxic").count().collect()}
    n, m = total.get(1, 0), total.get(0, 0)
    if not n:
        return [], set()
    counted = checkpointed(
        chain_part.select("toxic", "text").mapInArrow(_count_features, "feature string, in_toxic long, in_clean long")
        .groupBy("feature").agg(F.sum("in_toxic").alias("a"), F.sum("in_clean").alias("b"))
    )
    share, p = n / (n + m), F.col("a") / (F.col("a") + F.col("b"))
    clean = F.when(F.col("b") > 0, F.col("b") * F.log((1 - p) / (1 - share))).otherwise(0.0) if m else F.lit(0.0)
    rated = counted.where(p > share).select(
        "feature", (F.col("a") * (m + 1) / ((F.col("b") + 0.5) * (n + 1))).alias("lift"), (2 * (F.col("a") * F.log(p / share) + clean)).alias("ratio")
    )
    rows = rated.where(F.col("ratio") >= LEARN_RATIO).collect()
    known = {r["feature"] for r in rows}
    strong = {r["feature"] for r in rows if r["lift"] >= LEAST_LIFT and r["ratio"] >= LEAST_RATIO}

    def related(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for f in batch.column(0).to_pylist() if f not in known and not known.isdisjoint(features(f[1:]))]
            yield pa.record_batch([pa.array(found, pa.string())], ["feature"])

    if not strong:
        return [], strong
    words = counted.where(F.col("feature").startswith("=") & (F.col("b") >= 2)).select("feature")
    against = [r["feature"] for r in words.mapInArrow(related, "feature string").collect()]
    return sorted({*known, *against}), strong


def cut_chains(chain_part: DataFrame, names: list[str]) -> DataFrame:
    """(words, toxic, length, times): chains that hold a feature of ``names``, others counted by their length.

    ``words`` are lower-cased; those without a feature are empty, and ``words`` is
    null for counted chains.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = set(names)
        cache: dict[str, str] = {}
        plain: Counter = Counter()
        for batch in batches:
            chains, toxics = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text)
                for w in set(words).difference(cache):
                    cache[w] = w.lower() if not index.isdisjoint(features(w)) else ""
                for at in range(0, len(words), CHAIN):
                    run = [cache[w] for w in words[at : at + CHAIN]]
                    if any(run):
                        chains.append(run)
                        toxics.append(toxic)
                    else:
                        plain[len(run)] += 1
                if len(cache) > CACHE_WORDS:
                    cache.clear()
            yield pa.record_batch(
                [pa.array(chains, pa.list_(pa.string())), pa.array(toxics, pa.int32()), pa.array([len(c) for c in chains], pa.int32()), pa.array([1] * len(chains), pa.int64())],
                ["words", "toxic", "length", "times"],
            )
        yield pa.record_batch(
            [pa.array([None] * len(plain), pa.list_(pa.string())), pa.array([0] * len(plain), pa.int32()), pa.array(list(plain), pa.int32()), pa.array(list(plain.values()), pa.int64())],
            ["words", "toxic", "length", "times"],
        )

    return chain_part.select("toxic", "text").mapInArrow(cut, "words array<string>, toxic int, length int, times long")


def fit_chain(chains: pa.Table, names: list[str], strong: set[str], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> ToxicChain:
    """The chain by full gradient steps (Adam) over ``cut_chains``; words of toxic documents with a strong feature are tagged 1."""
    chains = chains.sort_by([(c, "ascending") for c in ("length", "times", "toxic")]).combine_chunks()
    lengths = chains["length"].to_numpy()
    times = chains["times"].to_numpy().astype(float)
    toxic = chains["toxic"].to_numpy()
    live = np.asarray(chains["words"].is_valid())
    flat = chains["words"].combine_chunks().flatten().dictionary_encode()
    vocabulary = ["", *flat.dictionary.to_pylist()]
    index = {f: i for i, f in enumerate(names)}
    of_word = [[index[f] for f in features(w) if f in index] if w else [] for w in vocabulary]
    tagged = np.array([bool(w) and not strong.isdisjoint(features(w)) for w in vocabulary])
    within = np.arange(CHAIN) < lengths[:, None]
    ids = np.zeros(within.shape, np.int64)
    ids[within & live[:, None]] = flat.indices.to_numpy() + 1
    y = (tagged[ids] & (toxic == 1)[:, None] & within).astype(float)
    word_of = np.repeat(np.arange(len(of_word)), [len(x) for x in of_word])
    feature_of = np.array([f for x in of_word for f in x], np.int64)
    both = within[:, 1:] * times[:, None]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b)).astype(float).ravel() @ both.ravel() for b in (0, 1)] for a in (0, 1)])
    n_words = (lengths * times).sum()
    w = np.zeros(len(names) + 5)  # features, bias, transitions
    w[len(names)] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        by_word = np.bincount(word_of, w[feature_of], len(of_word))
        chance, pairs = forward_backward(by_word[ids] + w[len(names)], lengths, w[-4:].reshape(2, 2), times)
        off = np.where(within, chance - y, 0.0) * times[:, None]
        per_word = np.bincount(ids[within], off[within], len(of_word))
        slope = np.concatenate([np.bincount(feature_of, per_word[word_of], len(names)), [off.sum()], (pairs - seen).ravel()])
        slope = slope / n_words + ridge * w / len(w)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
    weights = {f: float(x) for f, x in zip(names, w, strict=False) if abs(x) > 1e-3}
    return ToxicChain(weights, float(w[len(names)]), w[-4:].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame) -> ToxicChain:
    """The chain on about two thirds of the sample, the document fit on the rest."""
    sample = training_sample(docs, labels)
    model = ToxicChain({}, -6.0, np.zeros((2, 2)))
    if sample is None:
        return model
    chain_part = sample.where("part > 0")
    names, strong = feature_evidence(chain_part)
    if strong:
        model = fit_chain(cut_chains(chain_part, names).toArrow(), names, strong)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = model.tag(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    rest = sample.where("part = 0").select("toxic", "text").mapInArrow(described, "toxic int, x array<double>").collect()
    rest = sorted((r["toxic"], *r["x"]) for r in rest)  # a third of the sample
    if len({y for y, *_ in rest}) == 2:
        model.fit_documents(np.array([x for _, *x in rest]), np.array([float(y) for y, *_ in rest]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (``start:end`` of toxic words, comma-joined) for each row of ``docs``.

    Offsets are code points of the whole text, ends exclusive. Null texts count as
    empty and are scored like any text without words. Without toxic labels every
    score is low. Repeated rows are scored each, and equal texts alike; a row without
    doc_id is scored, not held out, and never learned from. Very long texts are
    learned from and scored whole. An empty table gives no rows. Further columns,
    whatever their names, are not read; labels other than 0 and 1 are passed over.
    """
    return predict(docs, train(docs, labels))


def predict(docs: DataFrame, model: ToxicChain) -> DataFrame:
    """``score_toxicity`` by a model that is there."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(2).to_pylist()]
                found, chances = model.tag(texts)
                score = model.scores_of(found)
                spans = []
                for text, chance in zip(texts, chances, strict=True):
                    hits = np.flatnonzero(chance >= 0.5)
                    if len(hits):
                        places = [m.span() for m in _WORD.finditer(text)]
                        spans.append(",".join(f"{a}:{b}" for a, b in (places[k] for k in hits)))
                    else:
                        spans.append("")
                yield pa.record_batch(
                    [
                        batch.column(0), batch.column(1), pa.array(score, pa.float64()),
                        pa.array((score >= PREDICT_FROM).astype(np.int32)), pa.array(spans),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")
