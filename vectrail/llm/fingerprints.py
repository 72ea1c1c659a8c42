"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words, weighted by how often they occur. For
each of ``SAMPLES`` draws every term has two gamma variates and a uniform one,
fixed by its hash: r, c ~ Gamma(2, 1), b ~ U(0, 1). A term of weight w is quantised
to t = floor(ln w / r + b) and scored ln a = ln c - r (t - b + 1); the draw's sample
is the (term, t) of the least score. Two texts agree in a draw with a probability
that equals their generalised Jaccard similarity, the sum of the lesser weights
over the sum of the greater.

Score and sample are packed in one long, so a text's signature is ``SAMPLES``
minima of longs: terms are exploded and reduced in one stage, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.text import words

SAMPLES = 32
#: Bits of a sample's id in the signature: 4 hex digits a draw.
ID_BITS = 16
#: Rows of a run of neighbouring documents, at least, and the number of runs from which runs
#: grow instead: a run is sorted, with spills, and read in order, so its rows are not held at
#: once, and what is broadcast of the runs is 24 bytes each.
RUN_ROWS, MOST_RUNS = 128, 1 << 20
ANCHORS = 200


def _uniform(bits: Column, shift: int) -> Column:
    """21 bits of a hash as a number in (0, 1)."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND((1 << 21) - 1)
    return (part.cast("double") + 0.5) / float(1 << 21)


def term_draws(term: Column, log_weight: Column, samples: int = SAMPLES) -> list[Column]:
    """For each draw a term's score and sample id in one long; the least is the text's sample."""
    draws = []
    for j in range(samples):
        x, y = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
        r = -F.log(_uniform(x, 0) * _uniform(x, 21))
        c = -F.log(_uniform(y, 0) * _uniform(y, 21))
        b = _uniform(x, 42)
        t = F.floor(log_weight / r + b)
        score = F.log(c) - r * (t - b + 1)
        # scores lie well within 512 of zero
        level = ((score + 512.0) * float(1 << 36)).cast("long")
        sample = (term.bitwiseAND((1 << 40) - 1) + t * 40503).bitwiseAND((1 << ID_BITS) - 1)
        draws.append(F.shiftleft(level, ID_BITS).bitwiseOR(sample))
    return draws


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """``df`` exploded to one row a distinct term of ``text``: ``term`` (its hash) and ``weight``; texts of none keep a row of nulls.

    Occurrences are sorted by hash; the places at which runs end give the counts.
    """
    hashes = F.transform(words(F.lower(F.col(text))), lambda w: F.xxhash64(w))
    df = df.withColumn("__sorted", F.sort_array(hashes)).drop(text)
    n = F.size("__sorted")
    ends = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("__sorted", i) != F.get("__sorted", i - 1))
    )
    df = df.withColumn("__ends", F.when(n > 0, ends).otherwise(F.array().cast("array<int>")))
    runs = F.transform(
        "__ends",
        lambda e, k: F.struct(
            F.get("__sorted", e - 1).alias("term"),
            (e - F.when(k > 0, F.get("__ends", k - 1)).otherwise(0)).alias("weight"),
        ),
    )
    kept = [c for c in df.columns if not c.startswith("__")]
    return df.select(*kept, F.explode_outer(runs).alias("__run")).select(
        *kept, F.col("__run.term").alias("term"), F.col("__run.weight").alias("weight")
    )


def signatures(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature``, an array of ``samples`` ids, empty where a text has no word.

    ``keys`` must name rows; where ``df`` is partitioned by some of them there is no shuffle.
    """
    terms = with_terms(df.select(*keys, text), text).withColumn("log_weight", F.log("weight"))
    names = [f"__s{j}" for j in range(samples)]
    least = terms.groupBy(*keys).agg(
        *(F.min(d).alias(n) for d, n in zip(term_draws(F.col("term"), F.col("log_weight"), samples), names, strict=True))
    )
    ids = F.array(*(F.col(n).bitwiseAND((1 << ID_BITS) - 1).cast("int") for n in names))
    return least.select(*keys, F.when(F.col(names[0]).isNotNull(), ids).otherwise(F.array().cast("array<int>")).alias("signature"))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), ID_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of draws in which two signatures agree; two texts without words are alike, one is unlike any other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def _unnamed(doc_id: Column, text: Column) -> Column:
    """The place of a document without an id, by a hash of its text in [0, 1); null for others."""
    part = F.shiftrightunsigned(F.xxhash64(text), 11).cast("double") / float(1 << 53)
    return F.when(doc_id.isNull(), part)


def _runs(docs: DataFrame, run_rows: int) -> Column:
    """Number of the run of neighbouring documents that a row is in, from the last in order up.

    Approximate quantiles of doc_id, a fixed number of them, are cut into equal
    steps, 0 and up. Documents without an id are dealt by ``unnamed`` to runs below 0.
    """
    shares = [i / ANCHORS for i in range(ANCHORS + 1)]
    seen = docs.agg(
        F.count("doc_id").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.percentile_approx("doc_id", shares, 10_000).alias("anchors"),
    ).first()
    none = max(1, round(min((seen["rows"] - seen["n"]) / run_rows, MOST_RUNS)))
    unnamed = -1 - F.floor(F.col("unnamed") * none)
    if not seen["n"]:
        return unnamed.cast("long")
    anchors = sorted({seen["low"], seen["high"], *seen["anchors"]})
    pieces = len(anchors) - 1
    if not pieces:
        return F.when(F.col("doc_id").isNull(), unnamed).otherwise(0).cast("long")
    steps = max(1, round(min(seen["n"] / run_rows, MOST_RUNS) / pieces))
    at = F.array(*map(F.lit, anchors))
    piece = F.least(F.lit(pieces), F.size(F.filter(at, lambda a: a <= F.col("doc_id"))))
    low, high = F.get(at, piece - 1), F.get(at, piece)
    within = (F.col("doc_id") - low).cast("double") / (high - low).cast("double")
    step = F.least(F.lit(steps - 1), F.floor(within * steps))
    return F.when(F.col("doc_id").isNull(), unnamed).otherwise((piece - 1) * steps + step).cast("long")


def with_next(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(run, place, doc_id, text, next_text, ghost) of each document in descending doc_id, the last followed by the first.

    Documents are dealt to runs of neighbouring ids. The first document of each
    run is copied to the end of the run before it, as a ghost, so every document
    finds the next one within its run: texts are shuffled once. Documents without an
    id come last, in order of a hash of their texts; rows that share an id are in
    order of their texts.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("unnamed", _unnamed(F.col("doc_id"), F.col("text")))
    rows = rows.withColumn("run", _runs(rows, run_rows))
    firsts = rows.groupBy("run").agg(F.max("doc_id").alias("first_id"), F.min("unnamed").alias("first_unnamed"))
    order = Window.orderBy(F.desc("run"))  # one row a run
    ends = firsts.select(
        "first_id", "first_unnamed", F.coalesce(F.lag("run").over(order), F.min("run").over(Window.partitionBy())).alias("before")
    )
    # as many rows as there are runs
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("unnamed").eqNullSafe(F.col("first_unnamed"))
    ghosts = rows.drop("run").join(F.broadcast(ends), is_first).select("doc_id", "text", "unnamed", F.col("before").alias("run"), F.lit(True).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    along = Window.partitionBy("run").orderBy("ghost", F.desc_nulls_last("doc_id"), "unnamed", "text")
    return both.select(
        "run", F.row_number().over(along).alias("place"), "doc_id", "text", F.lead("text").over(along).alias("next_text"), "ghost"
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of a text replaced by the first as many code points of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprint_pairs(docs: DataFrame, run_rows: int = RUN_ROWS, samples: int = SAMPLES) -> DataFrame:
    """Signatures of each whole text and of its edited text, and likeness to the edited and to the next.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; one row for each row of ``docs``, repeated ones included. Null texts
    count as empty, and an empty text's fingerprint is empty; very long texts count
    whole. In a table of one document it follows itself; an empty table gives no
    rows. Further columns, whatever their names, are not read.
    """
    placed = with_next(docs, run_rows).withColumn("edited_text", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    keyed = placed.select(
        "run", "place", "doc_id", "ghost", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.explode(
            F.when(F.col("ghost"), F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("body")))).otherwise(
                F.array(
                    F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("body")),
                    F.struct(F.lit(True).alias("is_edited"), F.col("edited_text").alias("body")),
                )
            )
        ).alias("version"),
    ).select("run", "place", "doc_id", "ghost", "n_chars", "edited_sha256", "version.is_edited", "version.body")
    keys = ["run", "place", "doc_id", "ghost", "n_chars", "edited_sha256", "is_edited"]
    signed = signatures(keyed, keys, "body", samples)
    along = Window.partitionBy("run").orderBy("is_edited", "place")
    beside = Window.partitionBy("run").orderBy("place", "is_edited")
    return (
        signed.withColumn("next_signature", F.lead("signature").over(along))
        .withColumn("edited_signature", F.lead("signature").over(beside))
        .where(~F.col("is_edited") & ~F.col("ghost"))
        .select(
            "doc_id", "n_chars", "edited_sha256",
            as_text(F.col("signature")).alias("fingerprint"),
            as_text(F.col("edited_signature")).alias("edited_fingerprint"),
            likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
            likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
        )
    )
