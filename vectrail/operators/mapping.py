"""Reports mapped to places: paragraph spans, mentions aligned by their contexts, boxes near a gap, fixed-length encodings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.functions import vectors as V

#: Two line ends or more, with blanks between them, part paragraphs.
BLANK_LINES = r"\r?\n[ \t]*\r?\n[ \t\r\n]*"
SPAN = "struct<start:long,end:long>"
#: Characters beside a mention that are compared with its context, at least.
BESIDE = 600
#: Boxes kept near a gap, and how much two boxes may share before they count as one.
MOST_NEAR, SAME_BOX = 6, 0.7
LEAST_OVERLAP = 0.25


def paragraph_spans(text: Column) -> Column:
    """(start, end) of the paragraphs, without the white space at their edges; blank ones are left out."""
    seps = X.matches(text, BLANK_LINES)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(seps, lambda m: m["end"]))

    def trimmed(piece: Column, start: Column) -> Column:
        lead = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        body = F.length(F.regexp_replace(F.regexp_replace(piece, r"^\s+", ""), r"\s+$", ""))
        return F.struct((start + lead).alias("start"), (start + lead + body).alias("end"))

    return F.filter(F.zip_with(F.split(text, BLANK_LINES, -1), starts, trimmed), lambda p: p["start"] < p["end"])


def report_spans(text: Column, most: int, overlap: int = 0) -> Column:
    """(start, end) of stretches of whole paragraphs of at most ``most`` characters together.

    A longer paragraph is cut every ``most`` characters. All but the first reach
    ``overlap`` characters further to the left. A text without a paragraph gives its
    first ``most`` characters; null gives null.
    """
    if most < 1 or not 0 <= overlap < most:
        raise ValueError("most must be positive and the overlap smaller")
    state = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("last"))

    def at(s: Column, p: Column) -> Column:
        fresh = s["at"].isNull() | (p["end"] - s["at"] > most)
        return F.when(p["end"] - p["start"] <= most, F.when(fresh, p["start"]).otherwise(s["at"]))

    step = lambda s, p: F.struct(at(s, p).alias("at"), p["end"].alias("last"))
    out = lambda s, p: F.struct(p["start"], p["end"], F.coalesce(at(s, p) == p["start"], F.lit(True)).alias("begins"), s["last"].alias("before"))
    told = X.running(paragraph_spans(text), state, step, out, "struct<start:long,end:long,begins:boolean,before:long>")

    def stretches(rows: Column) -> Column:
        last = F.array_max(F.transform(rows, lambda r: r["end"]))
        first = F.filter(rows, lambda r: r["begins"])
        whole = lambda f: F.transform(f, lambda r, i: F.struct(r["start"], F.coalesce(F.get(f, i + 1)["before"], last).alias("end")))
        return F.flatten(F.transform(F.array(first), whole))

    cut = lambda r: F.transform(F.sequence(r["start"], r["end"] - 1, F.lit(most).cast("long")), lambda a: F.struct(a.alias("start"), F.least(a + most, r["end"]).alias("end")))
    spans = F.flatten(F.transform(F.flatten(F.transform(F.array(told), stretches)), cut))
    wide = F.transform(spans, lambda r, i: F.struct(F.when(i > 0, F.greatest(F.lit(0).cast("long"), r["start"] - overlap)).otherwise(r["start"]).alias("start"), r["end"].alias("end")))
    none = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.least(F.length(text), F.lit(most)).cast("long").alias("end")))
    return F.when(text.isNotNull(), F.when(F.size(wide) > 0, wide.cast(f"array<{SPAN}>")).otherwise(none))


def _quoted(literal: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _words(text: Column) -> Column:
    """Words in lower case; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s ]+"), lambda w: w != "")


def _longest(words: Column, fits) -> Column:
    """The largest count of ``words`` from 1 on that ``fits``, else 0."""
    counts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(counts, fits)), F.lit(0))


def context_score(text: Column, start: Column, end: Column, left: Column, right: Column) -> Column:
    """(adjacent, words): how many of the two contexts lie whole beside a place, and how many of their words adjoin it."""
    width = lambda c: F.greatest(F.lit(BESIDE), F.length(F.coalesce(c, F.lit(""))) * 2)
    begin = F.greatest(F.lit(0), start - width(left))
    before = F.array_join(_words(F.substr(text, (begin + 1).cast("int"), (start - begin).cast("int"))), " ")
    after = F.array_join(_words(F.substr(text, (end + 1).cast("int"), width(right).cast("int"))), " ")
    lw, rw = _words(left), _words(right)
    nl = _longest(lw, lambda n: F.endswith(before, F.array_join(F.slice(lw, F.size(lw) - n + 1, n), " ")))
    nr = _longest(rw, lambda n: F.startswith(after, F.array_join(F.slice(rw, 1, n), " ")))
    whole = lambda n, w: ((F.size(w) > 0) & (n == F.size(w))).cast("int")
    return F.struct((whole(nl, lw) + whole(nr, rw)).alias("adjacent"), (nl + nr).alias("words"))


def align_mentions(docs: DataFrame, mentions: DataFrame, *, doc: str = "doc_id", key: str = "mention_id") -> DataFrame:
    """(key, doc, start, end, adjacent, words): each mention's place in its document whose contexts fit best, the first of equal ones.

    ``mentions`` has ``mention``, ``context_left`` and ``context_right``. Places are
    the exact ones; where there are none, those that differ in case or white space.
    A mention that is blank, or found nowhere, or whose document is missing or null,
    has null places.
    """
    mention = F.coalesce(F.col("mention"), F.lit(""))
    both = mentions.select(key, doc, "mention", "context_left", "context_right").join(docs.select(doc, "text"), doc, "left")
    flexible = F.concat(F.lit("(?iu)"), F.array_join(F.transform(F.filter(F.split(mention, r"\s+"), lambda w: w != ""), _quoted), r"\s+"))
    # a pattern that matches nothing stands for a blank mention
    blank = F.trim(F.regexp_replace(mention, r"\s", "")) == ""
    places = lambda p: X.matches(F.col("text"), F.when(blank, F.lit(r"(?!)")).otherwise(p))
    exact = both.withColumn("places", places(_quoted(mention)))
    found = exact.withColumn("places", F.when(F.size("places") > 0, F.col("places")).otherwise(places(flexible)))
    at = found.select(key, doc, "text", "context_left", "context_right", F.explode_outer("places").alias("p"))
    fit = context_score(F.col("text"), F.col("p.start"), F.col("p.end"), F.col("context_left"), F.col("context_right"))
    scored = at.select(key, doc, F.when(F.col("p").isNotNull(), F.struct(fit["adjacent"].alias("adjacent"), fit["words"].alias("words"), (-F.col("p.start")).alias("back"), F.col("p.end").alias("end"))).alias("x"))
    best = scored.groupBy(key, doc).agg(F.max("x").alias("x"))
    return best.select(key, doc, (-F.col("x.back")).alias("start"), F.col("x.end").alias("end"), F.col("x.adjacent").cast("long").alias("adjacent"), F.col("x.words").cast("long").alias("words"))


def shared_width(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two (left, width) as a share of the narrower; 0 if that has no width."""
    narrow = F.least(a[1], b[1])
    both = F.greatest(F.lit(0.0), F.least(a[0] + a[1], b[0] + b[1]) - F.greatest(a[0], b[0]))
    return F.when(narrow > 0, both / narrow).otherwise(0.0)


def near_gaps(objects: DataFrame, gaps: DataFrame, *, image: str, gap: str, item: str) -> DataFrame:
    """(image, gap, item, place): objects beside each gap of their image, best score first, at most ``MOST_NEAR``.

    Both sides have ``left``, ``top``, ``width``, ``height``; objects have ``score``.
    An object is near if it lies within a gap's height below it or a quarter above
    it and shares ``LEAST_OVERLAP`` of the narrower width. Of boxes that cover one
    another by ``SAME_BOX`` or more the better stays. Each place is one maximum over
    the gap's rows, so no group is gathered in memory.
    """
    sides = ("left", "top", "width", "height")
    g = gaps.select(image, gap, *(F.col(c).alias("g_" + c) for c in sides))
    o = objects.select(image, item, "score", *sides)
    band = (F.col("top") <= F.col("g_top") + 2 * F.col("g_height")) & (F.col("top") + F.col("height") >= F.col("g_top") - 0.25 * F.col("g_height"))
    wide = shared_width([F.col("g_left"), F.col("g_width")], [F.col("left"), F.col("width")]) >= LEAST_OVERLAP
    left = o.join(g, image).where(band & wide).withColumn("place", F.lit(None).cast("int"))
    corners = lambda x: [x("left"), x("top"), x("left") + x("width"), x("top") + x("height")]
    group = Window.partitionBy(image, gap)
    for place in range(MOST_NEAR):
        open_row = F.struct("score", (-F.col(item)).alias("tie"), *sides)
        left = left.withColumn("best", F.max(F.when(F.col("place").isNull(), open_row)).over(group))
        chosen = F.col("place").isNull() & (F.col(item) == -F.col("best.tie"))
        covered = V.iou(corners(F.col), corners(lambda c: F.col("best." + c))) >= SAME_BOX
        left = left.withColumn("place", F.when(chosen, place).otherwise(F.col("place")))
        left = left.where(F.col("place").isNotNull() | F.col("best").isNull() | ~covered)
    return left.where("place IS NOT NULL").select(image, gap, item, F.col("place").cast("long").alias("place"))


def gaussian_planes(dims: int, planes: int, seed: int) -> list[list[float]]:
    """``planes`` normals of ``dims`` independent Gaussian coordinates, as a seed gives them."""
    return np.random.default_rng(seed).normal(size=(dims, planes)).astype(np.float32).astype(float).T.tolist()


def sign_projection(dims: int, to: int, seed: int) -> list[list[float]]:
    """``to`` rows of random signs over the root of ``to``; inner products are kept in expectation."""
    return (np.random.default_rng(seed).choice([-1.0, 1.0], size=(to, dims)) / np.sqrt(to)).tolist()


def _literal(rows: list[list[float]]) -> Column:
    return F.array(*(F.lit(np.array(r)) for r in rows))


def simhash_bucket(vector: Column, planes: list[list[float]]) -> Column:
    """Gray-coded bucket of the sides of planes on which a vector lies."""
    return V.gray_bucket(F.transform(_literal(planes), lambda p: (V.dot(vector, p) > 0).cast("int")))


def fixed_encoding(
    vectors: DataFrame, *, item: str = "item", vector: str = "v", dims: int, planes: int = 3, to: int = 8, repetitions: int = 2,
    query: bool = False, centre: bool = False, unit: bool = False, seed: int = 0,
) -> DataFrame:
    """(item, fde): a multivector as one vector of ``repetitions * 2 ** planes * to`` numbers, whose inner products approximate late interaction.

    In each repetition the vectors of an item fall into buckets of their own planes,
    are projected to ``to`` numbers and summed (queries) or averaged (documents) by
    bucket; empty buckets hold zeros. ``centre`` takes an item's mean vector off
    first, ``unit`` divides by the norm. Null vectors do not count.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(item, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    if centre:
        mean = rows.groupBy(item).agg(F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(dims))).alias("mean"))
        rows = rows.join(mean, item).select(item, F.zip_with("v", "mean", lambda x, m: x - m).alias("v"))
    parts = []
    for r in range(repetitions):
        bucket = simhash_bucket(F.col("v"), gaussian_planes(dims, planes, seed + r)) + r * 2**planes
        shown = F.transform(_literal(sign_projection(dims, to, seed + 1000 + r)), lambda p: V.dot(F.col("v"), p))
        parts.append(F.struct(bucket.alias("bucket"), shown.alias("x")))
    flat = rows.select(item, F.inline(F.array(*parts)))
    total = F.sum if query else F.avg
    blocks = flat.groupBy(item, "bucket").agg(F.array(*(total(F.get("x", F.lit(i))) for i in range(to))).alias("x"))
    packed = blocks.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), to)
    fde = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repetitions * 2**planes - 1)), lambda b: F.coalesce(F.try_element_at("m", b), zeros)))
    return packed.select(item, (V.unit(fde) if unit else fde).alias("fde"))

