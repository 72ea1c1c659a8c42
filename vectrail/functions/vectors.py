"""Vector expressions over array columns; sums run in double, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length's positions."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + F.coalesce(x, F.lit(0.0)),
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, *, length: str = "lenient", zero: str = "zero") -> Column:
    """Cosine similarity under the policies in use.

    ``length``: ``lenient`` compares common positions, ``strict`` raises on unlike
    lengths, ``zero`` gives 0 for them and for empty vectors. ``zero``: a zero norm
    gives 0, or ``raise`` raises.
    """
    scale = norm(a) * norm(b)
    null_norm = F.raise_error(F.lit("vector with zero norm")).cast("double") if zero == "raise" else F.lit(0.0)
    value = F.when(scale == 0, null_norm).otherwise(dot(a, b) / scale)
    if length == "strict":
        return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unlike length")).cast("double")).otherwise(value)
    if length == "zero":
        return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(value)
    return value


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    n = norm(a)
    scale = F.when(n == 0, 1.0).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / scale)


def maxsim(query: Column, doc: Column, *, empty: str = "-inf") -> Column:
    """Late interaction: for each query vector its best inner product with the document's, summed.

    ``empty``: a document (or query) without vectors gives ``-inf``, ``0``, or ``raise``.
    """
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    nothing = {
        "-inf": F.lit(float("-inf")),
        "0": F.lit(0.0),
        "raise": F.raise_error(F.lit("multivector without vectors")).cast("double"),
    }[empty]
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), nothing).otherwise(total(best))


def quantize_int8(a: Column) -> Column:
    """Symmetric: rint(x / max|x| * 127); a zero row gives zeros."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top == 0, 1.0).otherwise(top)
    return F.transform(a, lambda x: F.rint(x.cast("double") / scale * 127).cast("tinyint"))


def quantize_uint8(a: Column, *, constant: int = 0) -> Column:
    """Linear over the row's range to 0..255; a constant row gives ``constant``."""
    low = F.array_min(a).cast("double")
    width = F.array_max(a).cast("double") - low
    return F.transform(
        a,
        lambda x: F.when(width == 0, constant).otherwise(F.rint((x.cast("double") - low) / width * 255)).cast("smallint"),
    )


def binary_text(a: Column) -> Column:
    """Bits of the signs, 1 above zero, as text; eight a byte from the left when packed."""
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def packed_binary(a: Column) -> Column:
    """The sign bits packed to bytes, padded with zeros at the end."""
    n = F.size(a)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / 8).cast("int")))
    byte = lambda k: F.lpad(F.conv(F.rpad(F.substr(binary_text(a), k * 8 + 1, F.lit(8)), 8, "0"), 2, 16), 2, "0")
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(starts, byte), ""))


def gray_bucket(bits: Column) -> Column:
    """Gray-coded bucket of a list of 0/1: g = (g << 1) + (bit xor (g & 1))."""
    return F.aggregate(
        bits,
        F.lit(0),
        lambda g, b: F.shiftleft(g, 1) + b.cast("int").bitwiseXOR(g.bitwiseAND(1)),
    )


def to_sparse(a: Column) -> Column:
    """(index, value) of the values above zero, ascending."""
    pairs = F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value")))
    return F.filter(pairs, lambda p: p["value"] > 0)


def log_saturation(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 where nothing is covered."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def even_indexes(count: int, total_of: Column) -> Column:
    """``count`` indexes spread evenly over 0 .. total - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * total_of / count).cast("int"))
