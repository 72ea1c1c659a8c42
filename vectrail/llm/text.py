"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, as every operator here counts them.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))
