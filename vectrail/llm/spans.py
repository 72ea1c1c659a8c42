"""Offsets of all matches of a pattern, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions import text as X


def _in_context(found: Column, pieces: Column, context: int) -> Column:
    """As ``placed``, with up to ``context`` characters of the pieces on either side."""
    n = F.size(found)
    whole = F.transform(
        F.zip_with(found, F.slice(pieces, 1, n), lambda m, p: F.struct(m.alias("m"), p.alias("p"))),
        lambda x, i: F.struct(
            x["m"].alias("m"), F.length(x["p"]).alias("gap"), F.right(x["p"], F.lit(context)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(context)).alias("after"),
        ),
    )

    def span(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        return F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("end"), x["m"].alias("match"), x["before"], x["after"])

    kind = "struct<start:long,end:long,match:string,before:string,after:string>"
    return X.running(whole, F.lit(0).cast("long"), lambda at, x: at + x["gap"] + F.length(x["m"]), span, kind)


def with_spans(
    df: DataFrame, text: str, patterns: dict[str, str], only_if: dict[str, Column] | None = None, context: int = 0
) -> DataFrame:
    """``df`` with a column for each entry of ``patterns`` (name to Java pattern) that holds its matches in order.

    Matches are leftmost and do not overlap; patterns must not match the empty
    text. ``only_if`` names rows in which a pattern is looked for; elsewhere, and in
    null texts, there are no matches. The text is split at the matches; the lengths
    of the pieces and the matches give the offsets. With ``context`` each match has
    ``before`` and ``after``: so many characters beside it, up to the next match.
    """
    held = {n: f"__match_{n}" for n in patterns}
    cut = {n: f"__piece_{n}" for n in patterns}
    none = F.array().cast("array<string>")

    def found(name: str, pattern: str) -> Column:
        all_of = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        wanted = F.col(text).isNotNull()
        if only_if and name in only_if:
            wanted = wanted & only_if[name]
        return F.when(wanted, all_of).otherwise(none)

    df = df.withColumns({held[n]: found(n, p) for n, p in patterns.items()})
    df = df.withColumns(
        {cut[n]: F.when(F.size(held[n]) > 0, F.split(text, p, -1)).otherwise(none) for n, p in patterns.items()}
    )
    place = (lambda m, p: _in_context(m, p, context)) if context else X.placed
    offsets = {n: F.when(F.size(held[n]) > 0, place(F.col(held[n]), F.col(cut[n]))) for n in patterns}
    offsets = {n: F.coalesce(c, F.slice(place(F.array(F.lit("")), F.array(F.lit(""), F.lit(""))), 1, 0)) for n, c in offsets.items()}
    return df.withColumns(offsets).drop(*held.values(), *cut.values())


def listing(spans: Column) -> Column:
    """``kind:start:end`` of each element, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
