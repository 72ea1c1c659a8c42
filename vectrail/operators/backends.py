"""The verbs encode, score, extract and generate over DataFrames, with pluggable back-ends.

The defaults are deterministic and made of built-in functions: hash vectors,
lexical coverage, patterns and templates. A back-end with a model of its own is a
function over pandas batches; it is built once in each Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.functions import vectors as V
from vectrail.operators import ranking as R

OUTPUTS = ("dense", "sparse", "multivector")


def encode(items: DataFrame, outputs: tuple[str, ...] = ("dense",), *, text: str = "text", instruction: str = "", dims: int = 64) -> DataFrame:
    """``items`` with the representations asked for, of the instruction and the text."""
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    body = F.concat(F.lit(instruction), F.coalesce(F.col(text), F.lit("")))
    out = items.withColumn("__tokens", X.alnum_tokens(body)).withColumn("__dense", X.hash_vector(body, dims))
    one_hot = lambda t: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: (b == X.hash_bucket(t, dims)).cast("double"))
    made = {
        "dense": V.unit(F.col("__dense")),
        "sparse": V.to_sparse(F.col("__dense")),
        "multivector": F.transform("__tokens", one_hot),
    }
    return out.withColumns({o: made[o] for o in outputs}).drop("__tokens", "__dense")


def score(queries: DataFrame, items: DataFrame, *, query: str = "query", text: str = "text", by: str = "query_id", item: str = "item_id", top: int = 10) -> DataFrame:
    """(query id, item id, score, rank from 0) by lexical coverage, best first, ties by id."""
    pairs = R.against(queries, items).withColumn("score", F.round(X.coverage(F.col(query), F.col(text)), 6))
    return R.top_k(pairs.select(by, item, "score"), [by], [F.desc("score"), F.asc(item)], top)


def extract(items: DataFrame, patterns: dict[str, str], *, text: str = "text") -> DataFrame:
    """``items`` with ``entities`` (start, end, label, text, score) found by patterns, and a null ``error``."""
    from vectrail.operators.spans import regex_spans

    return items.withColumn("entities", regex_spans(F.coalesce(F.col(text), F.lit("")), patterns)).withColumn(
        "error", F.lit(None).cast("struct<code:string,message:string>")
    )


def generate(items: DataFrame, template: str, *, most_tokens: int = 256) -> DataFrame:
    """``items`` with ``output``: the template with ``{column}`` filled in, cut at ``most_tokens`` words, and usage."""
    body: Column = F.lit(template)
    for name in items.columns:
        if "{" + name + "}" in template:
            body = F.replace(body, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    words = F.split(body, " ")
    return items.withColumn("output", F.array_join(F.slice(words, 1, most_tokens), " ")).withColumn(
        "finish_reason", F.when(F.size(words) > most_tokens, "length").otherwise("stop")
    )


def with_model(items: DataFrame, build: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows through a model: ``build()`` loads it in each worker, the result maps a pandas batch to one of ``schema``.

    A batch for which it raises is run again row by row; rows that fail give
    ``error`` where the schema has it, so one bad row never fails the job.
    """

    def run(batches: Iterator) -> Iterator:
        model = build()
        for batch in batches:
            try:
                yield model(batch)
            except Exception:
                parts = []
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    try:
                        parts.append(model(row))
                    except Exception as problem:
                        parts.append(row.assign(error=str(problem)))
                yield pd.concat(parts)

    return items.mapInPandas(run, schema)


def register_encoder(spark: SparkSession, name: str, build: Callable[[], Callable]) -> None:
    """A SQL function ``name(text)`` that gives vectors; ``build()`` loads the model once in a worker, it maps a list of texts to vectors."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())), dtype=object)

    spark.udf.register(name, F.pandas_udf(run, "array<double>"))


def register_extractor(spark: SparkSession, name: str, patterns: dict[str, str]) -> None:
    """A SQL table function ``name(text)`` that gives rows (start, end, label, match) of the patterns' matches."""

    class Extractor:
        def __init__(self):
            self.patterns = {k: re.compile(p) for k, p in patterns.items()}

        def eval(self, text: str):
            for label, pattern in self.patterns.items():
                for m in pattern.finditer(text or ""):
                    yield m.start(), m.end(), label, m.group()

    spark.udtf.register(name, F.udtf(Extractor, returnType="start long, end long, label string, match string"))


def rerank(pairs: DataFrame, scorer: Callable, *, by: tuple[str, ...] = ("query",), item: str = "doc", place: str = "place", top: int = 10) -> DataFrame:
    """The best ``top`` of each group of ``pairs`` by ``scorer(key, items)``, with ``score`` and ``rank`` from 0; ties keep their places."""
    return R.top_k(R.grouped_scores(pairs, scorer, by=by, item=item, place=place), list(by), [F.desc("score"), F.asc(place)], top)
