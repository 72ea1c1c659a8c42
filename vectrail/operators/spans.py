"""Span algebra: greedy selection, redaction, packing of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import text as X

SPAN = "array<struct<start:bigint,end:bigint,label:string,text:string,score:double>>"


def select_spans(spans: Column, least: float = 0.3) -> Column:
    """Spans of at least this score, best first (then the earlier, then as listed), each kept if it overlaps none kept; by start."""
    good = F.filter(spans, lambda s: s["score"] >= least)
    ordered = F.transform(
        F.sort_array(F.transform(good, lambda s, i: F.struct((-s["score"]).alias("k"), s["start"].alias("at"), i.alias("i"), s.alias("s")))),
        lambda x: x["s"],
    )
    kept = F.aggregate(
        ordered.cast(SPAN),
        F.array().cast(SPAN),
        lambda acc, s: F.when(
            F.exists(acc, lambda k: (k["start"] < s["end"]) & (k["end"] > s["start"])), acc
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_sort(kept)


def redact(text: Column, spans: Column) -> Column:
    """Text with each of the selected ``spans`` replaced by ``[LABEL_n]``; equal (label, text) share a number."""
    marks = F.transform(spans, lambda s: F.concat(s["label"], F.lit("\x00"), s["text"]))
    of_label = lambda s: F.array_distinct(
        F.filter(marks, lambda m: F.startswith(m, F.concat(s["label"], F.lit("\x00"))))
    )
    number = lambda s: F.array_position(of_label(s), F.concat(s["label"], F.lit("\x00"), s["text"]))
    mark = lambda s: F.concat(F.lit("["), F.upper(s["label"]), F.lit("_"), number(s).cast("string"), F.lit("]"))
    return X.replaced(text, spans, mark)


def regex_spans(text: Column, patterns: dict[str, str]) -> Column:
    """Spans of every match of each pattern, at its own place, with score 1; a simple detector for redaction."""
    spans = lambda label, pattern: F.transform(
        X.matches(text, pattern),
        lambda m: F.struct(m["start"], m["end"], F.lit(label).alias("label"), m["match"].alias("text"), F.lit(1.0).alias("score")),
    )
    return F.concat(*(spans(label, pattern) for label, pattern in patterns.items()))


def pack_paragraphs(text: Column, most: int) -> Column:
    """Stripped paragraphs packed, a blank line between them, up to ``most`` characters; longer ones are cut hard."""
    stripped = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    pieces = F.flatten(
        F.transform(
            stripped,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substr(p, i * most + 1, F.lit(most))
            ),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = F.length(joined) <= most
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open"))
        )

    done = F.aggregate(pieces, start, step)
    return F.when(done["open"] == "", done["done"]).otherwise(F.concat(done["done"], F.array(done["open"])))


def pack_clauses(text: Column, target: int = 900) -> Column:
    """Passages of a contract of about ``target`` characters.

    Paragraphs, or lines where there are fewer than three, are packed in order while
    they fit, a blank line between them; a passage of over 1.6 times the target gives
    pieces of the target's length until the rest is no longer than that.
    """
    kept = lambda parts: F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    paragraphs = kept(F.split(plain, r"\n\s*\n"))
    blocks = F.when(F.size(paragraphs) < 3, kept(F.split(plain, "\n"))).otherwise(paragraphs)

    def step(acc: Column, block: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(block) + 2 > target)
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        grown = F.when(full | (acc["open"] == ""), block).otherwise(F.concat(acc["open"], F.lit("\n\n"), block))
        return F.struct(done.alias("done"), grown.alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    packed = F.aggregate(blocks, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda p: p != ""))

    def cut(passage: Column) -> Column:
        cuts = F.greatest(F.lit(0), F.ceil(F.length(passage) / target - 1.6)).cast("int")
        piece = lambda i: F.substr(passage, i * target + 1, F.when(i < cuts, target).otherwise(F.length(passage)))
        return F.transform(F.sequence(F.lit(0), cuts), piece)

    return F.flatten(F.transform(packed, cut))


def greedy_interval_match(pred: DataFrame, gold: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """One-to-one matches: predictions in order of start claim the unmatched gold span that they overlap most.

    Both have ``keys``, id, start and end. Only pairs of equal keys that overlap are
    made. They are dealt by key to partitions and sorted there (with spills); a task
    reads them in that order, many keys a batch, and keeps what one key has claimed.
    ``parts`` is the number of partitions, else Spark's own.
    """
    deal = [*keys] if parts is None else [parts, *keys]
    p = pred.select(*keys, F.col("id").alias("pred_id"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    g = gold.select(*keys, F.col("id").alias("gold_id"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    if parts is not None:
        p, g = p.repartition(*deal), g.repartition(*deal)  # so the pairs are where they are read, and dealt once
    pairs = p.join(g, keys).withColumn("overlap", F.least("pe", "ge") - F.greatest("ps", "gs")).where("overlap > 0")
    schema = pairs.schema
    # an id's first start; the order of equal ones is stated to the last column
    placed = pairs.withColumn("__first", F.min("ps").over(Window.partitionBy(*keys, "pred_id")))
    order = [*keys, "__first", "pred_id", F.desc("overlap"), "gold_id", "ps", "pe", "gs", "ge"]

    def run(batches):
        import pyarrow as pa

        now, claimed, used = None, set(), set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "pred_id", "gold_id")]
            kept = []
            for i, (*key, one, other) in enumerate(zip(*columns, strict=True)):
                if key != now:
                    now, claimed, used = key, set(), set()
                if one not in claimed and other not in used:
                    claimed.add(one)
                    used.add(other)
                    kept.append(i)
            yield batch.select(schema.names).take(pa.array(kept, pa.int64()))

    return placed.repartition(*deal).sortWithinPartitions(*order).mapInArrow(run, schema)
