"""Secret scans through a trigram inverted index.

Each rule's pattern gives a Boolean query over trigrams that its matches must
hold. An inverted index (trigram, document) of the trigrams in any query is built in
one pass over the texts; the postings of a clause's trigrams are intersected by
document, and only documents that meet a rule's query are searched for its
pattern. Rules that need no trigram (long hex runs) are searched for everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.llm import spans
from vectrail.llm.trigrams import clauses, trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` is both a Java and a Python one. A match counts if its ``group`` has ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def clauses(self) -> list[frozenset[str]] | None:
        return clauses(trigram_query(self.pattern))


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    # a whole run of hex digits, as [0-9a-f]+ finds it, of 24 or more
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
MORE = (
    # the whole block; of one without an end, its first line and the lines of digits below
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
        r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s++[A-Za-z0-9+/=]{16,}+)*+)",
    ),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


SPAN = "struct<start:long,rank:int,kind:string,end:long,match:string>"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with null texts empty and ``__key``, a hash of id and text that names a row in the index.

    Equal rows share an entry, and so may unlike ones by chance: the entry then names
    the rules of both, which are searched for in each.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("__body", text).withColumn("__key", F.xxhash64("doc_id", "__body"))


def trigram_index(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, __key) of the named trigrams in the lower-cased texts."""
    lowered = keyed.select("__key", F.lower("__body").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return lowered.select("__key", F.explode(held).alias("trigram"))


def candidates(keyed: DataFrame, rules=RULES) -> DataFrame:
    """(__key, kinds): for each entry of the index the rules whose trigram query its postings meet."""
    spark = keyed.sparkSession
    needed = [
        (rule.kind, f"{rule.kind}/{k}", t, 1 << i, (1 << len(clause)) - 1)
        for rule in rules
        for k, clause in enumerate(rule.clauses() or [])
        for i, t in enumerate(sorted(clause))
    ]
    rows = ", ".join(f"('{kind}', '{clause}', '{t}', {bit}L, {all_of}L)" for kind, clause, t, bit, all_of in needed)
    # as many rows as the rules' queries have trigrams
    terms = spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, clause, trigram, bit, all_of)")
    index = trigram_index(keyed, sorted({x[2] for x in needed}))
    met = (
        index.join(F.broadcast(terms), "trigram")
        .groupBy("__key", "kind", "clause", "all_of")
        .agg(F.bit_or("bit").alias("bits"))
        .where(F.col("bits") == F.col("all_of"))
    )
    return met.groupBy("__key").agg(F.collect_set("kind").alias("__kinds"))


def with_found(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with ``__body``, the text or an empty one, and ``__found``, an array of (start, rank, kind, end, match).

    Finds are sorted by start, then the rules' order; offsets are code points, ends
    exclusive.
    """
    keyed = _keyed(docs)
    joined = keyed.join(candidates(keyed.select("__key", "__body"), rules), "__key", "left")
    wanted = {
        r.kind: F.coalesce(F.array_contains("__kinds", r.kind), F.lit(False)) for r in rules if r.clauses() is not None
    }
    located = spans.with_spans(joined, "__body", {f"__{r.kind}": r.pattern for r in rules}, {f"__{k}": w for k, w in wanted.items()})

    def kept(rank: int, rule: Rule):
        found = F.col(f"__{rule.kind}")
        if rule.least:
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.group)) >= rule.least)
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                s["end"].alias("end"), s["match"].alias("match"),
            ),
        )

    every = F.sort_array(F.concat(*(kept(i, r) for i, r in enumerate(rules))))
    return located.withColumn("__found", every).select(*docs.columns, "__body", "__found")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and ``found``, an array of (start, rank, kind, end, match) by start, then the rules' order.

    One row for each row of ``docs`` (doc_id, text), repeated ones and those without
    doc_id included; an empty table gives none. Null texts count as empty, very long
    ones are searched whole. Offsets are code points, ends exclusive. Further
    columns, whatever their names, are not read.
    """
    return with_found(docs.select("doc_id", "text"), rules).select("doc_id", F.col("__found").alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base spans' SHA-256, and all spans, from ``scan``."""
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(spans.listing(base), 256).alias("base_sha256"),
        spans.listing(F.col("found")).alias("spans"),
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every find of ``scan`` in its texts replaced by ``[kind]``; columns and rows as they were.

    Finds that overlap are replaced as one, by the kind of the one that begins first,
    or that the rules name first. A text in which nothing is found, null included,
    stays as it is. ``n_chars`` follows the text. Equal rows come out equal, an empty
    table stays empty, and further columns are kept.
    """
    found = with_found(docs)
    joined = X.joined_spans(F.col("__found"), SPAN)
    clean = X.replaced(F.col("__body"), F.col("__joined"), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))
    some = F.size("__found") > 0
    cleaned = found.withColumn("__joined", F.when(some, joined)).withColumn("text", F.when(some, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)
