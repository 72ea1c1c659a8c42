"""Personal data: labelers vote on candidate spans, and a classifier learns from their votes.

Patterns find candidates of several kinds. Three labelers vote on each: one looks
at its shape (a stricter pattern), one looks parts of it up in gazetteers (top-level
domains, country codes, issuers, given names), one looks for words before it that
speak for its kind or for something else. Expectation-maximisation over the counts
of vote patterns estimates how far each labeler is to be trusted. A logistic span
classifier is fitted to the posteriors on features that no labeler votes by: the
kind, the word after, the characters on both sides, separators, length and place;
it decides on the candidates of the further kinds, also where labelers say nothing
or the wrong thing. Spans of the base kinds always stay.

Candidates are kept with the characters beside them, so texts are read once. What
reaches the driver are counts of patterns of votes and features, whose number is
bounded by the values that these have, however many spans there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.llm import spans
from vectrail.llm.weak_supervision import fit
from vectrail.session import checkpointed

#: Patterns find what the plain ones do: a class that may not precede is one that a
#: match would have begun in, unless the last match ended there (\G). Runs are
#: possessive where what follows is not in their class.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # a whole run, as the plain pattern finds it, of 16 digits or more
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
KINDS = (*BASE, *MORE)

#: What a candidate of sound shape looks like.
SHAPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}",
    "card": r"[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}",
    "phone": r"\+[1-9][0-9]{0,2}[\x20(.-].*[0-9]",
    "national_id": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "local_phone": r"\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}",
    "account": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}",
    "person": r".*\x20[A-Z][a-z]+\x20[A-Z][a-z]+",
}
#: Top-level domains, IBAN countries and given names that are known.
DOMAINS = (
    "com org net edu gov mil int info biz name io ai app dev co me tv cc eu uk de fr es it nl be at ch pt pl cz sk hu ro bg gr ie se no "
    "dk fi is ee lv lt ua ru tr il in cn jp kr au nz ca us mx br ar cl za example test"
).split()
IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD "
    "ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK"
).split()
NAMES = (
    "Ahmed Alice Amy Ana Andrea Andreas Andrew Angela Anna Anne Antonio Barbara Ben Bernd Brian Camille Carla Carlos Carmen Catherine "
    "Charles Charlotte Chloe Christian Christine Claire Claudia Daniel David Diego Dieter Elena Elizabeth Emily Emma Eric Eva Felix "
    "Fernando Francois Frank Gabriel George Hannah Hans Heinz Helen Helga Henry Ines Isabel Jack Jacques James Jane Javier Jean Jennifer "
    "Jens Jessica Joan John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karin Karl Katrin Kevin Klaus Laura Lea Linda Lisa Louis Luca "
    "Lucas Lucia Luis Manuel Marc Marco Maria Marie Mark Markus Martin Mary Matthew Max Michael Michel Miguel Mohammed Monika Nadia "
    "Nathalie Nicolas Nina Olga Oliver Olivia Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rachel Richard Robert Rosa Ruth "
    "Samuel Sandra Sarah Sergio Simon Sofia Sophie Stefan Stephanie Steven Susan Sven Sylvie Teresa Thomas Uwe Valerie Victor Walter "
    "William Wolfgang Yusuf"
).split()
GAZETTEERS = {
    "email": rf".*\.(?i:{'|'.join(DOMAINS)})",
    "ip": r"(?!0\.|127\.|22[4-9]\.|2[3-5][0-9]\.).*",
    "card": r"(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9]).*",
    # one-digit, two-digit and three-digit country codes
    "phone": r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])[^0-9].*",
    "account": rf"(?:{'|'.join(IBAN_COUNTRIES)}).*",
    "person": rf".*\x20(?:{'|'.join(NAMES)}).*",
}
#: Words that speak for a kind within ``CONTEXT`` characters before the span.
CONTEXT = 40
CUES = {
    "email": r"(?:e-?mail|contact|write|correo|courriel|kontakt)",
    "ip": r"(?:\bip\b|address|server|host|login|from)",
    "card": r"(?:card|visa|credit|payment|karte|tarjeta|carte)",
    "phone": r"(?:phone|tel|call|mobile|fax|contact)",
    "national_id": r"(?:ssn|social security|national id|tax)",
    "local_phone": r"(?:phone|tel|call|mobile|fax|contact)",
    "account": r"(?:iban|account|bank|konto|cuenta|compte)",
    "person": r"(?:name|contact|dear|from|signed)",
}
OTHER_CUES = r"(?:version|isbn|order no|invoice|serial|build|section|figure|chapter)\W*$"
LABELERS = ("shape", "gazetteer", "context")
PRIOR = 0.8
KEEP_FROM = 0.5
#: Buckets of the word after a span.
WORD_BUCKETS = 16


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    from_right = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(from_right, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column | None:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return None


CANDIDATE = "struct<rank:int,start:long,end:long,kind:string,match:string,before:string,after:string>"


def _apart_from_base(spans_by_start: Column) -> Column:
    """Spans (sorted by start) of base kinds, and those of further kinds that overlap none of them."""
    is_base = lambda c: c["rank"] < len(BASE)
    wide = f"struct<c:{CANDIDATE},low:long>"

    def after(rows: Column) -> Column:
        ends = lambda end, c: F.when(is_base(c), F.greatest(end, c["end"])).otherwise(end)
        return X.running(rows, F.lit(0).cast("long"), ends, lambda end, c: F.struct(c.alias("c"), end.alias("low")), wide)

    def ahead(rows: Column) -> Column:
        # from the last one back: the first start of a base span behind each
        starts = lambda start, x: F.when(is_base(x["c"]), x["c"]["start"]).otherwise(start)
        far = F.lit((1 << 62)).cast("long")
        whole = f"struct<c:{CANDIDATE},low:long,high:long>"
        return X.running(F.reverse(rows), far, starts, lambda start, x: F.struct(x["c"].alias("c"), x["low"].alias("low"), start.alias("high")), whole)

    placed = F.flatten(F.transform(F.array(after(spans_by_start)), ahead))
    kept = F.filter(placed, lambda x: is_base(x["c"]) | ((x["low"] <= x["c"]["start"]) & (x["high"] >= x["c"]["end"])))
    return F.transform(kept, lambda x: x["c"])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``cands``: (rank, start, end, kind, match, before, after) by kind, then start.

    Failing matches of the base kinds are dropped; one of a further kind that
    overlaps a base span is dropped. ``before`` and ``after`` are the characters
    beside it, lower-cased, up to the next match of its kind.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    located = spans.with_spans(rows, "text", BASE | MORE, context=CONTEXT)

    def kept(rank: int, kind: str) -> Column:
        found = F.col(kind)
        if _passes(kind, F.lit("")) is not None:
            found = F.filter(found, lambda s: _passes(kind, s["match"]))
        one = lambda s: F.struct(
            F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match"),
            F.lower(s["before"]).alias("before"), F.lower(s["after"]).alias("after"),
        )
        return F.transform(found, one)

    located = located.select("doc_id", F.concat(*(kept(i, k) for i, k in enumerate(KINDS))).alias("cands"))
    some_more = F.exists("cands", lambda c: c["rank"] >= len(BASE))
    in_order = F.transform(
        F.sort_array(F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c.alias("c")))), lambda x: x["c"]
    )
    apart = F.sort_array(_apart_from_base(in_order))
    return located.select("doc_id", F.when(some_more, apart).otherwise(F.col("cands")).cast(f"array<{CANDIDATE}>").alias("cands"))


def _by_kind(kind: Column, values: dict[str, Column], default: Column) -> Column:
    chain = None
    for k, v in values.items():
        chain = F.when(kind == k, v) if chain is None else chain.when(kind == k, v)
    return chain.otherwise(default)


def labeler_votes(c: Column) -> dict[str, Column]:
    """Votes of the labelers on a candidate: 1 personal, 0 not, -1 nothing."""
    fits = lambda table: {k: F.when(c["match"].rlike(f"^(?:{p})$"), 1).otherwise(0) for k, p in table.items()}
    cue = _by_kind(c["kind"], {k: F.when(c["before"].rlike(p), 1).otherwise(-1) for k, p in CUES.items()}, F.lit(-1))
    return {
        "shape": _by_kind(c["kind"], fits(SHAPES), F.lit(-1)),
        "gazetteer": _by_kind(c["kind"], fits(GAZETTEERS), F.lit(-1)),
        "context": F.when(c["before"].rlike(OTHER_CUES), 0).otherwise(cue),
    }


def own_features(c: Column) -> dict[str, Column]:
    """What the classifier sees of a candidate, each a small whole number; no labeler votes by these."""
    word = F.regexp_extract(c["after"], r"^[^\p{L}]*(\p{L}+)", 1)
    left, right = F.right(c["before"], F.lit(1)), F.left(c["after"], F.lit(1))
    match = c["match"]
    return {
        "word": F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS))).cast("int"),
        "left": F.when(left == "", 0).when(left.rlike(r"[\s]"), F.when(F.trim(c["before"]).rlike(r"[:=]$"), 2).otherwise(1)).otherwise(3),
        "right": F.when(right == "", 0).when(right.rlike(r"[\s.,;!?]"), 1).otherwise(2),
        "mark": F.when(match.rlike(r"\x20"), 1).when(match.rlike("-"), 2).when(match.rlike(r"[.(]"), 3).otherwise(0),
        "length": F.when(c["end"] - c["start"] < 11, 0).when(c["end"] - c["start"] < 16, 1).otherwise(2),
        "early": (c["start"] < 200).cast("int"),
    }


OWN = ("word", "left", "right", "mark", "length", "early")


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic regression over the kind and ``OWN`` features; weights by (feature, value)."""

    bias: float
    weights: dict[tuple[str, object], float]

    def probability(self, c: Column) -> Column:
        z = F.lit(self.bias) + _by_kind(c["kind"], {k: F.lit(self.weights.get(("kind", k), 0.0)) for k in KINDS}, F.lit(0.0))
        for name, value in own_features(c).items():
            known = sorted(v for f, v in self.weights if f == name)
            table = F.array(*(F.lit(self.weights.get((name, v), 0.0)) for v in range(max(known, default=0) + 1)))
            z = z + F.coalesce(F.get(table, value), F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_logistic(rows: list[tuple[tuple, float, float]], fields: tuple[str, ...], rounds: int = 300, ridge: float = 1e-3) -> SpanClassifier:
    """Classifier for rows of (values of the fields, target in 0..1, count), by gradient steps scaled by each weight's share."""
    names = sorted({(f, v) for values, *_ in rows for f, v in zip(fields, values, strict=True)}, key=str)
    index = {x: i + 1 for i, x in enumerate(names)}  # 0: the bias
    at = np.array([[0, *(index[x] for x in zip(fields, values, strict=True))] for values, *_ in rows], np.int64).reshape(len(rows), len(fields) + 1)
    y, n = np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows])
    n = n / max(n.sum(), 1.0)
    w = np.zeros(len(names) + 1)
    added = lambda x: np.bincount(at.ravel(), np.repeat(x, at.shape[1]), len(w))
    share = added(n) * at.shape[1]
    for _ in range(rounds if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(1), -60, 60)))
        w -= 4 * (added((p - y) * n) + ridge * w / len(w)) / (share + ridge)
    return SpanClassifier(float(w[0]), {x: float(w[i]) for x, i in index.items()})


def train(cands: DataFrame) -> SpanClassifier:
    """EM over the labelers' votes, then the classifier on its posteriors.

    Only counts of patterns leave Spark: of 8 kinds, 3 ** 3 votes and 17 * 4 * 3 * 4 * 3 * 2
    features, of which a corpus has some thousands.
    """
    c = F.col("c")
    rows = cands.select(F.explode("cands").alias("c")).select(
        c["kind"].alias("kind"), *(v.alias(n) for n, v in labeler_votes(c).items()), *(v.alias(n) for n, v in own_features(c).items())
    )
    counted = rows.groupBy("kind", *LABELERS, *OWN).agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[int, ...], int] = {}
    for r in counted:
        key = tuple(r[n] for n in LABELERS)
        patterns[key] = patterns.get(key, 0) + r["n"]
    model = fit(sorted(patterns.items()), list(LABELERS), PRIOR)
    fields = ("kind", *OWN)
    samples = [(tuple(r[f] for f in fields), model.posterior({n: r[n] for n in LABELERS}), r["n"]) for r in counted]
    return fit_logistic(sorted(samples), fields)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: (rank, start, end, kind, match, probability) by kind, then start.

    One row for each row of ``docs`` (doc_id, text), repeated ones and those without
    doc_id included; an empty table gives none. Null texts count as empty, very long
    ones are searched whole; offsets are code points, ends exclusive. Further
    columns, whatever their names, are not read.
    """
    held = checkpointed(candidates(docs))
    model = train(held)
    scored = F.transform(
        "cands",
        lambda c: F.struct(
            c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"),
            c["kind"].alias("kind"), c["match"].alias("match"), model.probability(c).alias("probability"),
        ),
    )
    return held.select("doc_id", scored.alias("scored")).select(
        "doc_id",
        F.filter("scored", lambda s: (s["rank"] < len(BASE)) | (s["probability"] >= KEEP_FROM)).alias("found"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base spans' SHA-256, and all spans."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(spans.listing(base), 256).alias("base_sha256"),
        spans.listing(F.col("found")).alias("spans"),
        F.coalesce(F.array_min(F.transform("found", lambda s: s["probability"])), F.lit(1.0)).alias("least_probability"),
    )
