"""Quality rules that vote, weighed by their estimated accuracies.

Each rule of thumb says good (1), bad (0) or nothing (-1) of a document. Instead of
dropping what fails any rule, expectation-maximisation over the vote patterns
estimates how far each rule can be trusted, and a document is kept by its posterior
probability of being good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.text import WORD
from vectrail.llm.weak_supervision import VoteModel, fit, pattern_counts
from vectrail.session import checkpointed

WINDOW = 5
#: Share of good documents that EM starts from.
PRIOR = 0.85
KEEP_FROM = 0.5


def _repeated_words(windows: str, length: int) -> Column:
    """Words that windows occurring twice or more cover, from the array of window hashes.

    Most texts repeat nothing and are done once a set of the hashes is as large as
    their array. Else windows are sorted by hash, those beside an equal one are
    sorted by place, and each adds the words up to the next, ``length`` at most.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.transform(
        F.filter(
            F.transform(
                s,
                lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (
                        F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                    ).alias("twice"),
                ),
            ),
            lambda x: x["twice"],
        ),
        lambda x: x["i"],
    )
    # the sorted arrays are bound once, as elements of arrays of one
    places = F.flatten(F.transform(F.array(placed), lambda s: F.sort_array(again(s))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-length).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(length), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of each whole text; a null text has no words.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for the votes
    n_chars, n_lines, n_upper, n_letters, n_digits, n_marks, n_distinct_words.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    base = base.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    n = F.size("hashes")
    spans = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW)))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("windows", spans)
    count = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]+", "")).cast("long")
    return base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("windows", WINDOW).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{L}").alias("n_letters"),
        count(r"0-9").alias("n_digits"),
        count(r"!?.,;:").alias("n_marks"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), -1).when(bad, 0).when(good, 1).otherwise(-1)


def votes() -> dict[str, Column]:
    """Each rule's vote from the columns of ``text_stats``: 1 good, 0 bad, -1 nothing."""
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    chars = F.nullif(F.col("word_chars"), F.lit(0)).cast("double")
    lines = F.nullif(F.col("n_lines"), F.lit(0)).cast("double")
    length, variety = F.col("word_chars") / words, F.col("n_distinct_words") / words
    symbols, dense = F.col("n_symbols") / words, F.col("n_symbols") / chars
    upper, digits = F.col("n_upper") / chars, F.col("n_digits") / chars
    letters = (F.col("n_letters") + F.col("n_digits")) / chars
    repeated, again = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    marks = F.col("n_marks") / words
    return {
        "vote_size": F.when(F.col("n_words") < 10, 0).when(F.col("n_words") >= 50, 1).otherwise(-1),
        "vote_word_length": _vote(length, length.between(4, 8), ~length.between(2.2, 13)),
        "vote_symbols": _vote(symbols, symbols == 0, symbols > 0.15),
        "vote_symbol_share": _vote(dense, dense == 0, dense > 0.04),
        "vote_letters": _vote(letters, letters > 0.95, letters < 0.85),
        "vote_upper": _vote(upper, upper < 0.06, upper > 0.4),
        "vote_digits": _vote(digits, digits == 0, digits > 0.3),
        "vote_repeats": _vote(repeated, repeated == 0, repeated > 0.2),
        "vote_lines": _vote(again, again == 0, again > 0.3),
        "vote_variety": F.when(words < 100, -1).otherwise(_vote(variety, variety > 0.4, variety < 0.05)),
        "vote_marks": _vote(marks, marks.between(0.05, 0.3), marks > 0.9),
    }


def judge(stats: DataFrame, model: VoteModel) -> DataFrame:
    """``stats`` with base_failed, quality (the posterior) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "quality": model.score(votes())}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)
    )


def fit_rules(stats: DataFrame) -> VoteModel:
    rules = votes()
    return fit(pattern_counts(stats.select(*(v.alias(n) for n, v in rules.items())), list(rules)), list(rules), PRIOR)


def score_quality(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, quality and kept for each row of ``docs``, repeated rows included.

    The rules are weighed on all of ``docs``. Texts are read once: the statistics
    are kept and the texts are not.
    """
    stats = checkpointed(text_stats(docs))
    return judge(stats, fit_rules(stats))
