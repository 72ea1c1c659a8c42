"""Text expressions: windows, chunks, tokens, clean-up, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_windows(text: Column, window: int, overlap: int) -> Column:
    """(start, text) of windows of ``window`` characters that share ``overlap``.

    The last one is the first that reaches the end; blank texts have none.
    """
    if not 0 <= overlap < window:
        raise ValueError("the overlap must be smaller than the window")
    stride = window - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - window) / stride)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * stride).cast("long").alias("start"), F.substr(text, i * stride + 1, F.lit(window)).alias("text")),
    )
    return F.when(F.trim(text) == "", F.array().cast("array<struct<start:bigint,text:string>>")).otherwise(cut)


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def coverage(query: Column, text: Column, phrase_bonus: float = 0.35) -> Column:
    """Share of the query's distinct tokens that occur in the text, plus a bonus if the whole query does."""
    q = F.array_distinct(alnum_tokens(query))
    share = F.size(F.array_intersect(q, alnum_tokens(text))) / F.greatest(F.size(q), F.lit(1))
    return share + F.when(F.contains(F.lower(text), F.lower(query)), phrase_bonus).otherwise(0.0)


def hash_bucket(token: Column, dims: int = 64) -> Column:
    """Bucket of a token by its SHA-256; ``dims`` divides 256."""
    return (F.conv(F.substring(F.sha2(token, 256), 63, 2), 16, 10).cast("int") % dims).cast("int")


def hash_vector(text: Column, dims: int = 64) -> Column:
    """Token counts by bucket; zeros for a text without tokens."""
    buckets = F.transform(alnum_tokens(text), lambda t: hash_bucket(t, dims))
    count = lambda whole, b: (F.size(whole) - F.size(F.array_remove(whole, b))).cast("double")
    # elements of arrays of one are bound once
    counted = F.transform(F.array(buckets), lambda whole: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: count(whole, b)))
    return F.get(counted, F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a generator of one row: later filters and columns read it and never work it out again."""
    return F.explode(F.array(value))


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def plain_text(markup: Column) -> Column:
    """Links to their labels, citations and tags removed, common entities decoded, white space collapsed."""
    out = F.regexp_replace(markup, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"\(Citation:[^)]*\)", "")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def placeholder(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def token_estimate(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def mask_secret(text: Column) -> Column:
    """All but the last four characters starred; four or fewer wholly."""
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(4))))


def subtitle_time(seconds: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``; raises on negative or missing times."""
    ms = F.rint(seconds * 1000).cast("long")
    shown = F.format_string(
        f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000
    )
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.raise_error(F.lit("bad time"))).otherwise(shown)


def strip_fence(sql: Column) -> Column:
    """SQL out of a code fence or after a ``[SQL]`` mark, without the final semicolon."""
    out = F.regexp_replace(sql, r"(?i)```(?:sql)?", "")
    out = F.regexp_replace(out, r"(?i)^\s*\[SQL\]", "")
    return F.regexp_replace(F.regexp_replace(out, r";\s*$", ""), r"^\s+|\s+$", "")


def without_thinking(text: Column, tag: str = "think") -> Column:
    """Blocks between the tags removed; one that is not closed goes to the end."""
    return F.regexp_replace(text, rf"(?s)<{tag}>.*?(?:</{tag}>|$)", "")


def clock_minutes(text: Column) -> Column:
    """Minute of the day of the first twelve-hour time in a text, such as ``7:05 pm``; null if there is none."""
    found = F.regexp_extract(text, r"(?i)\b((?:0?[1-9]|1[0-2]):[0-5][0-9]) ?([AP])M\b", 0)
    hours, minutes = F.split(F.regexp_replace(found, "[^0-9:]", ""), ":")[0], F.right(F.regexp_replace(found, "[^0-9]", ""), F.lit(2))
    noon = F.when(F.upper(found).contains("P"), 720).otherwise(0)
    return F.when(found != "", hours.try_cast("int") % 12 * 60 + minutes.try_cast("int") + noon)


def distinct_paths(paths: Column, depth: int) -> Column:
    """Paths (arrays of names) cut to ``depth`` names, each once, in order of its first place; empty ones left out."""
    return F.array_distinct(F.filter(F.transform(paths, lambda p: F.slice(p, 1, depth)), lambda p: F.size(p) > 0))


def first_number(text: Column) -> Column:
    """The first decimal number, commas stripped."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def table_count(markdown: Column) -> Column:
    """Tables of a text: lines that begin with a bar and have a second one, each with a row of dashes below."""
    lines = F.split(markdown, "\r?\n")
    head = lambda a: F.rlike(a, F.lit(r"^[ \t]*\|.*\|"))
    dashes = lambda b: F.coalesce(F.contains(b, F.lit("-")) & F.rlike(b, F.lit(r"^\s*[-|: ]+\s*$")), F.lit(False))
    return F.size(F.filter(F.zip_with(lines, F.slice(lines, 2, 1 << 30), lambda a, b: dashes(b) & head(a)), lambda x: x))


#: Elements that ``running`` folds at once.
RUN = 256


def running(items: Column, start: Column, step, out, kind: str) -> Column:
    """``out(state, x)`` (of type ``kind``) of each element ``x`` with the state before it; ``step(state, x)`` gives the next.

    An array that grows in a fold is copied at each step, so elements are folded in
    runs: states at the runs' beginnings first, then each run by itself. The time
    grows with the elements, not with their square.
    """
    none = F.array().cast(f"array<{kind}>")

    def fold(begin: Column, run: Column) -> Column:
        grow = lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["o"], F.array(out(acc["s"], x).cast(kind))).alias("o"))
        return F.aggregate(run, F.struct(begin.alias("s"), none.alias("o")), grow, lambda acc: acc["o"])

    def begins(runs: Column) -> Column:
        grow = lambda acc, run: F.struct(F.aggregate(run, acc["s"], step).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o"))
        return F.aggregate(runs, F.struct(start.alias("s"), F.slice(F.array(start), 1, 0).alias("o")), grow, lambda acc: acc["o"])

    def cut(whole: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / RUN).cast("int"))
        return F.transform(at, lambda i: F.slice(whole, i * RUN + 1, F.lit(RUN)))

    # elements of arrays of one are bound once
    in_runs = F.transform(F.array(items), lambda whole: F.when(F.size(whole) > 0, cut(whole)))
    folded = F.transform(in_runs, lambda runs: F.flatten(F.zip_with(begins(runs), runs, fold)))
    return F.coalesce(F.get(folded, F.lit(0)), none)


MATCH = "struct<start:long,end:long,match:string>"


def placed(found: Column, pieces: Column) -> Column:
    """(start, end, match) of the matches ``found`` in a text that ``pieces`` are left of when it is split at them."""
    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))

    def span(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        return F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("end"), x["m"].alias("match"))

    return running(pairs, F.lit(0).cast("long"), lambda at, x: at + x["gap"] + F.length(x["m"]), span, MATCH)


def matches(text: Column, pattern: Column | str) -> Column:
    """(start, end, match) of every match, leftmost, without overlap; the pattern must not match the empty text.

    The text is split at the matches; the lengths of the pieces and the matches give the offsets.
    """
    return placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, F.lit(pattern), F.lit(-1)))


def joined_spans(spans: Column, kind: str) -> Column:
    """``spans`` (of type ``kind``, with start and end, sorted by start): those that overlap as one, the first's fields to the last end."""
    before = running(
        spans, F.lit(0).cast("long"), lambda end, x: F.greatest(end, x["end"]), lambda end, x: F.struct(x.alias("s"), end.alias("before")),
        f"struct<s:{kind},before:long>",
    )

    def join(rows: Column) -> Column:
        last = F.array_max(F.transform(rows, lambda x: x["s"]["end"]))
        first = F.filter(rows, lambda x: x["s"]["start"] >= x["before"])
        ends = lambda f: F.transform(f, lambda x, i: x["s"].withField("end", F.coalesce(F.get(f, i + 1)["before"], last)))
        return F.flatten(F.transform(F.array(first), ends))

    return F.flatten(F.transform(F.array(before), join))


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each of ``spans`` (sorted, without overlap) replaced by ``mark(span)``.

    A text is cut into stretches of ``RUN`` spans first, so a span's place is not
    looked for from the beginning of a long text.
    """

    def stretch(runs: Column, run: Column, k: Column) -> Column:
        begin = F.when(k > 0, F.element_at(F.get(runs, k - 1), -1)["end"]).otherwise(F.lit(0))
        body = F.substr(text, (begin + 1).cast("int"), (F.element_at(run, -1)["end"] - begin).cast("int"))

        def part(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(run, i - 1)["end"]).otherwise(begin)
            return lambda b: F.concat(F.substr(b, (at - begin + 1).cast("int"), (s["start"] - at).cast("int")), mark(s))

        return F.array_join(F.flatten(F.transform(F.array(body), lambda b: F.transform(run, lambda s, i: part(s, i)(b)))), "")

    at = lambda whole: F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / RUN).cast("int"))
    in_runs = F.transform(F.array(spans), lambda whole: F.transform(at(whole), lambda i: F.slice(whole, i * RUN + 1, F.lit(RUN))))
    done = F.transform(in_runs, lambda runs: F.array_join(F.transform(runs, lambda run, k: stretch(runs, run, k)), ""))
    tail = F.substr(text, (F.element_at(spans, -1)["end"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.get(done, F.lit(0)), tail)).otherwise(text)
