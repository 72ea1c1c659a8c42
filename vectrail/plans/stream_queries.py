"""Ordered chunks with attempts and times, blocks stripped from pieces, pages as structured documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.session import table
from vectrail.streaming import streams


def L(c):
    return c.cast("long")


#: A value from which an event is taken as its stream's last chunk.
DONE = 450


def _chunks(s, d):
    return table(s, d, "events").withColumn("k", L(F.get_json_object("props", "$.k")))


def attempt_chunks(s, d):
    """Chunks by user, events' types as attempts: stale if not of the first attempt seen, else as by their numbers; a last chunk is never dropped."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("event_type").over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = _chunks(s, d).withColumn("attempt", first).withColumn("current", F.col("event_type").eqNullSafe(F.col("attempt")))
    seen = F.max(F.when(F.col("current"), F.col("k"))).over(before)
    done = F.coalesce(F.col("value") >= DONE, F.lit(False))
    kind = F.when(~F.col("current"), "stale").when(seen.isNull(), "first").when((F.col("k") <= seen) & ~done, "dropped").when(F.col("k") > seen + 1, "gap").otherwise("ok")
    return own.select("event_id", kind.alias("kind"))


ATTEMPT_SQL = f"""WITH e AS (SELECT *, (props::JSON->>'$.k')::BIGINT AS k, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
w AS (SELECT *, max(CASE WHEN event_type = attempt THEN k END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
SELECT event_id, CASE WHEN event_type <> attempt THEN 'stale' WHEN seen IS NULL THEN 'first' WHEN k <= seen AND value < {DONE} THEN 'dropped' WHEN k > seen + 1 THEN 'gap' ELSE 'ok' END AS kind FROM w"""


def stream_timings(s, d):
    """By user, the first event as the request and the others as its tokens: seconds to the first, and from it to the last for each token."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    placed = _chunks(s, d).select("user_id", at.alias("at"), F.row_number().over(w).alias("n"))
    g = placed.groupBy("user_id").agg(F.count("*").alias("n"), F.min("at").alias("asked"), F.min(F.when(F.col("n") == 2, F.col("at"))).alias("first"), F.max("at").alias("last"))
    held = g.where("n > 1")
    return held.select("user_id", (F.col("n") - 1).alias("tokens"), F.round((F.col("first") - F.col("asked")) / 1e6, 3).alias("to_first"), F.round((F.col("last") - F.col("first")) / 1e6 / (F.col("n") - 1), 3).alias("a_token"))


TIMING_SQL = """WITH p AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT user_id, count(*) AS n, min(us) AS asked, min(CASE WHEN n = 2 THEN us END) AS first, max(us) AS last FROM p GROUP BY 1)
SELECT user_id, n - 1 AS tokens, round((first - asked) / 1e6::DOUBLE, 3) AS to_first, round((last - first) / 1e6::DOUBLE / (n - 1), 3) AS a_token FROM g WHERE n > 1"""

#: Marks added to turns by their number, so that they are cut across pieces.
AROUND = (("", "<th"), ("ink>", ""), ("", "</thin"), ("k>", "<"))


def stream_strip_blocks(s, d):
    """Conversations as pieces with marks that begin in one turn and end in another: what is shown of each conversation."""
    stream = streams.table_stream(s, d, "conversations", "conv_id bigint, turn bigint, role string, text string")
    pick = lambda i: F.get(F.array(*(F.lit(x[i]) for x in AROUND)), F.pmod("turn", F.lit(len(AROUND))).cast("int"))
    pieces = stream.withColumn("text", F.concat(pick(0), F.coalesce("text", F.lit("")), pick(1)))
    shown = streams.drain(streams.strip_blocks(pieces, "conv_id", "turn", "text"), "append")
    told = F.array_sort(F.collect_list(F.struct("item", "shown")))  # one conversation's turns
    return shown.groupBy(F.col("key").alias("conv_id")).agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(told, lambda x: x["shown"]), "")).alias("digest"))


_HALVES = "|".join(sorted({m[:n] for m in ("<think>", "</think>") for n in range(1, len(m))}, key=len, reverse=True))
STRIP_SQL = f"""WITH c AS (SELECT conv_id, turn, {[a for a, _ in AROUND]}[turn % 4 + 1] || coalesce(text, '') || {[b for _, b in AROUND]}[turn % 4 + 1] AS t FROM conversations),
j AS (SELECT conv_id, count(*) AS n, string_agg(t, '' ORDER BY turn) AS t FROM c GROUP BY 1),
o AS (SELECT conv_id, n, replace(regexp_replace(t, '<think>.*?(</think>|$)', '', 'gs'), '</think>', '') AS t FROM j)
SELECT conv_id, n, md5(regexp_replace(t, '({_HALVES})$', '')) AS digest FROM o"""

#: How markup becomes Markdown, in order: pattern and replacement (groups as ``$1``).
MARKDOWN = [
    (r"(?s)<!--.*?-->", ""), (r"(?s)<(script|style|head)[ >].*?</(script|style|head)>", ""), (r'(?s)<a href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"), (r"<li( [^>]*)?>", "\n- "),
    *((f"<h{n}( [^>]*)?>", "\n" + "#" * n + " ") for n in range(1, 7)), (r"<(p|br|div|tr)( [^>]*)?/?>", "\n"), (r"<[^>]*>", ""), (r"[ \t]+", " "), (r"\s*\n\s*", "\n"), (r"^\s+|\s+$", ""),
]
#: Parts of a page that are counted, by the markup that begins them.
PARTS = {"n_headings": "<h[1-6][ >]", "n_paragraphs": "<p[ >]", "n_links": "<a ", "n_items": "<li[ >]", "n_tables": "<table[ >]"}


def structured_pages(s, d):
    """Each page as a structured document: title, numbers of its parts, and its Markdown; a page without markup has an error and none of these."""
    html = F.coalesce("html", F.lit(""))
    bare = F.trim(html) == ""
    body = html
    for pattern, instead in MARKDOWN:
        body = F.regexp_replace(body, pattern, instead)
    counts = [L(F.regexp_count(html, F.lit(p))).alias(n) for n, p in PARTS.items()]
    title = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    read = table(s, d, "pages").select("page_id", title.alias("title"), *counts, X.once(body).alias("body"), F.when(bare, "empty document").alias("error"))
    return read.select("page_id", "title", *PARTS, L(F.length("body")).alias("n_chars"), F.md5("body").alias("digest"), "error")


def _structured_sql() -> str:
    body = "html"
    for pattern, instead in MARKDOWN:
        replaced = instead.replace("$1", "\\1").replace("$2", "\\2").replace("\n", "' || chr(10) || '")
        body = f"regexp_replace({body}, '{pattern}', '{replaced}', 'g')"
    counts = ", ".join(f"len(regexp_extract_all(html, '{p}')) AS {n}" for n, p in PARTS.items())
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT *, {body} AS body FROM p)
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, {counts}, length(body) AS n_chars, md5(body) AS digest, CASE WHEN trim(html) = '' THEN 'empty document' END AS error FROM m"""


QUERIES = {
    "attempt_chunks": (attempt_chunks, ATTEMPT_SQL),
    "stream_timings": (stream_timings, TIMING_SQL),
    "stream_strip_blocks": (stream_strip_blocks, STRIP_SQL),
    "structured_pages": (structured_pages, _structured_sql()),
}
