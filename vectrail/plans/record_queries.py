"""JSON records, ordered event policies, label scores, and reductions of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.plans.text_queries import CHUNK_SQL, chunks
from vectrail.session import checkpointed, table

#: Summaries that one further summary takes.
FAN_IN = 12
#: A segment ends at a sentence's end, or once it spans so many seconds.
SEGMENT_SECONDS, WORD_SECONDS = 30.0, 0.5
BREAK_AFTER = 3
HIGH, LOW = 0.9, 0.7
MOST_OFFENSES = 50
LABELS = ("the", "a", "with")


def L(c):
    return c.cast("long")


def json_pointer(json: Column, pointer: str) -> Column:
    """The text at a pointer such as ``/a/0/b~1c`` (``~1`` is a slash, ``~0`` a tilde); null where it leads nowhere."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer is empty or begins with a slash")
    path = "$"
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        path += f"[{name}]" if name.isdigit() else f"['{name}']"
    return F.get_json_object(json, path)


def pointer_values(s, d):
    return table(s, d, "events").select("event_id", json_pointer(F.col("props"), "/k").alias("k"), json_pointer(F.col("props"), "/none/0").alias("missing"))


def json_object_from_text(text: Column) -> Column:
    """From the first opening brace to the last closing one; null if that is no JSON object."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def json_from_text(s, d):
    """Objects taken out of fenced answers; a truncated one gives nothing."""
    whole = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```"))
    cut = F.when(F.col("event_type") == "signup", F.replace(whole, F.lit("}"), F.lit(""))).otherwise(whole)
    return table(s, d, "events").select("event_id", F.get_json_object(json_object_from_text(cut), "$.k").alias("k"))


def lenient_json(s, d):
    """Tags are stripped; what then parses is taken, the rest is kept as ``raw``."""
    made = F.concat(F.lit("<s_doc>"), F.when(F.col("value") < 50, F.col("props")).otherwise(F.col("event_type")), F.lit("</s_doc>"))
    bare = F.regexp_replace(made, "<[^>]*>", "")
    parsed = F.try_parse_json(bare).isNotNull()
    return table(s, d, "events").select(
        "event_id", F.when(parsed, F.get_json_object(bare, "$.k")).alias("k"), F.when(~parsed, bare).alias("raw")
    )


def structured_verdicts(s, d):
    """Records against a schema: fields present, of their type, in their range; counted by verdict."""
    made = F.when(F.col("event_type") == "signup", F.lit('{"k": "many"}')).when(F.col("event_type") == "click", F.lit("{}")).otherwise(F.col("props"))
    r = F.from_json(made, "k bigint, bad string", {"columnNameOfCorruptRecord": "bad"})
    verdict = F.when(r["bad"].isNotNull(), "type").when(r["k"].isNull(), "required").when(r["k"] < 0, "range").otherwise("ok")
    return table(s, d, "events").groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def config_keys(s, d):
    """One key for equal maps, whatever their order: entries sorted, as JSON, hashed."""
    m = F.map_from_arrays(F.array(F.lit("verb"), F.lit("k")), F.array("event_type", F.get_json_object("props", "$.k")))
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return table(s, d, "events").select("event_id", F.md5(key).alias("config_key"))


def float32_base64(vectors: Column) -> Column:
    """Little-endian float32 bytes of a vector in base64."""

    @F.pandas_udf("binary")
    def raw(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else x.astype("<f4").tobytes())

    return F.regexp_replace(F.base64(raw(vectors)), r"\s", "")


def base64_vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", float32_base64(F.col("embedding").cast("array<double>")).alias("encoded"))


def html_unescaped(text: Column) -> Column:
    """Character references resolved, white space collapsed, case folded."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        from html import unescape

        return texts.map(lambda t: None if t is None else " ".join(unescape(t).split()).casefold())

    return fold(text)


def html_unescape(s, d):
    return table(s, d, "pages").select("page_id", F.md5(html_unescaped(F.col("html"))).alias("digest"))


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, segment, start, end, n_words) of words spoken at a steady pace; blank texts have none."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                n, first = 0, 0
                words = (text or "").split()
                for i, word in enumerate(words):
                    spoken = (i + 1 - first) * WORD_SECONDS
                    if word[-1] in ".?!" or spoken >= SEGMENT_SECONDS or i + 1 == len(words):
                        out.append((doc_id, n, first * WORD_SECONDS, (i + 1) * WORD_SECONDS, i + 1 - first))
                        n, first = n + 1, i + 1
            yield pd.DataFrame(out, columns=["doc_id", "segment", "start", "end", "n_words"])

    return docs.select("doc_id", "text").mapInPandas(fold, "doc_id long, segment long, start double, end double, n_words long")


def word_segments(s, d):
    return segments(table(s, d, "documents"))


def saturation_latch(s, d):
    """On at HIGH or more, off at LOW or less, else as it was: the last level that decided."""
    level = F.col("value") / F.max("value").over(Window.partitionBy("user_id"))
    decided = F.when(F.col("level") >= HIGH, True).when(F.col("level") <= LOW, False)
    along = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(s, d, "events").select("event_id", "user_id", "ts", level.alias("level"))
    return e.select("event_id", F.coalesce(F.last(decided, ignorenulls=True).over(along), F.lit(False)).alias("saturated"))


LATCH_SQL = f"""WITH e AS (SELECT event_id, user_id, ts, value / max(value) OVER (PARTITION BY user_id) AS level FROM events),
x AS (SELECT *, CASE WHEN level >= {HIGH} THEN 1 WHEN level <= {LOW} THEN 0 END AS decided FROM e)
SELECT event_id, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS saturated FROM x"""


def circuit_breaker(s, d):
    """Failures in a row by user, any success resets; open from the third on."""
    failed = F.col("event_type") == "error"
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").select("event_id", "user_id", "ts", failed.alias("failed")).withColumn("run", F.sum((~F.col("failed")).cast("int")).over(along))
    within = Window.partitionBy("user_id", "run").orderBy("ts", "event_id")
    streak = F.sum(F.col("failed").cast("int")).over(within)
    return e.select("event_id", L(streak).alias("failures"), (streak >= BREAK_AFTER).alias("open"))


BREAKER_SQL = f"""WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
f AS (SELECT event_id, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM e) SELECT event_id, failures, failures >= {BREAK_AFTER} AS open FROM f"""


def sse_payloads(s, d):
    """Payloads of a conversation's lines: data lines alone, up to the first that says it is done."""
    line = F.when(F.col("turn") == 5, "data: [DONE]").when(F.col("role") == "user", F.concat(F.lit(": "), "text")).otherwise(F.concat(F.lit("data: "), "text"))
    c = table(s, d, "conversations").select("conv_id", "turn", line.alias("line"))
    c = c.withColumn("done_at", F.min(F.when(F.col("line") == "data: [DONE]", F.col("turn"))).over(Window.partitionBy("conv_id")))
    kept = c.where(F.col("line").startswith("data:") & (F.col("done_at").isNull() | (F.col("turn") < F.col("done_at"))))
    return kept.select("conv_id", "turn", F.md5(F.regexp_replace("line", "^data: ?", "")).alias("payload"))


SSE_SQL = """WITH m AS (SELECT conv_id, min(turn) AS done_at FROM conversations WHERE turn = 5 GROUP BY 1)
SELECT c.conv_id, turn, md5(text) AS payload FROM conversations c LEFT JOIN m USING (conv_id) WHERE role <> 'user' AND turn <> 5 AND (done_at IS NULL OR turn < done_at)"""


def recent_offenses(s, d):
    """The newest offenses of each user, at most MOST_OFFENSES, and how many they are."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(s, d, "events").where("value > 100").select("user_id", "ts", "event_id", "value", F.row_number().over(newest).alias("n"))
    return e.where(F.col("n") <= MOST_OFFENSES).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.round(F.max("value"), 6).alias("worst"))


def dead_letters(s, d):
    """Rejected events of the last 24 hours, with the reason."""
    why = F.when(F.col("user_id").isNull(), "no user").when(F.col("value") > 200, "value").when(F.length("props") == 0, "props")
    e = table(s, d, "events").withColumn("reason", why)
    newest = table(s, d, "events").agg(F.max("ts").alias("newest"))  # one row
    kept = e.where("reason IS NOT NULL").join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("INTERVAL 24 HOURS"))
    return kept.select("event_id", "reason")


def label_softmax(s, d):
    """Every text against every label: the label's share of words as a logit, softmax over labels."""
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    t = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", toks.alias("toks"))
    share = lambda x: F.size(F.filter("toks", lambda w: w == x)) / F.greatest(F.size("toks"), F.lit(1)).cast("double")
    scored = t.select("doc_id", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), (share(x) * 10).alias("logit")) for x in LABELS))).alias("x"))
    p = F.exp("x.logit") / F.sum(F.exp("x.logit")).over(Window.partitionBy("doc_id"))
    return scored.select("doc_id", F.col("x.label").alias("label"), F.round(p, 6).alias("score"))


SOFTMAX_SQL = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, label, exp(len(list_filter(toks, lambda w: w = label))::DOUBLE / greatest(len(toks), 1) * 10) AS e FROM t, (VALUES {", ".join(f"('{x}')" for x in LABELS)}) v(label))
SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS score FROM s"""


def hierarchical_summary(s, d):
    """A digest of each chunk, then of every FAN_IN digests in order, until a document has one.

    A generator stands where the digest is. Each round is one grouping by
    (document, place / FAN_IN), so no group is larger than FAN_IN.
    """
    level = chunks(table(s, d, "documents")).select("doc_id", F.col("chunk_ix").alias("pos"), F.md5("chunk").alias("summary"))
    level = checkpointed(level.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))))
    most = level.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        joined = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "summary"))), lambda x: x["summary"]), "\n"))
        merged = level.groupBy("doc_id", L(F.floor(F.col("pos") / FAN_IN)).alias("pos"), "n").agg(F.first("summary").alias("only"), joined.alias("merged"))
        level = merged.select("doc_id", "pos", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("merged")).alias("summary"), F.ceil(F.col("n") / FAN_IN).alias("n"))
        most = -(-most // FAN_IN)
    return level.select("doc_id", "summary")


def _summary_sql(rounds: int = 4) -> str:
    """``rounds`` levels serve texts of FAN_IN ** rounds chunks; a document that has one digest keeps it."""
    out = f"WITH {CHUNK_SQL}, l0 AS (SELECT doc_id, chunk_ix AS pos, md5(chunk) AS summary, count(*) OVER (PARTITION BY doc_id) AS n FROM c)"
    for k in range(rounds):
        out += (
            f", l{k + 1} AS (SELECT doc_id, pos // {FAN_IN} AS pos, CASE WHEN n = 1 THEN min(summary) ELSE md5(string_agg(summary, chr(10) ORDER BY pos)) END AS summary,"
            f" CAST(ceil(n / {FAN_IN}.0) AS BIGINT) AS n FROM l{k} t GROUP BY doc_id, t.pos // {FAN_IN}, n)"
        )
    return out + f" SELECT doc_id, summary FROM l{rounds}"


def muvera_partitions(s, d):
    """Vectors of an item (their label) by the signs of three axes: the mean of each place."""
    e = table(s, d, "embeddings").select("label", F.col("embedding").alias("v"))
    bucket = sum((F.get("v", F.lit(i)) > 0).cast("long") * (1 << i) for i in range(3))
    flat = e.select("label", bucket.alias("bucket"), F.posexplode("v").alias("pos", "x"))
    return flat.groupBy("label", "bucket", "pos").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 5).alias("mean")).withColumn("pos", L(F.col("pos")))


MUVERA_SQL = """WITH e AS (SELECT label, embedding AS v, (v[1] > 0)::BIGINT + 2 * (v[2] > 0)::BIGINT + 4 * (v[3] > 0)::BIGINT AS bucket FROM embeddings),
f AS (SELECT label, bucket, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) SELECT label, bucket, pos, count(*) AS n, round(avg(x::DOUBLE), 5) AS mean FROM f GROUP BY 1, 2, 3"""


def action_gate(s, d):
    """Novelty of an event for its user, one over one more than how often the verb was seen; recorded from a half on."""
    seen = F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = table(s, d, "events").select("event_id", F.round(1 / (1 + seen), 6).alias("score"))
    return e.where("score >= 0.5").select("event_id", "score", F.when(F.col("score") == 1, "review").otherwise("watch").alias("verdict"))


QUERIES = {
    "json_pointer": (pointer_values, "SELECT event_id, json_extract_string(props, '/k') AS k, json_extract_string(props, '/none/0') AS missing FROM events"),
    "json_from_text": (json_from_text, "SELECT event_id, CASE WHEN event_type <> 'signup' THEN props::JSON->>'$.k' END AS k FROM events"),
    "lenient_json": (lenient_json, "SELECT event_id, CASE WHEN value < 50 THEN props::JSON->>'$.k' END AS k, CASE WHEN value >= 50 THEN event_type END AS raw FROM events"),
    "structured_verdicts": (structured_verdicts, "SELECT event_type, CASE event_type WHEN 'signup' THEN 'type' WHEN 'click' THEN 'required' ELSE CASE WHEN (props::JSON->>'$.k')::BIGINT < 0 THEN 'range' ELSE 'ok' END END AS verdict, count(*) AS n FROM events GROUP BY 1, 2"),
    "config_keys": (config_keys, """SELECT event_id, md5('{"k":"' || (props::JSON->>'$.k') || '","verb":"' || event_type || '"}') AS config_key FROM events"""),
    "base64_vectors": (base64_vectors, None),
    "html_unescape": (html_unescape, None),
    "word_segments": (word_segments, None),
    "saturation_latch": (saturation_latch, LATCH_SQL),
    "circuit_breaker": (circuit_breaker, BREAKER_SQL),
    "sse_payloads": (sse_payloads, SSE_SQL),
    "recent_offenses": (recent_offenses, f"SELECT user_id, count(*) AS n, max(event_id) AS last_id, round(max(value), 6) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 100) WHERE r <= {MOST_OFFENSES} GROUP BY 1"),
    "dead_letters": (dead_letters, "SELECT event_id, CASE WHEN user_id IS NULL THEN 'no user' WHEN value > 200 THEN 'value' ELSE 'props' END AS reason FROM events WHERE (user_id IS NULL OR value > 200 OR length(props) = 0) AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS"),
    "label_softmax": (label_softmax, SOFTMAX_SQL),
    "hierarchical_summary": (hierarchical_summary, _summary_sql()),
    "muvera_partitions": (muvera_partitions, MUVERA_SQL),
    "action_gate": (action_gate, "WITH e AS (SELECT event_id, round(1.0::DOUBLE / (1 + count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 6) AS score FROM events) SELECT event_id, score, CASE WHEN score = 1 THEN 'review' ELSE 'watch' END AS verdict FROM e WHERE score >= 0.5"),
}
