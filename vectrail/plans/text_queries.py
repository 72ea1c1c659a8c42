"""Queries over ``documents``, ``pages``, ``benchmark`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.functions import vectors as V
from vectrail.operators import blocks as B
from vectrail.operators import ranking as R
from vectrail.session import table


def _docs(s, d) -> DataFrame:
    return table(s, d, "documents")


def L(c):
    return c.cast("long")


WINDOW, OVERLAP = 1000, 100
CHUNK_SQL = """c AS (SELECT doc_id, i AS chunk_ix, i * 900 AS start, substr(text, (i * 900 + 1)::INT, 1000) AS chunk
 FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 900.0))::BIGINT + 1)) AS i FROM documents WHERE trim(text) <> ''))"""
TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
VEC = "list_transform(range(64), lambda b: len(list_filter(list_transform(" + TOK + ", lambda t: CAST('0x' || substr(sha256(t), 63, 2) AS INT) % 64), lambda x: x = b))::DOUBLE)"


def chunks(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_ix, chunk_id, start, chunk); blank documents have none."""
    cut = docs.select("doc_id", F.posexplode(X.char_windows(F.col("text"), window, overlap)).alias("chunk_ix", "w"))
    return cut.select(
        "doc_id", L(F.col("chunk_ix")).alias("chunk_ix"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-c"), F.col("chunk_ix").cast("string")).alias("chunk_id"),
        F.col("w.start").alias("start"), F.col("w.text").alias("chunk"),
    )


def chunk_windows(s, d):
    return chunks(_docs(s, d)).select("doc_id", "chunk_ix", "chunk_id", "start", F.md5("chunk").alias("digest"))


def chunk_vectors(spark, chunked: DataFrame, text: str = "chunk", key: tuple[str, ...] = ("doc_id", "chunk_ix")) -> DataFrame:
    """``vector`` of token counts by hash bucket, through grouping rather than nested loops."""
    counted = chunked.select(*key, F.explode(X.alnum_tokens(F.col(text))).alias("t")).groupBy(*key, X.hash_bucket(F.col("t")).alias("b")).agg(F.count("*").alias("n"))
    packed = counted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double"))
    return packed.select(*key, dense.alias("vector"))


def hash_embed_norm(s, d):
    v = chunk_vectors(s, _docs(s, d), "text", ("doc_id",))
    return v.select("doc_id", F.posexplode("vector").alias("pos", "x"), V.norm(F.col("vector")).alias("n")).select("doc_id", L(F.col("pos")).alias("pos"), F.round(F.col("x") / F.col("n"), 6).alias("value"))


HASH_SQL = f"""WITH k AS (SELECT doc_id, CAST('0x' || substr(sha256(t), 63, 2) AS INT) % 64 AS b FROM (SELECT doc_id, unnest({TOK.format('text')}) AS t FROM documents)),
c AS (SELECT doc_id, b, count(*) AS n FROM k GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
SELECT l.doc_id, pos, round(coalesce(n, 0) / norm, 6) AS value FROM l CROSS JOIN range(64) r(pos) LEFT JOIN c ON c.doc_id = l.doc_id AND c.b = r.pos"""


def grounded_passages(s, d, k: int = 3):
    """For each benchmark item (every id divisible by 50) the chunks nearest to it by hash vectors, reranked by coverage."""
    items = table(s, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.col("text").alias("question"))
    q = items.select("item_id", X.hash_vector(F.col("question")).alias("query")).where(V.norm(F.col("query")) > 0)
    # a chunk is short, so its vector is counted in its row; nothing is shuffled before the ranking
    rows = chunks(_docs(s, d)).select("doc_id", "chunk_ix", "start", X.once(X.hash_vector(F.col("chunk"))).alias("vector"))
    near = B.matrix_knn(q, rows.where(V.norm(F.col("vector")) > 0), 20, query_id="item_id", row_ids=("doc_id", "chunk_ix", "start"), vector="vector", name="cosine")
    short = near.drop("rank")
    chunk = F.substr("text", (F.col("start") + 1).cast("int"), F.lit(WINDOW))
    texts = _docs(s, d).select("doc_id", "text").join(short, "doc_id").join(items, "item_id").withColumn("chunk", chunk)
    scored = texts.withColumn("score", F.round(X.coverage(F.col("question"), F.col("chunk")), 6))
    best = R.top_k(scored, ["item_id"], [F.desc("score"), F.desc("cosine"), F.asc("doc_id"), F.asc("chunk_ix")], k, "place")
    return best.select("item_id", L(F.col("place")).alias("place"), "doc_id", "chunk_ix", "start", "cosine", "score")


GROUNDED_SQL = f"""WITH {CHUNK_SQL}, items AS (SELECT item_id, text AS question, {VEC.format('text')} AS qv FROM benchmark WHERE item_id % 50 = 0),
tk AS (SELECT doc_id, chunk_ix, CAST('0x' || substr(sha256(t), 63, 2) AS INT) % 64 AS b, count(*) AS n FROM (SELECT doc_id, chunk_ix, unnest({TOK.format('chunk')}) AS t FROM c) GROUP BY 1, 2, 3),
qb AS (SELECT item_id, unnest(qv) AS x, unnest(range(64)) AS b FROM items),
qn AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM qb GROUP BY 1), cn AS (SELECT doc_id, chunk_ix, sqrt(sum(n * n)) AS n FROM tk GROUP BY 1, 2),
dots AS (SELECT item_id, doc_id, chunk_ix, sum(x * n) AS dp FROM qb JOIN tk USING (b) GROUP BY 1, 2, 3),
s AS (SELECT item_id, doc_id, chunk_ix, round(dp / (qn.n * cn.n), 6) AS cosine FROM dots JOIN qn USING (item_id) JOIN cn USING (doc_id, chunk_ix)),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id, chunk_ix) AS r FROM s) WHERE r <= 20),
e AS (SELECT a.*, start, round(len(list_intersect(list_distinct({TOK.format('question')}), {TOK.format('chunk')}))::DOUBLE / greatest(len(list_distinct({TOK.format('question')})), 1) + CASE WHEN contains(lower(chunk), lower(question)) THEN 0.35 ELSE 0 END, 6) AS score
 FROM a JOIN c USING (doc_id, chunk_ix) JOIN items USING (item_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, cosine DESC, doc_id, chunk_ix) AS p FROM e)
SELECT item_id, p - 1 AS place, doc_id, chunk_ix, start, cosine, score FROM f WHERE p <= 3"""


def alnum_token_sets(s, d):
    t = X.alnum_tokens(F.col("text"))
    return _docs(s, d).select("doc_id", L(F.size(t)).alias("n_tokens"), L(F.size(F.array_distinct(t))).alias("n_distinct"))


def document_frequency(s, d):
    t = _docs(s, d).select(F.explode(F.array_distinct(X.alnum_tokens(F.col("text")))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df"))


DF_SQL = f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({TOK.format('text')})) AS token FROM documents) GROUP BY 1"


def idf_table(s, d):
    n = _docs(s, d).agg(F.count("*").alias("n"))
    return document_frequency(s, d).crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


def sparse_dot_topk(s, d):
    """Inner product of token counts over shared tokens, for the benchmark items divisible by 50."""
    items = table(s, d, "benchmark").where("item_id % 50 = 0")
    post = lambda x, key: x.select(key, F.explode(X.alnum_tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("w"))
    q = post(items, "item_id").withColumnRenamed("w", "qw")
    hits = post(_docs(s, d), "doc_id").join(q, "token").groupBy("item_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return R.top_k(hits, ["item_id"], [F.desc("score"), F.asc("doc_id")], 10).select("item_id", "doc_id", "score", L(F.col("rank")).alias("rank"))


SPARSE_SQL = f"""WITH q AS (SELECT item_id, token, count(*) AS qw FROM (SELECT item_id, unnest({TOK.format('text')}) AS token FROM benchmark WHERE item_id % 50 = 0) GROUP BY 1, 2),
p AS (SELECT doc_id, token, count(*) AS w FROM (SELECT doc_id, unnest({TOK.format('text')}) AS token FROM documents) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(w * qw)::BIGINT AS score FROM p JOIN q USING (token) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s) SELECT item_id, doc_id, score, n - 1 AS rank FROM r WHERE n <= 10"""


def rerank_lexical(s, d):
    items = table(s, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.col("text").alias("question"))
    found = sparse_dot_topk(s, d).select("item_id", "doc_id").join(items, "item_id").join(_docs(s, d).select("doc_id", "text"), "doc_id")
    return found.select("item_id", "doc_id", F.round(X.coverage(F.col("question"), F.col("text")), 6).alias("score"))


RERANK_SQL = f"""WITH h AS ({SPARSE_SQL}) SELECT h.item_id, h.doc_id, round(len(list_intersect(list_distinct({TOK.format('b.text')}), {TOK.format('d.text')}))::DOUBLE / greatest(len(list_distinct({TOK.format('b.text')})), 1)
 + CASE WHEN contains(lower(d.text), lower(b.text)) THEN 0.35 ELSE 0 END, 6) AS score FROM h JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)"""


def html_to_text(s, d):
    return table(s, d, "pages").select("page_id", F.md5(X.plain_text(F.col("html"))).alias("digest"), L(F.length(X.plain_text(F.col("html")))).alias("n_chars"))


def _sql_plain(c):
    out = f"regexp_replace({c}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    out = f"regexp_replace({out}, '\\(Citation:[^)]*\\)', '', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def text_normalise(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.normalise(F.col("text"))).alias("digest"))


def simple_scalars(s, d):
    t = F.col("text")
    return _docs(s, d).select(
        "doc_id", X.token_estimate(t).alias("tokens"), F.md5(X.slug(t)).alias("slug"), F.md5(X.placeholder(t)).alias("placeholder"),
        F.md5(X.mask_secret(t)).alias("masked"), (F.length(F.trim(t)) < 16).alias("near_empty"), F.md5(F.concat(F.lit("query: "), t)).alias("templated"),
        F.md5(F.replace(F.replace(t, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))).alias("model_id"),
    )


SCALAR_SQL = r"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4))::BIGINT END AS tokens,
 md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
 md5(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS placeholder,
 md5(CASE WHEN length(text) <= 4 THEN repeat('*', length(text)) ELSE repeat('*', length(text) - 4) || right(text, 4) END) AS masked,
 length(trim(text)) < 16 AS near_empty, md5('query: ' || text) AS templated, md5(replace(replace(text, '/', '__'), ' ', '_')) AS model_id FROM documents"""


def unique_lines(s, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _docs(s, d).select("doc_id", L(F.size(lines)).alias("n_lines"), L(F.size(F.array_distinct(lines))).alias("n_unique"))


def paragraph_chunks(s, d):
    parts = F.filter(F.transform(F.split("text", r"\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 24)
    return _docs(s, d).select("doc_id", F.posexplode(parts).alias("pos", "part")).select("doc_id", L(F.col("pos")).alias("pos"), F.md5("part").alias("digest"))


PARA_SQL = r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 24) AS parts FROM documents)
SELECT doc_id, unnest(range(len(parts))) AS pos, md5(unnest(parts)) AS digest FROM p"""


def heading_chunks(s, d):
    """Lines from one heading to the next, joined by spaces; a line that begins upper-case ``A`` stands for a heading."""
    line = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    part = line.withColumn("section", F.sum(F.col("line").startswith("A").cast("int")).over(w))
    joined = part.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("body"))
    return joined.where(F.length("body") > 24).select("doc_id", L(F.col("section")).alias("section"), F.md5("body").alias("digest"))


HEADING_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
p AS (SELECT *, sum(CASE WHEN starts_with(line, 'A') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l),
j AS (SELECT doc_id, section, string_agg(line, ' ' ORDER BY pos) AS body FROM p GROUP BY 1, 2)
SELECT doc_id, section::BIGINT AS section, md5(body) AS digest FROM j WHERE length(body) > 24"""


def target_tokens(s, d):
    t = X.alnum_tokens(F.col("text"))
    return _docs(s, d).select("doc_id", F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("target_class"), L(F.size(F.slice(F.array_distinct(t), 1, 200))).alias("n_tokens"))


def quote_grounding(s, d):
    """All places of each benchmark text in documents, any white space between its words: their number, and the first, code points from 0.

    Words of a quote are looked for as they are first; only texts that hold its
    longest one are searched for the whole.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    longest = F.reduce(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    literal = F.transform(words, lambda w: F.regexp_replace(w, r"([^A-Za-z0-9\s])", r"\\$1"))
    items = table(s, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.array_join(literal, r"\s+").alias("pattern"), longest.alias("word")).where("word != ''")
    held = R.against(items, _docs(s, d).select("doc_id", "text")).where(F.contains("text", F.col("word")))
    hit = held.withColumn("found", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).where(F.size("found") > 0)
    start = L(F.instr(F.col("text"), F.col("found")[0]) - 1)
    return hit.select("item_id", "doc_id", L(F.size("found")).alias("n"), start.alias("start"), (start + F.length(F.col("found")[0])).alias("end"))


QUOTE_SQL = r"""WITH b AS (SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '([^A-Za-z0-9\s])', '\\\1', 'g')), '\s+') AS p FROM benchmark WHERE item_id % 50 = 0),
h AS (SELECT item_id, doc_id, text, regexp_extract_all(text, p) AS m FROM b, documents WHERE p <> '')
SELECT item_id, doc_id, len(m) AS n, (instr(text, m[1]) - 1)::BIGINT AS start, (instr(text, m[1]) - 1 + length(m[1]))::BIGINT AS "end" FROM h WHERE len(m) > 0"""


def numbers_and_times(s, d):
    t = F.col("text")
    return _docs(s, d).select(
        "doc_id", X.first_number(t).alias("number"),
        X.subtitle_time(F.col("n_chars") / 7.0).alias("srt"), X.subtitle_time(F.col("n_chars") / 7.0, ".").alias("vtt"),
        F.coalesce(X.clock_minutes(F.concat((F.col("doc_id") % 12 + 1).cast("string"), F.lit(":30 "), F.when(F.col("doc_id") % 2 == 0, "AM").otherwise("pm"))), F.lit(-1)).cast("long").alias("minute"),
        F.round(F.col("n_chars").cast("decimal(38,18)") / 1000, 6).cast("double").alias("thousands"),
    )


NUM_SQL = r"""WITH m AS (SELECT *, round_even(n_chars / 7.0 * 1000, 0)::BIGINT AS ms FROM documents)
SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS number,
 printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt,
 printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt,
 (((doc_id % 12 + 1) % 12 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 12 END) * 60 + 30)::BIGINT AS minute, round(n_chars / 1000.0, 6)::DOUBLE AS thousands FROM m"""


def llm_text_cleanup(s, d):
    """Thinking blocks, SQL fences and lenient markers stripped from turns made of conversations."""
    t = F.col("text")
    made = F.concat(F.lit("<think>"), t, F.lit("</think>"), t, F.lit("<think>open"))
    fenced = F.concat(F.lit("```sql\nSELECT "), F.col("turn").cast("string"), F.lit(";\n```"))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(X.without_thinking(made)).alias("visible"), X.strip_fence(fenced).alias("sql"))


CLEAN_SQL = r"""SELECT conv_id, turn, md5(regexp_replace('<think>' || text || '</think>' || text || '<think>open', '(?s)<think>.*?(?:</think>|$)', '', 'g')) AS visible, 'SELECT ' || turn AS sql FROM conversations"""


def transcripts(s, d):
    """Each conversation's turns in order, templated by role."""
    turn = F.format_string("<|%s|>%s", F.col("role"), F.col("text"))
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("line")))).alias("t"))
    return c.select("conv_id", L(F.size("t")).alias("n_turns"), F.md5(F.array_join(F.transform("t", lambda x: x["line"]), "\n")).alias("digest"))


def tool_call_json(s, d):
    j = F.concat(F.lit('{"name": "fn'), (F.col("turn") % 3).cast("string"), F.lit('", "arguments": {"k": '), F.col("turn").cast("string"), F.lit("}}"))
    whole = F.concat(F.lit("call: <tool_call>"), j, F.lit("</tool_call> done"))
    call = F.from_json(F.regexp_extract(whole, "(?s)<tool_call>(.*?)</tool_call>", 1), "name string, arguments struct<k bigint>")
    return table(s, d, "conversations").select("conv_id", "turn", call["name"].alias("name"), call["arguments"]["k"].alias("k"))


def tool_call_xml(s, d):
    whole = F.concat(F.lit("<function=f"), (F.col("turn") % 4).cast("string"), F.lit("><parameter=a>"), F.col("turn").cast("string"), F.lit("</parameter><parameter=b> x </parameter></function>"))
    names = F.regexp_extract_all(whole, F.lit("<parameter=([^>]+)>"), F.lit(1))
    values = F.transform(F.regexp_extract_all(whole, F.lit("(?s)<parameter=[^>]+>(.*?)</parameter>"), F.lit(1)), lambda x: F.trim(x))
    rows = table(s, d, "conversations").select("conv_id", "turn", F.regexp_extract(whole, "<function=([^>]+)>", 1).alias("name"), F.explode(F.map_from_arrays(names, values)).alias("parameter", "value"))
    return rows


def number_spans(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, start, end) of each number of four or more digits, found in overlapping windows and kept once.

    A hit at an edge that a neighbouring window lies beyond is left to that window,
    which holds it whole. One at least as long as the overlap may be whole in no
    window: its pieces are kept and joined.
    """
    cut = docs.select("doc_id", X.char_windows(F.col("text"), window, overlap).alias("ws"))
    cut = cut.select("doc_id", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w"))
    hits = cut.select("doc_id", "n", "pos", "w", F.explode(X.matches(F.col("w.text"), "[0-9]{4,}")).alias("m"))
    left = (F.col("pos") > 0) & (F.col("m.start") == 0)
    right = (F.col("pos") < F.col("n") - 1) & (F.col("m.end") == F.length("w.text"))
    placed = hits.select(
        "doc_id", L(F.col("w.start") + F.col("m.start")).alias("start"), L(F.col("w.start") + F.col("m.end")).alias("end"), (left | right).alias("edge")
    )
    kept = placed.where(~F.col("edge") | (F.col("end") - F.col("start") >= overlap))
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    apart = F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = kept.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def windowed_spans(s, d):
    return number_spans(_docs(s, d).select("doc_id", "text"))


def span_extraction(s, d):
    """How many numbers of four or more digits each document has, found window by window; ``windowed_spans`` places them."""
    return number_spans(_docs(s, d).select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n_spans"))


SPAN_SQL = "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4,}')) AS n_spans FROM documents WHERE regexp_matches(text, '[0-9]{4,}')"


def merge_adjacent_spans(s, d):
    """Upper-case words as labelled spans; neighbours at most one apart become one (islands over the running end)."""
    words = _docs(s, d).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    spans = words.where(F.col("w").rlike("^[A-Z]")).select("doc_id", F.col("pos").alias("start"), F.col("pos").alias("stop"), F.length("w").alias("score"))
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    apart = F.col("start") > F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1
    islands = spans.withColumn("island", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
    return islands.groupBy("doc_id", "island").agg(L(F.min("start")).alias("start"), L(F.max("stop")).alias("stop"), L(F.max("score")).alias("score")).select("doc_id", "start", "stop", "score")


ISLAND_SQL = """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
s AS (SELECT doc_id, pos, length(w) AS score FROM w WHERE regexp_matches(w, '^[A-Z]')),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s)
SELECT doc_id, min(pos) AS start, max(pos) AS stop, max(score)::BIGINT AS score FROM g GROUP BY doc_id, island"""


def entities_in_chunk(s, d):
    """How many entities (60 characters at every 450th of the whole text) overlap each chunk: start before its end, end after its start.

    Both sides meet by document and stretch of text, so a very long document is not one join key.
    """
    over = lambda a, b: F.explode(F.sequence(F.floor(a / 900), F.floor((b - 1) / 900))).alias("bucket")
    c = chunks(_docs(s, d)).select("doc_id", "chunk_ix", "start", (F.col("start") + F.length("chunk")).alias("stop"))
    c = c.select("*", over(F.col("start"), F.col("stop")))
    e = _docs(s, d).where("n_chars >= 60").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_chars") - 60) / 450))).alias("k"))
    e = e.select("doc_id", "k", (F.col("k") * 450).alias("e_start"), (F.col("k") * 450 + 60).alias("e_end"))
    met = c.join(e.select("*", over(F.col("e_start"), F.col("e_end"))), ["doc_id", "bucket"]).where("e_start < stop AND e_end > start")
    return met.select("doc_id", "chunk_ix", "k").distinct().groupBy("doc_id", "chunk_ix").agg(F.count("*").alias("n"))


ENT_SQL = f"""WITH {CHUNK_SQL}, e AS (SELECT doc_id, k * 450 AS s, k * 450 + 60 AS t FROM (SELECT doc_id, unnest(range(0, (n_chars - 60) // 450 + 1)) AS k FROM documents WHERE n_chars >= 60))
SELECT c.doc_id, chunk_ix, count(*) AS n FROM c JOIN e ON c.doc_id = e.doc_id AND s < start + length(chunk) AND t > start GROUP BY 1, 2"""


def markdown_tables(s, d):
    """Tables that begin in each text, and lines with a bar that a line with a bar follows."""
    lines = F.split("text", "\n")
    pairs = F.size(F.filter(F.zip_with(lines, F.slice(lines, 2, 1 << 30), lambda a, b: F.contains(a, F.lit("|")) & F.coalesce(F.contains(b, F.lit("|")), F.lit(False))), lambda x: x))
    return _docs(s, d).select("doc_id", L(pairs).alias("n_pairs"), L(X.table_count(F.col("text"))).alias("n_tables"))


def hash_scalars(s, d):
    t = F.col("text")
    h = F.sha2(t, 256)
    return _docs(s, d).select(
        "doc_id", L(X.hash_bucket(t)).alias("bucket"), F.substring(F.sha2(F.to_json(F.array(F.col("doc_id").cast("string"), F.col("lang"))), 256), 1, 20).alias("case_id"),
        F.round(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0, 9).alias("unit_interval"), F.md5(F.coalesce("text", F.lit(""))).alias("item_key"),
    )


HASHSC_SQL = """SELECT doc_id, (CAST('0x' || substr(sha256(text), 63, 2) AS INT) % 64)::BIGINT AS bucket,
 substr(sha256('["' || doc_id || '","' || lang || '"]'), 1, 20) AS case_id, round(CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0, 9) AS unit_interval, md5(text) AS item_key FROM documents"""


def context_compression(s, d):
    """Share of characters that the grounded passages spare against their documents."""
    p = grounded_passages(s, d).join(_docs(s, d).select("doc_id", "n_chars"), "doc_id")
    return p.groupBy("item_id").agg(F.sum("n_chars").alias("n_source"), F.round(1 - F.sum(F.least(F.col("n_chars") - F.col("start"), F.lit(1000))) / F.sum("n_chars"), 6).alias("saved"))


COMP_SQL = f"WITH g AS ({GROUNDED_SQL}) SELECT item_id, sum(n_chars)::BIGINT AS n_source, round(1 - sum(least(n_chars - start, 1000))::DOUBLE / sum(n_chars), 6) AS saved FROM g JOIN documents USING (doc_id) GROUP BY 1"


def url_parts(s, d):
    return table(s, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.lower(F.regexp_extract("url", r"^([a-z]+):", 1)).alias("scheme"), F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1).alias("suffix"))


QUERIES = {
    "chunk_windows": (chunk_windows, f"WITH {CHUNK_SQL} SELECT doc_id, chunk_ix, 'd' || doc_id || '-c' || chunk_ix AS chunk_id, start, md5(chunk) AS digest FROM c"),
    "hash_embed_norm": (hash_embed_norm, HASH_SQL),
    "grounded_passages": (grounded_passages, GROUNDED_SQL),
    "alnum_token_sets": (alnum_token_sets, f"SELECT doc_id, len({TOK.format('text')}) AS n_tokens, len(list_distinct({TOK.format('text')})) AS n_distinct FROM documents"),
    "document_frequency": (document_frequency, DF_SQL),
    "idf_table": (idf_table, f"WITH f AS ({DF_SQL}) SELECT token, df, round(ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS idf FROM f"),
    "sparse_dot_topk": (sparse_dot_topk, SPARSE_SQL),
    "rerank_lexical": (rerank_lexical, RERANK_SQL),
    "html_to_text": (html_to_text, f"SELECT page_id, md5({_sql_plain('html')}) AS digest, length({_sql_plain('html')}) AS n_chars FROM pages"),
    "text_normalise": (text_normalise, r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM documents"),
    "text_scalars": (simple_scalars, SCALAR_SQL),
    "unique_lines": (unique_lines, "SELECT doc_id, len(l) AS n_lines, len(list_distinct(l)) AS n_unique FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)"),
    "paragraph_chunks": (paragraph_chunks, PARA_SQL),
    "heading_chunks": (heading_chunks, HEADING_SQL),
    "target_tokens": (target_tokens, f"SELECT doc_id, coalesce({TOK.format('text')}[1], '') AS target_class, least(200, len(list_distinct({TOK.format('text')}))) AS n_tokens FROM documents"),
    "quote_grounding": (quote_grounding, QUOTE_SQL),
    "numbers_and_times": (numbers_and_times, NUM_SQL),
    "llm_text_cleanup": (llm_text_cleanup, CLEAN_SQL),
    "transcripts": (transcripts, "SELECT conv_id, count(*) AS n_turns, md5(string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1"),
    "tool_call_json": (tool_call_json, "SELECT conv_id, turn, 'fn' || (turn % 3) AS name, turn AS k FROM conversations"),
    "tool_call_xml": (tool_call_xml, "SELECT conv_id, turn, 'f' || (turn % 4) AS name, p AS parameter, CASE WHEN p = 'a' THEN turn::VARCHAR ELSE 'x' END AS value FROM conversations, (VALUES ('a'), ('b')) t(p)"),
    "windowed_extraction": (span_extraction, SPAN_SQL),
    "windowed_spans": (windowed_spans, None),
    "merge_adjacent_spans": (merge_adjacent_spans, ISLAND_SQL),
    "entities_in_chunk": (entities_in_chunk, ENT_SQL),
    "markdown_table_lines": (markdown_tables, "SELECT doc_id, len(list_filter(range(1, len(l)), lambda i: contains(l[i], '|') AND contains(l[i + 1], '|'))) AS n_pairs, len(list_filter(range(1, len(l)), lambda i: regexp_matches(l[i], '^[ \\t]*\\|.*\\|') AND contains(l[i + 1], '-') AND regexp_matches(l[i + 1], '^[-|: \\t]+$'))) AS n_tables FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"),
    "hash_scalars": (hash_scalars, HASHSC_SQL),
    "context_compression": (context_compression, COMP_SQL),
    "url_parts": (url_parts, r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, lower(regexp_extract(url, '^([a-z]+):', 1)) AS scheme, regexp_extract(url, '\.([A-Za-z0-9]+)$', 1) AS suffix FROM pages"),
}
