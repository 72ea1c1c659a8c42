"""Lookups, merges, ranking policies, small scalars and composite searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.functions import text as X
from vectrail.functions import vectors as V
from vectrail.operators import blocks as B
from vectrail.operators import ranking as R
from vectrail.plans import vector_queries as VQ
from vectrail.plans.span_queries import PATTERNS
from vectrail.plans.text_queries import _sql_plain
from vectrail.session import checkpointed, parts_for, table


def L(c):
    return c.cast("long")


COS_SQL = VQ._knn_sql(VQ.COS, 5)


def trim_all(s, d):
    toks = F.transform(F.split(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")), " "), lambda x: F.trim(x))
    return table(s, d, "part").select(F.col("p_partkey"), F.trim(F.concat(F.lit("  "), "p_brand")).alias("brand"), F.array_join(F.filter(toks, lambda x: x != ""), "|").alias("tokens"))


def overflow_policy(s, d):
    n = F.length("text")
    return table(s, d, "documents").select("doc_id", L(F.length(F.when(n > 500, F.left("text", F.lit(480))).otherwise(F.col("text")))).alias("n"), (n > 500).alias("cut"))


def geometry_guard(s, d):
    """Of an order's boxes neither too wide nor too low, the one of the largest score."""
    ok = table(s, d, "lineitem").where((F.col("l_quantity") < 45) & (F.col("l_linenumber") * 3 >= 3))
    best = ok.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("line"))
    return best.select("l_orderkey", L(F.col("line")).alias("line"))


def privileged_terms(s, d):
    e = table(s, d, "events").withColumn("score", F.col("value") % 1)
    hit = e.where((F.col("score") >= 0.5) & F.col("event_type").isin("purchase", "signup"))
    return hit.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set(F.upper("event_type"))), ",").alias("terms"))


def safety_verdict(s, d):
    v = F.when(F.col("turn") % 3 == 0, " No. ").when(F.col("turn") % 3 == 1, "no!").otherwise("Yes")
    clean = F.regexp_replace(F.lower(F.trim(v)), r"[.!,;:]+$", "")
    return table(s, d, "conversations").select("conv_id", "turn", (clean != "no").alias("unsafe"))


def score_lookup(s, d):
    """Candidates joined to rerank scores by id; those without a score go, unless none has one (then the dense order stands)."""
    hits = VQ.knn_cosine(s, d)
    scores = table(s, d, "embeddings").where("label >= 4").select("vec_id", (F.col("label") / 10.0).alias("rerank"))
    joined = hits.join(scores, "vec_id", "left").withColumn("found", F.max(F.col("rerank").isNotNull()).over(Window.partitionBy("query_id")))
    kept = joined.where(F.col("rerank").isNotNull() | ~F.col("found"))
    top = R.top_k(kept, ["query_id"], [F.desc_nulls_last("rerank"), F.asc("rank")], 3, "place")
    return top.select("query_id", "vec_id", L(F.col("place")).alias("place"), F.coalesce("rerank", "score").alias("score"))


LOOKUP_SQL = f"""WITH h AS ({COS_SQL}), j AS (SELECT h.*, CASE WHEN label >= 4 THEN label / 10.0::DOUBLE END AS rerank FROM h JOIN embeddings USING (vec_id)),
f AS (SELECT *, max(CASE WHEN rerank IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS found FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC NULLS LAST, rank) AS n FROM f WHERE rerank IS NOT NULL OR found = 0)
SELECT query_id, vec_id, n - 1 AS place, coalesce(rerank, score) AS score FROM r WHERE n <= 3"""


def rank_merge(s, d):
    """Cosine hits left-joined to rerank scores (missing: 0), by score, then cosine rank."""
    hits = VQ.knn_cosine(s, d).select("query_id", "vec_id", F.col("rank").alias("cosine_rank"))
    scores = table(s, d, "embeddings").where("label < 5").select("vec_id", (F.col("label") * 0.1).alias("score"))
    j = hits.join(scores, "vec_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return R.top_k(j, ["query_id"], [F.desc("score"), F.asc("cosine_rank")], 5).select("query_id", "vec_id", "cosine_rank", "score", L(F.col("rank")).alias("rank"))


MERGE_SQL = f"""WITH h AS ({COS_SQL}), j AS (SELECT query_id, vec_id, rank AS cosine_rank, round(CASE WHEN label < 5 THEN label * 0.1::DOUBLE ELSE 0 END, 6) AS score FROM h JOIN embeddings USING (vec_id))
SELECT query_id, vec_id, cosine_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine_rank) - 1 AS rank FROM j"""


def aligned_spans(docs, patterns: dict[str, str], bucket: int = 900):
    """(doc_id, label, start, end, first, last): the first and last word that each match of a pattern touches, over whole texts.

    Words are parted by single spaces. Words and spans meet by document and bucket
    of offsets, so a very long document is not one join key.
    """
    named = lambda label, p: F.transform(X.matches(F.col("text"), p), lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start"), m["end"].alias("end")))
    found = docs.withColumn("spans", F.concat(*(named(k, p) for k, p in patterns.items()))).where(F.size("spans") > 0)
    over = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket))).alias("bucket")
    spans = found.select("doc_id", F.inline("spans")).select("*", over(F.col("start"), F.col("end") - 1))
    w = found.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    stop = F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    w = w.withColumn("w_end", stop).withColumn("w_start", F.col("w_end") - F.length("w"))
    w = w.select("doc_id", "pos", "w_start", "w_end", over(F.col("w_start"), F.col("w_end")))
    touching = spans.join(w, ["doc_id", "bucket"]).where("w_start < end AND w_end > start")
    return touching.groupBy("doc_id", "label", "start", "end").agg(L(F.min("pos")).alias("first"), L(F.max("pos")).alias("last"))


def span_alignment(s, d):
    return aligned_spans(table(s, d, "documents").select("doc_id", "text"), PATTERNS)


def token_alignment(s, d):
    """First and last word of each document that the characters 20 to 60 touch; ``span_alignment`` aligns matches anywhere."""
    w = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    end = F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    t = w.withColumn("end", end).withColumn("start", F.col("end") - F.length("w"))
    return t.where("start < 60 AND end > 20").groupBy("doc_id").agg(L(F.min("pos")).alias("first"), L(F.max("pos")).alias("last"))


ALIGN_SQL = """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
t AS (SELECT doc_id, pos, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS e FROM w)
SELECT doc_id, min(pos) AS first, max(pos) AS last FROM t WHERE e - length(w) < 60 AND e > 20 GROUP BY 1"""


def relation_rows(s, d):
    """Relations between nations and regions, kept if both ends are known, scored by the weaker end."""
    n = table(s, d, "nation").select(F.col("n_name").alias("head"), (F.col("n_nationkey") / 25.0).alias("hs"), F.col("n_regionkey").alias("k"))
    r = table(s, d, "region").where("r_name IN ('AFRICA', 'AMERICA', 'ASIA')").select(F.col("r_name").alias("tail"), F.col("r_regionkey").alias("k"), F.lit(0.5).alias("ts"))
    j = n.join(r, "k").select("head", "tail", "k", F.round(F.least("hs", "ts"), 6).alias("score"))
    w = Window.partitionBy("tail").orderBy(F.desc("score"), "head")
    return j.withColumn("rank", L(F.row_number().over(w) - 1))


def placeholder_counts(s, d):
    mark = F.concat(F.lit("["), F.upper("role"), F.lit("_"), F.col("turn").cast("string"), F.lit("]"))
    label = F.lower(F.regexp_replace(mark, r"^\[|_[0-9]+\]$", ""))
    return table(s, d, "conversations").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def keyword_counts(s, d):
    """Words of a part's type count; those of its name only where the type lacks them."""
    p = table(s, d, "part").select("p_partkey", F.split("p_type", " ").alias("a"), F.split("p_name", " ").alias("b"))
    return p.select("p_partkey", L(F.size("a")).alias("n_primary"), L(F.size(F.array_except("b", "a"))).alias("n_secondary"))


def preference_vector(s, d):
    """Weight times IDF of wished terms in the order of the vocabulary."""
    p = table(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    n = p.select("p_partkey").distinct().count()
    df = p.groupBy("term").agg(F.countDistinct("p_partkey").alias("df"))
    wish = F.when(F.length("term") % 2 == 0, 1.0).otherwise(0.5)
    return df.select("term", F.round(wish * F.log(F.lit(float(n)) / F.col("df")), 6).alias("weight"))


def query_idf(s, d):
    """Distinct tokens of benchmark items with their IDF over documents, above zero."""
    docs = table(s, d, "documents")
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(X.alnum_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    q = table(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(X.alnum_tokens(F.col("text")))).alias("token"))
    return q.join(df, "token").select("item_id", "token", F.round(F.log(F.lit(float(n)) / F.col("df")), 6).alias("weight")).where("weight > 0")


IDF_SQL = """WITH f AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents) GROUP BY 1),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark)
SELECT item_id, token, round(ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS weight FROM q JOIN f USING (token) WHERE round(ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) > 0"""


def token_costs(s, d):
    """Savings, request estimates and pair costs by characters."""
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("m"))
    return t.select("conv_id", F.greatest(F.floor(F.col("n") / 4) - F.floor(F.col("m") / 4), F.lit(0)).cast("long").alias("saved"), F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("long").alias("estimate"), (F.col("n") + 3 * F.col("m")).cast("long").alias("pair_cost"))


def charged_calls(s, d):
    """Orders as calls: an id once, one version a customer."""
    o = table(s, d, "orders").groupBy("o_custkey").agg((F.count("o_orderkey") == F.countDistinct("o_orderkey")).alias("unique_ids"), (F.countDistinct("o_orderstatus") == 1).alias("one_version"))
    return o


def token_span_means(s, d):
    """Neighbouring tokens of one label as spans with their mean score.

    Orders are dealt to as many tasks as the number of lines asks for: each sorts and
    groups a bounded number of them, however large the table.
    """
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_quantity")
    li = li.repartition(parts_for(li), "l_orderkey").withColumn("new", F.coalesce((F.lag("l_returnflag").over(w) != F.col("l_returnflag")) | (F.col("l_linenumber") > F.lag("l_linenumber").over(w) + 1), F.lit(True)).cast("int"))
    g = li.withColumn("island", F.sum("new").over(w)).groupBy("l_orderkey", "island", F.col("l_returnflag").alias("label"))
    return g.agg(L(F.min("l_linenumber")).alias("start"), L(F.max("l_linenumber")).alias("stop"), F.round(F.avg("l_quantity"), 6).alias("score")).drop("island")


SPANMEAN_SQL = """WITH f AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w = l_returnflag AND l_linenumber <= lag(l_linenumber) OVER w + 1 THEN 0 ELSE 1 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS island FROM f)
SELECT l_orderkey, l_returnflag AS label, min(l_linenumber)::BIGINT AS start, max(l_linenumber)::BIGINT AS stop, round(avg(l_quantity), 6) AS score FROM g GROUP BY l_orderkey, island, l_returnflag"""


def top_tags(s, d):
    """The two labels whose first vectors are nearest to each query."""
    e = table(s, d, "embeddings")
    tags = R.top_k(e, ["label"], [F.asc("vec_id")], 1).select("label", "embedding")
    return B.matrix_knn(VQ._queries(e), tags, 2, row_ids=("label",)).select("query_id", "label", "score", L(F.col("rank")).alias("rank"))


TAG_SQL = f"""WITH {VQ.Q_SQL}, t AS (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1),
s AS (SELECT query_id, label, {VQ.COS} AS score FROM q, t), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS n FROM s)
SELECT query_id, label, score, n - 1 AS rank FROM r WHERE n <= 2"""


def term_shortlist(s, d):
    """Documents by how many of listed terms they hold; the first ten."""
    terms = ["the", "and", "token", "License", "que", "der"]
    n = sum((F.contains("text", F.lit(t)).cast("int") for t in terms), F.lit(0))
    return table(s, d, "documents").select("doc_id", L(n).alias("n")).orderBy(F.desc("n"), "doc_id").limit(10)


def lexical_ranking(s, d):
    """Customers by distance, balance and id; those without a second distance last."""
    c = table(s, d, "customer").withColumn("distance", F.abs(F.col("c_acctbal") - 5000)).withColumn("second", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 7))
    c = c.orderBy("distance", "c_custkey").limit(40)
    w = Window.orderBy(F.asc_nulls_last("second"), "distance", "c_custkey")
    return c.select("c_custkey", L(F.row_number().over(w) - 1).alias("rank"))


def pick_worker(s, d):
    """For each nation the customer of least pressure: balance band, then a hash, then id."""
    key = F.struct(F.floor(F.col("c_acctbal") / 1000).alias("p"), F.md5(F.col("c_custkey").cast("string")).alias("h"), F.col("c_custkey").alias("i"))
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", key).alias("c_custkey"))


def lru_candidate(s, d):
    """The user seen longest ago who is not pinned (every fifth is)."""
    e = table(s, d, "events").where("user_id % 5 != 0").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return e.orderBy("seen", "user_id").limit(1).select("user_id")


def distance_from_score(s, d):
    return VQ.knn_cosine(s, d).select("query_id", "vec_id", F.round(1 / (1 + F.col("score")), 6).alias("distance"))


def _hulls(lines, *keys: str):
    """Hull of four corners made of a line's values, relative to width and height."""
    xs, ys = F.array("l_quantity", F.col("l_quantity") + 7), F.array(F.col("l_linenumber") * 2.0, F.col("l_linenumber") * 2.0 + 3)
    return lines.select(*keys, F.round(F.array_min(xs) / 100, 6).alias("x1"), F.round(F.array_max(xs) / 100, 6).alias("x2"), F.round(F.array_min(ys) / 50, 6).alias("y1"), F.round(F.array_max(ys) / 50, 6).alias("y2"), F.round(F.coalesce(F.nullif(F.col("l_quantity"), F.lit(1.0)), F.lit(2.5)) / 5, 6).alias("scaled"))


def quad_boxes(s, d):
    """The hull of every line."""
    return quad_boxes_lines(s, d)


def quad_boxes_lines(s, d):
    return _hulls(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


def entity_markdown(s, d):
    """Entities of a conversation as a table in markdown, and as a page."""
    c = table(s, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("t"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "t")))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), r["role"], F.lit(" | "), F.replace(r["t"], F.lit("\n"), F.lit(" ")), F.lit(" |")))
    head = F.lit("| label | text |\n| --- | --- |\n")
    return c.groupBy("conv_id").agg(F.md5(F.concat(head, F.array_join(lines, "\n"))).alias("markdown"), F.md5(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n")).alias("page"))


MARKDOWN_SQL = """SELECT conv_id, md5('| label | text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || replace(text, chr(10), ' ') || ' |', chr(10) ORDER BY turn)) AS markdown,
 md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS page FROM conversations GROUP BY 1"""


def reading_order(s, d):
    """Whether three marks are all found in a text, in order."""
    at = [F.instr(F.col("text"), F.lit(m)) for m in ("a", "e", ".")]
    return table(s, d, "documents").select("doc_id", ((at[0] > 0) & (at[1] > 0) & (at[2] > 0)).alias("found"), ((at[0] > 0) & (at[1] > at[0]) & (at[2] > at[1])).alias("ordered"))


def hash_floats(s, d):
    """Words of SHA-256 of seed and index, to [-1, 1)."""
    i = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    t = table(s, d, "benchmark").select("item_id", i)
    h = F.sha2(F.concat(F.col("item_id").cast("string"), F.lit(":"), F.col("i").cast("string")), 256)
    return t.select("item_id", L(F.col("i")).alias("i"), F.round(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2147483648.0 - 1, 9).alias("x"))


def base64_capped(s, d):
    """Short texts through base64 and back, refused beyond a size."""
    b = F.base64(F.encode("text", "utf-8"))
    b = F.regexp_replace(b, r"\s", "")
    return table(s, d, "documents").select("doc_id", L(F.length(b)).alias("n"), F.coalesce(F.when(F.length(b) <= 4096, F.decode(F.unbase64(b), "utf-8")), F.lit("")).alias("back"))


def subtitles(s, d):
    """Turns as numbered cues, one document a conversation."""
    c = table(s, d, "conversations")
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), X.subtitle_time(F.col("turn") * 1.5), F.lit(" --> "), X.subtitle_time(F.col("turn") * 1.5 + 1.25), F.lit("\n"), F.col("text"))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n\n")).alias("srt"))


SRT_SQL = """WITH t AS (SELECT *, (turn * 1500)::BIGINT AS a, (turn * 1500 + 1250)::BIGINT AS b FROM conversations)
SELECT conv_id, md5(string_agg(turn || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS srt FROM t GROUP BY 1"""


def timestamp_parse(s, d):
    """ISO texts with a zone parse, those without are refused."""
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    ok = F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))
    return table(s, d, "events").select("event_id", F.coalesce(F.unix_seconds(ok), F.lit(-1)).alias("at"))


def entity_properties(s, d):
    """Labels to their distinct texts in order, per order."""
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), F.col("l_linenumber").cast("string").alias("t"))
    return li.groupBy("l_orderkey", "label").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("texts"))


def document_routing(s, d):
    """Plain text of a page, unless it is nearly empty, then its URL; the longer of two on ties of worth."""
    body = X.plain_text(F.col("html"))
    return table(s, d, "pages").select("page_id", F.when(F.length(F.trim(body)) < 16, "url").when(F.length(body) > F.length("html") / 2, "text").otherwise("markup").alias("route"))


def product_search(s, d):
    """Nearest rows, filtered by label with fallback to all, reranked by inner product."""
    e = table(s, d, "embeddings")
    hits = B.matrix_knn(VQ._queries(e), e, 20).join(e, "vec_id").join(VQ._queries(e), "query_id")
    flagged = hits.withColumn("hit", (F.col("label") == F.col("query_label") + 1)).withColumn("some", F.max("hit").over(Window.partitionBy("query_id")))
    kept = flagged.where(F.col("hit") | ~F.col("some")).withColumn("rerank", F.round(V.dot(F.col("query"), F.col("embedding")), 6))
    return R.top_k(kept.select("query_id", "vec_id", "rerank"), ["query_id"], [F.desc("rerank"), F.asc("vec_id")], 5).select("query_id", "vec_id", "rerank", L(F.col("rank")).alias("rank"))


PRODUCT_SQL = f"""WITH {VQ.Q_SQL}, s AS (SELECT query_id, query_label, vec_id, label, {VQ.COS} AS score, {VQ.DOT} AS rerank FROM q, embeddings),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 20),
f AS (SELECT *, label = query_label + 1 AS hit, max(CASE WHEN label = query_label + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS found FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, vec_id) AS k FROM f WHERE hit OR found = 0)
SELECT query_id, vec_id, rerank, k - 1 AS rank FROM r WHERE k <= 5"""


def attribute_recommender(s, d):
    """Parts nearest to every part divisible by 50 by TF-IDF of name words, by shared words only.

    Parts of equal names have equal scores, so names are compared, not parts: a name's
    first parts stand for it, one more than are shown, as a part is not its own match.
    """
    most = 5
    held = table(s, d, "part").where(F.col("p_partkey").isNotNull() & F.col("p_name").isNotNull())
    # of a part in several rows all words count
    parts = held.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("p_name")), " ").alias("name"))
    names = parts.groupBy("name").agg(F.count("*").alias("n_parts"))
    n = names.agg(F.sum("n_parts").cast("double").alias("n_all"))
    tf = names.select("name", "n_parts", F.explode(F.split("name", " ")).alias("term")).groupBy("name", "n_parts", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.sum("n_parts").alias("df")).crossJoin(F.broadcast(n))
    w = tf.join(df, "term").select("name", "term", (F.col("tf") * F.log(F.col("n_all") / F.col("df"))).alias("w"))
    norm = w.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    w = w.join(norm, "name").select("name", "term", (F.col("w") / F.col("n")).alias("w"))
    queries = parts.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("name").alias("query"))
    q = w.join(queries.select(F.col("query").alias("name")).distinct(), "name").select(F.col("name").alias("query"), "term", F.col("w").alias("qw"))
    pairs = w.join(q, "term").groupBy("query", "name").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))
    first = R.top_k(parts, ["name"], [F.asc("p_partkey")], most + 1, "at").drop("at")
    hits = R.top_k(pairs.join(first, "name").select("query", "p_partkey", "score"), ["query"], [F.desc("score"), F.asc("p_partkey")], most + 1)
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "p_partkey", "score"))).alias("hits"))
    others = F.slice(F.filter("hits", lambda x: x["p_partkey"] != F.col("query_id")), 1, most)
    found = queries.join(lists, "query").select("query_id", F.posexplode(others).alias("rank", "hit"))
    return found.select("query_id", "hit.p_partkey", "hit.score", L(F.col("rank")).alias("rank"))


RECOMMEND_SQL = """WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part), d AS (SELECT term, count(DISTINCT p_partkey) AS df FROM p GROUP BY 1),
t AS (SELECT p_partkey, term, count(*) * ln((SELECT count(DISTINCT p_partkey) FROM p)::DOUBLE / df) AS w FROM p JOIN d USING (term) GROUP BY p_partkey, term, df),
n AS (SELECT p_partkey, sqrt(sum(w * w)) AS n FROM t GROUP BY 1), u AS (SELECT p_partkey, term, w / n AS w FROM t JOIN n USING (p_partkey)),
s AS (SELECT q.p_partkey AS query_id, u.p_partkey, round(sum(u.w * q.w), 6) AS score FROM u JOIN u q USING (term) WHERE q.p_partkey % 50 = 0 AND u.p_partkey <> q.p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS k FROM s) SELECT query_id, p_partkey, score, k - 1 AS rank FROM r WHERE k <= 5"""


def fraud_risk(s, d):
    """The band of each query's best match by cosine; the rerank only orders the display."""
    best = VQ.knn_threshold(s, d).groupBy("query_id").agg(F.max("score").alias("top"))
    return best.select("query_id", "top", F.when(F.col("top") >= 0.6, "high").when(F.col("top") >= 0.4, "medium").otherwise("low").alias("band"))


def retrieval_ablation(s, d):
    """Recall of the relevant label in the first ten, of four retrieval forms."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    q = VQ._queries(table(s, d, "embeddings")).select("query_id", "query_label")
    a, b = (checkpointed(x.select("query_id", "vec_id", "rank")) for x in VQ._lists(s, d))  # searched once for all four
    fused, pool = VQ.fused((a, b)), VQ.pooled((a, b))
    parts = None
    for name, x in (("vector", a), ("prefix", b), ("rrf", fused), ("pool", pool)):
        one = x.select("query_id", "vec_id", F.lit(name).alias("form"))
        parts = one if parts is None else parts.unionByName(one)
    hit = parts.join(e, "vec_id").join(q, "query_id")
    return hit.groupBy("form").agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("int")), 6).alias("precision"), F.count("*").alias("n"))


ABLATION_SQL = f"""WITH {VQ.LISTS_SQL}, f AS ({VQ.RRF_SQL}), p AS ({VQ.POOL_SQL}),
u AS (SELECT 'vector' AS form, query_id, vec_id FROM a UNION ALL SELECT 'prefix', query_id, vec_id FROM b UNION ALL SELECT 'rrf', query_id, vec_id FROM f UNION ALL SELECT 'pool', query_id, vec_id FROM p)
SELECT form, round(avg(CASE WHEN e.label = g.label THEN 1 ELSE 0 END), 6) AS precision, count(*) AS n FROM u JOIN embeddings e USING (vec_id) JOIN embeddings g ON g.vec_id = u.query_id GROUP BY 1"""


def family_split(s, d):
    return table(s, d, "part").select("p_partkey", F.substring_index(F.replace("p_name", F.lit(" "), F.lit(".")), ".", 1).alias("family"))


def image_counts(s, d):
    """Authoritative counts where stamped and above zero, else the number submitted; streams have none unless stamped."""
    stamped, sent = F.when(F.col("l_linenumber") % 3 == 0, L(F.col("l_quantity"))), L(F.col("l_linenumber"))
    n = F.when((F.col("l_returnflag") == "R") & stamped.isNull(), -1).otherwise(F.coalesce(stamped, sent))
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum(n).alias("n"))


QUAD_SQL = "SELECT l_orderkey, l_linenumber, round(l_quantity / 100, 6) AS x1, round((l_quantity + 7) / 100, 6) AS x2, round(l_linenumber * 2.0::DOUBLE / 50, 6) AS y1, round((l_linenumber * 2.0::DOUBLE + 3) / 50, 6) AS y2, round(coalesce(nullif(l_quantity, 1.0), 2.5) / 5, 6) AS scaled FROM lineitem"


QUERIES = {
    "trim_all": (trim_all, "SELECT p_partkey, p_brand AS brand, replace(p_name, ' ', '|') AS tokens FROM part"),
    "overflow_policy": (overflow_policy, "SELECT doc_id, CASE WHEN length(text) > 500 THEN 480 ELSE length(text) END::BIGINT AS n, length(text) > 500 AS cut FROM documents"),
    "geometry_guard": (geometry_guard, "SELECT l_orderkey, l_linenumber::BIGINT AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem WHERE l_quantity < 45) WHERE n = 1"),
    "privileged_terms": (privileged_terms, "SELECT user_id, string_agg(t, ',' ORDER BY t) AS terms FROM (SELECT DISTINCT user_id, upper(event_type) AS t FROM events WHERE value % 1 >= 0.5 AND event_type IN ('purchase', 'signup')) GROUP BY 1"),
    "safety_verdict": (safety_verdict, "SELECT conv_id, turn, turn % 3 = 2 AS unsafe FROM conversations"),
    "rerank_score_lookup": (score_lookup, LOOKUP_SQL),
    "rerank_rank_merge": (rank_merge, MERGE_SQL),
    "span_alignment": (span_alignment, None),
    "quad_boxes_lines": (quad_boxes_lines, QUAD_SQL),
    "token_alignment": (token_alignment, ALIGN_SQL),
    "relation_rows": (relation_rows, "SELECT n_name AS head, r_name AS tail, round(least(n_nationkey / 25.0::DOUBLE, 0.5), 6) AS score, row_number() OVER (PARTITION BY r_name ORDER BY round(least(n_nationkey / 25.0::DOUBLE, 0.5), 6) DESC, n_name) - 1 AS rank, r_regionkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')"),
    "placeholder_counts": (placeholder_counts, "SELECT lower(role) AS label, count(*) AS n FROM conversations GROUP BY 1"),
    "keyword_counts": (keyword_counts, "SELECT p_partkey, len(string_split(p_type, ' ')) AS n_primary, len(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: NOT list_contains(string_split(p_type, ' '), x))) AS n_secondary FROM part"),
    "preference_vector": (preference_vector, "WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) SELECT term, round(CASE WHEN length(term) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * ln((SELECT count(*) FROM part)::DOUBLE / count(DISTINCT p_partkey)), 6) AS weight FROM p GROUP BY 1"),
    "query_idf": (query_idf, IDF_SQL),
    "token_costs": (token_costs, "SELECT conv_id, greatest(sum(length(text)) // 4 - max(length(text)) // 4, 0)::BIGINT AS saved, greatest(1, sum(length(text)) // 4)::BIGINT AS estimate, (sum(length(text)) + 3 * max(length(text)))::BIGINT AS pair_cost FROM conversations GROUP BY 1"),
    "charged_calls": (charged_calls, "SELECT o_custkey, count(o_orderkey) = count(DISTINCT o_orderkey) AS unique_ids, count(DISTINCT o_orderstatus) = 1 AS one_version FROM orders GROUP BY 1"),
    "token_span_means": (token_span_means, SPANMEAN_SQL),
    "top_tags": (top_tags, TAG_SQL),
    "term_shortlist": (term_shortlist, "SELECT doc_id, " + " + ".join(f"contains(text, '{t}')::BIGINT" for t in ("the", "and", "token", "License", "que", "der")) + " AS n FROM documents ORDER BY n DESC, doc_id LIMIT 10"),
    "lexical_ranking": (lexical_ranking, "WITH c AS (SELECT c_custkey, abs(c_acctbal - 5000) AS distance, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END AS second FROM customer ORDER BY distance, c_custkey LIMIT 40) SELECT c_custkey, row_number() OVER (ORDER BY second ASC NULLS LAST, distance, c_custkey) - 1 AS rank FROM c"),
    "pick_worker": (pick_worker, "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000), md5(c_custkey::VARCHAR), c_custkey) AS n FROM customer) WHERE n = 1"),
    "lru_candidate": (lru_candidate, "SELECT user_id FROM (SELECT user_id, max(ts) AS seen FROM events WHERE user_id % 5 <> 0 GROUP BY 1) ORDER BY seen, user_id LIMIT 1"),
    "distance_from_score": (distance_from_score, f"SELECT query_id, vec_id, round(1 / (1 + score), 6) AS distance FROM ({COS_SQL})"),
    "quad_boxes": (quad_boxes, QUAD_SQL),
    "entity_markdown": (entity_markdown, MARKDOWN_SQL),
    "reading_order": (reading_order, "SELECT doc_id, instr(text, 'a') > 0 AND instr(text, 'e') > 0 AND instr(text, '.') > 0 AS found, instr(text, 'a') > 0 AND instr(text, 'e') > instr(text, 'a') AND instr(text, '.') > instr(text, 'e') AS ordered FROM documents"),
    "hash_floats": (hash_floats, "SELECT item_id, i, round(CAST('0x' || substr(sha256(item_id || ':' || i), 1, 8) AS BIGINT)::DOUBLE / 2147483648.0 - 1, 9) AS x FROM benchmark, range(4) t(i)"),
    "base64_capped": (base64_capped, "SELECT doc_id, length(to_base64(encode(text))) AS n, CASE WHEN length(to_base64(encode(text))) <= 4096 THEN text ELSE '' END AS back FROM documents"),
    "subtitle_documents": (subtitles, SRT_SQL),
    "timestamp_parse": (timestamp_parse, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 ELSE -1 END::BIGINT AS at FROM events"),
    "entity_properties": (entity_properties, "SELECT l_orderkey, l_returnflag AS label, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS texts FROM lineitem GROUP BY 1, 2"),
    "document_routing": (document_routing, f"SELECT page_id, CASE WHEN length(trim(t)) < 16 THEN 'url' WHEN length(t) > length(html) / 2 THEN 'text' ELSE 'markup' END AS route FROM (SELECT *, {_sql_plain('html')} AS t FROM pages)"),
    "product_search": (product_search, PRODUCT_SQL),
    "attribute_recommender": (attribute_recommender, RECOMMEND_SQL),
    "fraud_risk": (fraud_risk, f"""WITH {VQ.Q_SQL}, s AS (SELECT query_id, {VQ.COS} AS score FROM q, embeddings WHERE vec_id <> query_id), t AS (SELECT query_id, max(score) AS top FROM s WHERE score > 0.3 GROUP BY 1)
SELECT query_id, top, CASE WHEN top >= 0.6 THEN 'high' WHEN top >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM t"""),
    "retrieval_ablation": (retrieval_ablation, ABLATION_SQL),
    "family_split": (family_split, "SELECT p_partkey, string_split(p_name, ' ')[1] AS family FROM part"),
    "image_counts": (image_counts, "SELECT l_returnflag, sum(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::BIGINT WHEN l_returnflag = 'R' THEN -1 ELSE l_linenumber END)::BIGINT AS n FROM lineitem GROUP BY 1"),
}
