"""Reports, mentions, boxes and receipts mapped to places; fixed-length encodings; clause search; costs before a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions import records
from vectrail.functions import text as X
from vectrail.functions import vectors as V
from vectrail.operators import backends, mapping
from vectrail.operators import blocks as B
from vectrail.operators import ranking as R
from vectrail.plans.span_queries import PATTERNS
from vectrail.plans.text_queries import TOK
from vectrail.session import table

REPORT, REPORT_OVERLAP = 1200, 100
DIMS, PLANES, TO, REPETITIONS = 64, 3, 8, 2
#: Rows of embeddings that make an item.
RUN = 8
SHORTLIST, BEST = 20, 3
EPSILON = 1e-9
#: Prices of a million tokens by verb.
PRICES = {"encode": 0.02, "extract": 0.1}


def L(c):
    return c.cast("long")


def report_spans(s, d):
    """Stretches of whole paragraphs of every document, blank lines made of its line ends."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    docs = table(s, d, "documents").select("doc_id", F.posexplode(mapping.report_spans(text, REPORT, REPORT_OVERLAP)).alias("place", "x"))
    return docs.select("doc_id", L(F.col("place")).alias("place"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def mentions_of(docs):
    """A mention from the middle of each text: two words in upper case, with four words on either side as its context."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    part = lambda a, n: F.array_join(F.slice("w", F.greatest(F.lit(1), a), n), " ")
    m = docs.select("doc_id", w.alias("w")).where(F.size("w") >= 12).withColumn("at", F.floor(F.size("w") / 2).cast("int"))
    return m.select(
        F.col("doc_id").alias("mention_id"), "doc_id", F.upper(part(F.col("at"), 2)).alias("mention"),
        part(F.col("at") - 4, 4).alias("context_left"), part(F.col("at") + 2, 4).alias("context_right"),
    )


def mention_alignment(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return mapping.align_mentions(docs, mentions_of(docs)).drop("mention_id")


def gap_neighbours(s, d):
    """Lines of an order as boxes; the first is a gap in the shelf, the others are price tags."""
    li = table(s, d, "lineitem").select(
        "l_orderkey", L(F.col("l_linenumber")).alias("line"), F.col("l_quantity").cast("double").alias("left"), (F.col("l_linenumber") % 3 * 10.0).alias("top"),
        F.lit(25.0).alias("width"), F.lit(12.0).alias("height"), F.col("l_discount").cast("double").alias("score"),
    )
    gaps = li.where("line = 1").withColumnRenamed("line", "gap")
    return mapping.near_gaps(li.where("line > 1").withColumnRenamed("line", "item"), gaps, image="l_orderkey", gap="gap", item="item")


def simhash_planes(s, d):
    planes = mapping.gaussian_planes(DIMS, PLANES, 0)
    e = table(s, d, "embeddings")
    return e.select("vec_id", L(mapping.simhash_bucket(F.col("embedding"), planes)).alias("bucket"))


def muvera_encoding(s, d):
    """Items (runs of vec_ids) as documents: one number of their encodings a row."""
    e = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / RUN).alias("item"), F.col("embedding").alias("v"))
    fde = mapping.fixed_encoding(e, dims=DIMS, planes=PLANES, to=TO, repetitions=REPETITIONS)
    return fde.select("item", F.posexplode("fde").alias("pos", "x")).select("item", L(F.col("pos")).alias("pos"), F.round("x", 5).alias("value"))


def _sides_sql(planes) -> list[str]:
    return [f"(list_dot_product(v, {p}::DOUBLE[]) > 0)::INT" for p in planes]


def _gray_sql(planes) -> str:
    """A Gray code's bits are xors of neighbours: the bit before the last one decides whether the next is turned."""
    out = "0"
    for side in _sides_sql(planes):
        out = f"(2 * {out} + xor({side}, {out} & 1))"
    return out


def _fde_sql() -> str:
    parts = []
    for r in range(REPETITIONS):
        rows = mapping.sign_projection(DIMS, TO, 1000 + r)
        shown = ", ".join(f"list_dot_product(v, {p}::DOUBLE[])" for p in rows)
        parts.append(f"SELECT item, {_gray_sql(mapping.gaussian_planes(DIMS, PLANES, r))} + {r * 2**PLANES} AS bucket, [{shown}] AS x FROM e")
    width = REPETITIONS * 2**PLANES * TO
    return f"""WITH e AS (SELECT vec_id // {RUN} AS item, embedding::DOUBLE[] AS v FROM embeddings), p AS ({' UNION ALL '.join(parts)}),
f AS (SELECT item, bucket * {TO} + i AS pos, avg(x[i + 1]) AS value FROM p, range({TO}) r(i) GROUP BY 1, 2)
SELECT i.item, r.pos, round(coalesce(value, 0), 5) AS value FROM (SELECT DISTINCT item FROM e) i CROSS JOIN range({width}) r(pos) LEFT JOIN f ON f.item = i.item AND f.pos = r.pos"""


def _padded_cosines(q, d):
    """Cosines with a small number added to a query's norm and to the product of norms, so that none is divided by zero."""
    import numpy as np

    scale = (np.linalg.norm(q, axis=1) + EPSILON)[:, None] * np.linalg.norm(d, axis=1)[None, :] + EPSILON
    return q @ d.T / scale


def clause_search(s, d):
    """The lines of documents nearest to each benchmark item (ids divisible by 50) by cosine, reranked by coverage; the best as one text."""
    items = table(s, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.col("text").alias("question"))
    q = items.select("item_id", X.hash_vector(F.col("question")).alias("query"))
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "clause")).where(F.trim("clause") != "")
    rows = lines.select("doc_id", "line", X.once(X.hash_vector(F.col("clause"))).alias("vector"))
    ids = ["doc_id", "line"]
    short = B.matrix_knn(q, rows, SHORTLIST, _padded_cosines, query_id="item_id", row_ids=("doc_id", "line"), vector="vector", name="cosine").drop("rank")
    texts = table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("lines")).join(short, "doc_id").join(items, "item_id")
    scored = texts.withColumn("clause", F.get("lines", F.col("line"))).withColumn("score", F.round(X.coverage(F.col("question"), F.col("clause")), 6))
    best = R.top_k(scored.drop("rank", "lines"), ["item_id"], [F.desc("score"), F.desc("cosine"), *ids], BEST)
    told = F.array_sort(F.collect_list(F.struct("rank", "clause", "score")))  # BEST rows
    return best.groupBy("item_id").agg(told.alias("t")).select(
        "item_id", L(F.size("t")).alias("n"), F.get("t", F.lit(0))["score"].alias("best"), F.md5(F.array_join(F.transform("t", lambda x: x["clause"]), "\n\n---\n\n")).alias("digest")
    )


_COUNTS = "SELECT {key}, CAST('0x' || substr(sha256(t), 63, 2) AS INT) % 64 AS b, count(*) AS n FROM (SELECT {key}, unnest({tok}) AS t FROM {rows}) GROUP BY ALL"
CLAUSE_SQL = f"""WITH items AS (SELECT item_id, text AS question FROM benchmark WHERE item_id % 50 = 0),
l AS (SELECT doc_id, i - 1 AS line, x[i] AS clause FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE trim(x[i]) <> ''),
lc AS ({_COUNTS.format(key='doc_id, line', tok=TOK.format('clause'), rows='l')}), qc AS ({_COUNTS.format(key='item_id', tok=TOK.format('question'), rows='items')}),
ln AS (SELECT doc_id, line, sqrt(sum(n * n)) AS norm FROM lc GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(n * n)) + {EPSILON} AS norm FROM qc GROUP BY ALL),
dp AS (SELECT item_id, doc_id, line, sum(lc.n * qc.n)::DOUBLE AS x FROM lc JOIN qc USING (b) GROUP BY ALL),
s AS (SELECT item_id, l.doc_id, l.line, round(coalesce(dp.x, 0) / (qn.norm * coalesce(ln.norm, 0) + {EPSILON}), 6) AS cosine FROM l CROSS JOIN items LEFT JOIN qn USING (item_id) LEFT JOIN ln USING (doc_id, line) LEFT JOIN dp USING (item_id, doc_id, line)),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id, line) AS r FROM s) WHERE r <= {SHORTLIST}),
e AS (SELECT a.*, clause, round(len(list_intersect(list_distinct({TOK.format('question')}), {TOK.format('clause')}))::DOUBLE / greatest(len(list_distinct({TOK.format('question')})), 1) + CASE WHEN contains(lower(clause), lower(question)) THEN 0.35 ELSE 0 END, 6) AS score
 FROM a JOIN l USING (doc_id, line) JOIN items USING (item_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, cosine DESC, doc_id, line) AS p FROM e)
SELECT item_id, count(*) AS n, max(score) AS best, md5(string_agg(clause, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p)) AS digest FROM f WHERE p <= {BEST} GROUP BY 1"""


def receipt_entities(s, d):
    """Texts anywhere in a record of parts, with their paths; numbers give none."""
    entry = lambda name: F.struct(F.col(name).alias("nm"), F.col("p_partkey").alias("cnt"))
    made = F.to_json(F.struct(F.array(entry("p_name"), entry("p_type")).alias("menu"), F.struct(F.struct(F.col("p_brand").alias("name")).alias("maker")).alias("total")))
    return table(s, d, "part").select("p_partkey", F.inline(records.json_entities(made)))


RECEIPT_SQL = """SELECT p_partkey, 'menu[0].nm' AS label, p_name AS text, 1.0::DOUBLE AS score FROM part UNION ALL SELECT p_partkey, 'menu[1].nm', p_type, 1.0::DOUBLE FROM part UNION ALL SELECT p_partkey, 'total.maker.name', p_brand, 1.0::DOUBLE FROM part"""


def cost_estimate(s, d):
    """What each verb would cost over a source's documents, from estimated tokens, before anything is run."""
    tokens = X.token_estimate(F.coalesce("text", F.lit("")))
    by = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("items"), F.sum(tokens).alias("tokens"))
    verbs = F.explode(F.array(*(F.struct(F.lit(v).alias("verb"), F.lit(p).alias("price")) for v, p in PRICES.items())))
    return by.select("source", "items", "tokens", verbs.alias("v")).select("source", "items", "tokens", F.col("v.verb").alias("verb"), F.round(F.col("tokens") * F.col("v.price") / 1e6, 6).alias("cost"))


COST_SQL = f"""SELECT source, items, tokens, verb, round(tokens * price / 1e6::DOUBLE, 6) AS cost FROM (SELECT source, count(*) AS items, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens FROM documents GROUP BY 1),
(VALUES {', '.join(f"('{v}', {p}::DOUBLE)" for v, p in PRICES.items())}) p(verb, price)"""


def ingest_enrichment(s, d):
    """Entities are extracted first; the text that is encoded is made of the distinct ones."""
    found = backends.extract(table(s, d, "documents").select("doc_id", "text"), PATTERNS)
    found = found.select("doc_id", X.once(F.col("entities")).alias("entities"))
    known = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["text"])))
    made = found.select("doc_id", L(F.size("entities")).alias("n_entities"), L(F.size(known)).alias("n_distinct"), F.array_join(known, " ").alias("text"))
    return backends.encode(made.where("n_entities > 0")).select("doc_id", "n_entities", "n_distinct", F.round(V.total(F.col("dense")), 6).alias("mass"))


ENRICH_SQL = f"""WITH x AS (SELECT doc_id, list_concat({', '.join(f"regexp_extract_all(text, '{p}')" for p in PATTERNS.values())}) AS e FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, len(e) AS n_entities, list_sort(list_distinct(e)) AS u FROM x WHERE len(e) > 0), t AS (SELECT *, array_to_string(u, ' ') AS body FROM k),
c AS ({_COUNTS.format(key='doc_id', tok=TOK.format('body'), rows='t')}), m AS (SELECT doc_id, sum(n) / sqrt(sum(n * n)) AS mass FROM c GROUP BY 1)
SELECT doc_id, n_entities, len(u) AS n_distinct, round(mass, 6) AS mass FROM t JOIN m USING (doc_id)"""


QUERIES = {
    "report_spans": (report_spans, None),
    "mention_alignment": (mention_alignment, None),
    "gap_neighbours": (gap_neighbours, None),
    "simhash_planes": (simhash_planes, f"SELECT vec_id, ({_gray_sql(mapping.gaussian_planes(DIMS, PLANES, 0))})::BIGINT AS bucket FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"),
    "muvera_encoding": (muvera_encoding, _fde_sql()),
    "clause_search": (clause_search, CLAUSE_SQL),
    "receipt_entities": (receipt_entities, RECEIPT_SQL),
    "cost_estimate": (cost_estimate, COST_SQL),
    "ingest_enrichment": (ingest_enrichment, ENRICH_SQL),
}
