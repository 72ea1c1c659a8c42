"""Queries over the star schema, labels and events: filters, aggregates, metrics, profiles, ordered streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.operators import ranking as R
from vectrail.operators.mapping import shared_width
from vectrail.operators.tables import bucket_passes, upsert
from vectrail.session import table


def L(c):
    return c.cast("long")


def _ev(s, d) -> DataFrame:
    return table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


EV = "e AS (SELECT *, (props::JSON->>'$.k')::BIGINT AS k FROM events)"
SPLIT = "2024-01-20"
#: Width of a line taken as a box.
SHELF = 20.0


def ilike_order_limit(s, d):
    c = table(s, d, "customer").where(F.col("c_name").ilike("%00%"))
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_name", "c_acctbal")


def filter_with_fallback(s, d):
    """Customers of a segment whose name holds a text; where none does, the segment."""
    c = table(s, d, "customer").withColumn("hit", F.lower("c_name").contains("zzz") & (F.col("c_mktsegment") == "BUILDING"))
    anyhit = c.agg(F.max("hit").alias("any_hit"))
    return c.crossJoin(F.broadcast(anyhit)).where(F.when(F.col("any_hit"), F.col("hit")).otherwise(F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name")


def compound_filter(s, d):
    return table(s, d, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_totalprice")


def required_rows(s, d):
    toks = F.split("p_name", " ")
    ok = F.col("p_name").isNotNull() & (F.size(toks) > 0) & ~F.exists(toks, lambda x: x.isNull() | (x == "")) & (F.col("p_size") > 0)
    return table(s, d, "part").where(ok).select("p_partkey", L(F.size(toks)).alias("n_tokens"))


def array_membership(s, d):
    allowed = [str(i) for i in range(10)]
    digits = F.filter(F.split(F.col("c_custkey").cast("string"), ""), lambda x: x != "")
    return table(s, d, "customer").where(F.forall(digits, lambda x: x.isin(allowed[:6]))).select("c_custkey")


def upsert_suppliers(s, d):
    t = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    fresh = t.where("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0)).unionByName(
        t.where("s_acctbal > 9000").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), "s_name", "s_acctbal"))
    return upsert(t, fresh, ["s_suppkey"])


def named_index(s, d):
    """Two entries a row, short and long, blanks left out."""
    p = table(s, d, "part").select("p_partkey", F.expr("stack(2, 'short', p_brand, 'long', p_name) AS (kind, body)"))
    return p.where(F.trim("body") != "").select(F.concat_ws("::", F.col("p_partkey").cast("string"), "kind").alias("id"), "body")


def enrichment_merge(s, d):
    words = F.transform(F.filter(F.split("p_name", " "), lambda x: F.length(x) > 4), lambda x: F.upper(x))
    p = table(s, d, "part")
    return p.select("p_partkey", "p_brand").join(p.select("p_partkey", F.array_join(words, "|").alias("entities")), "p_partkey", "left")


def cart_totals(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("total"))


def multiset_equality(s, d):
    """Whether lists are equal as multisets: orders and the orders of lines; the customers of orders and all customers."""
    o, c = table(s, d, "orders"), table(s, d, "customer")
    lists = {
        "orders_of_lines": (o.select(F.col("o_orderkey").alias("v")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("v")).distinct()),
        "orders_of_customers": (o.select(F.col("o_custkey").alias("v")), c.select(F.col("c_custkey").alias("v"))),
    }
    signed = None
    for name, (a, b) in lists.items():
        for side, n in ((a, 1), (b, -1)):
            part = side.select(F.lit(name).alias("name"), "v", F.lit(n).cast("long").alias("n"))
            signed = part if signed is None else signed.unionByName(part)
    odd = signed.groupBy("name", "v").agg(F.sum("n").alias("n"))
    return odd.groupBy("name").agg(F.sum((F.col("n") != 0).cast("long")).alias("n_odd"), (F.sum(F.abs("n")) == 0).alias("equal"))


def top_counts(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").count()
    return o.orderBy(F.desc("count"), "o_custkey").limit(10).select("o_custkey", F.col("count").alias("n"))


def count_by_key(s, d):
    return _ev(s, d).groupBy("event_type").agg(F.count("*").alias("n"), L(F.countDistinct("user_id")).alias("n_users"))


def percentiles(s, d):
    """Percentiles with the straight line between the two values at a fractional place."""
    ps = {"p50": 0.5, "p95": 0.95}
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ends = {f"{n}_{side}": cut(place(p)) for n, p in ps.items() for side, cut in (("low", F.floor), ("high", F.ceil))}
    at = R.values_at(_ev(s, d), "event_type", "value", ends)

    def line(n):
        part = place(ps[n]) - F.floor(place(ps[n]))
        return F.round(F.col(f"{n}_low") * (1 - part) + F.col(f"{n}_high") * part, 6).alias(n)

    return at.select("event_type", *(line(n) for n in ps))


def floor_percentiles(s, d):
    """sorted[int(p / 100 * (n - 1))]; -1 under ten samples."""
    ps = {"p50": 0.5, "p95": 0.95}
    at = R.values_at(_ev(s, d), "event_type", "value", {n: F.floor(F.lit(p) * (F.col("n") - 1)) for n, p in ps.items()})
    return at.select("event_type", *(F.when(F.col("n") >= 10, F.round(n, 6)).otherwise(-1.0).alias(n) for n in ps))


def rolling_mean(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-49, 0)
    return _ev(s, d).select("event_id", F.round(F.avg("value").over(w), 9).alias("mean_50"), L(F.count("*").over(w)).alias("n"))


def rolling_percentile(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-199, 0)
    return _ev(s, d).select("event_id", F.round(F.percentile("value", 0.5).over(w), 6).alias("p50"))


def guarded_sum(s, d):
    """Sums that hold only where every part is there."""
    x = F.when(F.col("l_discount") > 0.005, F.col("l_quantity"))
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(x).alias("m"), F.sum(x).alias("total"))
    return g.select("l_orderkey", F.when(F.col("n") == F.col("m"), F.col("total")).otherwise(-1.0).alias("total"))


def label_collapse(s, d):
    """Labels beyond the most frequent 20 become ``other``."""
    c = _ev(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "user_id").limit(20).select("user_id", F.lit(True).alias("named"))
    j = c.join(top, "user_id", "left").withColumn("label", F.when(F.col("named"), F.col("user_id").cast("string")).otherwise("other"))
    return j.groupBy("label").agg(F.sum("n").alias("n"))


def collect_sets(s, d):
    return _ev(s, d).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


def best_per_key(s, d):
    b = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("l_partkey"), F.max("l_extendedprice").alias("price"))
    return b


def term_weighted_score(s, d):
    t = table(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"), F.lit(1.0).alias("w"))
    li = table(s, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.count("*").alias("n"))
    j = t.join(li, t["p_partkey"] == li["l_partkey"]).groupBy("p_partkey").agg(F.round(F.sum(F.col("w") * F.col("q")) / F.max("n"), 6).alias("score"))
    return R.top_k(j.withColumn("all", F.lit(1)), ["all"], [F.desc("score"), F.asc("p_partkey")], 25).select("p_partkey", "score", L(F.col("rank")).alias("rank"))


def tfidf_features(s, d):
    p = table(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    n = p.select("p_partkey").distinct().count()
    df = p.distinct().groupBy("term").agg(F.count("*").alias("df"))
    tf = p.groupBy("p_partkey", "term").agg(F.count("*").alias("tf"))
    size = p.groupBy("p_partkey").agg(F.count("*").alias("size"))
    return tf.join(df, "term").join(size, "p_partkey").select("p_partkey", "term", F.round(F.col("tf") / F.col("size") * F.log(F.lit(float(n)) / F.col("df")), 6).alias("weight"))


def macro_f1_quality(s, d):
    """A length rule against the quality labels: precision, recall and F1 of each class, then their means."""
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))
    per = None
    for c in (0, 1):
        a = x.agg(*(F.sum(((F.col("p") == pp) & (F.col("y") == yy)).cast("int")).alias(n) for n, pp, yy in (("tp", c, c), ("fp", c, 1 - c), ("fn", 1 - c, c)))).withColumn("c", F.lit(c))
        per = a if per is None else per.unionByName(a)
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    per = per.select(p.alias("p"), r.alias("r"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f"))
    return per.agg(F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("f"), 6).alias("f1"))


def hierarchical_f1(s, d):
    """Ancestor overlap of region > nation > segment paths; the prediction is the next nation's path."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    guess = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("g"), F.col("n_name").alias("g_name"), F.col("r_name").alias("g_region"))
    c = c.join(guess, (F.col("c_nationkey") + 1) % 25 == F.col("g"))
    prefixes = lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_join(F.slice(a, F.lit(1), i), " > "))
    truth, pred = prefixes(F.array("r_name", "n_name", "c_mktsegment")), prefixes(F.array("g_region", "g_name", "c_mktsegment"))
    x = c.select(F.size(F.array_intersect(truth, pred)).alias("common"), F.size(pred).alias("np"), F.size(truth).alias("nt")).agg(F.sum("common").alias("c"), F.sum("np").alias("np"), F.sum("nt").alias("nt"))
    p, rc = F.col("c") / F.col("np"), F.col("c") / F.col("nt")
    return x.select(F.round(p, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.when(p + rc == 0, 0.0).otherwise(2 * p * rc / (p + rc)), 6).alias("f1"))


def per_level_accuracy(s, d):
    """Share of customers whose region (level 1) and nation (level 2) the guess meets; lenient accepts either neighbour."""
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    g = n.select(F.col("n_nationkey").alias("g"), F.col("n_regionkey").alias("g_region"))
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("c_custkey") % 25 == F.col("g"))
    lenient = (F.abs(F.col("g") - F.col("n_nationkey")) <= 1).cast("int")
    return c.agg(F.round(F.avg((F.col("n_regionkey") == F.col("g_region")).cast("int")), 6).alias("level_1"), F.round(F.avg((F.col("g") == F.col("n_nationkey")).cast("int")), 6).alias("level_2"), F.round(F.avg(lenient), 6).alias("lenient"))


def profiles(s, d):
    return _ev(s, d).groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("verbs"), L(F.size(F.collect_set("k"))).alias("n_values"), F.count("*").alias("n"),
        F.round(F.sum("value"), 4).alias("total"))


def profile_novelty(s, d):
    """Events after the split whose verb or value their user's profile before it lacks, with an additive score."""
    e = _ev(s, d)
    prof = e.where(F.col("ts") < SPLIT).groupBy("user_id").agg(F.collect_set("event_type").alias("verbs"), F.collect_set("k").alias("ks"))
    j = e.where(F.col("ts") >= SPLIT).join(prof, "user_id", "left")
    new_verb = F.coalesce(~F.array_contains("verbs", F.col("event_type")), F.lit(True)).cast("int")
    new_k = F.coalesce(~F.array_contains("ks", F.col("k")), F.lit(True)).cast("int")
    unknown = F.col("verbs").isNull().cast("int")
    score = F.least(F.lit(1.0), 0.5 * unknown + 0.3 * new_verb + 0.25 * new_k)
    band = F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")
    return j.select("event_id", L(new_verb).alias("new_verb"), L(new_k).alias("new_value"), F.round(score, 6).alias("score"), band.alias("band"))


NOVEL_SQL = f"""WITH {EV}, p AS (SELECT user_id, list(DISTINCT event_type) AS verbs, list(DISTINCT k) AS ks FROM e WHERE ts < '{SPLIT}' GROUP BY 1),
f AS (SELECT event_id, CASE WHEN verbs IS NULL OR NOT list_contains(verbs, event_type) THEN 1 ELSE 0 END AS nv, CASE WHEN ks IS NULL OR NOT list_contains(ks, k) THEN 1 ELSE 0 END AS nk, CASE WHEN verbs IS NULL THEN 1 ELSE 0 END AS un
 FROM e LEFT JOIN p USING (user_id) WHERE ts >= '{SPLIT}'),
g AS (SELECT *, least(1.0::DOUBLE, 0.5::DOUBLE * un + 0.3::DOUBLE * nv + 0.25::DOUBLE * nk) AS s FROM f)
SELECT event_id, nv::BIGINT AS new_verb, nk::BIGINT AS new_value, round(s, 6) AS score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM g"""


def repeat_match_decay(s, d):
    """Each late event's strongest earlier match by its user: likeness halved every 14 days, at most 1."""
    e = _ev(s, d)
    old = e.where(F.col("ts") < SPLIT).groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max("k").alias("old_k"))
    late = e.where(F.col("ts") >= SPLIT).select("event_id", "user_id", F.col("event_type").alias("verb"), F.to_date("ts").alias("now"), "k")
    alike = 0.5 * (F.col("event_type") == F.col("verb")).cast("double") + 0.3 * (F.col("old_k") == F.col("k")).cast("double")
    decay = F.pow(F.lit(0.5), F.datediff("now", "day") / 14.0)
    return late.join(old, "user_id").groupBy("event_id").agg(F.round(F.least(F.lit(1.0), F.max(alike * decay)), 6).alias("strength"))


DECAY_SQL = f"""WITH {EV}, o AS (SELECT user_id, event_type, ts::DATE AS day, max(k) AS old_k FROM e WHERE ts < '{SPLIT}' GROUP BY 1, 2, 3),
l AS (SELECT event_id, user_id, event_type AS verb, ts::DATE AS now_day, k FROM e WHERE ts >= '{SPLIT}')
SELECT event_id, round(least(1.0, max((0.5::DOUBLE * CASE WHEN event_type = verb THEN 1 ELSE 0 END + 0.3::DOUBLE * CASE WHEN old_k = k THEN 1 ELSE 0 END) * pow(0.5::DOUBLE, date_diff('day', day, now_day) / 14.0::DOUBLE))), 6) AS strength
FROM l JOIN o USING (user_id) GROUP BY 1"""


def sequence_gaps(s, d):
    """Chunks of a stream by user: dropped if not after the last, gap if more than one step ahead, else ok."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.max("k").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(seen.isNull(), "first").when(F.col("k") <= seen, "dropped").when(F.col("k") > seen + 1, "gap").otherwise("ok")
    return _ev(s, d).select("event_id", kind.alias("kind"))


def stream_outcome(s, d):
    """Deltas in arrival order joined, time to the first and mean gap."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("d")))).alias("a"))
    return c.select("conv_id", F.array_join(F.transform("a", lambda x: x["d"]), "").alias("joined"), L(F.size("a")).alias("n"))


def ttl_active(s, d):
    """Users active at the end: seen within two days of it or with a large value ever."""
    e = _ev(s, d)
    end = e.agg(F.max("ts").alias("stop"))
    g = e.groupBy("user_id").agg(F.max("ts").alias("seen"), F.max("value").alias("most"))
    return g.crossJoin(F.broadcast(end)).select("user_id", ((F.col("seen") > F.expr("stop - INTERVAL 2 DAYS")) | (F.col("most") > 400)).alias("active"))


def token_bucket(s, d):
    """Requests by user in order against a bucket of 3 that refills one a day."""
    e = _ev(s, d).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return bucket_passes(e, "user_id", "at", "event_id").select("user_id", "n", "passed")


def cost_order(s, d):
    """Orders by cost, oldest first, while their running cost and number stay within a batch."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    o = table(s, d, "orders").withColumn("running", F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    return o.where(((F.col("running") <= 50000) & (F.col("n") <= 16)) | (F.col("n") == 1)).select("o_orderkey", L(F.col("n")).alias("place"))


def box_geometry(s, d):
    """Boxes made of line items: overlap of neighbours in an order, and the padded crop."""
    box = lambda p: [F.col(p + "l_quantity"), F.col(p + "l_linenumber") * 3.0, F.col(p + "l_quantity") + 12.0, F.col(p + "l_linenumber") * 3.0 + 5.0]
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    other = li.select("l_orderkey", F.col("l_linenumber").alias("o_l_linenumber"), F.col("l_quantity").alias("o_l_quantity"))
    j = li.join(other, "l_orderkey").where("o_l_linenumber = l_linenumber + 1")
    a, b = box(""), box("o_")
    overlap = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) / 12.0
    return j.select("l_orderkey", L(F.col("l_linenumber")).alias("line"), F.round(V.iou(a, b), 6).alias("iou"), F.round(overlap, 6).alias("overlap"), F.greatest(F.lit(0.0), F.rint(a[0] - 12.0 * 0.2)).alias("crop_left"))


BOX_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS x, l_linenumber * 3.0::DOUBLE AS y FROM lineitem),
j AS (SELECT a.l_orderkey, a.n, a.x AS ax, b.x AS bx, greatest(0, least(a.x + 12, b.x + 12) - greatest(a.x, b.x)) AS w, greatest(0, least(a.y + 5, b.y + 5) - greatest(a.y, b.y)) AS h FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.n = a.n + 1)
SELECT l_orderkey, n::BIGINT AS line, round(w * h / (120.0::DOUBLE - w * h), 6) AS iou, round(w / 12.0::DOUBLE, 6) AS overlap, greatest(0, round_even(ax - 12.0::DOUBLE * 0.2::DOUBLE, 0)) AS crop_left FROM j"""


def even_sampling(s, d):
    o = table(s, d, "documents").select("doc_id", F.explode(V.even_indexes(4, F.col("n_chars"))).alias("at"))
    return o.select("doc_id", L(F.col("at")).alias("at"))


def classification_rows(s, d):
    """Class scores as a map, flattened to rows above a threshold, best first."""
    v = F.col("c_acctbal") / 10000.0
    m = F.create_map(F.lit("poor"), 1 - v, F.lit("rich"), v, F.lit("other"), F.lit(0.05))
    c = table(s, d, "customer").select("c_custkey", F.explode(m).alias("label", "score")).where("score >= 0.4").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("c_custkey").orderBy(F.desc("score"), "label")
    return c.select("c_custkey", "label", "score", L(F.row_number().over(w) - 1).alias("rank"))


def obligations(s, d):
    """A SELECT with bound parameters over a view, as a scoped SQL tool runs it."""
    table(s, d, "orders").createOrReplaceTempView("vectrail_orders")
    return s.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM vectrail_orders WHERE o_orderpriority = :p GROUP BY o_orderstatus", args={"p": "1-URGENT"})


def event_normalise(s, d):
    """Events of two shapes as one: valid ids, known verbs, counted rejects by reason."""
    e = _ev(s, d)
    why = F.when(F.col("user_id").isNull(), "no user").when(~F.col("event_type").rlike("^[a-z_]+$"), "verb").when(F.col("value") < 0, "value").otherwise("ok")
    return e.groupBy(why.alias("verdict")).agg(F.count("*").alias("n"))


def vertical_pairs(s, d):
    """For each order the pair of lines, as boxes of ``SHELF`` width, of the largest shared width of 0.6 or more, then of the best scores less the gap."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("left"), F.col("l_discount").cast("double").alias("score"))
    b = li.select("l_orderkey", *(F.col(c).alias("b_" + c) for c in ("l_linenumber", "left", "score")))
    width = F.lit(SHELF)
    shared = F.round(shared_width([F.col("left"), width], [F.col("b_left"), width]), 6)
    gap = (F.col("b_l_linenumber") - F.col("l_linenumber")) * 10
    j = li.join(b, "l_orderkey").where("l_linenumber < b_l_linenumber").select(
        "l_orderkey", L(F.col("l_linenumber")).alias("a"), L(F.col("b_l_linenumber")).alias("b"), shared.alias("overlap"), F.round(F.col("score") + F.col("b_score") - gap / 10000, 6).alias("score")
    )
    best = R.top_k(j.where("overlap >= 0.6"), ["l_orderkey"], [F.desc("overlap"), F.desc("score"), F.asc("a"), F.asc("b")], 1)
    return best.select("l_orderkey", "a", "b", "overlap", "score")


VERTICAL_SQL = f"""WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS s FROM lineitem),
j AS (SELECT a.l_orderkey, a.n AS x, b.n AS y, round(greatest(0, least(a.x, b.x) + {SHELF} - greatest(a.x, b.x)) / {SHELF}, 6) AS overlap, round(a.s + b.s - (b.n - a.n) * 10 / 10000.0::DOUBLE, 6) AS score FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.n < b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY overlap DESC, score DESC, x, y) AS k FROM j WHERE overlap >= 0.6)
SELECT l_orderkey, x::BIGINT AS a, y::BIGINT AS b, overlap, score FROM r WHERE k = 1"""


def misses(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def taxonomy_paths(s, d):
    p = F.split("p_type", " ")
    return table(s, d, "part").select("p_partkey", F.element_at(p, -1).alias("leaf"), L(F.size(p)).alias("level"), F.coalesce(F.when(F.size(p) >= 2, F.array_join(F.slice(p, 1, 2), " > ")), F.lit("")).alias("prefix_2"))


MULTISET_SQL = """WITH u AS (SELECT 'orders_of_lines' AS name, o_orderkey AS v, 1 AS n FROM orders UNION ALL SELECT DISTINCT 'orders_of_lines', l_orderkey, -1 FROM lineitem
 UNION ALL SELECT 'orders_of_customers', o_custkey, 1 FROM orders UNION ALL SELECT 'orders_of_customers', c_custkey, -1 FROM customer),
g AS (SELECT name, v, sum(n) AS n FROM u GROUP BY 1, 2) SELECT name, count(*) FILTER (n <> 0) AS n_odd, bool_and(n = 0) AS equal FROM g GROUP BY 1"""


QUERIES = {
    "ilike_order_limit": (ilike_order_limit, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name ILIKE '%00%' ORDER BY c_acctbal DESC, c_custkey LIMIT 20"),
    "filter_with_fallback": (filter_with_fallback, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), 'zzz') OR NOT EXISTS (SELECT 1 FROM customer WHERE contains(lower(c_name), 'zzz') AND c_mktsegment = 'BUILDING'))"),
    "compound_filter": (compound_filter, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "required_rows": (required_rows, "SELECT p_partkey, len(string_split(p_name, ' ')) AS n_tokens FROM part WHERE p_name IS NOT NULL AND p_size > 0 AND NOT list_contains(string_split(p_name, ' '), '')"),
    "array_membership": (array_membership, "SELECT c_custkey FROM customer WHERE regexp_full_match(c_custkey::VARCHAR, '[0-5]+')"),
    "upsert": (upsert_suppliers, "SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000"),
    "named_index_rows": (named_index, "SELECT p_partkey || '::' || kind AS id, body FROM (SELECT p_partkey, 'short' AS kind, p_brand AS body FROM part UNION ALL SELECT p_partkey, 'long', p_name FROM part) WHERE trim(body) <> ''"),
    "enrichment_merge": (enrichment_merge, "SELECT p_partkey, p_brand, coalesce(list_aggregate(list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4), lambda x: upper(x)), 'string_agg', '|'), '') AS entities FROM part"),
    "cart_totals": (cart_totals, "SELECT l_orderkey, round(sum(l_quantity * l_extendedprice), 2) AS total FROM lineitem GROUP BY 1"),
    "multiset_equality": (multiset_equality, MULTISET_SQL),
    "top_counts": (top_counts, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10"),
    "count_by_key": (count_by_key, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1"),
    "pct_interp_by_type": (percentiles, "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1"),
    "pct_floor_by_type": (floor_percentiles, "WITH v AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1) SELECT event_type, CASE WHEN len(v) >= 10 THEN round(v[floor(0.5 * (len(v) - 1))::INT + 1], 6) ELSE -1 END AS p50, CASE WHEN len(v) >= 10 THEN round(v[floor(0.95 * (len(v) - 1))::INT + 1], 6) ELSE -1 END AS p95 FROM v"),
    "rolling_mean_50": (rolling_mean, "SELECT event_id, round(avg(value) OVER w, 9) AS mean_50, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"),
    "rolling_percentile_200": (rolling_percentile, "SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 6) AS p50 FROM events"),
    "guarded_sum": (guarded_sum, "SELECT l_orderkey, CASE WHEN count(*) = count(CASE WHEN l_discount > 0.005 THEN 1 END) THEN sum(l_quantity) ELSE -1 END AS total FROM lineitem GROUP BY 1"),
    "label_collapse": (label_collapse, "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT user_id FROM c ORDER BY n DESC, user_id LIMIT 20) SELECT CASE WHEN user_id IN (SELECT user_id FROM t) THEN user_id::VARCHAR ELSE 'other' END AS label, sum(n)::BIGINT AS n FROM c GROUP BY 1"),
    "collect_set_by_key": (collect_sets, "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1"),
    "best_per_key": (best_per_key, "SELECT l_orderkey, l_partkey, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1"),
    "term_weighted_score": (term_weighted_score, "WITH q AS (SELECT l_partkey, avg(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT p_partkey, round(len(string_split(p_name, ' ')) * q / n, 6) AS score FROM part JOIN q ON p_partkey = l_partkey), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS k FROM s) SELECT p_partkey, score, k - 1 AS rank FROM r WHERE k <= 25"),
    "tfidf_features": (tfidf_features, "WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part), d AS (SELECT term, count(DISTINCT p_partkey) AS df FROM p GROUP BY 1), t AS (SELECT p_partkey, term, count(*) AS tf FROM p GROUP BY 1, 2), z AS (SELECT p_partkey, count(*) AS size FROM p GROUP BY 1) SELECT p_partkey, term, round(tf::DOUBLE / size * ln((SELECT count(DISTINCT p_partkey) FROM p)::DOUBLE / df), 6) AS weight FROM t JOIN d USING (term) JOIN z USING (p_partkey)"),
    "macro_f1_quality": (macro_f1_quality, "WITH x AS (SELECT quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT c, sum(CASE WHEN p = c AND y = c THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p = c AND y <> c THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN p <> c AND y = c THEN 1 ELSE 0 END)::DOUBLE AS fn FROM x, (VALUES (0), (1)) t(c) GROUP BY 1), m AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1 FROM m"),
    "hier_f1_region": (hierarchical_f1, "WITH c AS (SELECT n.n_regionkey = g.n_regionkey AS r, n.n_nationkey = g.n_nationkey AS n FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation g ON (c_nationkey + 1) % 25 = g.n_nationkey), m AS (SELECT sum(CASE WHEN r THEN 1 ELSE 0 END)::DOUBLE / (3 * count(*)) AS p FROM c) SELECT round(p, 6) AS precision, round(p, 6) AS recall, round(p, 6) AS f1 FROM m"),
    "per_level_metrics": (per_level_accuracy, "SELECT round(avg(CASE WHEN n.n_regionkey = g.n_regionkey THEN 1 ELSE 0 END), 6) AS level_1, round(avg(CASE WHEN n.n_nationkey = g.n_nationkey THEN 1 ELSE 0 END), 6) AS level_2, round(avg(CASE WHEN abs(n.n_nationkey - g.n_nationkey) <= 1 THEN 1 ELSE 0 END), 6) AS lenient FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation g ON c_custkey % 25 = g.n_nationkey"),
    "behaviour_profiles": (profiles, f"WITH {EV} SELECT user_id, (SELECT string_agg(event_type, ',' ORDER BY event_type) FROM (SELECT DISTINCT event_type FROM e x WHERE x.user_id = e.user_id)) AS verbs, count(DISTINCT k) AS n_values, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY user_id"),
    "profile_novelty": (profile_novelty, NOVEL_SQL),
    "repeat_match_decay": (repeat_match_decay, DECAY_SQL),
    "sequence_gaps": (sequence_gaps, f"WITH {EV}, w AS (SELECT event_id, k, max(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e) SELECT event_id, CASE WHEN seen IS NULL THEN 'first' WHEN k <= seen THEN 'dropped' WHEN k > seen + 1 THEN 'gap' ELSE 'ok' END AS kind FROM w"),
    "stream_outcome": (stream_outcome, "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS joined, count(*) AS n FROM conversations GROUP BY 1"),
    "ttl_active": (ttl_active, "SELECT user_id, max(ts) > (SELECT max(ts) FROM events) - INTERVAL 2 DAY OR max(value) > 400 AS active FROM events GROUP BY 1"),
    "token_bucket": (token_bucket, """WITH RECURSIVE n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, ts, i, 2.0::DOUBLE AS left_over, 1::BIGINT AS passed FROM n WHERE i = 1 UNION ALL
 SELECT user_id, ts, i, CASE WHEN f >= 1 THEN f - 1 ELSE f END, passed + CASE WHEN f >= 1 THEN 1 ELSE 0 END FROM (SELECT n.user_id, n.ts, n.i, b.passed, least(3.0, b.left_over + (epoch_us(n.ts) - epoch_us(b.ts)) / 86400000000.0::DOUBLE) AS f FROM b JOIN n ON n.user_id = b.user_id AND n.i = b.i + 1))
SELECT user_id, max(i) AS n, max(passed) AS passed FROM b GROUP BY 1"""),
    "cost_order_batch": (cost_order, "WITH o AS (SELECT *, sum(o_totalprice) OVER w AS running, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT o_orderkey, n AS place FROM o WHERE (running <= 50000 AND n <= 16) OR n = 1"),
    "box_geometry": (box_geometry, BOX_SQL),
    "even_sampling": (even_sampling, "SELECT doc_id, (i * n_chars) // 4 AS at FROM documents, range(4) t(i)"),
    "classification_rows": (classification_rows, "WITH v AS (SELECT c_custkey, c_acctbal / 10000.0::DOUBLE AS v FROM customer), u AS (SELECT c_custkey, 'poor' AS label, round(1 - v, 6) AS score FROM v WHERE 1 - v >= 0.4 UNION ALL SELECT c_custkey, 'rich', round(v, 6) FROM v WHERE v >= 0.4) SELECT c_custkey, label, score, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, label) - 1 AS rank FROM u"),
    "scoped_sql": (obligations, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"),
    "event_validation": (event_normalise, "SELECT CASE WHEN user_id IS NULL THEN 'no user' WHEN NOT regexp_full_match(event_type, '[a-z_]+') THEN 'verb' WHEN value < 0 THEN 'value' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1"),
    "vertical_pairs": (vertical_pairs, VERTICAL_SQL),
    "anti_join_misses": (misses, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "taxonomy_paths": (taxonomy_paths, "SELECT p_partkey, string_split(p_type, ' ')[-1] AS leaf, len(string_split(p_type, ' ')) AS level, CASE WHEN len(string_split(p_type, ' ')) >= 2 THEN string_split(p_type, ' ')[1] || ' > ' || string_split(p_type, ' ')[2] ELSE '' END AS prefix_2 FROM part"),
}
