"""2.5 Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import joins as J
from casebook.operators.aggregates import count_by
from casebook.plans.registry import query
from casebook.plans.sqlfn import rnd
from casebook.plans.tables import TICKETS_SQL, TRIPS_SQL, t, tickets, trips


@query("join_inner_diff_keys", f"""
SELECT c_mktsegment, count(*) AS n_orders, {rnd("sum(o_totalprice)", 2)} AS total
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def join_inner_diff_keys(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    j = c.join(o, c.c_custkey == o.o_custkey, "inner")
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"),
                                         F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_inner_same_key", """
WITH a AS (SELECT c_nationkey AS nationkey, count(*) AS n_customers FROM customer GROUP BY 1),
     b AS (SELECT s_nationkey AS nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1)
SELECT nationkey, n_customers, n_suppliers FROM a JOIN b USING (nationkey)""")
def join_inner_same_key(spark, d):
    a = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, "nationkey")


# Fine per violation code (literal dimension, three rows).
CODE_FINES = [("click", 55), ("view", 50), ("signup", 50)]


@query("join_broadcast_dim", f"""
WITH {TICKETS_SQL}, fines(code, fine) AS (VALUES ('click', 55), ('view', 50), ('signup', 50))
SELECT code, count(*) AS n, CAST(sum(fines.fine) AS BIGINT) AS total_fine
FROM (SELECT code FROM tickets) tk JOIN fines USING (code) GROUP BY code""")
def join_broadcast_dim(spark, d):
    fines = J.literal_dim(spark, CODE_FINES, "code string, fine int")
    j = J.join_dim(tickets(spark, d).select("code"), fines, "code")
    return j.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("fine").alias("total_fine"))


@query("join_anti_membership", """
SELECT count(*) AS n_unmatched FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def join_anti_membership(spark, d):
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    return J.anti_count(o, li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("join_semi_filter", """
SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 35) GROUP BY l_returnflag""")
def join_semi_filter(spark, d):
    li = t(spark, d, "lineitem")
    return count_by(J.keys_with_min_count(li, "l_partkey", 35), "l_returnflag")


@query("join_in_subquery_topk", """
SELECT event_type, CAST(hour(ts) AS INTEGER) AS hr, count(*) AS n FROM events
WHERE event_type IN (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 3)
GROUP BY ALL""")
def join_in_subquery_topk(spark, d):
    e = t(spark, d, "events")
    top = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "event_type") \
           .limit(3).select("event_type")
    return count_by(e.join(top, "event_type", "left_semi"), "event_type", F.hour("ts").alias("hr"))


@query("join_cross_scalar", f"""
WITH {TRIPS_SQL}
SELECT payment, count(*) AS n, (SELECT count(*) FROM trips) AS total,
       {rnd("100.0 * count(*) / (SELECT count(*) FROM trips)", 4)} AS pct
FROM trips GROUP BY payment""")
def join_cross_scalar(spark, d):
    tr = trips(spark, d)
    g = tr.groupBy("payment").agg(F.count(F.lit(1)).alias("n"))
    total = g.select(F.sum("n")).scalar()  # one-row scalar subquery over the groups: no join, no second scan
    return g.select("payment", "n", total.alias("total"), F.round(F.lit(100.0) * F.col("n") / total, 4).alias("pct"))


@query("join_cross_scalar_compare", f"""
WITH {TRIPS_SQL}
SELECT vendor, {rnd("avg(fare)", 4)} AS avg_fare, {rnd("(SELECT avg(fare) FROM trips)", 4)} AS overall_avg_fare,
       {rnd("avg(fare) - (SELECT avg(fare) FROM trips)", 4)} AS diff
FROM trips GROUP BY vendor""")
def join_cross_scalar_compare(spark, d):
    tr = trips(spark, d)
    g = tr.groupBy("vendor").agg(F.avg("fare").alias("_a"), F.sum("fare").alias("_s"), F.count("fare").alias("_n"))
    overall = g.select(F.try_divide(F.sum("_s"), F.sum("_n"))).scalar()      # from the groups: the join runs once
    return g.select("vendor", F.round("_a", 4).alias("avg_fare"), F.round(overall, 4).alias("overall_avg_fare"),
                    F.round(F.col("_a") - overall, 4).alias("diff"))


@query("join_outer_align", """
WITH a AS (SELECT c_nationkey AS nationkey, count(*) AS n_neg_balance FROM customer WHERE c_acctbal < 0 GROUP BY 1),
     b AS (SELECT s_nationkey AS nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1),
     c AS (SELECT c_nationkey AS nationkey, count(*) AS n_building FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT coalesce(a.nationkey, b.nationkey, c.nationkey) AS nationkey, n_neg_balance, n_suppliers, n_building
FROM a FULL JOIN b ON a.nationkey = b.nationkey FULL JOIN c ON coalesce(a.nationkey, b.nationkey) = c.nationkey""")
def join_outer_align(spark, d):
    cu, su = t(spark, d, "customer"), t(spark, d, "supplier")
    a = cu.where(F.col("c_acctbal") < 0).groupBy(F.col("c_nationkey").alias("nationkey")) \
          .agg(F.count(F.lit(1)).alias("n_neg_balance"))
    b = su.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    c = cu.where(F.col("c_mktsegment") == "BUILDING").groupBy(F.col("c_nationkey").alias("nationkey")) \
          .agg(F.count(F.lit(1)).alias("n_building"))
    return J.align_outer({"a": a, "b": b, "c": c}, ["nationkey"])


# Wide 0/1 mapping from part type to sector groups.
SECTOR_MAP = [
    ("ECONOMY", 1, 0, 0),
    ("PROMO", 1, 0, 0),
    ("SMALL", 0, 1, 0),
    ("MEDIUM", 0, 1, 0),
    ("LARGE", 0, 0, 1),
    ("STANDARD", 0, 0, 1),
]


@query("join_onehot_lookup", """
WITH m(p_type, Retail, Engineering, Heavy) AS (VALUES ('ECONOMY', 1, 0, 0), ('PROMO', 1, 0, 0), ('SMALL', 0, 1, 0),
        ('MEDIUM', 0, 1, 0), ('LARGE', 0, 0, 1), ('STANDARD', 0, 0, 1)),
long AS (SELECT p_type, 'Retail' AS sector FROM m WHERE Retail = 1
         UNION ALL SELECT p_type, 'Engineering' FROM m WHERE Engineering = 1
         UNION ALL SELECT p_type, 'Heavy' FROM m WHERE Heavy = 1)
SELECT sector, count(*) AS n_parts FROM part JOIN long USING (p_type) GROUP BY sector""")
def join_onehot_lookup(spark, d):
    mapping = J.literal_dim(spark, SECTOR_MAP, "p_type string, Retail int, Engineering int, Heavy int")
    long = J.onehot_mapping_long(mapping, "p_type", "sector")
    return count_by(t(spark, d, "part").join(F.broadcast(long), "p_type"), "sector", name="n_parts")


_SCORE = "round(((doc_id * 37) % 101) / 100.0, 2)"


def _scored(spark, d):
    lab = t(spark, d, "labels")
    return lab.select("doc_id", F.col("quality").alias("label"),
                      F.round(((F.col("doc_id") * 37) % 101) / 100.0, 2).alias("score"))


@query("join_reattach_ids", f"""
SELECT l.doc_id, lang, source, {_SCORE} AS score, CASE WHEN {_SCORE} > 0.5 THEN 1 ELSE 0 END AS predicted
FROM labels l JOIN documents USING (doc_id)""")
def join_reattach_ids(spark, d):
    s = _scored(spark, d)
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    # ids travel with the predictions; the join is by id, never by position
    return s.join(docs, "doc_id").select("doc_id", "lang", "source", "score",
                                         (F.col("score") > 0.5).cast("int").alias("predicted"))


@query("join_model_outputs", """
WITH m1 AS (SELECT doc_id, CASE WHEN ((doc_id * 37) % 101) > 50 THEN 1 ELSE 0 END AS pred_a FROM labels),
     m2 AS (SELECT doc_id, CASE WHEN ((doc_id * 53) % 97) > 40 THEN 1 ELSE 0 END AS pred_b FROM labels),
     m3 AS (SELECT doc_id, CASE WHEN ((doc_id * 29) % 89) > 60 THEN 1 ELSE 0 END AS pred_c FROM labels)
SELECT l.doc_id, quality AS actual, pred_a, pred_b, pred_c
FROM labels l JOIN m1 USING (doc_id) JOIN m2 USING (doc_id) JOIN m3 USING (doc_id)""")
def join_model_outputs(spark, d):
    lab = t(spark, d, "labels")
    m1 = lab.select("doc_id", (((F.col("doc_id") * 37) % 101) > 50).cast("int").alias("pred_a"))
    m2 = lab.select("doc_id", (((F.col("doc_id") * 53) % 97) > 40).cast("int").alias("pred_b"))
    m3 = lab.select("doc_id", (((F.col("doc_id") * 29) % 89) > 60).cast("int").alias("pred_c"))
    return lab.select("doc_id", F.col("quality").alias("actual")).join(m1, "doc_id").join(m2, "doc_id").join(m3, "doc_id")
