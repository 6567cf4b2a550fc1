"""2.7 Window functions and ranked selection, 2.8 sorts and top-k, 2.9 set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import ranking as K
from casebook.operators.aggregates import count_by
from casebook.plans.registry import query
from casebook.plans.shaping_q import RATINGS_SQL, ratings
from casebook.plans.sqlfn import rnd
from casebook.plans.tables import TICKETS_SQL, t, tickets


@query("win_dense_rank_topk", f"""
WITH {TICKETS_SQL}, c AS (SELECT precinct, code, count(*) AS n FROM tickets GROUP BY ALL)
SELECT * FROM (SELECT precinct, code, n, CAST(dense_rank() OVER (PARTITION BY precinct ORDER BY n DESC) AS INTEGER) AS rnk FROM c)
WHERE rnk <= 3""")
def win_dense_rank_topk(spark, d):
    c = count_by(tickets(spark, d), "precinct", "code")
    return K.topk_per_group(c, ["precinct"], [F.col("n").desc()], 3, ties="dense_rank")


# The three listed codes of the per-value top-k.
LISTED_CODES = ["click", "purchase", "error"]


@query("win_topk_per_value", f"""
WITH {TICKETS_SQL}, c AS (SELECT code, precinct, count(*) AS n FROM tickets
                          WHERE code IN ('click', 'purchase', 'error') GROUP BY ALL)
SELECT code, precinct, n, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY n DESC, precinct) AS INTEGER) AS rnk FROM c) WHERE rnk <= 5""")
def win_topk_per_value(spark, d):
    c = count_by(tickets(spark, d).where(F.col("code").isin(LISTED_CODES)), "code", "precinct")
    return K.topk_per_group(c, ["code"], [F.col("n").desc(), F.col("precinct")], 5)


@query("win_nth_ranked_group", f"""
WITH s AS (SELECT c_nationkey, c_mktsegment, sum(o_totalprice) AS total
           FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_mktsegment) AS rn FROM s)
SELECT c_nationkey, max(c_mktsegment) FILTER (WHERE rn = 1) AS rank1, max(c_mktsegment) FILTER (WHERE rn = 2) AS rank2,
       max(c_mktsegment) FILTER (WHERE rn = 3) AS rank3 FROM r GROUP BY c_nationkey""")
def win_nth_ranked_group(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    s = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_nationkey", "c_mktsegment") \
         .agg(F.sum("o_totalprice").alias("total"))
    return K.nth_ranked_wide(s, ["c_nationkey"], "c_mktsegment", [F.col("total").desc(), F.col("c_mktsegment")], 3)


@query("win_best_in_ranked_group", f"""
WITH j AS (SELECT c_nationkey, c_mktsegment, c_custkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey),
seg AS (SELECT c_nationkey, c_mktsegment, sum(o_totalprice) AS seg_total FROM j GROUP BY ALL),
segr AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY seg_total DESC, c_mktsegment) AS INTEGER) AS seg_rank FROM seg),
cust AS (SELECT c_nationkey, c_mktsegment, c_custkey, sum(o_totalprice) AS cust_total FROM j GROUP BY ALL),
custr AS (SELECT cust.*, seg_rank, row_number() OVER (PARTITION BY cust.c_nationkey, cust.c_mktsegment
                                                      ORDER BY cust_total DESC, c_custkey) AS cust_rank
          FROM cust JOIN segr USING (c_nationkey, c_mktsegment) WHERE seg_rank <= 2)
SELECT c_nationkey, seg_rank, c_mktsegment, c_custkey, {rnd("cust_total", 2)} AS cust_total FROM custr WHERE cust_rank = 1""")
def win_best_in_ranked_group(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    j = c.join(o, c.c_custkey == o.o_custkey).select("c_nationkey", "c_mktsegment", "c_custkey", "o_totalprice")
    seg = j.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("o_totalprice").alias("seg_total"))
    segr = K.topk_per_group(seg, ["c_nationkey"], [F.col("seg_total").desc(), F.col("c_mktsegment")], 2,
                            rank_name="seg_rank")
    cust = j.groupBy("c_nationkey", "c_mktsegment", "c_custkey").agg(F.sum("o_totalprice").alias("cust_total"))
    best = K.topk_per_group(cust.join(segr.select("c_nationkey", "c_mktsegment", "seg_rank"),
                                      ["c_nationkey", "c_mktsegment"]),
                            ["c_nationkey", "c_mktsegment"], [F.col("cust_total").desc(), F.col("c_custkey")], 1)
    return best.select("c_nationkey", "seg_rank", "c_mktsegment", "c_custkey",
                       F.round("cust_total", 2).alias("cust_total"))


@query("win_dedup_group_size", """
WITH x AS (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT k > 1 AS duplicated, count(*) AS n FROM x GROUP BY ALL""")
def win_dedup_group_size(spark, d):
    from casebook.operators.quality import group_size
    li = group_size(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return count_by(li.select((F.col("group_size") > 1).alias("duplicated")), "duplicated")


# ---- 2.8 sorts, limits, top-k ------------------------------------------------------------
@query("sort_topk_desc", """
SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey ORDER BY n_orders DESC, o_custkey LIMIT 10""")
def sort_topk_desc(spark, d):
    return count_by(t(spark, d, "orders"), "o_custkey", name="n_orders") \
        .orderBy(F.col("n_orders").desc(), "o_custkey").limit(10)


@query("sort_bottomk", f"""
WITH {RATINGS_SQL}, m AS (SELECT item, {rnd("avg(rating)", 6)} AS mean_rating FROM ratings GROUP BY item)
(SELECT item, mean_rating, 'top' AS "end" FROM m ORDER BY mean_rating DESC, item LIMIT 5)
UNION ALL
(SELECT item, mean_rating, 'bottom' AS "end" FROM m ORDER BY mean_rating ASC, item LIMIT 5)""")
def sort_bottomk(spark, d):
    m = ratings(spark, d).groupBy("item").agg(F.round(F.avg("rating"), 6).alias("mean_rating"))
    return K.top_bottom_k(m, "mean_rating", 5, tie=["item"])


@query("sort_multi_key", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mnth,
       CAST(day(o_orderdate) AS INTEGER) AS dy, count(*) AS n
FROM orders GROUP BY ALL ORDER BY yr DESC, mnth DESC, dy ASC""")
def sort_multi_key(spark, d):
    o = t(spark, d, "orders")
    return count_by(o, F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mnth"),
                    F.dayofmonth("o_orderdate").alias("dy")).orderBy(F.col("yr").desc(), F.col("mnth").desc(), "dy")


@query("sort_topk_excluding_invalid", f"""
WITH {TICKETS_SQL}
SELECT precinct, count(*) AS n FROM tickets WHERE precinct <> 0 GROUP BY precinct ORDER BY n DESC, precinct LIMIT 5""")
def sort_topk_excluding_invalid(spark, d):
    tk = tickets(spark, d).where(F.col("precinct") != 0)
    return count_by(tk, "precinct").orderBy(F.col("n").desc(), "precinct").limit(5)


@query("sort_nulls_last", """
WITH p AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value > 95) AS big,
                  count(*) FILTER (WHERE event_type = 'error') AS err FROM events GROUP BY user_id)
SELECT user_id, nullif(big, 0) AS big_purchases, err FROM p ORDER BY big_purchases DESC NULLS LAST, user_id LIMIT 10""")
def sort_nulls_last(spark, d):
    e = t(spark, d, "events")
    p = e.groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 95)).alias("big"),
                                 F.count_if(F.col("event_type") == "error").alias("err"))
    return p.select("user_id", F.nullif(F.col("big"), F.lit(0)).alias("big_purchases"), "err") \
            .orderBy(F.col("big_purchases").desc_nulls_last(), "user_id").limit(10)


# ---- 2.9 set operations ------------------------------------------------------------------
@query("set_union_all", """
SELECT '19' AS precinct_label, event_type, count(*) AS n FROM events WHERE user_id = 19 GROUP BY event_type
UNION ALL
SELECT '14' AS precinct_label, event_type, count(*) AS n FROM events WHERE user_id = 14 GROUP BY event_type""")
def set_union_all(spark, d):
    e = t(spark, d, "events")
    a = count_by(e.where(F.col("user_id") == 19), "event_type").select(F.lit("19").alias("precinct_label"), "event_type", "n")
    b = count_by(e.where(F.col("user_id") == 14), "event_type").select(F.lit("14").alias("precinct_label"), "event_type", "n")
    return a.unionAll(b)


@query("set_concat_by_name", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation
FROM customer
UNION ALL
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment, s_nationkey AS nation FROM supplier""")
def set_concat_by_name(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                       F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"),
                                       F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)
