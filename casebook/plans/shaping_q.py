"""2.2 Projection and column shaping, 2.12 row-wise math."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.rowmath import row_max, row_sum
from casebook.operators import columns as C
from casebook.plans.registry import query
from casebook.plans.sqlfn import rnd, rnd_even
from casebook.plans.tables import t


@query("proj_normalize_names", """
SELECT o_orderkey AS order_key, o_orderstatus AS order_status, o_orderpriority AS order_priority FROM orders""")
def proj_normalize_names(spark, d):
    raw = t(spark, d, "orders").select(F.col("o_orderkey").alias("order key"), F.col("o_orderstatus").alias("order status"),
                                       F.col("o_orderpriority").alias("order priority"))
    return C.normalize_names(raw)


@query("proj_rename_map", """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS balance FROM customer""")
def proj_rename_map(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return C.rename(c, {"c_custkey": "customer_id", "c_name": "customer_name", "c_acctbal": "balance"})


@query("proj_select_alias", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS Year, o_orderkey FROM orders""")
def proj_select_alias(spark, d):
    return t(spark, d, "orders").select(F.year("o_orderdate").alias("Year"), "o_orderkey")


@query("proj_drop_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus
FROM lineitem""")
def proj_drop_columns(spark, d):
    return t(spark, d, "lineitem").drop("l_discount", "l_tax", "l_shipdate")


@query("proj_columns_by_pattern", """
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem""")
def proj_columns_by_pattern(spark, d):
    li = t(spark, d, "lineitem")
    return C.select_by_pattern(li, suffix=["key"], contains=["price"])


@query("proj_cast", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, CAST(trunc(o_totalprice) AS INTEGER) AS price_int,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority
FROM orders""")
def proj_cast(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"),
                    F.col("o_totalprice").cast("int").alias("price_int"),
                    F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority"))


@query("proj_unit_scale", """
SELECT o_orderkey, o_totalprice / 1000000.0 AS price_musd FROM orders""")
def proj_unit_scale(spark, d):
    return t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / F.lit(1e6)).alias("price_musd"))


@query("proj_derived_ratio", f"""
SELECT l_orderkey, l_linenumber, {rnd("l_extendedprice / nullif(l_tax, 0)", 4)} AS price_per_tax FROM lineitem""")
def proj_derived_ratio(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    return C.derived_ratio(li, "price_per_tax", "l_extendedprice", "l_tax", digits=4)


@query("proj_constant_label", """
SELECT '19' AS precinct_label, o_orderkey, o_orderstatus FROM orders""")
def proj_constant_label(spark, d):
    return t(spark, d, "orders").select(F.lit("19").alias("precinct_label"), "o_orderkey", "o_orderstatus")


# ---- 2.12 row-wise math ---------------------------------------------------------------
@query("math_round", f"""
SELECT l_quantity / 4 AS x, {rnd("l_quantity / 4", 1)} AS half_up, {rnd_even("l_quantity / 4", 1)} AS half_even,
       count(*) AS n
FROM lineitem GROUP BY ALL""")
def math_round(spark, d):
    li = t(spark, d, "lineitem")
    x = F.col("l_quantity") / 4
    return li.groupBy(x.alias("x"), F.round(x, 1).alias("half_up"), F.bround(x, 1).alias("half_even")) \
             .agg(F.count(F.lit(1)).alias("n"))


@query("math_row_sum", """
SELECT l_orderkey, l_linenumber,
       l_quantity + l_tax * 100 + coalesce(nullif(l_linenumber, 4), 0) AS row_total FROM lineitem""")
def math_row_sum(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     row_sum([F.col("l_quantity"), F.col("l_tax") * 100,
                              F.nullif(F.col("l_linenumber"), F.lit(4))]).alias("row_total"))


@query("math_row_max", """
SELECT l_orderkey, l_linenumber, greatest(l_tax, l_discount) AS row_max FROM lineitem""")
def math_row_max(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", row_max(["l_tax", "l_discount"]).alias("row_max"))


RATINGS_SQL = f"""ratings AS (
  SELECT o_custkey AS usr, p_brand AS item, {rnd("avg(l_quantity) / 10", 4)} AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey, p_brand)"""


def ratings(spark, d):
    """Long ratings (usr, item, rating) from lineitem ⋈ orders ⋈ part."""
    li, o, p = t(spark, d, "lineitem"), t(spark, d, "orders"), t(spark, d, "part")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("o_custkey").alias("usr"), F.col("p_brand").alias("item")) \
            .agg(F.round(F.avg("l_quantity") / 10, 4).alias("rating"))


@query("math_mean_center", f"""
WITH {RATINGS_SQL}
SELECT usr, item, {rnd("rating - avg(rating) OVER (PARTITION BY usr)", 8)} AS centred FROM ratings""")
def math_mean_center(spark, d):
    from casebook.operators.recommend import centre
    r = centre(ratings(spark, d), "usr", "rating", "c")
    return r.select("usr", "item", F.round("c", 8).alias("centred"))
