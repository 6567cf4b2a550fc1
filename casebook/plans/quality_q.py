"""2.14 Data profiling, deduplication, missing values and outliers.

The driver tables have no NULLs, so the missing-value queries inject them with
the same expressions in Spark and in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import quality as Q
from casebook.operators.aggregates import count_by
from casebook.plans.registry import query
from casebook.plans.sqlfn import cnt_if, rnd
from casebook.plans.tables import t

LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _orders_with_nulls(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("o_orderdate"),
                    F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))


ORDERS_NULLS_SQL = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS o_orderdate,
  nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)"""


def _lines_with_nulls(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_returnflag", "l_quantity",
                     F.nullif(F.col("l_linenumber"), F.lit(4)).alias("line_no"),
                     F.when(F.col("l_quantity") > 45, F.col("l_tax")).alias("sparse_tax"))


LINES_NULLS_SQL = """x AS (SELECT l_orderkey, l_returnflag, l_quantity, nullif(l_linenumber, 4) AS line_no,
  CASE WHEN l_quantity > 45 THEN l_tax END AS sparse_tax FROM lineitem)"""


@query("dq_shape", """SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem""")
def dq_shape(spark, d):
    li = t(spark, d, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(li.columns)).alias("n_cols"))


@query("dq_schema_info", f"""
WITH {ORDERS_NULLS_SQL}
SELECT * FROM (VALUES ('o_orderkey', (SELECT count(o_orderkey) FROM o), 'bigint', 1),
  ('o_custkey', (SELECT count(o_custkey) FROM o), 'bigint', 2),
  ('o_orderstatus', (SELECT count(o_orderstatus) FROM o), 'string', 3),
  ('o_totalprice', (SELECT count(o_totalprice) FROM o), 'double', 4),
  ('o_orderdate', (SELECT count(o_orderdate) FROM o), 'timestamp_ntz', 5),
  ('o_orderpriority', (SELECT count(o_orderpriority) FROM o), 'string', 6)) v("column", non_null, dtype, position)""")
def dq_schema_info(spark, d):
    return Q.schema_info(_orders_with_nulls(spark, d))


def _describe_sql(table: str, cols, pcts=()):
    parts = []
    for c in cols:
        sel = [f"'{c}' AS \"column\"", f"CAST(count({c}) AS DOUBLE) AS count", f"{rnd(f'avg({c})', 4)} AS mean",
               f"{rnd(f'stddev_samp({c})', 4)} AS std", f"CAST(min({c}) AS DOUBLE) AS min", f"CAST(max({c}) AS DOUBLE) AS max"]
        sel += [f"{rnd(f'quantile_cont({c}, {p})', 4)} AS p{int(round(p * 100))}" for p in pcts]
        parts.append(f"SELECT {', '.join(sel)} FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("dq_describe", _describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def dq_describe(spark, d):
    return Q.describe(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("dq_describe_percentiles", _describe_sql("orders", ["o_totalprice"], [0.25, 0.5, 0.75, 0.9, 0.99]))
def dq_describe_percentiles(spark, d):
    return Q.describe(t(spark, d, "orders"), ["o_totalprice"], percentiles=[0.25, 0.5, 0.75, 0.9, 0.99])


_O_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("dq_null_count", f"""
WITH {ORDERS_NULLS_SQL}
SELECT * FROM (VALUES {", ".join(f"('{c}', (SELECT {cnt_if(f'{c} IS NULL')} FROM o))" for c in _O_COLS)}) v("column", n_null)""")
def dq_null_count(spark, d):
    return Q.null_profile(_orders_with_nulls(spark, d)).select("column", "n_null")


@query("dq_null_percent", f"""
WITH {ORDERS_NULLS_SQL}, p AS (SELECT * FROM (VALUES {", ".join(f"('{c}', (SELECT {cnt_if(f'{c} IS NULL')} FROM o))" for c in _O_COLS)}) v("column", n_null))
SELECT "column", n_null, {rnd("100.0 * n_null / (SELECT count(*) FROM o)", 2)} AS null_pct FROM p WHERE n_null > 0""")
def dq_null_percent(spark, d):
    return Q.null_profile(_orders_with_nulls(spark, d), min_pct=0).orderBy(F.col("null_pct").desc())


@query("dq_drop_sparse_columns", f"""
WITH {LINES_NULLS_SQL} SELECT l_orderkey, l_returnflag, l_quantity, line_no FROM x""")
def dq_drop_sparse_columns(spark, d):
    kept, _dropped = Q.drop_sparse(_lines_with_nulls(spark, d), 60.0)
    return kept


@query("dq_constant_columns", """
SELECT * FROM (VALUES
  ('o_orderkey', (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders), (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders)),
  ('o_orderstatus', (SELECT min(o_orderstatus) FROM orders), (SELECT max(o_orderstatus) FROM orders)),
  ('o_orderpriority', (SELECT min(o_orderpriority) FROM orders), (SELECT max(o_orderpriority) FROM orders)),
  ('source', 'tpch', 'tpch')) v("column", min_value, max_value)
SELECT "column", min_value, max_value, min_value = max_value AS is_constant FROM v""".replace(
    ") v(\"column\", min_value, max_value)\nSELECT", ") v(\"column\", min_value, max_value)) SELECT").replace(
    "SELECT * FROM (VALUES", "WITH v AS (SELECT * FROM (VALUES", 1))
def dq_constant_columns(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("tpch").alias("source"))
    return Q.constant_columns(o)


@query("dq_drop_constant_columns", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def dq_drop_constant_columns(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("tpch").alias("source"))
    return Q.drop_constant(o)[0]


_FLAGS_SQL = """x AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity >= 3 AS bulk, CASE WHEN l_linenumber > 6 THEN l_linenumber END AS last_line,
                   CASE WHEN l_tax > 0.07 THEN 'high' ELSE 'plain' END AS tax_class FROM lineitem)"""


def _flags(spark, d):
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", (F.col("l_quantity") >= 3).alias("bulk"),
        F.when(F.col("l_linenumber") > 6, F.col("l_linenumber")).alias("last_line"),
        F.when(F.col("l_tax") > 0.07, "high").otherwise("plain").alias("tax_class"))


def _dominant_sql(share: float) -> str:
    cols = ["l_orderkey", "l_returnflag", "l_linestatus", "bulk", "last_line", "tax_class"]
    one = lambda c: f"""SELECT '{c}' AS "column", value, n, {rnd("n / total", 4)} AS share FROM (
  SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, sum(count(*)) OVER () AS total FROM x WHERE {c} IS NOT NULL GROUP BY 1)
  WHERE n >= {share} * total QUALIFY row_number() OVER (ORDER BY n DESC, value) = 1"""  # noqa: E731
    return f"WITH {_FLAGS_SQL} " + " UNION ALL ".join(f"({one(c)})" for c in cols)


@query("dq_dominant_values", _dominant_sql(0.8))
def dq_dominant_values(spark, d):
    return Q.dominant_values(_flags(spark, d), 0.8)


@query("dq_drop_dominant", f"WITH {_FLAGS_SQL} SELECT l_orderkey, l_returnflag, l_linestatus FROM x")
def dq_drop_dominant(spark, d):
    return Q.drop_dominant(_flags(spark, d), 0.8)[0]


@query("dq_iqr_filter_heavy_tail", """
WITH h AS (SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 97 = 0 THEN 12 WHEN o_orderkey % 89 = 0 THEN -5 ELSE 1 END AS v FROM orders),
b1 AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM h),
k1 AS (SELECT h.* FROM h, b1 WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
b2 AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM k1)
SELECT k1.o_orderkey, v FROM k1, b2 WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def dq_iqr_filter_heavy_tail(spark, d):
    """A column with values far above and below its quartiles, so that both passes drop rows."""
    return Q.iqr_filter(heavy_tail(t(spark, d, "orders")), "v", k=1.5, passes=2)[0]


def heavy_tail(orders):
    far = F.when(F.col("o_orderkey") % 97 == 0, 12).when(F.col("o_orderkey") % 89 == 0, -5).otherwise(1)
    return orders.select("o_orderkey", (F.col("o_totalprice") * far).alias("v"))


@query("dq_all_null_rows", f"""
WITH {LINES_NULLS_SQL} SELECT {cnt_if("line_no IS NULL AND sparse_tax IS NULL")} AS n_all_null FROM x""")
def dq_all_null_rows(spark, d):
    x = _lines_with_nulls(spark, d)
    return x.agg(F.count_if(Q.all_null(["line_no", "sparse_tax"])).alias("n_all_null"))


_ORDER_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
               "l_linestatus", "l_shipdate"]
_DEDUP_COLS = ", ".join(LI_COLS)


def _dedup_sql(order: str, cond: str) -> str:
    return f"""SELECT {_DEDUP_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {", ".join(f"{c} {order}" for c in _ORDER_REST)}) AS rn FROM lineitem) WHERE {cond}"""


@query("dq_dedup_first", _dedup_sql("ASC", "rn = 1"))
def dq_dedup_first(spark, d):
    return Q.dedup(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "first", order_by=_ORDER_REST)


@query("dq_dedup_last", _dedup_sql("DESC", "rn = 1"))
def dq_dedup_last(spark, d):
    return Q.dedup(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "last", order_by=_ORDER_REST)


@query("dq_dedup_drop_all", f"""
SELECT {_DEDUP_COLS} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def dq_dedup_drop_all(spark, d):
    return Q.dedup(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "none")


@query("dq_full_row_duplicates", """
SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n_copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dq_full_row_duplicates(spark, d):
    return Q.full_row_duplicates(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("dq_drop_null_subset", f"""
WITH {LINES_NULLS_SQL} SELECT l_returnflag, count(*) AS n FROM x WHERE line_no IS NOT NULL GROUP BY l_returnflag""")
def dq_drop_null_subset(spark, d):
    return count_by(_lines_with_nulls(spark, d).na.drop(subset=["line_no"]), "l_returnflag")


@query("dq_drop_null_any", f"""
WITH {LINES_NULLS_SQL} SELECT l_returnflag, count(*) AS n FROM x
WHERE line_no IS NOT NULL AND sparse_tax IS NOT NULL GROUP BY l_returnflag""")
def dq_drop_null_any(spark, d):
    return count_by(_lines_with_nulls(spark, d).na.drop("any"), "l_returnflag")


@query("dq_fill_constants", f"""
WITH {ORDERS_NULLS_SQL}
SELECT coalesce(o_orderpriority, 'none') AS priority, coalesce(o_orderdate, TIMESTAMP '1900-01-01 00:00:00') AS odate
FROM o""")
def dq_fill_constants(spark, d):
    o = _orders_with_nulls(spark, d)
    f = Q.fill_constants(o, {"o_orderpriority": "none",
                             "o_orderdate": F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")})
    return f.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("odate"))


@query("dq_fill_all_zero", f"""
WITH {LINES_NULLS_SQL}
SELECT l_returnflag, CAST(sum(coalesce(line_no, 0)) AS BIGINT) AS line_no, {rnd("sum(coalesce(sparse_tax, 0))", 4)} AS sparse_tax
FROM x GROUP BY l_returnflag""")
def dq_fill_all_zero(spark, d):
    x = _lines_with_nulls(spark, d).na.fill(0)
    return x.groupBy("l_returnflag").agg(F.sum("line_no").alias("line_no"),
                                         F.round(F.sum("sparse_tax"), 4).alias("sparse_tax"))


@query("dq_fill_from_expression", f"""
WITH {LINES_NULLS_SQL}
SELECT l_orderkey, coalesce(line_no, CAST(l_quantity AS INTEGER) % 7) AS line_filled FROM x""")
def dq_fill_from_expression(spark, d):
    x = _lines_with_nulls(spark, d)
    return x.select("l_orderkey", F.coalesce("line_no", F.col("l_quantity").cast("int") % 7).alias("line_filled"))


@query("dq_sentinel_to_null", """
WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Select' ELSE c_mktsegment END AS segment,
                  CASE WHEN c_nationkey = 3 THEN 'Select' ELSE c_name END AS name FROM customer)
SELECT c_custkey, nullif(segment, 'Select') AS segment, nullif(name, 'Select') AS name FROM c""")
def dq_sentinel_to_null(spark, d):
    c = t(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "Select").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey") == 3, "Select").otherwise(F.col("c_name")).alias("name"))
    return Q.sentinel_to_null(c, "Select")


@query("dq_replace_with_mode", """
WITH m AS (SELECT event_type FROM events WHERE event_type <> 'error' GROUP BY event_type
           ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT CASE WHEN e.event_type = 'error' THEN m.event_type ELSE e.event_type END AS event_type, count(*) AS n
FROM events e, m GROUP BY 1""")
def dq_replace_with_mode(spark, d):
    return count_by(Q.replace_with_mode(t(spark, d, "events"), "event_type", ["error"]), "event_type")


@query("dq_retention", f"""
SELECT (SELECT count(*) FROM lineitem) AS n_before, (SELECT count(*) FROM lineitem WHERE l_discount > 0) AS n_after,
       {rnd("100.0 * (SELECT count(*) FROM lineitem WHERE l_discount > 0) / (SELECT count(*) FROM lineitem)", 2)} AS pct_kept,
       {rnd("100.0 - 100.0 * (SELECT count(*) FROM lineitem WHERE l_discount > 0) / (SELECT count(*) FROM lineitem)", 2)} AS pct_dropped""")
def dq_retention(spark, d):
    li = t(spark, d, "lineitem")
    return Q.retention(li, li.where(F.col("l_discount") > 0))


@query("dq_outlier_cutoff", """
SELECT count(*) AS n_kept, max(o_totalprice) AS max_price FROM orders WHERE o_totalprice <= 250000""")
def dq_outlier_cutoff(spark, d):
    o = t(spark, d, "orders").where(F.col("o_totalprice") <= 250000)
    return o.agg(F.count(F.lit(1)).alias("n_kept"), F.max("o_totalprice").alias("max_price"))


@query("dq_iqr_filter", """
WITH b1 AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
k1 AS (SELECT o.* FROM orders o, b1 WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
b2 AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM k1),
k2 AS (SELECT k1.* FROM k1, b2 WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
SELECT (SELECT count(*) FROM k2) AS n_kept, (SELECT count(*) FROM orders) - (SELECT count(*) FROM k2) AS n_dropped,
       (SELECT min(o_totalprice) FROM k2) AS min_kept, (SELECT max(o_totalprice) FROM k2) AS max_kept""")
def dq_iqr_filter(spark, d):
    kept, dropped = Q.iqr_filter(t(spark, d, "orders"), "o_totalprice", k=1.5, passes=2)
    n_dropped = dropped.select(F.count(F.lit(1))).scalar()
    return kept.agg(F.count(F.lit(1)).alias("n_kept"), F.min("o_totalprice").alias("min_kept"),
                    F.max("o_totalprice").alias("max_kept")).select("n_kept", n_dropped.alias("n_dropped"),
                                                                    "min_kept", "max_kept")
