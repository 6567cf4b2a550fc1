"""2.3 Filters and predicates, and the data-quality rule set (taxi stand-in)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.binning import all_of
from casebook.functions.compat import ne_null_aware
from casebook.operators import rules as R
from casebook.operators.aggregates import count_by
from casebook.plans.registry import query
from casebook.plans.tables import TICKETS_SQL, TRIPS_SQL, t, tickets, trips

# Quality rules over the trip stand-in: TRUE when a row breaks the rule. Each rule
# is written once as a Column (built lazily: Columns need a session) and once as
# SQL text for the oracle.
def _trip_rules():
    return {
        "period": (~(F.year("pickup_ts").between(1995, 2000) & F.year("dropoff_ts").between(1995, 2000)),
                   "NOT (year(pickup_ts) BETWEEN 1995 AND 2000 AND year(dropoff_ts) BETWEEN 1995 AND 2000)"),
        "negative_time": (F.col("dropoff_ts") < F.col("pickup_ts"), "dropoff_ts < pickup_ts"),
        "passengers": (~F.col("passengers").between(1, 6), "NOT (passengers BETWEEN 1 AND 6)"),
        "distance": (F.col("distance") <= 0, "distance <= 0"),
        "fare": (F.col("fare") <= 0, "fare <= 0"),
        "no_tip": (F.col("tip") == 0, "tip = 0"),
        "extra": (~F.col("extra").isin(0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07),
                  "extra NOT IN (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07)"),
        "payment": (F.col("payment") == "5-LOW", "payment = '5-LOW'"),
    }


TRIP_RULES_SQL = {
    "period": "NOT (year(pickup_ts) BETWEEN 1995 AND 2000 AND year(dropoff_ts) BETWEEN 1995 AND 2000)",
    "negative_time": "dropoff_ts < pickup_ts",
    "passengers": "NOT (passengers BETWEEN 1 AND 6)",
    "distance": "distance <= 0",
    "fare": "fare <= 0",
    "no_tip": "tip = 0",
    "extra": "extra NOT IN (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07)",
    "payment": "payment = '5-LOW'",
}


def trip_rules() -> dict:
    """Rule name → Column (TRUE = broken)."""
    return {k: v[0] for k, v in _trip_rules().items()}


def _sql_broken(expr: str) -> str:
    return f"coalesce({expr}, true)"


SQL_ANY_BROKEN = " OR ".join(_sql_broken(v) for v in TRIP_RULES_SQL.values())
SQL_BROKEN_NAMES = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {_sql_broken(v)} THEN '{k}' END" for k, v in TRIP_RULES_SQL.items()) + ")"

# --- minimum slice: quality scorecard by provider ---------------------------------
# (lineitem only: zero discount, quantity out of range, ship date out of period)
def line_rules() -> dict:
    return {
        "zero_discount": F.col("l_discount") == 0,
        "qty_range": ~F.col("l_quantity").between(1, 45),
        "ship_period": ~F.year("l_shipdate").between(1996, 2000),
        "zero_tax": F.col("l_tax") == 0,
    }


LINE_RULES_SQL = {
    "zero_discount": "l_discount = 0",
    "qty_range": "NOT (l_quantity BETWEEN 1 AND 45)",
    "ship_period": "NOT (year(l_shipdate) BETWEEN 1996 AND 2000)",
    "zero_tax": "l_tax = 0",
}


def faulty_by_source(spark, d):
    li = t(spark, d, "lineitem")
    return R.rule_scorecard(li, line_rules(), by=["l_returnflag"])


_faulty_sql = ("SELECT l_returnflag, count(*) AS n_rows, "
               + ", ".join(f"count(*) FILTER (WHERE coalesce({v}, true)) AS n_{k}" for k, v in LINE_RULES_SQL.items())
               + ", count(*) FILTER (WHERE " + " OR ".join(f"coalesce({v}, true)" for v in LINE_RULES_SQL.values())
               + ") AS n_faulty FROM lineitem GROUP BY l_returnflag")
query("agg_faulty_by_source", _faulty_sql)(faulty_by_source)


@query("flt_quality_rules", f"""
WITH {TRIPS_SQL}
SELECT vendor, payment, passengers, {SQL_BROKEN_NAMES} AS broken
FROM trips WHERE {SQL_ANY_BROKEN}""")
def flt_quality_rules(spark, d):
    rules = trip_rules()
    tr = R.apply_rules(trips(spark, d), rules)
    return R.rejected(tr, rules).select("vendor", "payment", "passengers",
                                        F.array_join("broken", ",").alias("broken"))


@query("flt_clean_rows", f"""
WITH {TRIPS_SQL}
SELECT vendor, CAST(month(pickup_ts) AS INTEGER) AS mnth, count(*) AS n, round(sum(fare), 2) AS fare
FROM trips WHERE NOT ({SQL_ANY_BROKEN}) GROUP BY ALL""")
def flt_clean_rows(spark, d):
    c = R.clean(trips(spark, d), trip_rules())
    return c.groupBy("vendor", F.month("pickup_ts").alias("mnth")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("fare"), 2).alias("fare"))


@query("flt_compare", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE year(l_shipdate) = 1997 AND l_quantity <= 5""")
def flt_compare(spark, d):
    li = t(spark, d, "lineitem")
    start, end = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1997, 1998))    # a range reaches the scan, year() does not
    return li.where((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end) & (F.col("l_quantity") <= 5)) \
             .select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt_null_or_zero", """
SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE nullif(l_linenumber, 4) IS NULL OR l_discount = 0 GROUP BY l_returnflag""")
def flt_null_or_zero(spark, d):
    li = t(spark, d, "lineitem")
    ln = F.nullif(F.col("l_linenumber"), F.lit(4))
    return count_by(li.where(ln.isNull() | (F.col("l_discount") == 0)), "l_returnflag")


@query("flt_not_in", """
SELECT l_linenumber, count(*) AS n FROM lineitem
WHERE nullif(l_linenumber, 4) NOT IN (1, 2, 3) GROUP BY l_linenumber""")
def flt_not_in(spark, d):
    li = t(spark, d, "lineitem")
    ln = F.nullif(F.col("l_linenumber"), F.lit(4))
    # NOT IN drops the NULL rows, as in SQL
    return count_by(li.where(~ln.isin(1, 2, 3)), "l_linenumber")


@query("flt_in_list", """
SELECT o_orderstatus, count(*) AS n FROM orders
WHERE month(o_orderdate) IN (11, 12) GROUP BY o_orderstatus""")
def flt_in_list(spark, d):
    o = t(spark, d, "orders")
    return count_by(o.where(F.month("o_orderdate").isin(11, 12)), "o_orderstatus")


@query("flt_between", """
SELECT p_type, count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 15 GROUP BY p_type""")
def flt_between(spark, d):
    return count_by(t(spark, d, "part").where(F.col("p_size").between(5, 15)), "p_type")


@query("flt_not_equal_null_aware", """
SELECT 'sql' AS form, count(*) AS n FROM events WHERE nullif(event_type, 'error') <> 'click'
UNION ALL
SELECT 'pandas' AS form, count(*) AS n FROM events WHERE nullif(event_type, 'error') IS DISTINCT FROM 'click'""")
def flt_not_equal_null_aware(spark, d):
    e = t(spark, d, "events").withColumn("et", F.nullif(F.col("event_type"), F.lit("error")))
    sql_form = e.where(F.col("et") != "click").agg(F.count(F.lit(1)).alias("n")).select(F.lit("sql").alias("form"), "n")
    pd_form = e.where(ne_null_aware("et", "click")).agg(F.count(F.lit(1)).alias("n")) \
               .select(F.lit("pandas").alias("form"), "n")
    return sql_form.unionByName(pd_form)


@query("flt_regex", f"""
WITH {TICKETS_SQL}
SELECT regexp_matches(vtime, '^[0-9]{{4}}[AP]$') AS well_formed, count(*) AS n FROM tickets GROUP BY ALL""")
def flt_regex(spark, d):
    tk = tickets(spark, d)
    return tk.groupBy(F.col("vtime").rlike("^[0-9]{4}[AP]$").alias("well_formed")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_null_string", """
WITH x AS (SELECT CASE WHEN event_type = 'error' THEN 'nan' WHEN event_type = 'view' THEN NULL ELSE event_type END AS s
           FROM events)
SELECT count(*) FILTER (WHERE s IS NULL) AS n_null, count(*) FILTER (WHERE s = 'nan') AS n_nan_text,
       count(*) FILTER (WHERE nullif(s, 'nan') IS NOT NULL) AS n_kept FROM x""")
def flt_null_string(spark, d):
    e = t(spark, d, "events")
    s = F.when(F.col("event_type") == "error", F.lit("nan")).when(F.col("event_type") == "view", F.lit(None)) \
         .otherwise(F.col("event_type"))
    x = e.select(s.alias("s"))
    return x.agg(F.count_if(F.col("s").isNull()).alias("n_null"),
                 F.count_if(F.col("s") == "nan").alias("n_nan_text"),
                 F.count_if(F.nullif(F.col("s"), F.lit("nan")).isNotNull()).alias("n_kept"))


@query("flt_out_of_period", f"""
WITH {TRIPS_SQL}
SELECT vendor, count(*) AS n FROM trips
WHERE (month(pickup_ts) NOT IN (11, 12) OR year(pickup_ts) <> 1997)
  AND (month(dropoff_ts) NOT IN (11, 12) OR year(dropoff_ts) <> 1997)
GROUP BY vendor""")
def flt_out_of_period(spark, d):
    tr = trips(spark, d)

    def outside(c):
        return ~F.month(c).isin(11, 12) | (F.year(c) != 1997)
    return count_by(tr.where(outside("pickup_ts") & outside("dropoff_ts")), "vendor")


@query("flt_threshold_conjunction", """
SELECT c_custkey, c_nationkey, c_acctbal FROM customer
WHERE c_acctbal > 9000.5 AND c_nationkey < 20 AND c_custkey > 6""")
def flt_threshold_conjunction(spark, d):
    c = t(spark, d, "customer")
    return c.where(all_of([F.col("c_acctbal") > 9000.5, F.col("c_nationkey") < 20, F.col("c_custkey") > 6])) \
            .select("c_custkey", "c_nationkey", "c_acctbal")
