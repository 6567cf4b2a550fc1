"""2.15 Feature engineering over a wide per-month customer table built from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.binning import flag
from casebook.operators import features as FE
from casebook.operators.aggregates import count_by
from casebook.operators.columns import drop_by_pattern
from casebook.operators.splits import split_hash
from casebook.plans.registry import query
from casebook.plans.sqlfn import rnd
from casebook.plans.tables import t

# Analysis periods are calendar years: good phase 1996-1997, action 1998, churn 1999.
MONTHS = [1996, 1997, 1998, 1999]
GOOD, ACTION, CHURN = [1996, 1997], 1998, 1999


def _in_month(m):
    return F.year("o_orderdate") == m


def monthly_wide(spark, d):
    """One row per customer; for each analysis month: order count, spend, urgent
    orders and the last order date. One grouped pass over all of orders
    (conditional aggregates, map-side partial aggregation)."""
    o = t(spark, d, "orders")
    aggs = []
    for m in MONTHS:
        aggs += [F.count_if(_in_month(m)).alias(f"n_orders_{m}"),
                 F.coalesce(F.sum(F.when(_in_month(m), F.col("o_totalprice"))), F.lit(0.0)).alias(f"arpu_{m}"),
                 F.count_if(_in_month(m) & (F.col("o_orderpriority") == "1-URGENT")).alias(f"urgent_mou_{m}"),
                 F.max(F.when(_in_month(m), F.col("o_orderdate"))).cast("date").alias(f"last_order_{m}")]
    return o.groupBy("o_custkey").agg(*aggs)


def _sql_in(m):
    return f"year(o_orderdate) = {m}"


WIDE_SQL = "wide AS (SELECT o_custkey, " + ", ".join(
    f"count(*) FILTER (WHERE {_sql_in(m)}) AS n_orders_{m}, "
    f"coalesce(sum(o_totalprice) FILTER (WHERE {_sql_in(m)}), 0.0) AS arpu_{m}, "
    f"count(*) FILTER (WHERE {_sql_in(m)} AND o_orderpriority = '1-URGENT') AS urgent_mou_{m}, "
    f"CAST(max(o_orderdate) FILTER (WHERE {_sql_in(m)}) AS DATE) AS last_order_{m}" for m in MONTHS
) + " FROM orders GROUP BY o_custkey)"

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("fe_one_hot", "SELECT p_partkey, p_size, " + ", ".join(
    f"CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END AS type_{v}" for v in TYPES) + " FROM part")
def fe_one_hot(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_size", "p_type")
    return FE.one_hot(p, ["p_type"], prefix={"p_type": "type"})


@query("fe_one_hot_drop_first", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS seg_{v}" for v in SEGMENTS[1:]) + " FROM customer")
def fe_one_hot_drop_first(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return FE.one_hot(c, ["c_mktsegment"], prefix={"c_mktsegment": "seg"}, drop_first=True)


@query("fe_zscore", f"""
SELECT o_orderkey, {rnd("(o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()", 6)} AS o_totalprice
FROM orders""")
def fe_zscore(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    z = FE.zscore(o, ["o_totalprice"], ddof=1)
    return z.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


_HASH = "('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 100"


@query("fe_standard_scale", f"""
WITH train AS (SELECT * FROM orders WHERE {_HASH.format(k='o_orderkey')} >= 30),
     test AS (SELECT * FROM orders WHERE {_HASH.format(k='o_orderkey')} < 30),
     s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM train)
SELECT o_orderkey, {rnd("(o_totalprice - m) / sd", 6)} AS o_totalprice FROM test, s""")
def fe_standard_scale(spark, d):
    train, test = split_hash(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 30)
    z = FE.StandardScale(["o_totalprice"], ddof=0).fit(train).transform(test)
    return z.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("fe_minmax_scale", f"""
WITH train AS (SELECT * FROM part WHERE {_HASH.format(k='p_partkey')} >= 30),
     test AS (SELECT * FROM part WHERE {_HASH.format(k='p_partkey')} < 30),
     s AS (SELECT min(p_retailprice) AS a1, max(p_retailprice) AS b1, CAST(min(p_size) AS DOUBLE) AS a2,
                  CAST(max(p_size) AS DOUBLE) AS b2 FROM train)
SELECT p_partkey, {rnd("(p_retailprice - a1) / (b1 - a1) * 4.0 + 1.0", 6)} AS p_retailprice,
       {rnd("(p_size - a2) / (b2 - a2) * 4.0 + 1.0", 6)} AS p_size FROM test, s""")
def fe_minmax_scale(spark, d):
    train, test = split_hash(t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey", 30)
    sc = FE.MinMaxScale(["p_retailprice", "p_size"], lo=1.0, hi=5.0).fit(train).transform(test)
    return sc.select("p_partkey", F.round("p_retailprice", 6).alias("p_retailprice"), F.round("p_size", 6).alias("p_size"))


@query("fe_phase_sums", f"""
WITH {WIDE_SQL}
SELECT o_custkey, {rnd("arpu_1996 + arpu_1997", 2)} AS arpu_good, n_orders_1996 + n_orders_1997 AS n_orders_good,
       urgent_mou_1996 + urgent_mou_1997 AS urgent_mou_good FROM wide""")
def fe_phase_sums(spark, d):
    w = monthly_wide(spark, d)
    return w.select("o_custkey", F.round(FE.period_sum([f"arpu_{m}" for m in GOOD]), 2).alias("arpu_good"),
                    FE.period_sum([f"n_orders_{m}" for m in GOOD]).alias("n_orders_good"),
                    FE.period_sum([f"urgent_mou_{m}" for m in GOOD]).alias("urgent_mou_good"))


@query("fe_phase_decrease", f"""
WITH {WIDE_SQL}
SELECT CASE WHEN arpu_1998 < (arpu_1996 + arpu_1997) / 2.0 THEN 1 ELSE 0 END AS decrease_arpu,
       CASE WHEN n_orders_1998 < (n_orders_1996 + n_orders_1997) / 2.0 THEN 1 ELSE 0 END AS decrease_orders, count(*) AS n
FROM wide GROUP BY ALL""")
def fe_phase_decrease(spark, d):
    w = monthly_wide(spark, d)
    # the good phase spans two months: compare its monthly mean with the action month
    good_arpu = FE.period_sum([f"arpu_{m}" for m in GOOD]) / 2.0
    good_orders = FE.period_sum([f"n_orders_{m}" for m in GOOD]) / 2.0
    return count_by(w, flag(F.col(f"arpu_{ACTION}") < good_arpu).alias("decrease_arpu"),
                    flag(F.col(f"n_orders_{ACTION}") < good_orders).alias("decrease_orders"))


def _month_end(m):
    return F.make_date(F.lit(m), F.lit(12), F.lit(31))


def _days_sql():
    parts, prev = [], None
    for i, m in enumerate(MONTHS):
        src = "wide" if i == 0 else f"g{MONTHS[i - 1]}"
        carried = (f"datediff('day', DATE '{MONTHS[0] - 1}-12-31', DATE '{m}-12-31')" if prev is None
                   else f"days_{prev} + datediff('day', DATE '{prev}-12-31', DATE '{m}-12-31')")
        parts.append(f"g{m} AS (SELECT *, coalesce(datediff('day', last_order_{m}, DATE '{m}-12-31'), {carried}) "
                     f"AS days_{m} FROM {src})")
        prev = m
    return ",\n".join(parts)


@query("fe_days_since_last", f"""
WITH {WIDE_SQL},
{_days_sql()}
SELECT o_custkey, {", ".join(f"CAST(days_{m} AS INTEGER) AS days_{m}" for m in MONTHS)} FROM g{MONTHS[-1]}""")
def fe_days_since_last(spark, d):
    w = monthly_wide(spark, d)
    gaps = FE.days_since_last([_month_end(m) for m in MONTHS], [F.col(f"last_order_{m}") for m in MONTHS],
                              F.lit(f"{MONTHS[0] - 1}-12-31").cast("date"))
    return w.select("o_custkey", *[g.alias(f"days_{m}") for g, m in zip(gaps, MONTHS)])


@query("fe_usage_flags", f"""
WITH {WIDE_SQL}
SELECT {", ".join(f"CASE WHEN n_orders_{m} <> 0 THEN 1 ELSE 0 END AS used_{m}" for m in MONTHS)}, count(*) AS n
FROM wide GROUP BY ALL""")
def fe_usage_flags(spark, d):
    w = monthly_wide(spark, d)
    return count_by(w, *[flag(F.col(f"n_orders_{m}") != 0).alias(f"used_{m}") for m in MONTHS])


FOLD = {"arpu": "mean", "n_orders": "sum", "urgent_mou": "max", "last_order": "last"}


@query("fe_period_fold", f"""
WITH {WIDE_SQL}
SELECT o_custkey, {rnd("(arpu_1996 + arpu_1997) / 2.0", 4)} AS arpu_good, n_orders_1996 + n_orders_1997 AS n_orders_good,
       greatest(urgent_mou_1996, urgent_mou_1997) AS urgent_mou_good, last_order_1997 AS last_order_good,
       {rnd("arpu_1998", 4)} AS arpu_1998, n_orders_1998, urgent_mou_1998, last_order_1998,
       {rnd("arpu_1999", 4)} AS arpu_1999, n_orders_1999, urgent_mou_1999, last_order_1999 FROM wide""")
def fe_period_fold(spark, d):
    w = FE.fold_periods(monthly_wide(spark, d), FOLD, [str(m) for m in GOOD], "good")
    return w.withColumns({c: F.round(c, 4) for c in ["arpu_good", f"arpu_{ACTION}", f"arpu_{CHURN}"]})


@query("fe_high_value_filter", f"""
WITH {WIDE_SQL}, g AS (SELECT o_custkey, (arpu_1996 + arpu_1997) / 2.0 AS avg_arpu FROM wide)
SELECT o_custkey, {rnd("avg_arpu", 4)} AS avg_arpu FROM g
WHERE avg_arpu >= (SELECT {rnd("quantile_cont(avg_arpu, 0.7)", 0)} FROM g)""")
def fe_high_value_filter(spark, d):
    w = monthly_wide(spark, d)
    g = w.select("o_custkey", (FE.period_sum([f"arpu_{m}" for m in GOOD]) / 2.0).alias("avg_arpu"))
    from casebook.operators.aggregates import exact_quantiles
    cut = F.round(exact_quantiles(g, "avg_arpu", [0.7]).select("q0").scalar(), 0)
    return g.where(F.col("avg_arpu") >= cut).select("o_custkey", F.round("avg_arpu", 4).alias("avg_arpu"))


@query("fe_churn_label", f"""
WITH {WIDE_SQL}
SELECT o_custkey, {", ".join(f"n_orders_{m}, arpu_{m}, urgent_mou_{m}, last_order_{m}" for m in MONTHS[:-1])},
       CASE WHEN n_orders_1999 + arpu_1999 + urgent_mou_1999 = 0 THEN 1 ELSE 0 END AS churn FROM wide""")
def fe_churn_label(spark, d):
    w = monthly_wide(spark, d)
    usage = FE.period_sum([f"n_orders_{CHURN}", f"arpu_{CHURN}", f"urgent_mou_{CHURN}"])
    labelled = w.withColumn("churn", flag(usage == 0))
    return drop_by_pattern(labelled, suffix=[f"_{CHURN}"])
