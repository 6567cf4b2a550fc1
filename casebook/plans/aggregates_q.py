"""2.6 Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.binning import bin_col, decode_col
from casebook.operators import aggregates as A
from casebook.operators.joins import literal_dim
from casebook.operators.stats import safe_corr
from casebook.plans.registry import query
from casebook.plans.shaping_q import RATINGS_SQL, ratings
from casebook.plans.sqlfn import cnt_if, rnd
from casebook.plans.tables import TRIPS_SQL, t, trips

# Columns of the mean matrix in its SQL, generated by rule (25 brands).
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
RETURNS = {"A": "accepted", "N": "none"}


@query("agg_count_by_case", """
SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' END AS return_state, count(*) AS n
FROM lineitem GROUP BY ALL""")
def agg_count_by_case(spark, d):
    return A.count_by(t(spark, d, "lineitem"), decode_col("l_returnflag", RETURNS).alias("return_state"))


@query("agg_count_multi_key", f"""
WITH {TRIPS_SQL}
SELECT vendor, strftime(pickup_ts, '%Y') AS pick_yyyy, strftime(pickup_ts, '%m') AS pick_mm,
       strftime(dropoff_ts, '%Y') AS drop_yyyy, count(*) AS n
FROM trips GROUP BY ALL""")
def agg_count_multi_key(spark, d):
    tr = trips(spark, d)
    return A.count_by(tr, "vendor", F.date_format("pickup_ts", "yyyy").alias("pick_yyyy"),
                      F.date_format("pickup_ts", "MM").alias("pick_mm"),
                      F.date_format("dropoff_ts", "yyyy").alias("drop_yyyy"))


@query("agg_count_by_column", """
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def agg_count_by_column(spark, d):
    return A.count_by(t(spark, d, "orders"), "o_orderpriority")


@query("agg_global_count", f"""
SELECT count(*) AS n_rows, {cnt_if("l_quantity > 45")} AS n_large FROM lineitem""")
def agg_global_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count_if(F.col("l_quantity") > 45).alias("n_large"))


@query("agg_min_max", """
SELECT min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_extendedprice) AS min_price,
       max(l_extendedprice) AS max_price FROM lineitem""")
def agg_min_max(spark, d):
    li = t(spark, d, "lineitem")
    return li.agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
                  F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"))


@query("agg_avg_rounded_by_case", f"""
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' ELSE 'Other' END AS priority,
       {rnd("avg(o_totalprice)", 2)} AS avg_price
FROM orders GROUP BY ALL""")
def agg_avg_rounded_by_case(spark, d):
    o = t(spark, d, "orders")
    lab = decode_col("o_orderpriority", {"1-URGENT": "Urgent", "2-HIGH": "High"}, "Other")
    return o.groupBy(lab.alias("priority")).agg(F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


@query("agg_avg_median_by_case", f"""
SELECT l_returnflag, {rnd("avg(l_extendedprice)", 4)} AS avg_price, quantile_disc(l_extendedprice, 0.5) AS median_price
FROM lineitem GROUP BY l_returnflag""")
def agg_avg_median_by_case(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
                                          F.percentile_approx("l_extendedprice", 0.5, 1_000_000).alias("median_price"))


@query("agg_count_distinct_by_key", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts
FROM lineitem GROUP BY l_returnflag""")
def agg_count_distinct_by_key(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n_orders"),
                                          F.count_distinct("l_partkey").alias("n_parts"))


@query("agg_distinct_keys", """
SELECT count(DISTINCT o_custkey) AS n_customers,
       (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS n_groups FROM orders""")
def agg_distinct_keys(spark, d):
    o = t(spark, d, "orders")
    n_groups = o.select("o_custkey", "o_orderstatus").distinct().select(F.count(F.lit(1))).scalar()
    return o.agg(F.count_distinct("o_custkey").alias("n_customers")).select("n_customers", n_groups.alias("n_groups"))


@query("agg_approx_percentiles", f"""
SELECT l_returnflag, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.5) AS p50,
       quantile_disc(l_extendedprice, 0.75) AS p75, {rnd("avg(l_extendedprice)", 4)} AS mean
FROM lineitem GROUP BY l_returnflag""")
def agg_approx_percentiles(spark, d):
    li = t(spark, d, "lineitem")
    q = A.quantiles("l_extendedprice", [0.25, 0.5, 0.75], exact=False)
    g = li.groupBy("l_returnflag").agg(q.alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    return g.select("l_returnflag", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                    F.col("q")[2].alias("p75"), "mean")


@query("agg_exact_quantiles", f"""
SELECT {rnd("avg(o_totalprice)", 4)} AS mean, {rnd("median(o_totalprice)", 4)} AS median,
       {rnd("quantile_cont(o_totalprice, 0.25)", 4)} AS q25, {rnd("quantile_cont(o_totalprice, 0.75)", 4)} AS q75,
       max(o_totalprice) AS max FROM orders""")
def agg_exact_quantiles(spark, d):
    o = t(spark, d, "orders")
    q = A.exact_quantiles(o, "o_totalprice", [0.5, 0.25, 0.75])
    g = o.agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("max"))
    return g.select("mean", F.round(q.select("q0").scalar(), 4).alias("median"),
                    F.round(q.select("q1").scalar(), 4).alias("q25"), F.round(q.select("q2").scalar(), 4).alias("q75"),
                    "max")


@query("agg_median_by_group", f"""
SELECT p_type, {rnd("median(p_retailprice)", 4)} AS median_price FROM part GROUP BY p_type""")
def agg_median_by_group(spark, d):
    p = t(spark, d, "part")
    m = A.exact_quantiles(p, "p_retailprice", [0.5], by=["p_type"])
    return m.select("p_type", F.round("q0", 4).alias("median_price")).orderBy(F.col("median_price").desc(), "p_type")


@query("agg_sum_by_group", f"""
SELECT o_orderpriority, o_orderstatus, {rnd("sum(o_totalprice)", 2)} AS total FROM orders GROUP BY ALL""")
def agg_sum_by_group(spark, d):
    o = t(spark, d, "orders")
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total")) \
            .orderBy(F.col("total").desc(), "o_orderpriority", "o_orderstatus")


@query("agg_count_notnull_by_group", """
SELECT l_returnflag, count(nullif(l_linenumber, 4)) AS n_linenumber, count(l_tax) AS n_tax, count(*) AS n_rows
FROM lineitem GROUP BY l_returnflag""")
def agg_count_notnull_by_group(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count(F.nullif(F.col("l_linenumber"), F.lit(4))).alias("n_linenumber"),
                                          F.count("l_tax").alias("n_tax"), F.count(F.lit(1)).alias("n_rows"))


@query("agg_mean_all_numeric", f"""
SELECT p_type, {rnd("avg(p_partkey)", 6)} AS p_partkey, {rnd("avg(p_size)", 6)} AS p_size,
       {rnd("avg(p_retailprice)", 6)} AS p_retailprice
FROM part GROUP BY p_type""")
def agg_mean_all_numeric(spark, d):
    p = t(spark, d, "part")
    return A.mean_all_numeric(p, ["p_type"], digits=6)


@query("agg_share_of_total", f"""
SELECT o_orderpriority, count(*) AS n, {rnd("100.0 * count(*) / (SELECT count(*) FROM orders)", 2)} AS share
FROM orders GROUP BY o_orderpriority""")
def agg_share_of_total(spark, d):
    return A.share_of_total(t(spark, d, "orders"), ["o_orderpriority"], digits=2)


@query("agg_share_round_then_scale", f"""
SELECT p_type, count(*) AS n, 100.0 * {rnd("count(*) / (SELECT count(*) FROM part)", 2)} AS share
FROM part GROUP BY p_type""")
def agg_share_round_then_scale(spark, d):
    return A.share_of_total(t(spark, d, "part"), ["p_type"], digits=2, round_before_scale=True)


@query("agg_conversion_rate", f"""
SELECT toxic, count(*) AS n, {rnd("avg(quality) * 100", 4)} AS conversion_pct FROM labels GROUP BY toxic""")
def agg_conversion_rate(spark, d):
    lab = t(spark, d, "labels")
    return lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.avg("quality") * 100, 4).alias("conversion_pct"))


@query("agg_corr_pair", f"""
SELECT l_returnflag, {rnd("corr(l_quantity, l_extendedprice)", 4)} AS corr_qty_price FROM lineitem GROUP BY l_returnflag""")
def agg_corr_pair(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(safe_corr("l_quantity", "l_extendedprice"), 4).alias("corr_qty_price"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_PICKUP = "CASE WHEN user_id % 2 = 0 THEN 'Airport' ELSE 'City' END"


def _pickup(e):
    return e.withColumn("pickup_point", F.when(F.col("user_id") % 2 == 0, "Airport").otherwise("City"))


@query("agg_pivot_count", f"""
SELECT {_PICKUP} AS pickup_point, CAST(hour(ts) // 6 AS INTEGER) AS slot,
       {", ".join(f"{cnt_if(f"event_type = '{v}'")} AS {v}" for v in EVENT_TYPES)}
FROM events GROUP BY ALL""")
def agg_pivot_count(spark, d):
    e = _pickup(t(spark, d, "events")).withColumn("slot", (F.hour("ts") / 6).cast("int"))
    out = A.pivot_count(e, ["pickup_point", "slot"], "event_type", EVENT_TYPES)
    return out.na.fill(0, subset=EVENT_TYPES)


@query("agg_pivot_row_percent", f"""
SELECT {_PICKUP} AS pickup_point,
       {", ".join(f"{rnd(f"100.0 * {cnt_if(f"event_type = '{v}'")} / count(*)", 1)} AS {v}" for v in EVENT_TYPES)}
FROM events GROUP BY ALL""")
def agg_pivot_row_percent(spark, d):
    e = _pickup(t(spark, d, "events"))
    return A.pivot_row_percent(e, ["pickup_point"], "event_type", EVENT_TYPES, digits=1, fill=0.0)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("agg_unstack_sum", f"""
SELECT o_orderstatus,
       {", ".join(f'{rnd(f"sum(o_totalprice) FILTER (WHERE o_orderpriority = {chr(39)}{v}{chr(39)})", 2)} AS "{v}"'
                  for v in PRIORITIES)}
FROM orders GROUP BY o_orderstatus""")
def agg_unstack_sum(spark, d):
    o = t(spark, d, "orders")
    p = o.groupBy("o_orderstatus").pivot("o_orderpriority", PRIORITIES).agg(F.sum("o_totalprice"))
    return p.select("o_orderstatus", *[F.round(F.col(f"`{v}`"), 2).alias(v) for v in PRIORITIES])


@query("agg_pivot_mean_matrix", f"""
WITH {RATINGS_SQL}
SELECT usr, {", ".join(f'coalesce(max(rating) FILTER (WHERE item = {chr(39)}{b}{chr(39)}), 0.0) AS "{b}"' for b in BRANDS)}
FROM ratings GROUP BY usr""")
def agg_pivot_mean_matrix(spark, d):
    r = ratings(spark, d)
    # one column an item, found by a distinct pass; spark.sql.pivotMaxValues refuses a
    # catalogue too wide for columns, whose working form is the long one
    wide = r.groupBy("usr").pivot("item").agg(F.avg("rating"))
    return wide.na.fill(0.0, subset=wide.columns[1:])


@query("agg_column_totals", f"""
SELECT * FROM (VALUES ('quantity', (SELECT {rnd("sum(l_quantity)", 2)} FROM lineitem)),
                      ('revenue', (SELECT {rnd("sum(l_extendedprice)", 2)} FROM lineitem)),
                      ('tax', (SELECT {rnd("sum(l_tax)", 2)} FROM lineitem))) v(measure, total)""")
def agg_column_totals(spark, d):
    li = t(spark, d, "lineitem")
    out = A.column_totals(li, {"quantity": "l_quantity", "revenue": "l_extendedprice", "tax": "l_tax"})
    return out.select("measure", F.round("total", 2).alias("total"))


@query("agg_mean_of_group_stat", f"""
WITH {RATINGS_SQL}, per_user AS (SELECT usr, avg(rating) AS m, count(*) AS n FROM ratings GROUP BY usr)
SELECT {rnd("avg(m)", 6)} AS mean_user_rating, {rnd("avg(n)", 6)} AS mean_ratings_per_user FROM per_user""")
def agg_mean_of_group_stat(spark, d):
    per_user = ratings(spark, d).groupBy("usr").agg(F.avg("rating").alias("m"), F.count(F.lit(1)).alias("n"))
    return per_user.agg(F.round(F.avg("m"), 6).alias("mean_user_rating"),
                        F.round(F.avg("n"), 6).alias("mean_ratings_per_user"))


_SIZE_BINS = [0, 5, 10, 15, 20, 25]


@query("agg_binned_group_sizes", f"""
WITH {RATINGS_SQL}, per_user AS (SELECT usr, count(*) AS n FROM ratings GROUP BY usr),
bins(size_bin) AS (VALUES ('(0,5]'), ('(5,10]'), ('(10,15]'), ('(15,20]'), ('(20,25]')),
binned AS (SELECT CASE WHEN n > 0 AND n <= 5 THEN '(0,5]' WHEN n > 5 AND n <= 10 THEN '(5,10]'
                       WHEN n > 10 AND n <= 15 THEN '(10,15]' WHEN n > 15 AND n <= 20 THEN '(15,20]'
                       WHEN n > 20 AND n <= 25 THEN '(20,25]' END AS size_bin FROM per_user)
SELECT bins.size_bin, count(binned.size_bin) AS n_users FROM bins LEFT JOIN binned ON bins.size_bin = binned.size_bin
GROUP BY bins.size_bin""")
def agg_binned_group_sizes(spark, d):
    per_user = ratings(spark, d).groupBy("usr").agg(F.count(F.lit(1)).alias("n"))
    binned = per_user.select(bin_col("n", _SIZE_BINS, closed="right").alias("size_bin"))
    labels = [f"({_SIZE_BINS[i]},{_SIZE_BINS[i + 1]}]" for i in range(len(_SIZE_BINS) - 1)]
    bins = literal_dim(spark, [(lab,) for lab in labels], "size_bin string")
    counts = binned.groupBy("size_bin").agg(F.count(F.lit(1)).alias("n_users"))
    return bins.join(counts, "size_bin", "left").select("size_bin",
                                                        F.coalesce("n_users", F.lit(0)).cast("long").alias("n_users"))


@query("agg_having_count", """
SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 15""")
def agg_having_count(spark, d):
    return A.count_by(t(spark, d, "orders"), "o_custkey", name="n_orders").where(F.col("n_orders") > 15)


@query("agg_histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
x AS (SELECT CASE WHEN l_extendedprice = hi THEN 20 ELSE CAST(floor((l_extendedprice - lo) / ((hi - lo) / 20.0)) AS INTEGER) + 1 END AS bin
      FROM lineitem, b)
SELECT g.bin, lo + (g.bin - 1) * ((hi - lo) / 20.0) AS bin_lo, lo + g.bin * ((hi - lo) / 20.0) AS bin_hi,
       count(x.bin) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 21)) g CROSS JOIN b LEFT JOIN x ON g.bin = x.bin
GROUP BY g.bin, lo, hi""")
def agg_histogram(spark, d):
    return A.histogram(t(spark, d, "lineitem"), "l_extendedprice", n_bins=20)


@query("agg_boxplot_stats", f"""
WITH s AS (SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS min,
                  {rnd("quantile_cont(l_extendedprice, 0.25)", 4)} AS q1, {rnd("quantile_cont(l_extendedprice, 0.5)", 4)} AS median,
                  {rnd("quantile_cont(l_extendedprice, 0.75)", 4)} AS q3, max(l_extendedprice) AS max FROM lineitem GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM s)
SELECT f.*, min(CASE WHEN l_extendedprice BETWEEN lower_fence AND upper_fence THEN l_extendedprice END) AS whisker_lo,
       max(CASE WHEN l_extendedprice BETWEEN lower_fence AND upper_fence THEN l_extendedprice END) AS whisker_hi,
       count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN lower_fence AND upper_fence)) AS n_outliers
FROM f JOIN lineitem USING (l_returnflag) GROUP BY ALL""")
def agg_boxplot_stats(spark, d):
    return A.boxplot_stats(t(spark, d, "lineitem"), "l_extendedprice", by=["l_returnflag"], digits=4)


_HEAVY = "l_extendedprice * CASE WHEN l_orderkey % 53 = 0 THEN 9 WHEN l_orderkey % 61 = 0 THEN -4 ELSE 1 END"


@query("agg_boxplot_outliers", f"""
WITH h AS (SELECT l_returnflag, {_HEAVY} AS v FROM lineitem),
s AS (SELECT l_returnflag, count(v) AS n, min(v) AS min, {rnd("quantile_cont(v, 0.25)", 4)} AS q1, {rnd("quantile_cont(v, 0.5)", 4)} AS median,
             {rnd("quantile_cont(v, 0.75)", 4)} AS q3, max(v) AS max FROM h GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM s)
SELECT f.*, min(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_lo,
       max(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_hi,
       count(*) FILTER (WHERE NOT (v BETWEEN lower_fence AND upper_fence)) AS n_outliers
FROM f JOIN h USING (l_returnflag) GROUP BY ALL""")
def agg_boxplot_outliers(spark, d):
    """Prices with values far outside the fences on both sides."""
    far = F.when(F.col("l_orderkey") % 53 == 0, 9).when(F.col("l_orderkey") % 61 == 0, -4).otherwise(1)
    h = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * far).alias("v"))
    return A.boxplot_stats(h, "v", by=["l_returnflag"], digits=4)


@query("agg_group_by_ordinal", """
SELECT CAST(floor(hour(ts) / 4) AS INTEGER) + 1 AS time_bin, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC""")
def agg_group_by_ordinal(spark, d):
    # SQL with a DataFrame parameter: no global view name is registered
    return spark.sql("SELECT CAST(floor(hour(ts) / 4) AS INT) + 1 AS time_bin, count(*) AS n FROM {e} "
                     "GROUP BY 1 ORDER BY 2 DESC", e=t(spark, d, "events"))


@query("agg_speed_by_month", f"""
WITH {TRIPS_SQL}
SELECT CAST(month(pickup_ts) AS INTEGER) AS mnth,
       {rnd(f"avg({rnd('distance / nullif((epoch(dropoff_ts) - epoch(pickup_ts)) / 3600.0, 0)', 2)})", 8)} AS avg_speed
FROM trips GROUP BY ALL""")
def agg_speed_by_month(spark, d):
    tr = trips(spark, d)
    hours = F.timestamp_diff("SECOND", F.col("pickup_ts"), F.col("dropoff_ts")) / 3600.0
    speed = F.round(F.try_divide(F.col("distance"), hours), 2)
    return tr.groupBy(F.month("pickup_ts").alias("mnth")).agg(F.round(F.avg(speed), 8).alias("avg_speed"))


# Fine per code for the revenue estimate (literal dimension).
FINES = [("click", 55), ("view", 50), ("signup", 50), ("purchase", 45), ("error", 115)]


@query("agg_revenue_estimate", """
WITH top AS (SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type
             ORDER BY n DESC, event_type LIMIT 3),
fines(event_type, fine) AS (VALUES ('click', 55), ('view', 50), ('signup', 50), ('purchase', 45), ('error', 115))
SELECT top.event_type, n, fine, CAST(n * fine AS BIGINT) AS revenue FROM top JOIN fines USING (event_type)""")
def agg_revenue_estimate(spark, d):
    e = t(spark, d, "events")
    top = e.groupBy("event_type").agg(F.count_distinct("event_id").alias("n")) \
           .orderBy(F.col("n").desc(), "event_type").limit(3)
    fines = literal_dim(spark, FINES, "event_type string, fine int")
    return top.join(fines, "event_type").select("event_type", "n", "fine",
                                                (F.col("n") * F.col("fine")).cast("long").alias("revenue")) \
              .orderBy(F.col("revenue").desc(), "event_type")
