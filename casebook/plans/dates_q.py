"""2.11 Date and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.dates import (elapsed_seconds, parse_hhmm_ap, parse_mixed_day_first, parse_month_year,
                                      round_hour)
from casebook.operators.aggregates import count_by
from casebook.plans.registry import query
from casebook.plans.sqlfn import rnd
from casebook.plans.tables import TICKETS_SQL, TRIPS_SQL, t, tickets, trips


@query("dt_format_parts", """
SELECT strftime(l_shipdate, '%Y') AS yyyy, strftime(l_shipdate, '%m') AS mm, count(*) AS n,
       count(DISTINCT strftime(l_shipdate, '%d')) AS n_days
FROM lineitem GROUP BY ALL""")
def dt_format_parts(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy(F.date_format("l_shipdate", "yyyy").alias("yyyy"), F.date_format("l_shipdate", "MM").alias("mm")) \
             .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.date_format("l_shipdate", "dd")).alias("n_days"))


@query("dt_year_month", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon, count(*) AS n
FROM orders GROUP BY ALL""")
def dt_year_month(spark, d):
    o = t(spark, d, "orders")
    return count_by(o, F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"))


@query("dt_parse_mixed_formats", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS parsed
FROM events""")
def dt_parse_mixed_formats(spark, d):
    e = t(spark, d, "events")
    # two text forms in one column: 'd/M/yyyy H:mm' and 'dd-MM-yyyy HH:mm:ss'
    txt = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "d/M/yyyy H:mm")) \
           .otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
    return e.select("event_id", parse_mixed_day_first(txt).alias("parsed"))


@query("dt_parse_month_year", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS issue_month, count(*) AS n FROM orders GROUP BY ALL""")
def dt_parse_month_year(spark, d):
    o = t(spark, d, "orders")
    txt = F.date_format("o_orderdate", "MMM-yy")  # e.g. 'Jan-95', 'Mar-01'
    return count_by(o, parse_month_year(txt).alias("issue_month"))


_ROUND_SQL = """(date_trunc('hour', ts) + CASE
   WHEN epoch_us(ts) - epoch_us(date_trunc('hour', ts)) > 1800000000
     OR (epoch_us(ts) - epoch_us(date_trunc('hour', ts)) = 1800000000 AND hour(ts) % 2 = 1)
   THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END)"""


@query("dt_round_hour", f"""
SELECT CAST(hour({_ROUND_SQL}) AS INTEGER) AS req_hour, CAST({_ROUND_SQL} AS DATE) AS req_date, count(*) AS n
FROM events GROUP BY ALL""")
def dt_round_hour(spark, d):
    e = t(spark, d, "events").withColumn("r", round_hour("ts"))
    return count_by(e, F.hour("r").alias("req_hour"), F.to_date("r").alias("req_date"))


@query("dt_format_display", """
SELECT event_id, strftime(ts, '%d-%m-%Y %H:%M:%S') AS shown, strftime(ts, '%d-%m-%Y') AS shown_date FROM events""")
def dt_format_display(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("shown"),
                    F.date_format("ts", "dd-MM-yyyy").alias("shown_date"))


@query("dt_elapsed_hours", f"""
WITH {TRIPS_SQL}
SELECT vendor, {rnd("avg((epoch(dropoff_ts) - epoch(pickup_ts)) / 3600.0)", 6)} AS avg_hours,
       min((epoch(dropoff_ts) - epoch(pickup_ts)) / 3600.0) AS min_hours
FROM trips GROUP BY vendor""")
def dt_elapsed_hours(spark, d):
    tr = trips(spark, d)
    h = elapsed_seconds("pickup_ts", "dropoff_ts") / 3600.0
    return tr.groupBy("vendor").agg(F.round(F.avg(h), 6).alias("avg_hours"), F.min(h).alias("min_hours"))


@query("dt_days_between", """
SELECT o_orderstatus, CAST(min(datediff('day', o_orderdate, l_shipdate)) AS INTEGER) AS min_days,
       CAST(max(datediff('day', o_orderdate, l_shipdate)) AS INTEGER) AS max_days,
       CAST(sum(datediff('day', o_orderdate, l_shipdate)) AS BIGINT) AS sum_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""")
def dt_days_between(spark, d):
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    days = F.datediff("l_shipdate", "o_orderdate")
    return j.groupBy("o_orderstatus").agg(F.min(days).alias("min_days"), F.max(days).alias("max_days"),
                                          F.sum(days).alias("sum_days"))


@query("dt_ampm_to_24h", f"""
WITH {TICKETS_SQL}
SELECT CAST(hour(ts) AS INTEGER) AS hour24, CAST(minute(ts) AS INTEGER) AS minute, count(*) AS n
FROM tickets GROUP BY ALL""")
def dt_ampm_to_24h(spark, d):
    p = tickets(spark, d).select(parse_hhmm_ap("vtime").alias("p"))
    return count_by(p, F.col("p.hour").alias("hour24"), F.col("p.minute").alias("minute"))
