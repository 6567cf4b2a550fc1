"""2.4 Conditional expressions and binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.binning import (bin_col, cap_values, collapse_other, decode_col, equal_width_bin, flag,
                                        replace_values)
from casebook.functions.dates import season_col
from casebook.operators.aggregates import count_by
from casebook.plans.registry import query
from casebook.plans.tables import t

# Fixed labels for the priority decode (payment-type style decode of the survey)
PRIORITY_LABELS = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Unknown"}


@query("case_decode", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
            WHEN '4-NOT SPECIFIED' THEN 'Unknown' ELSE 'Invalid entry' END AS priority, count(*) AS n
FROM orders GROUP BY ALL""")
def case_decode(spark, d):
    o = t(spark, d, "orders")
    return count_by(o, decode_col("o_orderpriority", PRIORITY_LABELS, "Invalid entry").alias("priority"))


@query("case_bucket_half_open", """
SELECT CASE WHEN l_extendedprice / 1000 >= 0 AND l_extendedprice / 1000 < 5 THEN '[0,5)'
            WHEN l_extendedprice / 1000 >= 5 AND l_extendedprice / 1000 < 10 THEN '[5,10)'
            WHEN l_extendedprice / 1000 >= 10 AND l_extendedprice / 1000 < 20 THEN '[10,20)'
            WHEN l_extendedprice / 1000 >= 20 AND l_extendedprice / 1000 < 40 THEN '[20,40)'
            WHEN l_extendedprice / 1000 >= 40 THEN '>=40' ELSE 'invalid' END AS bucket, count(*) AS n
FROM lineitem GROUP BY ALL""")
def case_bucket_half_open(spark, d):
    li = t(spark, d, "lineitem")
    b = bin_col(F.col("l_extendedprice") / 1000, [0, 5, 10, 20, 40], closed="left", open_top=True, invalid="invalid")
    return count_by(li, b.alias("bucket"))


@query("case_bucket_right_closed", """
SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '(0,10]'
            WHEN l_quantity > 10 AND l_quantity <= 20 THEN '(10,20]'
            WHEN l_quantity > 20 AND l_quantity <= 35 THEN '(20,35]'
            WHEN l_quantity > 35 AND l_quantity <= 45 THEN '(35,45]' END AS bucket, count(*) AS n
FROM lineitem GROUP BY ALL""")
def case_bucket_right_closed(spark, d):
    li = t(spark, d, "lineitem")
    return count_by(li, bin_col("l_quantity", [0, 10, 20, 35, 45], closed="right").alias("bucket"))


@query("case_hour_bin", """
SELECT CASE WHEN hour(ts) BETWEEN 0 AND 23 THEN CAST(floor(hour(ts) / 4) AS INTEGER) + 1 END AS time_bin,
       count(*) AS n
FROM events GROUP BY ALL""")
def case_hour_bin(spark, d):
    e = t(spark, d, "events")
    return count_by(e, equal_width_bin(F.hour("ts"), 4, 0, 6).alias("time_bin"))


@query("case_hour_slot", """
SELECT CASE WHEN hour(ts) <= 6 THEN 'early_morning' WHEN hour(ts) <= 12 THEN 'morning'
            WHEN hour(ts) <= 18 THEN 'afternoon' ELSE 'night' END AS slot, event_type, count(*) AS n
FROM events GROUP BY ALL""")
def case_hour_slot(spark, d):
    e = t(spark, d, "events")
    h = F.hour("ts")
    slot = F.when(h <= 6, "early_morning").when(h <= 12, "morning").when(h <= 18, "afternoon").otherwise("night")
    return count_by(e, slot.alias("slot"), "event_type")


@query("case_season", """
SELECT CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7) THEN 'summer'
            WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' ELSE 'fall' END AS season, count(*) AS n
FROM orders GROUP BY ALL""")
def case_season(spark, d):
    return count_by(t(spark, d, "orders"), season_col("o_orderdate", "reference").alias("season"))


@query("case_binary_category", """
SELECT CASE WHEN nullif(l_linenumber, 4) = 1 THEN 'solo' WHEN nullif(l_linenumber, 4) > 1 THEN 'multiple'
            ELSE 'NA' END AS party,
       CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS stored_flag, count(*) AS n
FROM lineitem GROUP BY ALL""")
def case_binary_category(spark, d):
    li = t(spark, d, "lineitem")
    ln = F.nullif(F.col("l_linenumber"), F.lit(4))
    party = F.when(ln == 1, "solo").when(ln > 1, "multiple").otherwise("NA")
    return count_by(li, party.alias("party"),
                    F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("stored_flag"))


@query("case_flag", """
SELECT l_returnflag, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_discount,
       CAST(sum(CASE WHEN nullif(l_linenumber, 4) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_late_line
FROM lineitem GROUP BY l_returnflag""")
def case_flag(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.sum(flag(F.col("l_discount") > 0.05)).alias("n_high_discount"),
        F.sum(flag(F.nullif(F.col("l_linenumber"), F.lit(4)) > 2)).alias("n_late_line"))


@query("case_yes_no_map", """
WITH x AS (SELECT CASE l_linestatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS answer FROM lineitem)
SELECT answer, CASE answer WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS code, count(*) AS n FROM x GROUP BY ALL""")
def case_yes_no_map(spark, d):
    li = t(spark, d, "lineitem")
    x = li.select(decode_col("l_linestatus", {"F": "Yes", "O": "No"}).alias("answer"))
    return count_by(x, "answer", decode_col("answer", {"Yes": 1, "No": 0}).alias("code"))


# Canonical groups for the part-name adjective clean-up example.
NAME_GROUPS = {"hot": ["hot", "red"], "cold": ["cold", "blue"], "small": ["small", "new"]}


@query("case_replace_values", """
SELECT CASE WHEN split_part(p_name, ' ', 1) IN ('hot', 'red') THEN 'hot'
            WHEN split_part(p_name, ' ', 1) IN ('cold', 'blue') THEN 'cold'
            WHEN split_part(p_name, ' ', 1) IN ('small', 'new') THEN 'small'
            ELSE split_part(p_name, ' ', 1) END AS adjective, count(*) AS n
FROM part GROUP BY ALL""")
def case_replace_values(spark, d):
    p = t(spark, d, "part")
    return count_by(p, replace_values(F.split_part("p_name", F.lit(" "), F.lit(1)), NAME_GROUPS).alias("adjective"))


@query("case_collapse_other", """
SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN p_type ELSE 'OTHERS' END AS p_type_group, count(*) AS n
FROM part GROUP BY ALL""")
def case_collapse_other(spark, d):
    p = t(spark, d, "part")
    return count_by(p, collapse_other("p_type", ["ECONOMY", "SMALL", "LARGE"]).alias("p_type_group"))


@query("case_cap_list", """
SELECT CASE WHEN p_size IN (40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50) THEN 40 ELSE p_size END AS size_capped,
       count(*) AS n
FROM part GROUP BY ALL""")
def case_cap_list(spark, d):
    p = t(spark, d, "part")
    return count_by(p, cap_values("p_size", 40, list(range(40, 51))).alias("size_capped"))
