"""Driver tables and the stand-in views the example queries share.

Each stand-in is written twice, once as a DataFrame and once as SQL text, so the
query and its oracle read exactly the same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- taxi-trip stand-in: lineitem ⋈ orders ---------------------------------
def trips(spark: SparkSession, d: str) -> DataFrame:
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_returnflag").alias("vendor"),
        F.col("o_orderdate").alias("pickup_ts"),
        F.col("l_shipdate").alias("dropoff_ts"),
        F.col("l_quantity").alias("distance"),
        F.col("l_extendedprice").alias("fare"),
        (F.col("l_discount") * F.col("l_extendedprice")).alias("tip"),
        F.col("l_tax").alias("extra"),
        F.col("o_orderpriority").alias("payment"),
        F.col("l_linenumber").alias("passengers"),
    )


TRIPS_SQL = """trips AS (
  SELECT l_returnflag AS vendor, o_orderdate AS pickup_ts, l_shipdate AS dropoff_ts,
         l_quantity AS distance, l_extendedprice AS fare, l_discount * l_extendedprice AS tip,
         l_tax AS extra, o_orderpriority AS payment, l_linenumber AS passengers
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# --- parking-ticket stand-in: events --------------------------------------
def tickets(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.select(
        F.col("event_id").alias("summons"),
        F.col("event_type").alias("code"),
        F.col("user_id").alias("precinct"),
        F.to_date("ts").alias("issue_date"),
        F.concat(F.date_format("ts", "hhmm"), F.substring(F.date_format("ts", "a"), 1, 1)).alias("vtime"),
        F.col("value").alias("fine"),
        F.col("ts"),
    )


TICKETS_SQL = """tickets AS (
  SELECT event_id AS summons, event_type AS code, user_id AS precinct, CAST(ts AS DATE) AS issue_date,
         strftime(ts, '%I%M') || substr(strftime(ts, '%p'), 1, 1) AS vtime, value AS fine, ts
  FROM events)"""
