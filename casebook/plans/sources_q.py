"""2.1 Sources and sinks: driver tables written to the shared scratch folder, read back.

Writing is the feature of these queries, so each one runs its write job when the
query is built and returns the lazily read-back DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casebook.operators.joins import literal_dim
from casebook.session import scratch_path
from casebook.sources import readers as RD
from casebook.sources import sinks as SK
from casebook.plans.filters_q import trip_rules
from casebook.operators import rules as R
from casebook.plans.registry import query
from casebook.plans.tables import t, trips
from casebook.plans.filters_q import SQL_ANY_BROKEN
from casebook.plans.tables import TRIPS_SQL


def _path(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("src_csv_infer", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders""")
def src_csv_infer(spark, d):
    p = _path(spark, "orders_csv")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice",
                                     F.col("o_orderdate").cast("date").alias("o_orderdate"))
    SK.write_csv(o, p)
    return RD.read_csv(spark, p, infer=True, date_format="yyyy-MM-dd")


LINEITEM_DDL = ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ")


@query("src_csv_schema", "SELECT * FROM lineitem")
def src_csv_schema(spark, d):
    p = _path(spark, "lineitem_csv")
    SK.write_csv(t(spark, d, "lineitem"), p)
    return RD.read_csv(spark, p, schema=LINEITEM_DDL, header=True, sep=",")


@query("src_csv_encoding", "SELECT doc_id, lang, source, text FROM documents")
def src_csv_encoding(spark, d):
    p = _path(spark, "documents_latin1")
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "text")
    SK.write_csv(docs, p, encoding="ISO-8859-1", quoted=True)
    return RD.read_csv(spark, p, schema="doc_id BIGINT, lang STRING, source STRING, text STRING",
                       encoding="ISO-8859-1", quoted=True)


@query("src_tsv", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def src_tsv(spark, d):
    p = _path(spark, "orders_tsv")
    SK.write_csv(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), p, sep="\t")
    return RD.read_csv(spark, p, sep="\t",
                       schema="o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING, o_totalprice DOUBLE")


@query("src_csv_quoted", "SELECT conv_id, turn, role, text FROM conversations")
def src_csv_quoted(spark, d):
    p = _path(spark, "conversations_csv")
    SK.write_csv(t(spark, d, "conversations"), p, quoted=True)
    return RD.read_csv(spark, p, schema="conv_id BIGINT, turn BIGINT, role STRING, text STRING", quoted=True)


@query("src_csv_parse_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due_date
FROM orders""")
def src_csv_parse_dates(spark, d):
    p = _path(spark, "orders_dates_csv")
    o = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"),
                                     F.date_format(F.date_add("o_orderdate", 30), "MM/dd/yyyy").alias("due_date"))
    SK.write_csv(o, p)
    raw = RD.read_csv(spark, p, schema="o_orderkey BIGINT, order_date STRING, due_date STRING")
    return RD.parse_date_columns(raw, ["order_date", "due_date"], "MM/dd/yyyy")


# In-line list of nations of interest with a display label.
NATION_LABELS = [("NATION_0", "Zero"), ("NATION_5", "Five"), ("NATION_10", "Ten"), ("NATION_24", "Twenty-four")]


@query("src_literal_rows", """
WITH lab(n_name, label) AS (VALUES ('NATION_0', 'Zero'), ('NATION_5', 'Five'), ('NATION_10', 'Ten'),
                                   ('NATION_24', 'Twenty-four'))
SELECT label, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN lab USING (n_name)
GROUP BY label""")
def src_literal_rows(spark, d):
    lab = literal_dim(spark, NATION_LABELS, "n_name string, label string")
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(lab, "n_name")
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n_customers"))


@query("src_temp_view_sql", """
SELECT o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY o_orderstatus""")
def src_temp_view_sql(spark, d):
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {o} WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01' "
                     "AND o_orderdate < TIMESTAMP_NTZ '1999-01-01' GROUP BY o_orderstatus", o=t(spark, d, "orders"))


@query("src_partition_scan", """
SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE year(l_shipdate) = 1997 AND month(l_shipdate) IN (11, 12) GROUP BY l_returnflag""")
def src_partition_scan(spark, d):
    p = _path(spark, "lineitem_orc")
    li = t(spark, d, "lineitem").withColumn("yr", F.year("l_shipdate")).withColumn("mn", F.month("l_shipdate"))
    SK.write_partitioned(li, p, ["yr", "mn"], fmt="orc")
    back = RD.read_partitioned(spark, p, "orc")
    # both predicates are on partition columns → PartitionFilters, no data read for other months
    return back.where((F.col("yr") == 1997) & F.col("mn").isin(11, 12)).groupBy("l_returnflag") \
               .agg(F.count(F.lit(1)).alias("n"))


@query("sink_orc_partitioned", f"""
WITH {TRIPS_SQL}
SELECT CAST(month(pickup_ts) AS INTEGER) AS mnth, count(*) AS n FROM trips WHERE NOT ({SQL_ANY_BROKEN}) GROUP BY ALL""")
def sink_orc_partitioned(spark, d):
    p = _path(spark, "trips_clean_orc")
    clean = R.clean(trips(spark, d), trip_rules()).withColumn("mnth", F.month("pickup_ts")) \
             .withColumn("dy", F.dayofmonth("pickup_ts"))
    SK.write_partitioned(clean, p, ["mnth", "dy"], fmt="orc", compression="snappy")
    return RD.read_partitioned(spark, p, "orc").groupBy("mnth").agg(F.count(F.lit(1)).alias("n"))


@query("sink_table_replace", """
SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def sink_table_replace(spark, d):
    name = f"cb_segments_{uuid.uuid4().hex[:12]}"
    agg = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    path = _path(spark, name)
    SK.replace_table(agg.limit(0), name, path)      # a first table, then the one that takes its place
    SK.replace_table(agg, name, path)
    back = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")                 # external: the files stay for the reader
    return back


@query("sink_csv", """
SELECT p_type, count(*) AS n, CAST(round(CAST(avg(p_size) AS DECIMAL(38,12)), 4) AS DOUBLE) AS avg_size FROM part GROUP BY p_type""")
def sink_csv(spark, d):
    p = _path(spark, "part_summary_csv")
    agg = t(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"),
                                                    F.round(F.avg("p_size"), 4).alias("avg_size"))
    SK.write_csv(agg, p)
    return RD.read_csv(spark, p, schema="p_type STRING, n BIGINT, avg_size DOUBLE")
