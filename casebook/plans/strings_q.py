"""2.10 String functions and 2.13 the scalar UDF surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.functions.compat import to_number
from casebook.functions.strings import (alnum_key, first_digits, keyword_hits, replace_chain, split_first, split_two,
                                        trim_upper)
from casebook.operators.aggregates import count_by
from casebook.plans.registry import query
from casebook.plans.tables import TICKETS_SQL, t, tickets


@query("str_substring", """
SELECT substr(o_orderpriority, 1, 1) AS first_char, substr(o_orderpriority, 3, 3) AS word3, count(*) AS n
FROM orders GROUP BY ALL""")
def str_substring(spark, d):
    o = t(spark, d, "orders")
    return count_by(o, F.substring("o_orderpriority", 1, 1).alias("first_char"),
                    F.substring("o_orderpriority", 3, 3).alias("word3"))


# Ordered literal replacements (order matters: '#0' before '0').
NAME_REPLACEMENTS = [("Customer#", "C-"), ("-0", "-o"), ("00", "0")]


@query("str_replace_literal", """
SELECT c_custkey, replace(replace(replace(c_name, 'Customer#', 'C-'), '-0', '-o'), '00', '0') AS short_name
FROM customer""")
def str_replace_literal(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", replace_chain("c_name", NAME_REPLACEMENTS).alias("short_name"))


@query("str_trim_upper", """
SELECT upper(trim('  ' || lower(c_mktsegment) || ' ')) AS segment, count(*) AS n FROM customer GROUP BY ALL""")
def str_trim_upper(spark, d):
    c = t(spark, d, "customer")
    padded = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return count_by(c, trim_upper(padded).alias("segment"))


@query("str_ascii_alnum_key", """
SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS name_key FROM customer""")
def str_ascii_alnum_key(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", alnum_key("c_name").alias("name_key"))


@query("str_split_first", """
SELECT split_part(p_type || '|' || p_brand || '|' || p_name, '|', 1) AS main_category, count(*) AS n
FROM part GROUP BY ALL""")
def str_split_first(spark, d):
    p = t(spark, d, "part")
    return count_by(p, split_first(F.concat_ws("|", "p_type", "p_brand", "p_name"), "|").alias("main_category"))


@query("str_split_two", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS head, nullif(substr(p_name, strpos(p_name, ' ') + 1), p_name) AS rest
FROM part""")
def str_split_two(spark, d):
    p = t(spark, d, "part")
    head, rest = split_two("p_name", " ")
    return p.select("p_partkey", head.alias("head"), rest.alias("rest"))


@query("str_first_digits", """
SELECT TRY_CAST(nullif(regexp_extract(o_orderpriority, '(\\d+)', 1), '') AS INTEGER) AS priority_no, count(*) AS n
FROM orders GROUP BY ALL""")
def str_first_digits(spark, d):
    return count_by(t(spark, d, "orders"), first_digits("o_orderpriority").alias("priority_no"))


@query("str_regex_replace", """
SELECT c_custkey, regexp_replace(c_name, '0', 'na', 'g') AS replaced FROM customer""")
def str_regex_replace(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", F.regexp_replace("c_name", "0", "na").alias("replaced"))


# Keyword list for the free-text hit count (one alternation pattern).
KEYWORDS = ["the", "and", "with", "les", "des"]


@query("str_keyword_hits", """
SELECT doc_id, CAST(len(regexp_extract_all(text, 'the|and|with|les|des')) AS INTEGER) AS hits,
       CASE WHEN len(regexp_extract_all(text, 'the|and|with|les|des')) > 0 THEN 1 ELSE 0 END AS has_hit
FROM documents""")
def str_keyword_hits(spark, d):
    docs = t(spark, d, "documents")
    h = keyword_hits("text", KEYWORDS)
    return docs.select("doc_id", h.alias("hits"), F.when(h > 0, 1).otherwise(0).alias("has_hit"))


@query("str_to_number", """
SELECT o_orderkey, coalesce(TRY_CAST(nullif(split_part(o_orderpriority, '-', 1), '5') AS DOUBLE), 0.0) AS priority_num
FROM orders""")
def str_to_number(spark, d):
    o = t(spark, d, "orders")
    txt = F.nullif(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), F.lit("5"))
    return o.select("o_orderkey", to_number(txt, default=0).alias("priority_num"))


# ---- 2.13 scalar UDF surface --------------------------------------------------------
@F.pandas_udf(T.IntegerType())
def hour24_udf(vtime: pd.Series) -> pd.Series:
    """Arrow-batched twin of ``parse_hhmm_ap(...).hour`` (strict): 'hhmmA|P' → 0..23."""
    s = vtime.astype("string")
    ok = s.str.fullmatch(r"[0-9]{4}[AP]").fillna(False)
    h = pd.to_numeric(s.str.slice(0, 2), errors="coerce")
    m = pd.to_numeric(s.str.slice(2, 4), errors="coerce")
    ok = ok & h.between(1, 12) & m.between(0, 59)
    out = h.where(h < 12, 0) + (s.str.slice(4, 5) == "P").astype("float") * 12
    return out.where(ok).astype("Int32")


@query("udf_scalar", f"""
WITH {TICKETS_SQL}
SELECT CAST(hour(ts) AS INTEGER) AS hour24, count(*) AS n FROM tickets GROUP BY ALL""")
def udf_scalar(spark, d):
    return count_by(tickets(spark, d), hour24_udf("vtime").alias("hour24"))
