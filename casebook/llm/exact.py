"""Exact deduplication by distributed MSD radix partitioning (no digest decides equality).

A text, freed of the characters ``[\\x20\\x09-\\x0D]`` and taken as UTF-8, is read as a string of digits: its byte
length, its first 64 bytes, the next 4,096, then runs 64 times as long each round. A round groups the documents of
each open group by their next digit; groups of one document are done, groups whose text ended hold equal texts, the
rest go to the next round. Only the digit of the round is moved, so each byte of an open document is shuffled once,
and equal digits combine before the shuffle, so a group of copies of any size sends one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import keyed, stored

FIRST, GROWTH = 64, 64


def normalised():
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary")


def radix_groups(rows: DataFrame, first: int = FIRST, growth: int = GROWTH) -> tuple[DataFrame, DataFrame]:
    """(facts of every row, group of the rows that have an equal): ``rows`` has ``_row``, ``doc_id``, ``text``.
    ``gid`` is the least ``_row`` of a group of equal texts."""
    data = normalised()
    facts = stored(rows.select("_row", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("points"),
                               F.octet_length(data).cast("long").alias("bytes"), F.sha2(data, 256).alias("sha"),
                               F.substring(data, 1, first).alias("digit")), "radix-facts")

    def split(level: DataFrame, keys: list[str]) -> DataFrame:
        groups = level.groupBy(*keys, "digit").agg(F.count("*").alias("n"), F.min("_row").alias("gid_")).filter("n > 1")
        return level.join(groups, [*keys, "digit"]).select("_row", "bytes", F.col("gid_").alias("gid"))

    open_, done, at, width = stored(split(facts, ["bytes"]), "radix"), [], first, first * growth
    while True:
        done.append(open_.filter(F.col("bytes") <= at).select("_row", "gid"))
        more = open_.filter(F.col("bytes") > at)
        if more.isEmpty():
            return facts, reduce(DataFrame.unionAll, done)
        digits = rows.filter(F.octet_length(normalised()) > at).select("_row", F.substring(data, at + 1, width).alias("digit"))
        # one plan at every size: a broadcast of small rounds would only hide how the moved bytes grow
        level = stored(more.hint("merge").join(digits, "_row"), "radix-digits")
        open_, at, width = stored(split(level, ["gid"]), "radix"), at + width, min(width * growth, 1 << 30)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``, plus ``_row`` (the row key).

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal texts the row
    with the most code points in the original text stays, then the smallest doc_id (null last); of rows that also
    share the doc_id, one stays. An empty table gives no rows; extra columns are ignored.
    """
    return decide(keyed(docs, text="string"))


def decide(rows: DataFrame) -> DataFrame:
    """``exact_dedup`` of keyed rows."""
    facts, groups = radix_groups(rows)
    groups = stored(groups.join(facts.select("_row", "doc_id", "points"), "_row"), "radix-groups")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "_row"))
    heads = groups.groupBy("gid").agg(F.count("*").alias("group_size"), best.alias("best"))
    placed = groups.select("_row", "gid").join(heads, "gid").select(
        "_row", "group_size", F.col("best.doc_id").alias("head"), F.col("best._row").alias("head_row"))
    return facts.select("_row", "doc_id", "sha").join(placed, "_row", "left").select(
        "_row", "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("head_row") == F.col("_row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))
