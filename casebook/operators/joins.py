"""Join helpers. Physical strategy is left to Catalyst and AQE, which broadcast a side
only after its size is known."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def literal_dim(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """An in-line table (SQL ``VALUES``)."""
    return spark.createDataFrame(list(rows), schema)


def join_dim(df: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a dimension."""
    return df.join(dim, on, how)


def anti_count(left: DataFrame, right: DataFrame, on, name: str = "n_unmatched") -> DataFrame:
    """Number of left rows without a match on the right (``left_anti`` + count)."""
    return left.join(right, on, "left_anti").agg(F.count(F.lit(1)).alias(name))


def keys_with_min_count(df: DataFrame, key: str, min_count: int, strict: bool = True) -> DataFrame:
    """Rows whose key occurs more than (``strict``) / at least ``min_count`` times.

    Uses a grouped count + left-semi join: the count side is one row per key and
    partial aggregation runs map-side, so a hot key costs one row per task.
    """
    cnt = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    keep = cnt.where(F.col("_n") > min_count if strict else F.col("_n") >= min_count).select(key)
    return df.join(keep, key, "left_semi")


def onehot_mapping_long(mapping: DataFrame, key: str, label: str = "group") -> DataFrame:
    """Wide 0/1 mapping (key + one column per group) → long (key, group) where = 1."""
    groups = [c for c in mapping.columns if c != key]
    long = mapping.unpivot([key], groups, label, "_v")
    return long.where(F.col("_v") == 1).select(key, label)


def align_outer(frames: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Full outer join of several aggregates on a key; missing cells → NULL."""
    out = None
    for _, f in frames.items():
        out = f if out is None else out.join(f, list(key), "full")
    return out
