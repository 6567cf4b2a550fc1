"""Ranked selection: top-k per group, n-th ranked group, per-value top-k.

All rankings take an explicit ordering; ``row_number`` callers must give a total
order (add a tie-break key) or the result is not reproducible. A filter on
``rank``/``dense_rank``/``row_number`` <= k lets Spark insert a
``WindowGroupLimit`` before the shuffle, so each task ships at most k rows per
group and a hot group does not pile up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANKERS = {"row_number": F.row_number, "dense_rank": F.dense_rank, "rank": F.rank}


def rank_col(partition: Sequence, order: Sequence[Column], ties: str = "row_number") -> Column:
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return _RANKERS[ties]().over(w)


def topk_per_group(df: DataFrame, group: Sequence, order: Sequence[Column], k: int,
                   ties: str = "row_number", rank_name: str = "rnk") -> DataFrame:
    """Rows ranked <= k inside each group (``ties`` = row_number | dense_rank | rank)."""
    return df.withColumn(rank_name, rank_col(group, order, ties)).where(F.col(rank_name) <= k)


def nth_ranked_wide(df: DataFrame, entity: Sequence[str], label: str, order: Sequence[Column],
                    n: int = 3, prefix: str = "rank") -> DataFrame:
    """Label of the 1st..n-th ranked row per entity as columns ``rank1..rankn``."""
    r = topk_per_group(df, entity, order, n, "row_number", "_r")
    return (r.groupBy(*entity).pivot("_r", list(range(1, n + 1))).agg(F.first(label))
              .select(*entity, *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(1, n + 1)]))


def top_bottom_k(df: DataFrame, order_col: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """k largest and k smallest rows, tagged ``end = 'top' | 'bottom'``."""
    top = df.orderBy(F.col(order_col).desc(), *tie).limit(k).withColumn("end", F.lit("top"))
    bot = df.orderBy(F.col(order_col).asc(), *tie).limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(bot)
