"""Connected components by alternating large-star and small-star (Kiveris et al., 2014) as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours at the least node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points itself and its smaller neighbours at the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every node that has a link, with the least node of its component; that node itself has no row.

    ``edges`` has long ``u, v``; self-links, repeats and either direction are allowed. Each round is stored in the
    shared folder, and the loop ends when a round changes no link. A node with very many links is one aggregated row
    beside a join that adaptive execution may split.
    """
    now = stored(edges.filter("u != v").select("u", "v").distinct(), "star")
    seen = None
    while True:
        now = stored(_small_star(_large_star(now)), "star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state
