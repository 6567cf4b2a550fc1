"""Registry of the example queries: one per inventory ID, each beside its oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle is ANSI SQL over the
driver tables (DuckDB dialect), or ``None`` for iterative model fits that SQL
cannot express (those get a rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(qid: str, sql: str | None = None):
    """Register ``fn`` under ``qid`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLES[qid] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from casebook.plans import (  # noqa: F401
        sources_q, shaping_q, filters_q, binning_q, joins_q, aggregates_q, ranking_q,
        strings_q, dates_q, quality_q, features_q, evaluation_q, recommend_q, models_q,
    )
