"""Named data-quality rules → clean and rejected outputs.

A rule is a ``Column`` that is TRUE when the row BREAKS it. A NULL rule result
counts as broken, so ``clean`` and ``rejected`` are disjoint and together hold
every input row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rule: Column) -> Column:
    """TRUE when the rule fires or cannot be evaluated (NULL)."""
    return F.coalesce(rule, F.lit(True))


def broken_names(rules: Mapping[str, Column]) -> Column:
    """array<string> of the names of the rules a row breaks (empty when clean)."""
    return F.array_compact(F.array(*[F.when(broken(r), F.lit(n)) for n, r in rules.items()]))


def apply_rules(df: DataFrame, rules: Mapping[str, Column], col: str = "broken") -> DataFrame:
    """Add ``broken array<string>``: the names of the rules each row breaks."""
    return df.withColumn(col, broken_names(rules))


def any_broken(rules: Mapping[str, Column]) -> Column:
    out = None
    for r in rules.values():
        out = broken(r) if out is None else out | broken(r)
    return out


def rejected(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking at least one rule (OR of all rules)."""
    return df.where(any_broken(rules))


def clean(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking no rule: the exact complement of :func:`rejected`."""
    return df.where(~any_broken(rules))


def rule_scorecard(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One scan: per group the row count, one count per rule, and the faulty count.

    Columns: ``*by, n_rows, n_<rule>…, n_faulty``. Partial aggregation runs
    map-side, so only one small row per group and task is shuffled.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(broken(r)).alias(f"n_{n}") for n, r in rules.items()]
    aggs.append(F.count_if(any_broken(rules)).alias("n_faulty"))
    g = df.groupBy(*by) if by else df
    return g.agg(*aggs)
