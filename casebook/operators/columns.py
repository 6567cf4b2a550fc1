"""Projection and column shaping (all metadata-only: they rewrite the plan)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_names(df: DataFrame, old: str = " ", new: str = "_") -> DataFrame:
    """Replace ``old`` by ``new`` in every column name."""
    return df.toDF(*[c.replace(old, new) for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def columns_by_pattern(df: DataFrame, contains: Sequence[str] = (), prefix: Sequence[str] = (),
                       suffix: Sequence[str] = (), regex: str | None = None) -> list[str]:
    """Column names matching any of the given substrings / prefixes / suffixes / regex."""
    out = []
    for c in df.columns:
        if (any(s in c for s in contains) or any(c.startswith(p) for p in prefix)
                or any(c.endswith(s) for s in suffix) or (regex is not None and re.search(regex, c))):
            out.append(c)
    return out


def select_by_pattern(df: DataFrame, keep: Sequence[str] = (), **pattern) -> DataFrame:
    """Keep the ``keep`` columns plus those matching the pattern."""
    cols = columns_by_pattern(df, **pattern)
    return df.select(*keep, *[c for c in cols if c not in keep])


def drop_by_pattern(df: DataFrame, **pattern) -> DataFrame:
    return df.drop(*columns_by_pattern(df, **pattern))


def derived_ratio(df: DataFrame, name: str, num: str, den: str, digits: int = 3,
                  drop_inputs: bool = True) -> DataFrame:
    """``round(num / den, digits)`` with NULL for a zero divisor; inputs dropped."""
    out = df.withColumn(name, F.round(F.try_divide(F.col(num), F.col(den)), digits))
    return out.drop(num, den) if drop_inputs else out
