"""Row-wise arithmetic across columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.compat import col_


def row_sum(cols: Sequence, skip_null: bool = True) -> Column:
    """Sum across columns; pandas ``sum(axis=1)`` skips NULL (treated as 0)."""
    parts = [F.coalesce(col_(c), F.lit(0)) if skip_null else col_(c) for c in cols]
    return reduce(lambda a, b: a + b, parts)


def row_max(cols: Sequence) -> Column:
    """Max across columns, NULLs skipped (NULL only when all are NULL)."""
    return F.greatest(*[col_(c) for c in cols])
