"""Semantics that differ between pandas / Hive and Spark, decided once.

Spark 4 runs with ANSI mode on: a division by zero or a bad cast raises. The
helpers here give the NULL-returning behaviour the analyses rely on, the two
rounding modes, and the two standard-deviation conventions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (Hive semantics, C1)."""
    return F.try_divide(col_(a), col_(b))


def round_half_up(c, digits: int = 0) -> Column:
    """SQL / Hive ``round``: ties away from zero."""
    return F.round(col_(c), digits)


def round_half_even(c, digits: int = 0) -> Column:
    """pandas / numpy ``round``: ties to even (banker's rounding)."""
    return F.bround(col_(c), digits)


def to_number(c, default=None) -> Column:
    """Text to DOUBLE; unparsable → NULL, optional default for NULL (C2)."""
    v = col_(c).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def std(c, ddof: int = 1) -> Column:
    """Standard deviation: ddof=1 sample (pandas), ddof=0 population (sklearn) (C3)."""
    return F.stddev_samp(col_(c)) if ddof == 1 else F.stddev_pop(col_(c))


def ne_null_aware(c, value) -> Column:
    """pandas ``!=``: a NULL cell counts as different, so the row is kept (C8)."""
    return ~col_(c).eqNullSafe(F.lit(value))
