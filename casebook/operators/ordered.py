"""Range buckets over a global order, for selections that count rows by bucket, and NULL-safe joins.

Boundaries come from ``percentile_approx``, a bounded-memory sketch; the bucket number is monotone in the key. Running
sums, ranks and previous values over an order are in :mod:`casebook.operators.prefix`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ROWS_PER_BUCKET = 1_000_000
_FINE = 4096  # quantiles read in the one boundary pass; also the most buckets there are


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the keys appear once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, cond, how).drop(*[f"_right_{k}" for k in keys])


def range_bucket(df: DataFrame, key: str, n_buckets: int | None = None, name: str = "_bucket") -> DataFrame:
    """Add a bucket id 0, 1, ... that is monotone in ``key`` (ascending, NULL first).

    Boundaries are approximate quantiles of ``key`` over the whole frame: one
    aggregate pass whose single row (a count and ``_FINE`` - 1 numbers) is read on
    the driver. Without ``n_buckets`` there are as many as ``ROWS_PER_BUCKET``
    asks for, at least 64 and at most ``_FINE``.
    """
    x = F.col(key).cast("double")
    grid = "array(" + ",".join(f"{i / _FINE}D" for i in range(1, _FINE)) + ")"
    row = df.select(x.alias("x")).agg(F.count(F.lit(1)).alias("n"),
                                      F.expr(f"percentile_approx(x, {grid}, {4 * _FINE})").alias("b")).first()
    n = n_buckets or min(_FINE, max(64, -(-row["n"] // ROWS_PER_BUCKET)))
    fine = row["b"] or []
    bounds = sorted({fine[min(len(fine) - 1, max(0, i * _FINE // n - 1))] for i in range(1, n)}) if fine else []
    return df.withColumn(name, _search(x, bounds, 0, len(bounds)) if len(bounds) < 256 else _search_many(x, bounds))


def _search(x: Column, bounds: Sequence[float], lo: int, hi: int) -> Column:
    """Number of ``bounds`` below ``x`` as a balanced CASE tree (log2 comparisons
    per row, small generated code)."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x > F.lit(bounds[mid]), _search(x, bounds, mid + 1, hi)).otherwise(_search(x, bounds, lo, mid))


def _search_many(x: Column, bounds: Sequence[float]) -> Column:
    """The same number by binary search in a folded array literal, for lists whose
    CASE tree would outgrow generated code."""
    m = len(bounds)
    table = F.split(F.lit(",".join(repr(float(v)) for v in bounds)), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(m.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= m) & (x > F.element_at(table, F.least(at + s, F.lit(m)))), at + s).otherwise(at))
