"""Correlation and collinearity statistics.

All pairwise statistics are computed in ONE aggregate pass (``corr(a, b)`` for
each pair, partial aggregation map-side); only the k×k result reaches the driver
when a matrix inverse is needed (VIF), and k is the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows with both values; NULL where one is constant
    (``corr`` itself raises DIVIDE_BY_ZERO under ANSI)."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_long(df: DataFrame, cols: Sequence[str], digits: int = 6, diagonal: bool = True) -> DataFrame:
    """Pearson correlation matrix in long form (a, b, corr)."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    one = df.agg(*[safe_corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs])
    rows = []
    for i, j in pairs:
        rows.append(f"'{cols[i]}', '{cols[j]}', c{i}_{j}")
        rows.append(f"'{cols[j]}', '{cols[i]}', c{i}_{j}")
    if diagonal:
        rows += [f"'{c}', '{c}', CAST(1.0 AS DOUBLE)" for c in cols]
    long = one.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (a, b, corr)")
    return long.select("a", "b", F.round("corr", digits).alias("corr"))


def offdiag_extremes(corr: DataFrame) -> DataFrame:
    """Largest and smallest off-diagonal correlation (pair with a < b, ties by names)."""
    off = corr.where(F.col("a") < F.col("b"))
    hi = off.orderBy(F.col("corr").desc(), "a", "b").limit(1).withColumn("which", F.lit("max"))
    lo = off.orderBy(F.col("corr").asc(), "a", "b").limit(1).withColumn("which", F.lit("min"))
    return hi.unionByName(lo)


def target_correlations(df: DataFrame, features: Sequence[str], target: str, digits: int = 6) -> DataFrame:
    """(feature, corr with target, kept = corr >= 0) — one pass."""
    one = df.agg(*[safe_corr(f, target).alias(f"c{i}") for i, f in enumerate(features)])
    rows = ", ".join(f"'{f}', c{i}" for i, f in enumerate(features))
    long = one.selectExpr(f"stack({len(features)}, {rows}) as (feature, corr)")
    return long.select("feature", F.round("corr", digits).alias("corr"), (F.col("corr") >= 0).alias("kept"))


def drop_negative_corr(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, list[str]]:
    """Drop features negatively correlated with the target (metadata pass)."""
    rows = target_correlations(df, features, target).collect()
    dropped = [r["feature"] for r in rows if r["corr"] is not None and r["corr"] < 0]
    return df.drop(*dropped), dropped


def vif(df: DataFrame, cols: Sequence[str], intercept: bool = True, digits: int = 6) -> DataFrame:
    """Variance inflation factor per feature, sorted descending.

    With an intercept (centred) VIF_j = [R⁻¹]_jj of the correlation matrix R;
    without, the uncentred form uses the scaled second-moment matrix. The k×k
    matrix comes from one aggregate. Each feature is judged against the others by
    least squares: a feature that they explain entirely has an infinite VIF, the
    rest keep theirs; a constant feature gives NULL.
    """
    cols = list(cols)
    vals = vif_values(corr_matrix(df, cols) if intercept else moment_matrix(df, cols))
    rows = [(c, None if v is None else round(v, digits)) for c, v in zip(cols, vals)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double").orderBy(F.col("vif").desc())


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Correlations as a k×k array from one aggregate; NaN beside a constant column."""
    at = {n: i for i, n in enumerate(cols)}
    m = np.eye(len(at))
    for r in corr_long(df, list(cols), digits=15, diagonal=False).collect() if len(at) > 1 else []:
        m[at[r["a"]], at[r["b"]]] = np.nan if r["corr"] is None else r["corr"]
    return m


def moment_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Second moments scaled to a unit diagonal, from one aggregate."""
    k = len(cols)
    one = df.agg(*[F.avg(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(cols)
                   for j, b in enumerate(cols) if j >= i]).collect()[0]
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = np.nan if one[f"m{i}_{j}"] is None else one[f"m{i}_{j}"]
    d = np.sqrt(np.diag(m))
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.outer(d, d)


def vif_values(m: np.ndarray) -> list[float | None]:
    """VIF of every feature of a correlation or scaled moment matrix."""
    k = len(m)
    flat = [j for j in range(k) if np.isnan(np.delete(m[j], j)).all() and k > 1]
    rest = [j for j in range(k) if j not in flat]
    vals: list[float | None] = [None] * k
    for j in rest:
        others = [i for i in rest if i != j]
        left = 1.0
        if others:
            left = m[j, j] - m[j, others] @ np.linalg.lstsq(m[np.ix_(others, others)], m[others, j], rcond=1e-12)[0]
        vals[j] = float("inf") if left <= 1e-12 else float(1.0 / left)
    return vals
