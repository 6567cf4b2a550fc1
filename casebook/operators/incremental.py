"""Principal components from batches, without a refit: a tree of QR factors.

The state is the row count, the mean and the triangular factor R of the centred rows (R'R is their scatter matrix). Two
states combine into one of the same size: the factors are stacked with one row for the difference of the means and
factored again. Tasks build such states batch by batch, rounds of grouped merges combine a bounded number at a time, and
a new batch of data is merged into the fitted state. Any order of batches gives the same state up to rounding: relative
errors of the eigenvalues are of the order of machine precision times the number of merges on the longest path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 32
_SHAPE = "n long, mean array<double>, factor array<double>"
State = tuple[int, np.ndarray, np.ndarray]


def combine(a: State | None, b: State | None) -> State | None:
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    shift = (b[1] - a[1]) * np.sqrt(a[0] * b[0] / n)
    factor = np.linalg.qr(np.vstack([a[2], b[2], shift[None, :]]), mode="r")
    return n, a[1] + (b[1] - a[1]) * (b[0] / n), factor


def of_rows(x: np.ndarray) -> State | None:
    if not len(x):
        return None
    mean = x.mean(axis=0)
    return len(x), mean, np.linalg.qr(x - mean, mode="r")


def _frame(s: State | None) -> pd.DataFrame:
    rows = [] if s is None else [(s[0], s[1], s[2].ravel())]
    return pd.DataFrame(rows, columns=["n", "mean", "factor"])


def _of_frame(pdf: pd.DataFrame) -> State | None:
    out = None
    for n, mean, factor in zip(pdf["n"], pdf["mean"], pdf["factor"], strict=True):
        out = combine(out, (int(n), np.asarray(mean, float), np.asarray(factor, float).reshape(-1, len(mean))))
    return out


class IncrementalPCA:
    """Components of an array column. Rows with a NULL or NaN are left out; all points have one width."""

    def __init__(self) -> None:
        self.state: State | None = None

    def partial_fit(self, df: DataFrame, vec: str) -> IncrementalPCA:
        """Merge the rows of ``df`` into the model, in one pass over them."""
        points = df.select(F.col(vec).cast("array<double>").alias("x")).where("x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))")

        def run(frames):
            own = None
            for pdf in frames:
                for i in range(0, len(pdf), 4096):
                    own = combine(own, of_rows(np.stack(pdf["x"].iloc[i:i + 4096].to_numpy()).astype(float)))
            yield _frame(own)

        parts, n = points.mapInPandas(run, _SHAPE), points.rdd.getNumPartitions()
        while n > FAN:
            n = -(-n // FAN)
            parts = parts.groupBy(F.pmod(F.xxhash64("mean"), F.lit(n)).alias("_g")).applyInPandas(lambda pdf: _frame(_of_frame(pdf)), _SHAPE)
        self.state = combine(self.state, _of_frame(parts.toPandas()))      # at most FAN factors
        return self

    def eigen(self) -> tuple[np.ndarray, np.ndarray]:
        """Variances of the components, falling, and the components as columns, each with its largest weight positive."""
        if self.state is None or self.state[0] < 2:
            raise ValueError("components need two rows")
        n, mean, factor = self.state
        _, s, v = np.linalg.svd(factor, full_matrices=False)
        values, vectors = np.zeros(len(mean)), np.zeros((len(mean), len(mean)))
        values[:len(s)], vectors[:, :len(s)] = s ** 2 / (n - 1), v.T
        top = np.abs(vectors).argmax(axis=0)
        return values, vectors * np.where(vectors[top, np.arange(len(mean))] < 0, -1, 1)

    def scree(self, spark: SparkSession, digits: int = 6) -> DataFrame:
        """(component, explained_ratio, cumulative)."""
        ratio = self.eigen()[0]
        ratio = ratio / ratio.sum() if ratio.sum() > 0 else ratio
        rows = [(i + 1, round(float(r), digits), round(float(c), digits)) for i, (r, c) in enumerate(zip(ratio, np.cumsum(ratio), strict=True))]
        return spark.createDataFrame(rows, "component int, explained_ratio double, cumulative double")

    def transform(self, df: DataFrame, vec: str, k: int, name: str = "pca") -> DataFrame:
        """``df`` with the first ``k`` coordinates of its points (NULL where a row has no point)."""
        mean, axes = self.state[1], self.eigen()[1][:, :k]

        @F.pandas_udf("array<double>")
        def project(xs: pd.Series) -> pd.Series:
            out = [None] * len(xs)
            for i, x in enumerate(xs):
                if x is not None and len(x) == len(mean):
                    out[i] = (np.asarray(x, float) - mean) @ axes
            return pd.Series(out)

        return df.withColumn(name, project(F.col(vec).cast("array<double>")))
