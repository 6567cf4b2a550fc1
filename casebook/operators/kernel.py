"""Kernel classifiers of any number of rows.

The RBF kernel is replaced by its Nystrom features: a bounded number of landmark rows, their kernel matrix whitened by
its eigenvectors. With all distinct rows as landmarks the features give the kernel exactly. The hinge-loss machine on
them is solved in its dual: rows lie in blocks with their multipliers, a round runs coordinate ascent inside every block
against the shared weights, and an exact line search says how far to go along the sum of all blocks' changes, so the
dual never falls. The duality gap bounds how far the objective is from the optimum. Weights are all that travels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.session import stored

BLOCK_ROWS = 4096


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    sq = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(sq, 0.0))


def landmarks(df: DataFrame, vec: str, m: int, seed: int = 7) -> np.ndarray:
    """``m`` distinct points of an array column, those of least seeded hash: a sample that does not depend on
    partitions, of a size that is a parameter."""
    points = df.select(F.col(vec).cast("array<double>").alias("x")).where("x IS NOT NULL").distinct()
    rows = points.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(m).collect()
    return np.array([r["x"] for r in rows], float)


def whitening(points: np.ndarray, gamma: float) -> np.ndarray:
    """K^(-1/2) of the landmarks, on the directions that their kernel has."""
    values, vectors = np.linalg.eigh(rbf(points, points, gamma))
    keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def features(x: np.ndarray, points: np.ndarray, white: np.ndarray, gamma: float) -> np.ndarray:
    """Nystrom features and a constant 1 (the intercept is regularised like any weight)."""
    return np.column_stack([rbf(x, points, gamma) @ white, np.ones(len(x))])


@dataclass
class KernelSVM:
    points: np.ndarray
    white: np.ndarray
    gamma: float
    weights: np.ndarray
    primal: float
    dual: float
    rounds: int

    @property
    def gap(self) -> float:
        """Upper bound of the distance from the best objective, relative to it."""
        return (self.primal - self.dual) / max(abs(self.dual), 1e-12)

    def margin(self, df: DataFrame, vec: str, name: str = "margin") -> DataFrame:
        points, white, gamma, weights = self.points, self.white, self.gamma, self.weights

        @F.pandas_udf("double")
        def score(xs: pd.Series) -> pd.Series:
            return pd.Series(features(np.stack(xs.to_numpy()).astype(float), points, white, gamma) @ weights) if len(xs) else pd.Series([], dtype=float)

        return df.withColumn(name, score(F.col(vec).cast("array<double>")))


def _ascend(z: np.ndarray, y: np.ndarray, c: np.ndarray, alpha: np.ndarray, w: np.ndarray, scale: float, passes: int, seed: int):
    """Coordinate ascent on one block: (new multipliers, change of the weights)."""
    alpha, change, own = alpha.copy(), np.zeros_like(w), w.copy()
    norm = (z ** 2).sum(axis=1) / scale
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            if norm[i] <= 0:
                continue
            new = min(max(alpha[i] + (1 - y[i] * (z[i] @ own)) / norm[i], 0.0), c[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] / scale * z[i]
                change += step
                own += step
                alpha[i] = new
    return alpha, change


def fit_kernel_svm(df: DataFrame, vec: str, label: str, c: float = 1.0, gamma: float = 0.1, m: int = 64, weight: str | None = None,
                   tolerance: float = 1e-3, max_rounds: int = 60, passes: int = 5, block_rows: int = BLOCK_ROWS, seed: int = 7) -> KernelSVM:
    """Machine of least ``|w|^2 / 2 + c * sum of weighted hinge losses``; ``label`` is 0 or 1, ``vec`` an array column.

    Rows with a NULL point or label are left out. It stops when the relative duality gap is at most ``tolerance``, or
    after ``max_rounds``; the gap stands in the result either way."""
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("c")).where("x IS NOT NULL AND y IS NOT NULL")
    points = landmarks(rows, "x", m, seed)
    if not len(points):
        raise ValueError("no rows to fit")
    white = whitening(points, gamma)
    width = white.shape[1] + 1

    def block(frames):
        for pdf in frames:
            for i in range(0, len(pdf), block_rows):
                part = pdf.iloc[i:i + block_rows]
                z = features(np.stack(part["x"].to_numpy()).astype(float), points, white, gamma)
                yield pd.DataFrame({"z": [z.tobytes()], "y": [np.where(part["y"].to_numpy() > 0, 1.0, -1.0).tobytes()], "c": [part["c"].to_numpy(float).tobytes()]})

    n = rows.count()
    blocks = stored(rows.repartition(max(1, -(-n // block_rows)), F.xxhash64("x")).mapInPandas(block, "z binary, y binary, c binary").withColumn("block", F.monotonically_increasing_id()), "svm-blocks")
    scale = 1.0 / c          # lambda * n
    state = blocks.select("block", F.lit(None).cast("binary").alias("old"), F.lit(None).cast("binary").alias("new"))
    w, t, best, dual = np.zeros(width), 0.0, None, -np.inf
    for r in range(max_rounds + 1):
        def step(frames, w=w, t=t, r=r):
            for pdf in frames:
                for b, z, y, cap, old, new in zip(pdf["block"], pdf["z"], pdf["y"], pdf["c"], pdf["old"], pdf["new"], strict=True):
                    z, y, cap = np.frombuffer(z).reshape(-1, width), np.frombuffer(y), np.frombuffer(cap)
                    alpha = np.zeros(len(y)) if old is None else (1 - t) * np.frombuffer(old) + t * np.frombuffer(new)
                    loss = float((cap * np.maximum(0, 1 - y * (z @ w))).sum())
                    after, change = _ascend(z, y, cap, alpha, w, scale, passes, seed + 7919 * r + int(b) % 1_000_003)
                    yield pd.DataFrame({"block": [b], "old": [alpha.tobytes()], "new": [after.tobytes()], "change": [change], "loss": [loss],
                                        "total": [float(alpha.sum())], "gain": [float((after - alpha).sum())]})

        state = stored(blocks.join(state.select("block", "old", "new"), "block").mapInPandas(
            step, "block long, old binary, new binary, change array<double>, loss double, total double, gain double"), "svm-state")
        one = state.agg(F.sum("loss").alias("loss"), F.sum("total").alias("total"), F.sum("gain").alias("gain")).first()
        ridge = scale * float(w @ w) / 2
        dual = max(dual, one["total"] - ridge)
        if best is None or ridge + one["loss"] < best.primal:
            best = KernelSVM(points, white, gamma, w, ridge + one["loss"], dual, r)
        best.dual, best.rounds = dual, r
        if best.gap <= tolerance:
            break
        move = np.zeros(width)
        for x in state.select(F.posexplode("change").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():      # one number a feature
            move[x["i"]] = x["v"]
        # the dual along the common direction is a parabola
        t = float(np.clip((one["gain"] - scale * (w @ move)) / max(scale * (move @ move), 1e-300), 0.0, 1.0))
        w = w + t * move
    return best
