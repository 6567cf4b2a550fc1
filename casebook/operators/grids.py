"""Grid searches whose passes over the data do not grow with the grid.

Rows are stored once with a fold number. All settings and folds are fitted together by Newton steps: one pass gives, for
every (setting, fold), the loss, gradient and curvature over the rows outside the fold; the driver makes the steps (a
small problem each, with a proximal step for an absolute penalty). One more pass scores the held-out rows under all
settings, and their ranking gives every AUC at once. The number of passes is that of Newton steps, about ten.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.operators import kernel as K
from casebook.operators.prefix import scan
from casebook.session import stored


@dataclass(frozen=True)
class Setting:
    """``loss``: 'logistic' (mean loss plus ``reg`` * (elastic |w| + (1 - elastic) |w|^2 / 2)) or 'hinge2' (|w|^2 / 2 plus
    ``c`` times the squared hinge losses), on scaled features or, with ``gamma``, on RBF landmark features."""

    loss: str = "logistic"
    reg: float = 0.0
    elastic: float = 0.0
    c: float = 1.0
    gamma: float | None = None


class Batch:
    """All (setting, fold) fits over one stored table."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, settings: Sequence[Setting], folds: int = 3, seed: int = 11,
                 balanced: bool = False, m: int = 32) -> None:
        self.settings, self.folds, self.balanced = list(settings), folds, balanced
        x = F.array(*[F.col(f).cast("double") for f in features])
        # the fold is a hash of the row, so it does not depend on partitions
        fold = F.pmod(F.xxhash64(*[F.col(f) for f in features], F.col(label), F.lit(seed)), F.lit(folds)).cast("int")
        self.rows = stored(df.select(x.alias("x"), F.col(label).cast("double").alias("y"), fold.alias("fold"))
                           .where("y IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))"), "grid")
        d, col = len(features), F.col("x")
        stats = self.rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p"), *[F.sum(col[i]).alias(f"s{i}") for i in range(d)],
                                              *[F.sum(col[i] * col[i]).alias(f"q{i}") for i in range(d)]).collect()
        table = np.zeros((folds, 2 + 2 * d))
        for r in stats:
            table[r["fold"]] = [r["n"], r["p"], *[r[f"s{i}"] for i in range(d)], *[r[f"q{i}"] for i in range(d)]]
        rest = table.sum(axis=0) - table                       # of the rows outside each fold
        n = np.maximum(rest[:, :1], 1)
        self.mean = rest[:, 2:2 + d] / n
        var = (rest[:, 2 + d:] - n * self.mean ** 2) / np.maximum(n - 1, 1)
        self.std = np.sqrt(np.maximum(var, 0))
        self.std[self.std <= 1e-12 * (1 + np.abs(self.mean))] = np.inf      # a constant feature scales to 0
        ones = rest[:, 1]
        total = rest[:, 0]
        self.weight = np.column_stack([total / np.maximum(2 * (total - ones), 1), total / np.maximum(2 * ones, 1)]) if balanced else np.ones((folds, 2))
        self.mass = self.weight[:, 0] * (total - ones) + self.weight[:, 1] * ones
        gammas = sorted({s.gamma for s in self.settings if s.gamma is not None})
        points = K.landmarks(self.rows, "x", m, seed) if gammas else np.zeros((0, d))
        scaled = [(points - self.mean[f]) / self.std[f] for f in range(folds)]
        self.maps = {(g, f): (scaled[f], K.whitening(scaled[f], g)) for g in gammas for f in range(folds)}
        size = lambda s, f: (d if s.gamma is None else self.maps[s.gamma, f][1].shape[1]) + 1
        self.w = {(s, f): np.zeros(size(v, f)) for s, v in enumerate(self.settings) for f in range(folds)}
        self.passes = 0

    def _design(self, x: np.ndarray, fold: int, gamma: float | None) -> np.ndarray:
        z = (x - self.mean[fold]) / self.std[fold]
        return np.column_stack([z, np.ones(len(z))]) if gamma is None else K.features(z, *self.maps[gamma, fold], gamma)

    def _sums(self) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
        """Loss, gradient and curvature of every (setting, fold) at the current weights, in one pass."""
        me = {k: v for k, v in self.__dict__.items() if k != "rows"}
        shell = object.__new__(Batch)
        shell.__dict__.update(me)

        def run(frames):
            total: dict = {}
            for pdf in frames:
                for a in range(0, len(pdf), 4096):
                    part = pdf.iloc[a:a + 4096]
                    x, y, fold = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(), part["fold"].to_numpy()
                    for f in range(shell.folds):
                        use = fold != f
                        for gamma in {s.gamma for s in shell.settings}:
                            z, label = shell._design(x[use], f, gamma), y[use]
                            cw = shell.weight[f][label.astype(int)]
                            for s, v in enumerate(shell.settings):
                                if v.gamma != gamma:
                                    continue
                                m = z @ shell.w[s, f]
                                if v.loss == "logistic":
                                    p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                                    loss, first, second = cw * (np.logaddexp(0, m) - label * m), cw * (p - label), cw * p * (1 - p)
                                else:
                                    t = 2 * label - 1
                                    short = np.maximum(0, 1 - t * m)
                                    loss, first, second = cw * short ** 2, -2 * cw * t * short, 2 * cw * (short > 0)
                                got = np.concatenate([[loss.sum()], z.T @ first, ((z.T * second) @ z).ravel()])
                                total[s, f] = total[s, f] + got if (s, f) in total else got
            yield pd.DataFrame([(s, f, v) for (s, f), v in total.items()], columns=["s", "f", "v"])

        cells = self.rows.mapInPandas(run, "s int, f int, v array<double>").select("s", "f", F.posexplode("v").alias("i", "v"))
        out = {k: np.zeros(1 + len(w) + len(w) ** 2) for k, w in self.w.items()}
        for r in cells.groupBy("s", "f", "i").agg(F.sum("v").alias("v")).toLocalIterator():
            out[r["s"], r["f"]][r["i"]] = r["v"]
        self.passes += 1
        return {k: (v[0], v[1:1 + len(self.w[k])], v[1 + len(self.w[k]):].reshape(len(self.w[k]), -1)) for k, v in out.items()}

    def _objective(self, k, loss: float) -> float:
        v, w = self.settings[k[0]], self.w[k][:-1]
        if v.loss == "logistic":
            return loss / max(self.mass[k[1]], 1e-12) + v.reg * (v.elastic * np.abs(w).sum() + (1 - v.elastic) / 2 * w @ w)
        return w @ w / 2 + v.c * loss

    def fit(self, max_passes: int = 30, tolerance: float = 1e-9) -> Batch:
        """Newton steps of all fits together until no objective falls by more than ``tolerance`` of itself; a step that
        made an objective rise is halved."""
        before: dict = {}
        open_ = set(self.w)
        while open_ and self.passes < max_passes:
            sums = self._sums()
            for k in list(open_):
                value = self._objective(k, sums[k][0])
                if k in before and value > before[k][0] * (1 + 1e-12) + 1e-15 and before[k][2] < 8:
                    self.w[k] = (self.w[k] + before[k][1]) / 2
                    before[k] = (before[k][0], before[k][1], before[k][2] + 1)
                    continue
                if k in before and before[k][0] - value <= tolerance * max(abs(value), 1e-12):
                    open_.discard(k)
                    continue
                before[k] = (value, self.w[k], 0)
                self.w[k] = self._step(k, *sums[k][1:])
        return self

    def _step(self, k, gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
        v, w = self.settings[k[0]], self.w[k]
        ridge = np.ones(len(w))
        ridge[-1] = 0.0
        if v.loss == "logistic":
            mass = max(self.mass[k[1]], 1e-12)
            gradient, curve, l1, l2 = gradient / mass, curve / mass, v.reg * v.elastic, v.reg * (1 - v.elastic)
        else:
            gradient, curve, l1, l2 = v.c * gradient, v.c * curve, 0.0, 1.0
        gradient, curve = gradient + l2 * ridge * w, curve + np.diag(l2 * ridge + 1e-10)
        if not l1:
            return w - np.linalg.solve(curve, gradient)
        new = w.copy()
        for _ in range(500):       # coordinate descent on the quadratic model
            moved = 0.0
            for i in range(len(w)):
                slope = gradient[i] + curve[i] @ (new - w) - curve[i, i] * new[i]
                target = -slope / curve[i, i] if not ridge[i] else -np.sign(slope) * max(abs(slope) - l1, 0.0) / curve[i, i]
                moved, new[i] = max(moved, abs(target - new[i])), target
            if moved < 1e-12:
                break
        return new

    def auc(self) -> list[float | None]:
        """Mean held-out AUC of each setting, over the folds that hold both classes: one pass for all of them."""
        me = {k: v for k, v in self.__dict__.items() if k != "rows"}
        shell = object.__new__(Batch)
        shell.__dict__.update(me)

        def run(frames):
            for pdf in frames:
                for f in range(shell.folds):
                    part = pdf[pdf["fold"] == f]
                    if not len(part):
                        continue
                    x = np.stack(part["x"].to_numpy()).astype(float)
                    for gamma in {s.gamma for s in shell.settings}:
                        z = shell._design(x, f, gamma)
                        for s, v in enumerate(shell.settings):
                            if v.gamma == gamma:
                                yield pd.DataFrame({"s": s, "f": f, "score": z @ shell.w[s, f], "y": part["y"].to_numpy()})

        counts = self.rows.mapInPandas(run, "s int, f int, score double, y double").groupBy("s", "f", "score").agg(
            F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg"))
        ranked = scan(counts.withColumn("n", F.col("pos") + F.col("neg")), ["score"], {"n": "upto"}, partition=["s", "f"])
        rank = F.col("upto") - (F.col("n") - 1) / 2.0
        one = ranked.groupBy("s", "f").agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        value = F.try_divide(F.col("r") - F.col("P") * (F.col("P") + 1) / 2.0, F.col("P") * F.col("N"))
        got = {r["s"]: r["auc"] for r in one.groupBy("s").agg(F.avg(value).alias("auc")).collect()}
        return [got.get(s) for s in range(len(self.settings))]


def search(df: DataFrame, features: Sequence[str], label: str, settings: Sequence[Setting], folds: int = 3, seed: int = 11,
           balanced: bool = False, m: int = 32) -> list[tuple[Setting, float | None, bool]]:
    """(setting, mean AUC rounded to 6 digits, whether it is the best; the first of equals is)."""
    auc = Batch(df, features, label, settings, folds, seed, balanced, m).fit().auc()
    auc = [None if a is None else round(a, 6) for a in auc]
    best = max(range(len(auc)), key=lambda i: (auc[i] is not None, auc[i] or 0.0, -i))
    return [(s, a, i == best) for i, (s, a) in enumerate(zip(settings, auc, strict=True))]
