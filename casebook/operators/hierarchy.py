"""Complete-linkage clusters of any number of points.

Every task sums its points up as balls (centre, radius, count): a point joins the nearest ball if that stays within a
threshold, which is 0 until there are more balls than allowed and then grows. Summaries are merged in rounds, a bounded
number at a time, until one list of at most ``most`` balls is left. On that list nearest-neighbour chains build the
complete-linkage tree, with centre distance plus both radii as the distance of two balls, an upper bound of the largest
distance between their points. Where all balls are single points, which is the case for up to ``most`` distinct
points, the tree is the exact one. Cutting it gives cluster numbers, and points take the cluster of their nearest ball.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, FAN = 1024, 32
_SHAPE = "centre array<double>, radius double, n long"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - b) ** 2).sum(axis=1) for x in a])) if len(a) else np.zeros((0, len(b)))


class Balls:
    """At most ``most`` balls that cover the points added."""

    def __init__(self, most: int, width: int) -> None:
        self.most, self.threshold = most, 0.0
        self.centre, self.radius, self.n = np.zeros((0, width)), np.zeros(0), np.zeros(0, np.int64)

    def add(self, centre: np.ndarray, radius: np.ndarray, n: np.ndarray) -> None:
        order = np.lexsort((radius, *centre.T[::-1]))
        for i in range(0, len(order), max(1, self.most)):
            self._add(*(x[order[i:i + max(1, self.most)]] for x in (centre, radius, n)))

    def _add(self, centre: np.ndarray, radius: np.ndarray, n: np.ndarray) -> None:
        self.centre, self.radius, self.n = np.vstack([self.centre, centre]), np.append(self.radius, radius), np.append(self.n, n)
        self._merge()
        while len(self.n) > self.most:
            near = _distances(self.centre, self.centre) + self.radius[:, None]
            np.fill_diagonal(near, np.inf)
            # about half of the balls find another one within the new threshold
            self.threshold = max(float(np.median(near.min(axis=1))), self.threshold * 1.1)
            self._merge()

    def _merge(self) -> None:
        """In falling order of count, a ball takes in every ball that lies within the threshold of its centre."""
        order = np.lexsort((*self.centre.T[::-1], -self.n))
        free = np.ones(len(order), bool)
        kept = []
        for i in order:
            if not free[i]:
                continue
            reach = np.sqrt(((self.centre - self.centre[i]) ** 2).sum(axis=1)) + self.radius
            own = free & (reach <= max(self.threshold, 0.0))
            own[i] = True
            free &= ~own
            kept.append((i, max(self.radius[i], float(reach[own].max()) if own.sum() > 1 else self.radius[i]), int(self.n[own].sum())))
        at = np.array([k[0] for k in kept], np.int64)
        self.centre, self.radius, self.n = self.centre[at], np.array([k[1] for k in kept]), np.array([k[2] for k in kept], np.int64)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"centre": list(self.centre), "radius": self.radius, "n": self.n})


def _taken(most: int, frames) -> Balls | None:
    balls = None
    for pdf in frames:
        if len(pdf):
            centre = np.stack(pdf["centre"].to_numpy()).astype(float)
            balls = balls or Balls(most, centre.shape[1])
            balls.add(centre, pdf["radius"].to_numpy(float), pdf["n"].to_numpy(np.int64))
    return balls


def summaries(df: DataFrame, vec: str, most: int = MOST) -> Balls | None:
    """Balls of the array column ``vec``; rows with a NULL or NaN are left out. None for a frame without points."""
    points = df.select(F.col(vec).cast("array<double>").alias("centre")).where("centre IS NOT NULL AND NOT exists(centre, x -> x IS NULL OR isnan(x))")

    def run(frames):
        balls = _taken(most, frames)
        if balls is not None:
            yield balls.frame()

    # equal points need one row; a point that is there often is counted before any task holds it
    counted = points.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).select("centre", F.lit(0.0).alias("radius"), "n")
    parts = counted.mapInPandas(run, _SHAPE)
    n = counted.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.groupBy(F.pmod(F.xxhash64("centre"), F.lit(n)).alias("_g")).applyInPandas(
            lambda pdf: _taken(most, [pdf]).frame(), _SHAPE)
    return _taken(most, [parts.toPandas()])      # at most FAN tasks' summaries


def complete_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (lower index, other index, height) of complete linkage, by nearest-neighbour chains, in rising height.

    Clusters carry the least index of their points; among equal distances the chain prefers the point before, then the
    least index."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    live, chain, out = np.ones(len(d), bool), [], []
    for _ in range(len(d) - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            row = np.where(live, d[chain[-1]], np.inf)
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        b, a = chain.pop(), chain.pop()
        a, b = min(a, b), max(a, b)
        out.append((a, b, float(d[a, b])))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        live[b] = False
    return sorted(out, key=lambda m: m[2])


def cut(merges: Sequence[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Cluster number of each of ``n`` points when ``k`` clusters are left; clusters are numbered by their first point."""
    top = np.arange(n)

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b, _ in merges[:max(0, n - k)]:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def cluster(df: DataFrame, vec: str, k: int, most: int = MOST, name: str = "cluster") -> tuple[DataFrame, list[float]]:
    """(``df`` with the complete-linkage cluster of its points, heights of all merges).

    Clusters are numbered from 0 by their lexicographically first ball. Rows without a point have a NULL cluster; with
    fewer than ``k`` distinct points every point is a cluster of its own."""
    balls = summaries(df, vec, most)
    if balls is None:
        return df.withColumn(name, F.lit(None).cast("int")), []
    order = np.lexsort(balls.centre.T[::-1])
    centre, radius = balls.centre[order], balls.radius[order]
    merges = complete_linkage(_distances(centre, centre) + radius[:, None] + radius[None, :])
    label = cut(merges, len(centre), k)

    @F.pandas_udf("int")
    def nearest(xs: pd.Series) -> pd.Series:
        out = np.full(len(xs), -1)
        good = [i for i, x in enumerate(xs) if x is not None and np.isfinite(np.asarray(x, float)).all() and len(x) == centre.shape[1]]
        for i in range(0, len(good), 256):
            some = good[i:i + 256]
            out[some] = label[np.argmin(_distances(np.stack([np.asarray(xs.iloc[j], float) for j in some]), centre), axis=1)]
        return pd.Series(out).astype("Int32").where(out >= 0)

    return df.withColumn(name, nearest(F.col(vec).cast("array<double>"))), [h for _, _, h in merges]
