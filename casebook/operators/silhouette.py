"""Euclidean silhouette of any number of points, exact or with proved bounds.

The silhouette needs, for every point, the sum of its distances to all points of each cluster. All pairs are summed where
that is less work than the bounds, or where ``exact`` asks for it: every task holds one block of points and their sums,
and all points stream past it. The work grows with the square of the points, the memory of a task does not.

Otherwise the points are summed up by balls, the points nearest to one of a bounded number of centres, and a *cell*, the
points of one ball and one cluster, keeps its count n, mean m and variance v (mean squared distance to m). For any point x
the distances to the cell's points add up to at least n |x - m| (the distance is convex) and at most n sqrt(|x - m|^2 + v)
(their squares add up to n (|x - m|^2 + v)). A point is taken out of its own cell first. So one scan against a bounded
number of cells gives both ends of every point's silhouette; where all cells hold equal points both ends agree and the
value is exact. While the mean's bound is above the tolerance, there are eight times as many balls, up to a limit. Several
clusterings of the same points share these scans, as many as a task may hold the cells of.

Rows with a NULL cluster, a NULL vector or a component that is NULL, NaN or infinite take no part. A point alone in its
cluster has silhouette 0, and so has one at distance 0 from its own and the next cluster. With fewer than two clusters
the result is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.operators.hierarchy import MOST
from casebook.operators.kernel import landmarks
from casebook.operators.kmeans import fit_many, label_many, matrix, squared
from casebook.session import stored

LIMIT = 8192        # balls that every task may hold
NUMBERS = 1 << 22   # about as many numbers of cell means, or of sums of a block, are in a task at once
CHUNK = 1024
DISTANCES = 1 << 20     # distances of some points to all cells that a task holds at once
BLOCKS, BLOCK_ROWS = 24, 32768      # least number of blocks that all pairs are dealt in, most points of one


def _usable(df: DataFrame, vec: str, *clusters: str) -> DataFrame:
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), *clusters)
    return rows.where("x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")


def place(rows: DataFrame, most: int) -> tuple[DataFrame, np.ndarray | None]:
    """``rows`` (with the point ``x``) and the number of each point's nearest centre, stored; the centres: ``most``
    distinct points of least seeded hash, which are all of them where there are no more."""
    centre = landmarks(rows, "x", most)
    if not len(centre):
        return rows.withColumn("ball", F.lit(None).cast("int")), None

    @F.pandas_udf("int")
    def nearest(xs: pd.Series) -> pd.Series:
        points = np.stack(xs.to_numpy()).astype(float) if len(xs) else np.zeros((0, centre.shape[1]))
        return pd.Series(np.concatenate([squared(points[i:i + CHUNK], centre).argmin(axis=1) for i in range(0, len(points), CHUNK)] or [[]]), dtype="int32")

    return stored(rows.withColumn("ball", nearest("x")), "placed"), centre


def _long(placed: DataFrame, clusters: Sequence[str]) -> DataFrame:
    """``x, ball`` and the cluster names in the order of ``clusters``."""
    return placed.select("x", "ball", F.array(*[F.col(c).cast("string") for c in clusters]).alias("names"))


def _cells(placed: DataFrame, centre: np.ndarray, clusters: Sequence[str]) -> list[dict]:
    """Per clustering the cluster, ball, count, and sum and squares around the ball's centre of the points of each
    (cluster, ball). A task adds up those of one batch and one clustering at a time, Spark the rest; they travel as Arrow
    columns, so a number takes 8 bytes of a task or the driver."""
    width = centre.shape[1]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ball = batch.column("ball").to_numpy()
            x = matrix(batch, width) - centre[ball]
            names, square = batch.column("names").flatten(), (x ** 2).sum(axis=1)
            for k in range(len(clusters)):
                code = names.take(pa.array(np.arange(len(batch)) * len(clusters) + k)).dictionary_encode()
                at = pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.lexsort((ball, at))
                order = order[at[order] >= 0]
                if not len(order):
                    continue
                c, b = at[order], ball[order]
                first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (b[1:] != b[:-1])))
                s = np.add.reduceat(x[order], first, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), k, np.int32)), code.dictionary.take(pa.array(c[first])), pa.array(b[first]), pa.array(np.diff(np.append(first, len(order)))),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, width, dtype=np.int32)), pa.array(s.ravel())), pa.array(np.add.reduceat(square[order], first))],
                    names=["k", "c", "ball", "n", "s", "q"])

    parts = _long(placed, clusters).mapInArrow(run, "k int, c string, ball int, n long, s array<double>, q double")
    found = parts.groupBy("k", "c", "ball").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"),
        F.sum("q").alias("q")).orderBy("k", "c", "ball").toArrow()
    k, s = found["k"].to_numpy(), found["s"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    n, q, ball, c = (found[x].to_numpy() for x in ("n", "q", "ball", "c"))
    return [{"c": c[at], "ball": ball[at], "n": n[at].astype(float), "q": q[at], "s": s[at]} for at in (k == i for i in range(len(clusters)))]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = np.maximum(a, b)
    return np.divide(b - a, most, out=np.zeros_like(most), where=most > 0)


class _Clustering:
    """The cells of one clustering, and the ends of the silhouette of points against them."""

    def __init__(self, cells: dict, centres: np.ndarray) -> None:
        self.names, self.of = np.unique(cells["c"].astype(str), return_inverse=True)
        self.n, self.q, self.s = cells["n"], cells["q"], cells["s"]
        self.centre = centres[cells["ball"]]
        shift = self.s / self.n[:, None]
        self.mean = self.centre + shift
        self.var = np.maximum(self.q / self.n - (shift ** 2).sum(axis=1), 0.0)
        self.member = (self.of[:, None] == np.arange(len(self.names))[None, :]).astype(float)
        self.size = self.n @ self.member
        self.at = {key: i for i, key in enumerate(zip(cells["c"], cells["ball"]))}

    def ends(self, x: np.ndarray, names: np.ndarray, ball: np.ndarray) -> tuple[float, float]:
        cell = np.array([self.at[key] for key in zip(names, ball)])
        line, mine = np.arange(len(x)), self.of[cell]
        d2 = squared(x, self.mean)
        least, most = self.n * np.sqrt(d2), self.n * np.sqrt(d2 + self.var)
        # its own cell without the point itself
        off, m = x - self.centre[cell], self.n[cell] - 1
        rest = np.maximum(m, 1)[:, None]
        own_s, own_q = (self.s[cell] - off) / rest, (self.q[cell] - (off ** 2).sum(axis=1)) / rest[:, 0]
        own = ((off - own_s) ** 2).sum(axis=1)
        least[line, cell] = m * np.sqrt(own)
        most[line, cell] = m * np.sqrt(own + np.maximum(own_q - (own_s ** 2).sum(axis=1), 0.0))
        least, most = least @ self.member, most @ self.member
        others = np.maximum(self.size[mine] - 1, 1)
        a_low, a_high = least[line, mine] / others, most[line, mine] / others
        least, most = least / self.size, most / self.size
        least[line, mine] = most[line, mine] = np.inf
        several = self.size[mine] > 1
        return (float(_ratio(a_high, least.min(axis=1))[several].sum()), float(_ratio(a_low, most.min(axis=1))[several].sum()))


def ends(placed: DataFrame, centre: np.ndarray | None, clusters: Sequence[str]) -> list[tuple[float, float, int] | None]:
    """Per clustering the least and greatest mean silhouette and the number of points: a scan for the cells, and one for
    as many clusterings as have about ``NUMBERS`` numbers of cell means together."""
    if centre is None:
        return [None] * len(clusters)
    cells = _cells(placed, centre, clusters)
    runs: list[list[int]] = []
    held = NUMBERS
    for k in (k for k, some in enumerate(cells) if len(set(some["c"])) > 1):
        held += cells[k]["s"].size
        if held > NUMBERS:
            runs.append([])
            held = cells[k]["s"].size
        runs[-1].append(k)
    by: dict[int, tuple[float, float, int]] = {}
    for live in runs:
        by |= _scan(placed, centre, clusters, {k: cells[k] for k in live})
    return [by.get(k) for k in range(len(clusters))]


def _scan(placed: DataFrame, centre: np.ndarray, clusters: Sequence[str], cells: dict[int, dict]) -> dict[int, tuple[float, float, int]]:
    step = max(1, min(CHUNK, DISTANCES // max(len(some["n"]) for some in cells.values())))

    def run(frames):
        models = {k: _Clustering(some, centre) for k, some in cells.items()}     # only the cells travel
        total = {k: np.zeros(3) for k in models}
        for pdf in frames:
            for i in range(0, len(pdf), step):
                some = pdf.iloc[i:i + step]
                x, names, ball = np.stack(some["x"].to_numpy()).astype(float), np.stack(some["names"].to_numpy()), some["ball"].to_numpy()
                for k, model in models.items():
                    known = np.array([c is not None for c in names[:, k]])
                    if known.any():
                        total[k] += (*model.ends(x[known], names[known, k], ball[known]), known.sum())
        found = np.array(list(total.values()))
        yield pd.DataFrame({"k": list(total), "low": found[:, 0], "high": found[:, 1], "n": found[:, 2].astype(np.int64)})

    found = _long(placed, clusters).mapInPandas(run, "k int, low double, high double, n long").groupBy("k").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n")).collect()
    return {r["k"]: (r["low"] / r["n"], r["high"] / r["n"], r["n"]) for r in found}


def all_pairs(rows: DataFrame, clusters: Sequence[str]) -> list[tuple[float, float, int] | None]:
    """What :func:`ends` gives, from the distances of all pairs: both ends are the mean silhouette.

    Equal points of equal clusters are one row with a count. Rows are dealt by hash into blocks of bounded size, and every
    block gets its own rows first and then all others; a task holds one block, its sums and one batch."""
    names = [f"c{k}" for k in range(len(clusters))]
    points = stored(rows.groupBy("x", *[F.col(c).cast("string").alias(n) for n, c in zip(names, clusters, strict=True)])
                    .agg(F.count(F.lit(1)).alias("n")), "points")
    listed = points.select(F.posexplode(F.array(*names)).alias("k", "c"), "n").where("c is not null")
    size = [{} for _ in clusters]
    for r in listed.groupBy("k", "c").agg(F.sum("n").alias("n")).orderBy("k", "c").collect():      # one row a cluster
        size[r["k"]][r["c"]] = r["n"]
    live = [k for k, known in enumerate(size) if len(known) > 1]
    if not live:
        return [None] * len(clusters)
    facts = points.agg(F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width, count = facts["width"], facts["n"]
    start = dict(zip(live, np.cumsum([0, *[len(size[k]) for k in live]])[:-1].tolist(), strict=True))
    columns = sum(len(size[k]) for k in live)
    most = min(BLOCK_ROWS, max(256, NUMBERS // (columns + width)))
    blocks = max(min(BLOCKS, -(-count // 64)), -(-count // most))
    known = {k: pa.array(list(size[k]), pa.string()) for k in live}
    many = {k: np.array(list(size[k].values()), float) for k in live}

    def codes(batch) -> np.ndarray:
        """Per live clustering the number of the cluster, -1 for none."""
        return np.stack([pc.fill_null(pc.index_in(batch.column(f"c{k}"), value_set=known[k]), -1).to_numpy(zero_copy_only=False) for k in live])

    def finish(code: np.ndarray, n: np.ndarray, total: np.ndarray):
        out = []
        for at, k in zip(code, live, strict=True):
            use = np.flatnonzero((at >= 0) & (many[k][at] > 1))
            sums, line, mine = total[use, start[k]:start[k] + len(many[k])], np.arange(len(use)), at[use]
            a, b = sums[line, mine] / (many[k][mine] - 1), sums / many[k]
            b[line, mine] = np.inf
            out.append((k, float(_ratio(a, b.min(axis=1)) @ n[use]) if len(use) else 0.0))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.float64())], names=["k", "total"])

    def run(batches):
        block, own, code, n, total = None, [], [], [], None
        for whole in batches:
            to = whole.column("to").to_numpy()
            for i in np.unique(to):
                at = np.flatnonzero(to == i)
                batch = whole.slice(at[0], len(at))
                if i != block:
                    if block is not None:
                        yield finish(np.hstack(code), np.concatenate(n), np.vstack(total))
                    block, own, code, n, total = i, [], [], [], []
                x, c, w, home = matrix(batch, width), codes(batch), batch.column("n").to_numpy().astype(float), batch.column("home").to_numpy()
                new = home == i                 # the block's own rows come first
                if new.any():
                    fresh = (x[new], c[:, new], w[new])
                    before = [(y, z, v) for y, z, v in zip(own, code, n, strict=True)]
                    own.append(fresh[0]), code.append(fresh[1]), n.append(fresh[2]), total.append(np.zeros((int(new.sum()), columns)))
                    for y, z, v in before:      # rows of an earlier batch have met only those before
                        _meet([fresh[0]], total[-1:], y, z, v)
                _meet(own, total, x, c, w)
        if block is not None:
            yield finish(np.hstack(code), np.concatenate(n), np.vstack(total))

    def _meet(own: list, total: list, x: np.ndarray, code: np.ndarray, w: np.ndarray) -> None:
        order = np.lexsort(code)
        x, code, w = x[order], code[:, order], w[order]
        for j in range(0, len(x), 2 * CHUNK):
            y, some, weight = x[j:j + 2 * CHUNK], code[:, j:j + 2 * CHUNK], w[j:j + 2 * CHUNK]
            # points that all clusterings put together are added up first, where these are fewer than the sums of a point
            first = np.flatnonzero(np.append(True, (some[:, 1:] != some[:, :-1]).any(axis=0)))
            if 2 * len(first) > columns:
                first = None
            label = some if first is None else some[:, first]
            member = np.zeros((label.shape[1], columns))
            for at, k in zip(label, live, strict=True):
                use = np.flatnonzero(at >= 0)
                member[use, start[k] + at[use]] = weight[use] if first is None else 1.0
            for mine, sums in zip(own, total, strict=True):
                for i in range(0, len(mine), CHUNK // 2):
                    d = np.sqrt(squared(mine[i:i + CHUNK // 2], y))
                    sums[i:i + CHUNK // 2] += (d if first is None else np.add.reduceat(d * weight, first, axis=1)) @ member

    homed = points.withColumn("home", F.pmod(F.xxhash64("x", *names), F.lit(blocks)).cast("int"))
    dealt = homed.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartitionById(blocks, F.col("to"))
    found = dealt.sortWithinPartitions("to", F.col("home") != F.col("to")).mapInArrow(run, "k int, total double")
    by = {r["k"]: r["total"] / sum(size[r["k"]].values()) for r in found.groupBy("k").agg(F.sum("total").alias("total")).collect()}
    return [(by[k], by[k], sum(size[k].values())) if k in by else None for k in range(len(clusters))]


def euclidean_silhouette(df: DataFrame, vec: str, clusters: Sequence[str], tolerance: float = 1e-3, most: int = MOST,
                         limit: int = LIMIT, exact: bool = False) -> DataFrame:
    """One row a column of ``clusters``: ``clustering, silhouette, bound, n``.

    The mean silhouette is within ``bound`` (rounded up) of ``silhouette``, the middle of its two ends; ``vec`` is an
    array column. All pairs of points are summed (bound 0) if ``exact``, or if the points are no more than
    ``limit`` for each clustering, where this is less work: a clustering has more cells than there are balls. Else the balls are found once for all columns; columns whose
    bound is above ``tolerance`` are done again with eight times as many balls, up to ``limit``."""
    rows = _usable(df, vec, *clusters)
    todo, done = list(clusters), {}
    if exact or rows.count() <= limit * len(todo):
        done.update(zip(todo, all_pairs(rows, todo), strict=True))
        todo = []
    while todo:
        placed, centre = place(rows, most)
        per = max(1, NUMBERS // (most * centre.shape[1])) if centre is not None else len(todo)
        for i in range(0, len(todo), per):
            done.update(zip(todo[i:i + per], ends(placed, centre, todo[i:i + per])))
        todo = [c for c in todo if done[c] is not None and done[c][1] - done[c][0] > 2 * tolerance] if most < limit else []
        most = min(8 * most, limit)
    out = []
    for c in clusters:
        if done[c] is None:
            out.append((c, None, None, None))
        else:
            low, high, n = done[c]
            out.append((c, round((low + high) / 2, 6), float(np.ceil(max(high - low - 1e-9, 0.0) / 2 * 1e6) / 1e6), n))
    return df.sparkSession.createDataFrame(out, "clustering string, silhouette double, bound double, n long")


def kmeans_silhouette(df: DataFrame, vec: str, ks: Sequence[int], seed: int = 100, max_iter: int = 50, **options) -> DataFrame:
    """``k, silhouette, bound`` of the k-means clusters of the array column ``vec`` for each k, all fitted together."""
    rows = _usable(df, vec)
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([(k, None, None) for k in ks], "k int, silhouette double, bound double")
    names = [f"k{k}" for k in ks]
    labelled = stored(label_many(rows, fit_many(rows, ks, seed, max_iter), names), "clusters")
    found = euclidean_silhouette(labelled, "x", names, **options)
    return found.select(F.substring("clustering", 2, 9).cast("int").alias("k"), "silhouette", "bound")
