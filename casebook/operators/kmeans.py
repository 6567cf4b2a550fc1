"""k-means for several k at once.

Spark's ``KMeans`` finds the first centres of each k (k-means||, no rounds) over one cached frame, several k side by
side. The rounds are then done for all k together: every task holds the centres of all k and adds up, for each centre, the
points nearest to it, so a round is one small job for all k and not one for each. The rules are those of ``KMeans``: a
centre without points stays, and a k is done when none of its centres moves by more than ``tol``, or after ``max_iter``
rounds. Only centres and their sums travel.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

CHUNK = 1024
FITS = 8        # first centres of so many k are looked for side by side


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :]
    d = size - 2 * a @ b.T
    return np.where(d < 1e-13 * size, 0.0, d)


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = batch.column("x")
    if len(x) and not pc.all(pc.equal(pc.list_value_length(x), width)).as_py():
        raise ValueError("the vectors differ in length")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def first_centres(rows: DataFrame, ks: Sequence[int], seed: int) -> list[np.ndarray]:
    """Per k the centres that ``KMeans`` starts from, at most k; ``rows`` have the point ``x``."""
    vectors = rows.select(array_to_vector("x").alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    vectors.count()     # before the fits, which else would all fill the cache

    def fit(k: int) -> np.ndarray:
        return np.array(KMeans(featuresCol="v", k=k, seed=seed, maxIter=0).fit(vectors).clusterCenters())

    try:
        with ThreadPool(min(FITS, len(ks))) as pool:
            return pool.map(inheritable_thread_target(rows.sparkSession)(fit), ks, chunksize=1)
    finally:
        vectors.unpersist()


def _nearest(x: np.ndarray, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Per k the number of each point's nearest centre, the first of equal ones."""
    d = squared(x, np.vstack(centres))
    cuts = np.cumsum([len(c) for c in centres])[:-1]
    return [part.argmin(axis=1) for part in np.split(d, cuts, axis=1)]


def _spread(rows: DataFrame) -> DataFrame:
    """The points dealt evenly over all cores: a file of few row groups is read by few tasks."""
    return rows.select("x").repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def fit_many(rows: DataFrame, ks: Sequence[int], seed: int = 100, max_iter: int = 50, tol: float = 1e-4) -> list[np.ndarray]:
    """Per k the centres of the k-means clusters of the points ``x`` (arrays of finite doubles, one at least)."""
    centres = first_centres(rows, ks, seed)
    width = centres[0].shape[1]

    def blocks(batches):
        for batch in batches:
            x = matrix(batch, width)
            for i in range(0, len(x), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([x[i:i + CHUNK].tobytes()], pa.binary())], names=["x"])

    # a few tasks more or less change nothing: every task returns sums
    held = _spread(rows).mapInArrow(blocks, "x binary").rdd.map(lambda r: np.frombuffer(r["x"]).reshape(-1, width))
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        live = list(range(len(ks)))
        for _ in range(max_iter):
            found = held.mapPartitions(_adder([centres[i] for i in live], width)).treeReduce(np.add)
            still, at = [], 0
            for i in live:
                total, at = found[at:at + len(centres[i])], at + len(centres[i])
                new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centres[i])
                if (((new - centres[i]) ** 2).sum(axis=1) > tol * tol).any():
                    still.append(i)
                centres[i] = new
            live = still
            if not live:
                break
    finally:
        held.unpersist()
    return centres


def _adder(centres: list[np.ndarray], width: int):
    """For each centre of each k the sum and the number of its points in a partition."""
    start = np.cumsum([0, *[len(c) for c in centres]])

    def run(parts):
        total = np.zeros((start[-1], width + 1))
        for x in parts:
            member = np.zeros((len(x), start[-1]))
            for at, first in zip(_nearest(x, centres), start[:-1], strict=True):
                member[np.arange(len(x)), first + at] = 1.0
            total[:, :-1] += member.T @ x
            total[:, -1] += member.sum(axis=0)
        yield total

    return run


def label_many(rows: DataFrame, centres: list[np.ndarray], names: Sequence[str]) -> DataFrame:
    """``x`` and per k, as the column of its name, the number of the nearest centre, in one pass."""
    width = centres[0].shape[1]

    def run(batches):
        for batch in batches:
            x = matrix(batch, width)
            parts = [_nearest(x[i:i + CHUNK], centres) for i in range(0, len(x), CHUNK)]
            found = [pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*parts, strict=True)] if parts else [pa.array([], pa.int32())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("x"), *found], names=["x", *names])

    return _spread(rows).mapInArrow(run, "x array<double>, " + ", ".join(f"{n} int" for n in names))
