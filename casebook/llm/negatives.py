"""Hard-negative mining by slot-decomposed selection.

A positive's window of negatives reaches from a share of the positive's score up to that score. The windows of one
anchor overlap, but their upper limits cut the scores into disjoint slots, and the highest scores below a limit are
the highest of its slot and of all slots further down. So every task keeps the best few rows per (anchor, slot), Spark
merges these combiners, and a suffix merge over at most ``positives`` slots answers all windows of an anchor.

Anchors go against all rows in blocks of bounded bytes: a block is broadcast, every task multiplies its rows with it
tile by tile, and holds the running best of the block alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import keyed, stored

BLOCK_BYTES, TILE = 32 << 20, 512
_LEAST = np.iinfo(np.int64).min


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as int64, short ones filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(column.offsets.to_numpy())
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where every sum is a whole number below 2^53."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = lambda x: float(np.abs(x.astype(float)).max()) if x.size else 0.0
    if top(a) * top(b) * width < 2.0 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _best(group: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` rows of highest score, then least ``row``, of each group."""
    order = np.lexsort((row, -score, group))
    own = group[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own, "left") < k]


def _candidates(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, column) of the allowed cells that reach the k-th highest allowed score of their line, ties included."""
    held = np.where(allowed, score, _LEAST)
    if held.shape[1] > k:
        allowed = allowed & (held >= np.partition(held, -k, axis=1)[:, -k][:, None])
    return np.nonzero(allowed)


class _Running:
    """The best ``k`` rows per group so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.parts = [np.zeros(0, np.int64)] * 4        # group, score, row, id

    def add(self, *new: np.ndarray) -> None:
        every = [np.concatenate(x) for x in zip(self.parts, new, strict=True)]
        keep = _best(every[0], every[1], every[2], self.k)
        self.parts = [x[keep] for x in every]


def _batches(batches):
    """(rows, ids, their null mask, labels, vectors) of Arrow batches of _row, vec_id, label, embedding."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(1)
            yield (batch.column(0).to_numpy(), ids.fill_null(_LEAST).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3)))


def _positives(block, k: int):
    def run(batches):
        own, label, vectors = block.value
        best = _Running(k)
        for row, ids, labels, m in _batches(batches):
            for t in range(0, len(own), TILE):
                score = _scores(vectors[t:t + TILE], m)
                a, v = _candidates(score, (label[t:t + TILE, None] == labels) & (own[t:t + TILE, None] != row), k)
                best.add(a + t, score[a, v], row[v], ids[v])
        group, score, row, ids = best.parts
        yield pa.RecordBatch.from_arrays([pa.array(own[group]), pa.array(score), pa.array(row), pa.array(ids, mask=ids == _LEAST)],
                                         names=["anchor", "score", "_row", "vec_id"])
    return run


def _slots(block, k: int):
    def run(batches):
        own, label, vectors, upper, lower = block.value       # limits falling, one line an anchor; unused ones are least
        best, slots = _Running(k), upper.shape[1]
        for row, ids, labels, m in _batches(batches):
            for t in range(0, len(own), TILE):
                score, high = _scores(vectors[t:t + TILE], m), upper[t:t + TILE]
                other = label[t:t + TILE, None] != labels
                for s in range(slots):
                    inside = other & (score <= high[:, s, None]) & (score >= lower[t:t + TILE, s, None])
                    if s + 1 < slots:
                        inside &= score > high[:, s + 1, None]
                    a, v = _candidates(score, inside & (high[:, s, None] > _LEAST), k)
                    best.add((a + t) * slots + s, score[a, v], row[v], ids[v])
        group, score, row, ids = best.parts
        yield pa.RecordBatch.from_arrays([pa.array(own[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(row), pa.array(ids, mask=ids == _LEAST)],
                                         names=["anchor", "slot", "score", "_row", "vec_id"])
    return run


def _top(df: DataFrame, k: int, *keys: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "_row"))
    return df.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id`` (long), ``embedding`` (whole numbers), ``label`` and ``anchor`` (boolean). Scores are
    inner products; higher ones come first, ties by smaller vec_id (null last), then by row. An anchor's positives are
    its first ``positives`` other rows of its label; a positive's negatives the first ``negatives`` rows of other
    labels with ``share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score``.

    Rows with a null label, vector or component take no part; a null ``anchor`` is false. Vectors of unequal length
    are compared as if filled up with zeros. Repeated vec_ids are rows of their own, so an anchor's copy can be its
    positive; their results stand side by side. Positives without negatives, anchors without positives and empty
    tables give no row. Scores and their multiples by ``share`` have to fit in 64 bits.
    """
    spark = vectors.sparkSession
    rows = keyed(vectors.withColumnRenamed("vec_id", "doc_id"), label="long", embedding="array<bigint>", anchor="boolean")
    rows = rows.filter("label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    rows = stored(rows.select("_row", F.col("doc_id").alias("vec_id"), "label", "embedding", F.coalesce("anchor", F.lit(False)).alias("anchor")), "vectors")
    asked = rows.filter("anchor")
    n, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], shape)
    # one file holds at most as many anchors as a block may have bytes for
    room = max(1, block_bytes // (8 * max(1, width)))
    files = stored(asked.drop("anchor").repartition(-(-n // room)), "anchors", maxRecordsPerFile=room).inputFiles()
    every = rows.select("_row", "vec_id", "label", "embedding")
    out = None
    for file in files:
        found = _block(spark, every, spark.read.parquet(file), positives, negatives, share)
        out = found if out is None else out.unionByName(found)
    return out


def _block(spark, rows: DataFrame, block: DataFrame, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    table = block.select("_row", "label", "embedding").toArrow().combine_chunks()
    own, label = table["_row"].to_numpy(), table["label"].to_numpy()
    matrix = _matrix(table["embedding"].combine_chunks())
    order = np.argsort(own)
    own, label, matrix = own[order], label[order], matrix[order]
    sent = spark.sparkContext.broadcast((own, label, matrix))
    near = stored(_top(rows.mapInArrow(_positives(sent, positives), "anchor long, score long, _row long, vec_id long"), positives, "anchor"), "positives")
    # the distinct scores of an anchor's positives, falling, are the upper limits of its slots
    limits = near.select("anchor", "score").distinct().toArrow()        # at most `positives` rows an anchor of the block
    anchor, score = limits["anchor"].to_numpy(), limits["score"].to_numpy()
    order = np.lexsort((-score, anchor))
    anchor, score = np.searchsorted(own, anchor[order]), score[order]
    upper = np.full((len(own), positives), _LEAST)
    place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor, "left")
    upper[anchor, place] = score
    lower = upper.copy()
    lower[anchor, place] = -((-score * share[0]) // share[1])
    sent = spark.sparkContext.broadcast((own, label, matrix, upper, lower))
    kept = _top(rows.mapInArrow(_slots(sent, negatives), "anchor long, slot int, score long, _row long, vec_id long"), negatives, "anchor", "slot")
    kept = kept.select("anchor", F.col("slot").alias("below"), F.col("score"), "_row", F.col("vec_id").alias("negative_id"))
    first = near.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("score"))) - 1)
    first = first.select("anchor", "slot", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # suffix merge: a positive takes the first rows of its own slot and of all slots below
    merged = first.join(kept, "anchor").filter(F.col("below") >= F.col("slot"))
    merged = _top(merged, negatives, "anchor", "place").filter(F.col("score") * share[1] >= F.col("positive_score") * share[0])
    ids = block.select(F.col("_row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return merged.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
