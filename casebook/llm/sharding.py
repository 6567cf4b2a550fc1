"""Contiguous sharding by minimax: the smallest capacity with which an ordered row of atomic groups fits the shards.

Groups are equal texts (null counts as empty), ordered by their least row key; a group is never split. Rows are laid
out once in (group, row) order by a range partitioning, with running sizes per partition; the partition totals (one
row a partition) give every row its place and every group its end on one line of bytes.

The least capacity is found by binary search with a greedy check: each shard runs to the last group end within the
capacity. The driver never holds all ends. It knows some of them, and of each gap between two whether other ends lie
inside, so a greedy run gives a lower and an upper bound for every cut. Where that leaves capacities undecided, only
the gaps that a cut can fall into are read more finely (at most ``KNOWN`` numbers a round), until the least capacity
and its cuts are exact.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import keyed, stored

KNOWN = 8192


class Ends:
    """Known group ends; ``open_[i]`` tells whether unknown ends lie between known[i - 1] and known[i]."""

    def __init__(self, total: int) -> None:
        self.known, self.open_ = np.array([0, total], np.int64), np.array([False, True])

    def run(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Cuts of a greedy run; of unknown cuts the least (or, if hopeful, the greatest) possible place."""
        x, cuts, total = 0, [], int(self.known[-1])
        for _ in range(shards):
            at = int(np.searchsorted(self.known, x + capacity, "right"))
            nearest = int(self.known[at - 1])
            x = x + capacity if hopeful and at < len(self.known) and self.open_[at] else max(nearest, 0)
            cuts.append(min(x, total))
        return cuts

    def fits(self, capacity: int, shards: int, hopeful: bool) -> bool:
        return self.run(capacity, shards, hopeful)[-1] >= self.known[-1]

    def least(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """Smallest capacity in low..high that fits; ``high`` is known to."""
        while low < high:
            mid = (low + high) // 2
            if self.fits(mid, shards, hopeful):
                high = mid
            else:
                low = mid + 1
        return low

    def refine(self, ends: DataFrame, gaps: list[int]) -> None:
        """Read the ends inside the given gaps: all of them, or the last of each of about ``KNOWN`` stretches.
        Neighbouring gaps are read as one span, in place of the ends known inside it."""
        runs = np.split(np.array(gaps), np.flatnonzero(np.diff(gaps) > 1) + 1)
        spans = [(int(self.known[r[0] - 1]), int(self.known[r[-1]])) for r in runs]
        width = max(1, sum(b - a for a, b in spans) // KNOWN)
        inside = reduce(or_, ((F.col("end") > a) & (F.col("end") < b) for a, b in spans))
        got = ends.filter(inside).groupBy(F.floor(F.col("end") / width).alias("w")).agg(F.max("end").alias("end"), F.count("*").alias("n")).collect()
        now = dict(zip(self.known.tolist(), self.open_.tolist(), strict=True))
        for r in runs:
            for i in r[:-1]:
                del now[int(self.known[i])]
            now[int(self.known[r[-1]])] = False
        now |= {r["end"]: r["n"] > 1 for r in got}
        self.known = np.array(sorted(now), np.int64)
        self.open_ = np.array([now[x] for x in self.known.tolist()])


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(least capacity, cuts) for groups that end at ``ends.end`` on a line of ``total``."""
    if total == 0:
        return 0, [0] * shards
    row = Ends(total)
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    while True:
        low = row.least(low, high, shards, hopeful=True)     # less cannot fit
        high = row.least(low, high, shards, hopeful=False)   # this surely fits
        bounds = list(zip(row.run(low, shards, False), row.run(high, shards, True), strict=True))
        gaps = sorted({i for a, b in bounds for i in range(int(np.searchsorted(row.known, a, "right")), min(len(row.known), int(np.searchsorted(row.known, b, "right")) + 1)) if row.open_[i]})
        if low == high and row.run(low, shards, False) == row.run(low, shards, True):
            return low, row.run(low, shards, False)
        row.refine(ends, gaps)


def _laid_out(batches):
    """Partition number, place and running size of each row of a sorted partition."""
    part, place, held = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        size = batch.column(2).to_numpy().astype(np.int64)
        upto = np.cumsum(size) + held
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(place, place + n)), pa.array(upto)],
                                         names=["_row", "doc_id", "size", "text_crc32", "g", "part", "place", "upto"])
        place, held = place + n, int(upto[-1]) if n else held


def contiguous_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size``: UTF-8 bytes of the text plus 8; null counts as the empty text, with crc32 0. ``law`` is ``bytes``,
    ``grown_shard`` null. ``slot`` counts the rows of a shard from 0 in (group, row) order. Equal texts share a shard.
    Repeated rows and null ids are rows of their own; an empty table gives no rows. With fewer groups than shards,
    shards stay empty.
    """
    rows, data = keyed(docs, text="string"), F.coalesce("text", F.lit("")).cast("binary")
    facts = stored(rows.select("_row", "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                               F.unhex(F.md5(data)).alias("same")), "shard-facts")
    groups = facts.groupBy("same", "size").agg(F.min("_row").alias("g"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = facts.join(groups, ["same", "size"], "left").select("_row", "doc_id", "size", "text_crc32", F.coalesce("g", "_row").alias("g"))
    line = stored(placed.repartitionByRange("g", "_row").sortWithinPartitions("g", "_row").mapInArrow(
        _laid_out, "_row long, doc_id long, size long, text_crc32 long, g long, part long, place long, upto long"), "shard-line")
    parts = line.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("part").collect()
    spark, before, at, total = docs.sparkSession, [], 0, 0
    for p in parts:
        before.append((p["part"], at, total))
        at, total = at + p["n"], total + p["bytes"]
    offsets = spark.createDataFrame(before, "part long, rows_before long, bytes_before long")
    whole = line.join(offsets, "part").select("doc_id", "size", "text_crc32", "g", (F.col("place") + F.col("rows_before")).alias("place"),
                                              (F.col("upto") + F.col("bytes_before")).alias("end"))
    ends = stored(whole.groupBy("g").agg(F.max("end").alias("end"), F.sum("size").alias("size")).select("end", "size"), "shard-ends")
    largest = ends.agg(F.max("size")).first()[0] or 0
    _, cuts = minimax_cuts(ends, total, largest, shards)
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    whole = whole.withColumn("shard", shard.cast("int"))
    firsts = {r["shard"]: r["first"] for r in whole.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for i in range(shards) for x in (i, firsts.get(i, 0))]), F.col("shard"))
    return whole.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
