"""Prefix scans over a global order: running sums, row numbers and previous values without a window on raw rows.

``Window.orderBy(x)`` without ``partitionBy`` moves every row into one task, and a window by key moves a hot key into
one. A scan goes through the order in partitions instead:

1. the rows are range-partitioned and sorted once, by group, order and all other columns, so equal order keys are split
   too; each task runs through its sorted Arrow batches with cumulative sums and a carried last row. It holds one batch.
   The result, with the task's number, is stored;
2. a summary row per (task, group) - sums, count, last values, an associative combination - is read back from the
   stored rows, and exclusive prefix sums over these few rows are the offsets;
3. the offsets are added to the stored rows in a join on (task, group).

There are as many partitions as the session's shuffle partitions (adaptive execution merges small neighbours), whatever
the number of distinct keys. Only rows equal in every column stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.operators.ordered import null_safe_join
from casebook.session import stored

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _starts(batch: pa.RecordBatch, names: Sequence[str], carried: list | None) -> np.ndarray:
    """Rows at which a new group begins (NULL equals NULL); the first row against the row carried over."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for i, name in enumerate(names):
        column = batch.column(name)
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        first = column[0]
        new[0] |= carried is None or not (first.equals(carried[i]) or (not first.is_valid and not carried[i].is_valid))
    new[0] |= carried is None
    return new


def _local(groups: Sequence[str], sums: Sequence[str], whole: Sequence[bool], previous: Sequence[str]):
    def run(batches):
        part, done, carried, last, total = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _starts(batch, groups, carried)
            at = np.flatnonzero(new)
            head = int(at[0]) if len(at) else n          # rows that go on with the carried group
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out, ends = [], []
            for i, name in enumerate(sums):
                kind = np.int64 if whole[i] else np.float64
                x = batch.column(name).cast(pa.int64() if whole[i] else pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                x[x != x] = 0
                running = np.cumsum(x)
                running -= np.where(begin > 0, running[begin - 1], 0).astype(kind)
                if head and total is not None:
                    running[:head] += total[i]
                ends.append(running[-1])
                out.append(pa.array(running))
            for i, name in enumerate(previous):
                column = batch.column(name)
                index = np.arange(n) - 1
                lag = column.take(pa.array(index, mask=new | (index < 0)))
                if head and last is not None:            # the first row goes on with the carried group
                    lag = pa.concat_arrays([pa.array([last[i].as_py()], column.type), lag.slice(1)])
                out.append(lag)
            out += [pa.array(new), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n) + done)]
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[f"_sum{i}" for i in range(len(sums))],
                                                                            *[f"_lag{i}" for i in range(len(previous))], "_new", "_part", "_pos"])
            carried, total = [batch.column(g)[n - 1] for g in groups], ends
            last = [batch.column(p)[n - 1] for p in previous]
    return run


def scan(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str] | None = None, previous: dict[str, str] | None = None,
         partition: Sequence[str] = (), totals: dict[str, str] | None = None, parts: int | None = None,
         keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with running values in ``order`` (column names, or columns with a direction) within ``partition``.

    ``sums`` names columns by the value whose inclusive running sum they get (whole numbers exactly; NULL and NaN count
    as 0), ``totals`` columns that get the group's whole sum of one of these values, ``previous`` columns that get the
    value of the row before (NULL at a group's first row). NULL group keys form a group; ties in ``order`` are broken
    by all other columns. ``parts`` fixes the number of range partitions; ``keep`` names the columns of ``df`` to return
    (all, if not given), so that the others end at the sort.
    """
    spark, sums, previous, totals = df.sparkSession, sums or {}, previous or {}, totals or {}
    groups, columns = list(partition), df.columns
    exact = [isinstance(df.schema[v].dataType, _WHOLE) for v in sums]
    ties = [c for c in columns if c not in groups and c not in {o for o in order if isinstance(o, str)} and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    keys = [F.col(k) if isinstance(k, str) else k for k in [*groups, *order, *ties]]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    columns = [c for c in columns if keep is None or c in keep]
    sent = [c for c in df.columns if c in {*columns, *groups, *sums, *previous}]
    shape = T.StructType([*[df.schema[c] for c in sent], *[T.StructField(f"_sum{i}", T.LongType() if w else T.DoubleType()) for i, w in enumerate(exact)],
                          *[T.StructField(f"_lag{i}", df.schema[v].dataType) for i, v in enumerate(previous)],
                          T.StructField("_new", T.BooleanType()), T.StructField("_part", T.IntegerType()), T.StructField("_pos", T.LongType())])
    local = stored(dealt.sortWithinPartitions(*keys).select(*sent).mapInArrow(_local(groups, list(sums), exact, list(previous)), shape), "scan")

    value = lambda v, w: F.col(v).cast("long") if w else F.nanvl(F.col(v).cast("double"), F.lit(0.0))
    own = [F.sum(value(v, w)).alias(f"_t{i}") for i, (v, w) in enumerate(zip(sums, exact, strict=True))]
    tail = [F.max_by(F.struct(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(previous)]), "_pos").alias("_tail")] if previous else []
    small = local.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), *own, *tail)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row a (task, group)
    every = Window.partitionBy(*groups)
    offsets = small.select("_part", *groups, *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))],
                           *[F.sum(f"_t{list(sums).index(v)}").over(every).alias(f"_all{i}") for i, v in enumerate(totals)],
                           *([F.lag("_tail").over(Window.partitionBy(*groups).orderBy("_part")).alias("_carry")] if previous else []))
    joined = null_safe_join(local, offsets, ["_part", *groups])
    lag = lambda i: F.when(F.col("_new"), F.col(f"_carry._v{i}")).otherwise(F.col(f"_lag{i}"))
    return joined.select(*columns, *[(F.col(f"_sum{i}") + F.col(f"_o{i}")).alias(name) for i, name in enumerate(sums.values())],
                         *[lag(i).alias(name) for i, name in enumerate(previous.values())],
                         *[F.col(f"_all{i}").alias(name) for i, name in enumerate(totals.values())])
