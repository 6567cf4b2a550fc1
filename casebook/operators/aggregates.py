"""Grouped aggregates, shares, pivots, histograms and box-plot statistics.

Scale notes:
* totals for shares come from a scalar subquery (``DataFrame.scalar``), not a
  cross join and not an un-partitioned window, so no single task sees all groups;
* pivots always take an explicit value list (no extra job to find the values,
  and a bounded output width);
* histogram bin tables are generated from ``n_bins`` (a parameter, so a proven
  size bound) and are the only side that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.compat import col_
from casebook.operators.ordered import null_safe_join, range_bucket
from casebook.session import cut_lineage


def count_by(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    """Row count by (derived) keys: ``GROUP BY keys``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_total(df: DataFrame, by: Sequence, digits: int = 2, scale: float = 100.0,
                   round_before_scale: bool = False, name: str = "n",
                   share: str = "share") -> DataFrame:
    """Group count and its share of all rows.

    ``round_before_scale=False``: ``round(scale * n / total, digits)``;
    ``True`` reproduces ``scale * round(n / total, digits)`` (whole percents).
    """
    grouped = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    # the total is summed from the grouped counts (one row per group), so the
    # input is scanned once; the subquery reuses the grouped exchange
    total = grouped.select(F.sum(name)).scalar()
    frac = F.col(name) / total
    val = F.lit(scale) * F.round(frac, digits) if round_before_scale else F.round(F.lit(scale) * frac, digits)
    return grouped.withColumn(share, val)


def pivot_count(df: DataFrame, index: Sequence, column: str, values: Sequence,
                value_col: str | None = None) -> DataFrame:
    """Count pivot (``index`` × listed ``values`` of ``column``); empty cell → NULL."""
    agg = F.count(F.col(value_col)) if value_col else F.count(F.lit(1))
    out = df.groupBy(*index).pivot(column, list(values)).agg(agg)
    # pandas leaves a missing combination as NaN, Spark's pivot count gives NULL too
    return out


def pivot_row_percent(df: DataFrame, index: Sequence, column: str, values: Sequence,
                      digits: int = 1, fill=None) -> DataFrame:
    """Pivot counts as a percentage of the row total, ``round(100*x/total, digits)``.

    The total counts every row of the group, also those whose value is not listed;
    a value that a group lacks is NULL (or ``fill``)."""
    names = [str(v) for v in values]
    p = df.groupBy(*index).agg(F.count(F.lit(1)).alias("_total"),
                               *[F.count_if(F.col(column) == v).alias(f"_n{i}") for i, v in enumerate(values)])
    out = p.select(*index, *[F.round(F.lit(100.0) * F.nullif(F.col(f"_n{i}"), F.lit(0)) / F.col("_total"), digits).alias(n)
                             for i, n in enumerate(names)])
    if fill is not None:
        out = out.na.fill(fill, subset=names)
    return out


def histogram(df: DataFrame, c: str, n_bins: int = 20, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Fixed-width histogram; top edge goes to the last bin, empty bins kept.

    ``lo``/``hi`` default to the column's min / max, read in one metadata pass
    (a single-row aggregate). Columns: ``bin (1..n), bin_lo, bin_hi, n``.
    """
    x = F.col(c).cast("double")
    if lo is None or hi is None:
        r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
        lo = r["a"] if lo is None else lo
        hi = r["b"] if hi is None else hi
    lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    width = (hi_c - lo_c) / F.lit(float(n_bins))
    b = F.when(x == hi_c, F.lit(n_bins)).otherwise(F.floor((x - lo_c) / width).cast("int") + 1)
    counts = (df.where(x.isNotNull() & (x >= lo_c) & (x <= hi_c))
                .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    bins = df.sparkSession.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(bins).join(counts, "bin", "left")
    return out.select("bin",
                      (lo_c + (F.col("bin") - 1) * width).alias("bin_lo"),
                      (lo_c + F.col("bin") * width).alias("bin_hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def exact_quantiles(df: DataFrame, c: str, probs: Sequence[float], by: Sequence[str] = (),
                    prefix: str = "q", n_buckets: int = 64, count_name: str | None = None,
                    interpolation: str = "linear", few: int = 1_000_000) -> DataFrame:
    """Exact quantiles by selection (pandas ``quantile``, SQL ``percentile_cont``).

    Wanted are the values at ranks floor(h)+1 and ceil(h)+1, h = (n-1)·p. While a
    group still has more than ``few`` candidate rows of differing values, these are
    counted by range bucket (combined map-side, no row moves), only the buckets
    that hold a wanted rank are kept, and the ranks become ranks within them. The
    last candidates are grouped by value, so ties cost one row each, and a running
    count over the distinct values finds the wanted ones. No window or shuffle
    sees the raw rows, and a group with a third of all rows is never gathered.

    Values keep their own type throughout. ``interpolation`` 'linear' interpolates
    as doubles; 'lower' and 'higher' return the value itself. NULL values are left
    out, NULL keys form a group. Columns: ``*by, q0, q1, …`` in the order of
    ``probs``, plus the non-NULL count as ``count_name`` when given.
    """
    keys = list(by)
    rows = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("_v"), F.lit(0).cast("long").alias("_p"))
    hs = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    sides = [F.struct(F.lit(i).alias("_i"), F.lit(s).alias("_s"), (f(h) + 1).cast("long").alias("_r"))
             for i, h in enumerate(hs) for s, f in ((0, F.floor), (1, F.ceil))]
    want = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) \
               .select(*keys, "_n", F.lit(0).cast("long").alias("_p"), F.inline(F.array(*sides)))

    before = None
    while True:
        left = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        most = left.where("_a < _b").agg(F.max("_m")).first()[0] or 0
        if most <= few or most == before:           # few enough, or equal as doubles: the last step is exact anyway
            break
        before = most
        fine = range_bucket(rows, "_v", n_buckets).withColumnRenamed("_p", "_up") \
            .withColumn("_p", F.col("_up") * n_buckets + F.col("_bucket")).drop("_bucket")
        below = Window.partitionBy(*keys, "_up").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        totals = fine.groupBy(*keys, "_up", "_p").agg(F.count(F.lit(1)).alias("_m")) \
            .withColumn("_o", F.coalesce(F.sum("_m").over(below), F.lit(0)))
        hit = null_safe_join(want.withColumnRenamed("_p", "_up"), totals, [*keys, "_up"]) \
            .where((F.col("_r") > F.col("_o")) & (F.col("_r") <= F.col("_o") + F.col("_m")))
        want = cut_lineage(hit.select(*keys, "_n", "_p", "_i", "_s", (F.col("_r") - F.col("_o")).alias("_r")))
        rows = cut_lineage(null_safe_join(fine.drop("_up"), want.select(*keys, "_p").distinct(), [*keys, "_p"], "left_semi"))

    upto = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = rows.groupBy(*keys, "_p", "_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_c", F.sum("_m").over(upto))
    picked = null_safe_join(want, values, [*keys, "_p"]) \
        .where((F.col("_r") <= F.col("_c")) & (F.col("_r") > F.col("_c") - F.col("_m")))
    at = lambda i, s: F.max(F.when((F.col("_i") == i) & (F.col("_s") == s), F.col("_v")))
    g = picked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[at(i, s).alias(f"_{s}_{i}") for i in range(len(probs)) for s in (0, 1)])
    if interpolation == "linear":
        lo, hi = (lambda i, s=s: F.col(f"_{s}_{i}").cast("double") for s in (0, 1))
        qs = [lo(i) + (h - F.floor(h)) * (hi(i) - lo(i)) for i, h in enumerate(hs)]
    else:
        qs = [F.col(f"_{int(interpolation == 'higher')}_{i}") for i in range(len(probs))]
    extra = [F.col("_n").alias(count_name)] if count_name else []
    return g.select(*keys, *[q.alias(f"{prefix}{i}") for i, q in enumerate(qs)], *extra)


def quantiles(c, probs: Sequence[float], exact: bool = True, accuracy: int = 1_000_000) -> Column:
    """array of quantiles as one aggregate Column. exact → Spark ``percentile``
    (keeps a value → count map per group: use only for columns with few distinct
    values per group, otherwise :func:`exact_quantiles`); otherwise
    ``percentile_approx`` (bounded sketch memory)."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return F.percentile(col_(c), arr) if exact else F.percentile_approx(col_(c), arr, accuracy)


def boxplot_stats(df: DataFrame, c: str, by: Sequence[str] = (), whisker: float = 1.5,
                  digits: int | None = None) -> DataFrame:
    """Five-number summary, IQR fences, whisker ends and outlier count by group.

    Pass 1: per-group quartiles (exact, distributed: :func:`exact_quantiles`).
    Pass 2: the data is
    joined to its group's fences (AQE broadcasts the stats side when it is
    measured small, else sort-merge) and whiskers / outliers are counted.
    Whisker ends are the most extreme data values inside the fences. With
    ``digits`` the quartiles are rounded before the fences are derived. Groups
    whose values are all NULL have no row.
    """
    x = F.col(c)
    keys = list(by)
    # min and max are the quantiles 0 and 1, and the count comes with the ranks:
    # one ranked pass gives the whole five-number summary
    q = exact_quantiles(df, c, [0.0, 0.25, 0.5, 0.75, 1.0], keys, count_name="n")
    rq = (lambda v: F.round(v, digits)) if digits is not None else (lambda v: v)
    q = q.select(*keys, "n", F.col("q0").alias("min"), rq(F.col("q1")).alias("q1"), rq(F.col("q2")).alias("median"),
                 rq(F.col("q3")).alias("q3"), F.col("q4").alias("max"))
    if keys:
        stats = q
    else:
        stats = df.sparkSession.range(1).select(*[q.select(n).scalar().alias(n)
                                                   for n in ["n", "min", "q1", "median", "q3", "max"]])
    stats = stats.withColumn("iqr", F.col("q3") - F.col("q1")) \
                 .withColumn("lower_fence", F.col("q1") - F.lit(whisker) * F.col("iqr")) \
                 .withColumn("upper_fence", F.col("q3") + F.lit(whisker) * F.col("iqr"))
    inside_of = lambda v, lo, hi: (v >= lo) & (v <= hi)
    if keys:
        j = df.select(*keys, x.alias("_x")).join(stats.select(*keys, "lower_fence", "upper_fence"), keys)
        inside = inside_of(F.col("_x"), F.col("lower_fence"), F.col("upper_fence"))
        w = j.groupBy(*keys).agg(
            F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
            F.count_if(F.col("_x").isNotNull() & ~inside).alias("n_outliers"))
        return stats.join(w, keys)
    # global: the fences are one row, read through scalar subqueries (no join)
    lo, hi = stats.select("lower_fence").scalar(), stats.select("upper_fence").scalar()
    inside = inside_of(x, lo, hi)
    w = df.agg(F.min(F.when(inside, x)).alias("whisker_lo"),
               F.max(F.when(inside, x)).alias("whisker_hi"),
               F.count_if(x.isNotNull() & ~inside).alias("n_outliers"))
    return stats.select("*", w.select("whisker_lo").scalar().alias("whisker_lo"),
                        w.select("whisker_hi").scalar().alias("whisker_hi"),
                        w.select("n_outliers").scalar().alias("n_outliers"))


def mean_all_numeric(df: DataFrame, by: Sequence[str], digits: int | None = None,
                     prefix: str = "") -> DataFrame:
    """Mean of every numeric column that is not a key (``groupby(k).mean()``)."""
    num = [f.name for f in df.schema.fields
           if f.name not in by and f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")]
    aggs = []
    for n in num:
        a = F.avg(n)
        aggs.append((F.round(a, digits) if digits is not None else a).alias(prefix + n))
    return df.groupBy(*by).agg(*aggs)


def column_totals(df: DataFrame, cols: dict, label: str = "measure", value: str = "total") -> DataFrame:
    """Sum of several columns as labelled rows: ``{label: column}`` → (label, total)."""
    one = df.agg(*[F.sum(F.col(c)).alias(f"_s{i}") for i, c in enumerate(cols.values())])
    pairs = ", ".join(f"'{lab}', _s{i}" for i, lab in enumerate(cols.keys()))
    return one.selectExpr(f"stack({len(cols)}, {pairs}) as ({label}, {value})")
