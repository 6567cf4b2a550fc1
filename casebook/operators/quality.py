"""Profiling, deduplication, missing values and outliers.

Operators that decide the output *schema* from the data (sparse-column drop,
constant columns) run one documented metadata pass: a single one-row aggregate
collected to the driver, then a static ``select``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.session import cut_lineage


def _stack(one_row: DataFrame, labels: Sequence[str], prefix: str, out_cols: Sequence[str]) -> DataFrame:
    """Unpivot ``prefix{i}_{j}`` cells of a one-row frame into (column, values…)."""
    k = len(out_cols)
    parts = []
    for i, name in enumerate(labels):
        esc = name.replace("'", "\\'")
        parts.append(", ".join([f"'{esc}'"] + [f"`{prefix}{i}_{j}`" for j in range(k)]))
    return one_row.selectExpr(f"stack({len(labels)}, {', '.join(parts)}) as (`column`, {', '.join(out_cols)})")


def null_profile(df: DataFrame, min_pct: float | None = None, digits: int = 2) -> DataFrame:
    """Per column: ``n_null`` and ``null_pct = round(100*n_null/n, digits)``; one scan.

    ``min_pct`` keeps only columns whose share is above it (``> 0`` in the survey).
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"s{i}_0") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    one = one.select("*", *[F.round(F.lit(100.0) * F.col(f"s{i}_0") / F.col("_n"), digits).alias(f"s{i}_1")
                            for i in range(len(cols))])
    out = _stack(one, cols, "s", ["n_null", "null_pct"])
    if min_pct is not None:
        out = out.where(F.col("null_pct") > min_pct)
    return out


def schema_info(df: DataFrame) -> DataFrame:
    """Per column: position, Spark type and non-null count (``df.info()``); one scan."""
    cols = df.columns
    types = [f.dataType.simpleString() for f in df.schema.fields]
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"s{i}_0") for i, c in enumerate(cols)])
    one = one.select("*", *[F.lit(t).alias(f"s{i}_1") for i, t in enumerate(types)],
                     *[F.lit(i + 1).alias(f"s{i}_2") for i in range(len(cols))])
    return _stack(one, cols, "s", ["non_null", "dtype", "position"])


def describe(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = (),
             digits: int = 4) -> DataFrame:
    """count / mean / std (sample) / min / max [/ percentiles] per column, one scan.

    Long form: one row per column. Percentiles are exact (linear interpolation).
    """
    stats = ["count", "mean", "std", "min", "max"] + [f"p{int(round(p * 100))}" for p in percentiles]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"s{i}_0"), F.round(F.avg(x), digits).alias(f"s{i}_1"),
                 F.round(F.stddev_samp(x), digits).alias(f"s{i}_2"), F.min(x).alias(f"s{i}_3"),
                 F.max(x).alias(f"s{i}_4")]
    one = df.agg(*aggs)
    if percentiles:
        from casebook.operators.aggregates import exact_quantiles
        extra = []
        for i, c in enumerate(cols):
            q = exact_quantiles(df, c, percentiles)
            extra += [F.round(q.select(f"q{j}").scalar(), digits).alias(f"s{i}_{5 + j}") for j in range(len(percentiles))]
        one = one.select("*", *extra)
    return _stack(one, list(cols), "s", stats)


def drop_sparse(df: DataFrame, pct: float, inclusive: bool = True) -> tuple[DataFrame, list[str]]:
    """Drop columns whose null share is >= ``pct`` (> when not inclusive).

    Metadata pass: one aggregate row is collected to choose the columns.
    """
    prof = null_profile(df).collect()
    dropped = [r["column"] for r in prof if (r["null_pct"] >= pct if inclusive else r["null_pct"] > pct)]
    return df.drop(*dropped), dropped


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: is it single-valued (ignoring NULL)? ``min = max`` in one pass.

    Returns (column, n_distinct_le_1 BOOLEAN, min, max) as strings.
    """
    cols = list(cols or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs += [F.min(x).cast("string").alias(f"s{i}_0"), F.max(x).cast("string").alias(f"s{i}_1")]
    one = df.agg(*aggs)
    one = one.select("*", *[F.coalesce(F.col(f"s{i}_0") == F.col(f"s{i}_1"), F.lit(True)).alias(f"s{i}_2")
                            for i in range(len(cols))])
    return _stack(one, cols, "s", ["min_value", "max_value", "is_constant"])


def dominant_values(df: DataFrame, share: float = 0.99, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Columns of which one value makes up at least ``share`` of the non-NULL values: (column, value, n, share).

    Two passes, whatever the number of columns. A frequent-items sketch of all columns (``freqItems``: mergeable
    counters, a few per column, that cannot miss a value this frequent) names candidates, a bounded list that the driver
    reads; one aggregate counts exactly these. Values are compared and shown as strings; of values that are equally
    frequent the least is shown. Columns of NULLs alone have no dominant value.
    """
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    cols = list(cols or df.columns)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    # NULLs are left out of the shares, but the sketch counts them: it gets room for them as for any frequent value
    nulls = text.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"c{i}").alias(f"k{i}") for i in range(len(cols))]).first()
    least = min([nulls[f"k{i}"] / nulls["n"] for i in range(len(cols)) if nulls[f"k{i}"]], default=1.0) if nulls["n"] else 1.0
    found = text.stat.freqItems([f"c{i}" for i in range(len(cols))], max(1e-4, share * least / 2)).first()
    seen = [(i, v) for i in range(len(cols)) for v in sorted({x for x in found[f"c{i}_freqItems"] or [] if x is not None})]
    shape = "`column` string, value string, n long, share double"
    if not seen:
        return df.sparkSession.createDataFrame([], shape)
    counts = [F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("value")) for i in sorted({i for i, _ in seen})]
    held = text.select(F.explode(F.array(*counts)).alias("x")).select("x.i", "x.value").where("value IS NOT NULL")
    listed = df.sparkSession.createDataFrame(seen, "i int, value string")
    exact = held.join(listed, ["i", "value"]).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    total = {i: nulls[f"k{i}"] for i in range(len(cols))}
    names = df.sparkSession.createDataFrame([(i, c, total[i]) for i, c in enumerate(cols)], "i int, `column` string, total long")
    first = exact.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("x")).select("i", (-F.col("x.less")).alias("n"), "x.value")
    out = first.join(names, "i").where(F.col("n") >= F.lit(share) * F.col("total"))
    return out.select("column", "value", "n", F.round(F.col("n") / F.col("total"), digits).alias("share"))


def drop_dominant(df: DataFrame, share: float = 0.99) -> tuple[DataFrame, list[str]]:
    """Drop columns that one value dominates, and columns of NULLs alone (metadata pass)."""
    dropped = {r["column"] for r in dominant_values(df, share).collect()}
    empty = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    dropped |= {c for i, c in enumerate(df.columns) if not empty[f"k{i}"]}
    return df.drop(*dropped), [c for c in df.columns if c in dropped]


def drop_constant(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop single-valued columns (metadata pass)."""
    rows = constant_columns(df).collect()
    dropped = [r["column"] for r in rows if r["is_constant"]]
    return df.drop(*dropped), dropped


def all_null(cols: Sequence[str]) -> Column:
    out = None
    for c in cols:
        p = F.col(f"`{c}`").isNull()
        out = p if out is None else out & p
    return out


def dedup(df: DataFrame, keys: Sequence[str], keep: str = "first",
          order_by: Sequence[str] = (), null_keys: str = "group") -> DataFrame:
    """Deterministic deduplication, written as aggregates so a hot key is
    combined map-side instead of being sorted whole inside one task.

    keep: 'first' / 'last' → one row per key, the smallest / largest in
    ascending ``order_by`` (ties broken by the remaining columns, so the result
    is deterministic even without a total order); 'none' → drop every row of a
    duplicated key; 'all_but_last' → every row except one copy of the last row
    of its key (pandas ``df[df.duplicated(keep='last')]``).
    null_keys: 'group' → NULL keys equal each other (pandas); 'keep' → a row
    with a NULL key is never a duplicate.

    'first' / 'last' are ``min`` / ``max`` of a struct (order columns first);
    'none' joins back the keys whose grouped count is 1 (left-semi, NULL-safe);
    'all_but_last' is ``exceptAll`` of the last rows, grouped by whole rows.
    """
    if keep not in ("first", "last", "none", "all_but_last"):
        raise ValueError(keep)
    order = list(order_by)
    if keep != "none" and not order:
        raise ValueError("keep='first'/'last'/'all_but_last' needs order_by")
    cols = df.columns
    if null_keys == "keep":
        has_null = None
        for k in keys:
            p = F.col(k).isNull()
            has_null = p if has_null is None else has_null | p
        nulls = df.where(has_null)
        rest = dedup(df.where(~has_null), keys, keep, order, "group")
        return rest if keep == "all_but_last" else rest.unionByName(nulls)
    others = [c for c in cols if c not in keys and c not in order]
    if keep in ("first", "last", "all_but_last"):
        pick = F.min if keep == "first" else F.max
        packed = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)],
                          *[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(others)])
        agg = df.groupBy(*keys).agg(pick(packed).alias("_p"))
        best = agg.select(*keys, *[F.col(f"_p.o{i}").alias(c) for i, c in enumerate(order)],
                          *[F.col(f"_p.r{i}").alias(c) for i, c in enumerate(others)]).select(*cols)
        return best if keep != "all_but_last" else df.exceptAll(best)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(counts[f"_k{i}"])
        cond = c if cond is None else cond & c
    return df.join(counts, cond, "left_semi")


def group_size(df: DataFrame, keys: Sequence[str], name: str = "group_size") -> DataFrame:
    """Attach the number of rows sharing each row's key (NULL keys form one group).

    Grouped count joined back NULL-safely instead of ``count(*) over (partition
    by key)``, so a hot key is counted map-side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], name)
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(counts[f"_g{i}"])
        cond = c if cond is None else cond & c
    return df.join(counts, cond, "inner").drop(*[f"_g{i}" for i in range(len(keys))])


def full_row_duplicates(df: DataFrame, name: str = "n_copies") -> DataFrame:
    """Distinct rows that occur more than once, with their multiplicity."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(name)) \
             .where(F.col(name) > 1)


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """NULL → constant per column (dates and timestamps through ``coalesce``)."""
    out = df
    simple = {}
    for c, v in values.items():
        if isinstance(v, Column):
            out = out.withColumn(c, F.coalesce(F.col(c), v))
        else:
            simple[c] = v
    return out.na.fill(simple) if simple else out


def sentinel_to_null(df: DataFrame, sentinel: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Placeholder text (e.g. ``'Select'``) → NULL over all (or the given) string columns."""
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    target = set(cols or strings)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit(sentinel)).alias(c) if c in target else F.col(f"`{c}`")
                       for c in df.columns])


def mode_value(df: DataFrame, c: str, exclude: Sequence = ()) -> Column:
    """Most frequent non-NULL value of ``c`` (ties → smallest value), excluding the
    listed codes, as a scalar-subquery Column. Partial counts are combined
    map-side, so only one row per distinct value is shuffled."""
    x = F.col(c)
    src = df.where(x.isNotNull() & ~x.isin(list(exclude))) if exclude else df.where(x.isNotNull())
    counts = src.groupBy(x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    # max_by over (count, then smallest value) written as min_by of (-count, value)
    best = counts.agg(F.min_by(F.col("_v"), F.struct((-F.col("_n")).alias("a"), F.col("_v").alias("b"))).alias("m"))
    return best.select("m").scalar()


def replace_with_mode(df: DataFrame, c: str, bad: Sequence) -> DataFrame:
    """Invalid codes → the most frequent valid value."""
    m = mode_value(df, c, bad)
    return df.withColumn(c, F.when(F.col(c).isin(list(bad)), m).otherwise(F.col(c)))


def iqr_bounds(df: DataFrame, c: str, k: float = 1.5) -> tuple[Column, Column]:
    """Fences from the exact quartiles. The one-row quartile result is read on the
    driver (metadata pass) so each pass of :func:`iqr_filter` filters on literals
    instead of nesting the previous pass's subqueries."""
    from casebook.operators.aggregates import exact_quantiles
    r = exact_quantiles(df, c, [0.25, 0.75]).first()
    q1, q3 = r["q0"], r["q1"]
    if q1 is None:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    return F.lit(q1 - k * (q3 - q1)), F.lit(q3 + k * (q3 - q1))


def iqr_filter(df: DataFrame, c: str, k: float = 1.5, passes: int = 1,
               checkpoint_every: int = 2) -> tuple[DataFrame, DataFrame]:
    """Keep rows inside [Q1 - k·IQR, Q3 + k·IQR] (inclusive); NULL goes to dropped.

    Each pass recomputes the quartiles on the rows kept by the previous pass.
    Long chains are cut with a reliable checkpoint every ``checkpoint_every``
    passes so the plan does not grow with ``passes``.
    """
    kept = df
    dropped = None
    for i in range(passes):
        lo, hi = iqr_bounds(kept, c, k)
        inside = F.coalesce((F.col(c) >= lo) & (F.col(c) <= hi), F.lit(False))
        d = kept.where(~inside)
        dropped = d if dropped is None else dropped.unionByName(d)
        kept = kept.where(inside)
        if checkpoint_every and passes > checkpoint_every and (i + 1) % checkpoint_every == 0:
            kept = cut_lineage(kept)
            dropped = cut_lineage(dropped)
    return kept, dropped


def retention(before: DataFrame, after: DataFrame, digits: int = 2) -> DataFrame:
    """Rows kept and % kept / dropped, from two scalar counts."""
    n0 = before.select(F.count(F.lit(1))).scalar()
    n1 = after.select(F.count(F.lit(1))).scalar()
    spark = before.sparkSession
    return spark.range(1).select(n0.alias("n_before"), n1.alias("n_after"),
                                 F.round(F.lit(100.0) * n1 / n0, digits).alias("pct_kept"),
                                 F.round(F.lit(100.0) - F.lit(100.0) * n1 / n0, digits).alias("pct_dropped"))
