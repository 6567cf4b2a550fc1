"""Feature engineering: one-hot, scalers (fit on one frame, apply to another),
period folds and day gaps over wide per-period tables.

Fitted statistics are one-row aggregates used through scalar subqueries, so a
``transform`` never joins the data with its statistics and never collects them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.compat import col_


def levels_of(df: DataFrame, c: str) -> list:
    """Sorted distinct non-NULL values. Each becomes a column of the result's schema,
    which the driver holds anyway."""
    return sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, cols: Sequence[str], prefix: Mapping[str, str] | None = None,
            drop_first: bool = False, levels: Mapping[str, Sequence] | None = None,
            keep_source: bool = False) -> DataFrame:
    """``pd.get_dummies``: one INT 0/1 column per sorted level, named ``prefix_level``.

    ``drop_first`` drops the first sorted level (Spark's OneHotEncoder drops the
    *last*, so it is not used here). NULL → all zeros. Without ``levels`` the
    distinct values are read in one metadata pass per column.
    """
    out = df
    for c in cols:
        lv = list(levels[c]) if levels and c in levels else levels_of(df, c)
        if drop_first:
            lv = lv[1:]
        pre = (prefix or {}).get(c, c)
        out = out.withColumns({f"{pre}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in lv})
        if not keep_source:
            out = out.drop(c)
    return out


class StandardScale:
    """z-score with ddof=0 (population std, sklearn) or ddof=1 (sample std, pandas).

    ``fit`` keeps one-row statistics; ``transform`` reads them as scalar
    subqueries. A constant column scales to 0.
    """

    def __init__(self, cols: Sequence[str], ddof: int = 0):
        self.cols, self.ddof = list(cols), ddof
        self.stats: DataFrame | None = None

    def fit(self, df: DataFrame) -> "StandardScale":
        sd = F.stddev_pop if self.ddof == 0 else F.stddev_samp
        aggs = []
        for i, c in enumerate(self.cols):
            aggs += [F.avg(c).alias(f"m{i}"), sd(c).alias(f"s{i}")]
        self.stats = df.agg(*aggs)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        st = self.stats
        repl = {}
        for i, c in enumerate(self.cols):
            m, s = st.select(f"m{i}").scalar(), st.select(f"s{i}").scalar()
            repl[c] = F.when(s == 0, F.lit(0.0)).otherwise((F.col(c) - m) / s)
        return df.withColumns(repl)


class MinMaxScale:
    """Scale to [lo, hi] with min / max fitted on one frame. Constant column → lo."""

    def __init__(self, cols: Sequence[str], lo: float = 0.0, hi: float = 1.0):
        self.cols, self.lo, self.hi = list(cols), lo, hi
        self.stats: DataFrame | None = None

    def fit(self, df: DataFrame) -> "MinMaxScale":
        aggs = []
        for i, c in enumerate(self.cols):
            aggs += [F.min(c).cast("double").alias(f"a{i}"), F.max(c).cast("double").alias(f"b{i}")]
        self.stats = df.agg(*aggs)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        st = self.stats
        repl = {}
        for i, c in enumerate(self.cols):
            a, b = st.select(f"a{i}").scalar(), st.select(f"b{i}").scalar()
            scaled = (F.col(c) - a) / (b - a) * F.lit(self.hi - self.lo) + F.lit(self.lo)
            repl[c] = F.when(b == a, F.lit(float(self.lo))).otherwise(scaled)
        return df.withColumns(repl)


def zscore(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """pandas ``(df - df.mean()) / df.std()`` (sample std by default)."""
    return StandardScale(cols, ddof=ddof).fit(df).transform(df)


def period_sum(cols: Sequence) -> Column:
    """Sum of a measure family over the periods of a phase (NULL counts as 0)."""
    out = None
    for c in cols:
        v = F.coalesce(col_(c), F.lit(0))
        out = v if out is None else out + v
    return out


FOLD_RULES = {"max": F.greatest, "sum": lambda *cs: period_sum(cs),
              "mean": lambda *cs: period_sum(cs) / F.lit(float(len(cs))), "last": lambda *cs: cs[-1]}


def fold_periods(df: DataFrame, families: Mapping[str, str], periods: Sequence[str], into: str) -> DataFrame:
    """Fold ``family_<period>`` columns into ``family_<into>`` by rule
    (max / sum / mean / last) and drop the period columns. Every listed period is
    used."""
    out = df
    for fam, rule in families.items():
        cols = [F.col(f"{fam}_{p}") for p in periods]
        out = out.withColumn(f"{fam}_{into}", FOLD_RULES[rule](*cols))
        out = out.drop(*[f"{fam}_{p}" for p in periods])
    return out


def days_since_last(period_ends: Sequence[Column], last_events: Sequence[Column], initial: Column) -> list[Column]:
    """Days from each period end back to the latest event, carried over silent periods.

    Period k: ``datediff(end_k, last_k)`` when the period has an event; else the
    previous period's gap plus the days between the two period ends; for the
    first period, the gap back to ``initial``.
    """
    out = []
    for k, (end, last) in enumerate(zip(period_ends, last_events)):
        direct = F.datediff(end, last)
        if k == 0:
            carried = F.datediff(end, initial)
        else:
            carried = out[-1] + F.datediff(end, period_ends[k - 1])
        out.append(F.coalesce(direct, carried))
    return out
