"""Binning, decoding and category clean-up as single Column expressions.

Each builder returns one ``CASE WHEN`` chain so the expression stays inside
whole-stage codegen and is defined once (used in both SELECT and GROUP BY).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.compat import col_


def _fmt(x) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def bin_col(c, edges: Sequence[float], labels: Sequence[str] | None = None,
            closed: str = "left", invalid=None, open_top: bool = False,
            open_top_label: str | None = None) -> Column:
    """Bucket ``c`` by ``edges``.

    ``closed='left'`` gives ``[e0,e1) [e1,e2) …`` (Hive CASE chains / Bucketizer);
    ``closed='right'`` gives ``(e0,e1] (e1,e2] …`` (``pd.cut``). With ``open_top``
    values at or above the last edge go to one more bin (``>=eN``). Values outside
    all bins and NULL get ``invalid``.
    """
    x = col_(c)
    n = len(edges) - 1
    if labels is None:
        if closed == "left":
            labels = [f"[{_fmt(edges[i])},{_fmt(edges[i + 1])})" for i in range(n)]
        else:
            labels = [f"({_fmt(edges[i])},{_fmt(edges[i + 1])}]" for i in range(n)]
        if open_top:
            labels = list(labels) + [open_top_label or f">={_fmt(edges[-1])}"]
    expr = None
    for i in range(n):
        lo, hi = F.lit(edges[i]), F.lit(edges[i + 1])
        cond = (x >= lo) & (x < hi) if closed == "left" else (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    if open_top:
        top = F.lit(edges[-1])
        cond = x >= top if closed == "left" else x > top
        expr = expr.when(cond, F.lit(labels[n]))
    return expr.otherwise(F.lit(invalid))


def equal_width_bin(c, width: float, start: float = 0, n_bins: int | None = None,
                    label_base: int = 1, invalid=None) -> Column:
    """``floor((c - start) / width) + label_base`` with a range check (hour bins)."""
    x = col_(c)
    idx = F.floor((x - F.lit(start)) / F.lit(width)).cast("int") + F.lit(label_base)
    ok = x >= F.lit(start)
    if n_bins is not None:
        ok = ok & (x < F.lit(start + width * n_bins))
    return F.when(ok, idx).otherwise(F.lit(invalid))


def decode_col(c, mapping: Mapping, default=None) -> Column:
    """Exact-match code → label; unmatched and NULL → ``default`` (NULL when None)."""
    x = col_(c)
    expr = None
    for k, v in mapping.items():
        cond = x == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


def replace_values(c, groups: Mapping[str, Sequence]) -> Column:
    """Merge misspelt variants: ``{canonical: [variant, …]}``; others unchanged."""
    x = col_(c)
    expr = None
    for canon, variants in groups.items():
        cond = x.isin(list(variants))
        expr = F.when(cond, F.lit(canon)) if expr is None else expr.when(cond, F.lit(canon))
    return x if expr is None else expr.otherwise(x)


def collapse_other(c, keep: Sequence, other: str = "OTHERS") -> Column:
    """Keep the listed categories, everything else (NULL too) → ``other``."""
    x = col_(c)
    return F.when(x.isin(list(keep)), x).otherwise(F.lit(other))


def cap_values(c, cap, values: Sequence | None = None) -> Column:
    """Cap large values: every listed value (or, with no list, anything above) → ``cap``."""
    x = col_(c)
    if values is None:
        return F.when(x > F.lit(cap), F.lit(cap)).otherwise(x)
    return F.when(x.isin(list(values)), F.lit(cap)).otherwise(x)


def flag(pred: Column) -> Column:
    """0/1 INT from a predicate; NULL predicate → 0."""
    return F.coalesce(pred.cast("int"), F.lit(0))


def all_of(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds)
