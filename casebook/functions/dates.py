"""Date and time helpers. Timestamps are wall-clock (``TIMESTAMP_NTZ``) so results
do not depend on the session time zone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.compat import col_

# A season map in which
# summer is June-July and August falls through to fall.
SEASON_REFERENCE = {
    "spring": (3, 4, 5),
    "summer": (6, 7),
    "winter": (12, 1, 2),
}
SEASON_REFERENCE_DEFAULT = "fall"

SEASON_METEOROLOGICAL = {
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "fall": (9, 10, 11),
    "winter": (12, 1, 2),
}


def season_col(d, preset: str | Mapping = "reference") -> Column:
    """Month of ``d`` → season label. ``preset`` is 'reference', 'meteorological'
    or a ``{label: months}`` dict; months not in the map get the default."""
    m = F.month(col_(d))
    if preset == "reference":
        mapping, default = SEASON_REFERENCE, SEASON_REFERENCE_DEFAULT
    elif preset == "meteorological":
        mapping, default = SEASON_METEOROLOGICAL, None
    else:
        mapping, default = dict(preset), None
    expr = None
    for label, months in mapping.items():
        cond = m.isin(list(months))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def round_hour(ts, mode: str = "half_even") -> Column:
    """Round to the nearest hour. ``half_even`` matches pandas ``dt.round('h')``
    (16:30 → 16:00, 17:30 → 18:00); ``half_up`` sends every :30:00 up."""
    t = col_(ts)
    base = F.date_trunc("hour", t)
    rem = F.timestamp_diff("MICROSECOND", base, t)
    half = F.lit(1800 * 1_000_000)
    if mode == "half_even":
        up = (rem > half) | ((rem == half) & (F.hour(base) % 2 == 1))
    else:
        up = rem >= half
    return F.when(up, base + F.expr("INTERVAL 1 HOUR")).otherwise(base)


def parse_month_year(c, pivot: int = 69) -> Column:
    """``'Jan-85'`` → DATE with Python's two-digit-year rule: yy >= pivot → 19yy,
    else 20yy (Spark alone would give 2085). Unparsable → NULL."""
    d = F.try_to_date(col_(c), "MMM-yy")
    return F.when(F.year(d) >= F.lit(2000 + pivot), F.add_months(d, -1200)).otherwise(d)


def parse_mixed_day_first(c) -> Column:
    """Day-first text with ``/`` or ``-`` and optional seconds → TIMESTAMP_NTZ."""
    s = F.replace(col_(c), F.lit("/"), F.lit("-"))
    a = F.try_to_timestamp(s, F.lit("d-M-yyyy H:m:s"))
    b = F.try_to_timestamp(s, F.lit("d-M-yyyy H:m"))
    return F.coalesce(a, b).cast("timestamp_ntz")


def elapsed_seconds(start, end) -> Column:
    """Whole seconds from ``start`` to ``end`` (negative when end is earlier)."""
    return F.timestamp_diff("SECOND", col_(start), col_(end))


def parse_hhmm_ap(c, strict: bool = True) -> Column:
    """``'hhmmA'`` / ``'hhmmP'`` → struct(hour INT, minute INT) on a 24-hour clock.

    12A → 0, 12P → 12. With ``strict`` an hour outside 1..12 or a minute outside
    0..59 gives NULL; ``strict=False`` is the loose rule, which maps any
    hour >= 12 to 0 before adding 12 for P.
    """
    s = col_(c)
    ok = s.rlike("^[0-9]{4}[AP]$")
    h = F.substring(s, 1, 2).try_cast("int")
    mi = F.substring(s, 3, 2).try_cast("int")
    ap = F.substring(s, 5, 1)
    h12 = F.when(h >= 12, F.lit(0)).otherwise(h)
    hour = h12 + F.when(ap == "P", F.lit(12)).otherwise(F.lit(0))
    valid = ok
    if strict:
        valid = ok & h.between(1, 12) & mi.between(0, 59)
    return F.when(valid, F.struct(hour.alias("hour"), mi.alias("minute")))
