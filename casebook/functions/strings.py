"""String helpers (all native expressions; NULL in → NULL out unless stated)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.compat import col_


def trim_upper(c) -> Column:
    return F.upper(F.trim(col_(c)))


def alnum_key(c) -> Column:
    """ASCII letters and digits only, upper-cased: a match key. NULL stays NULL."""
    return F.upper(F.regexp_replace(col_(c), "[^A-Za-z0-9]", ""))


def replace_chain(c, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements applied in the given order."""
    out = col_(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def split_first(c, sep: str) -> Column:
    """First element of a delimited list (whole text when no separator)."""
    return F.split_part(col_(c), F.lit(sep), F.lit(1))


def split_two(c, sep: str = " ") -> tuple[Column, Column]:
    """Split once: (head, rest); rest is NULL when there is no separator."""
    parts = F.split(col_(c), sep, 2)
    return parts.getItem(0), F.get(parts, 1)


def first_digits(c, as_type: str = "int") -> Column:
    """First run of digits as a number; no digits → NULL."""
    s = F.regexp_extract(col_(c), r"(\d+)", 1)
    return F.nullif(s, F.lit("")).try_cast(as_type)


def keyword_hits(c, keywords: Sequence[str]) -> Column:
    """Number of (non-overlapping, case-sensitive) keyword matches; NULL text → 0."""
    pattern = "|".join(keywords)
    return F.coalesce(F.regexp_count(col_(c), F.lit(pattern)), F.lit(0))
