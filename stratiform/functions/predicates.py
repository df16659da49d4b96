"""Row predicates.  NULL input makes each of them NULL or false, as in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    c = as_column(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def in_set(c, values) -> Column:
    return as_column(c).isin(list(values))


def not_in_set(c, values) -> Column:
    c = as_column(c)
    return c.isNotNull() & ~c.isin(list(values))


def matches(c, pattern: str) -> Column:
    return as_column(c).rlike(pattern)


def in_range(c, lo=None, hi=None, strict: bool = False) -> Column:
    """Inside the bounds; a missing bound is open and a NULL value passes."""
    c = as_column(c)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & ((c > F.lit(lo)) if strict else (c >= F.lit(lo)))
    if hi is not None:
        ok = ok & ((c < F.lit(hi)) if strict else (c <= F.lit(hi)))
    return c.isNull() | ok


def untrimmed(c) -> Column:
    c = as_column(c)
    return c.isNotNull() & (c != F.trim(c))


def after(c, day) -> Column:
    """Later than ``day`` (a date, or a column)."""
    bound = F.lit(day) if isinstance(day, (date, str)) else day
    return as_column(c) > bound


def since(ts, as_of, interval: str) -> Column:
    """Within the last ``interval`` (for example ``30 DAYS``) before ``as_of``."""
    return as_column(ts) > as_column(as_of) - F.expr(f"INTERVAL {interval}")
