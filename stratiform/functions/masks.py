"""Masking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_head(c: Column, n: int = 2) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.lit("***"))


def keep_tail(c: Column, n: int = 2) -> Column:
    return F.concat(F.lit("***"), F.right(c, F.lit(n)))


def hide(c: Column) -> Column:
    return F.lit(None)


MASKS = {"head": keep_head, "tail": keep_tail, "null": hide}
