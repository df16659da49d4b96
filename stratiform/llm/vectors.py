"""What the vector operators share: which rows take part, and equal vectors as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not NULL, not empty, not all zero, and every component a finite number."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_doubles(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v) of the usable rows, components as doubles."""
    v = F.col(column).cast("array<double>")
    return vectors.where(usable(v)).select(F.col(key).alias("id"), v.alias("v"))


def dimension(vectors: DataFrame) -> int | None:
    """The one length of all vectors; other lengths can't be compared and fail."""
    r = vectors.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if r["low"] != r["high"]:
        raise ValueError(f"vectors of {r['low']} to {r['high']} components")
    return r["low"]
