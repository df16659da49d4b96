"""Ranking and duplicate marking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], tie_break: Sequence[Column]
) -> DataFrame:
    """One row per key: the first in ``order`` (then ``tie_break``, which must be total).

    ``row_number() = 1`` lets Spark cut every map task down to one row per key before the
    shuffle, so a hot key costs its reducer one row per map task.
    """
    if not tie_break:
        raise ValueError("latest_per_key needs a tie-breaker to be repeatable")
    w = Window.partitionBy(*keys).orderBy(*order, *tie_break)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int):
    """The first ``n`` rows per key, with their rank in ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dedupe(df: DataFrame, keys: Sequence[str], tie_break: Sequence[Column]) -> DataFrame:
    return latest_per_key(df, keys, [], tie_break)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count ``c``.  NULLs form one group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")


def mark_by_key(df: DataFrame, keys: Sequence[str], marked: DataFrame, flag: str) -> DataFrame:
    """Add a boolean ``flag``: the row's key is in ``marked`` (unique keys, NULL-safe).

    A left join on pre-aggregated keys, not a window, so that AQE can split a hot key.
    """
    names = [f"_m{i}" for i in range(len(keys))]
    right = marked.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.lit(True).alias("_marked")
    )
    on = F.lit(True)
    for i, (k, n) in enumerate(zip(keys, names)):
        cond = df[k].eqNullSafe(right[n])
        on = cond if i == 0 else on & cond
    return (
        df.join(right, on, "left")
        .withColumn(flag, F.coalesce("_marked", F.lit(False)))
        .drop("_marked", *names)
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    marked = mark_by_key(df, keys, duplicate_keys(df, keys), "_dup")
    return marked.filter("_dup").drop("_dup")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values; ties go to the smaller value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), F.asc(column))
        .limit(n)
    )


def top_rows(df: DataFrame, column: str, n: int, tie_break: Sequence[Column]) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *tie_break).limit(n)
