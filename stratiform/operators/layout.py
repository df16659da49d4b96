"""Physical layout: compaction, clustering, statistics, caching."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Z_BITS = 6
#: Strings drawn to find the cuts of a column.
SAMPLE = 8192


def z_value(df: DataFrame, columns: Sequence[str], bits: int = Z_BITS) -> Column:
    """Position on a Z-curve over two or more columns.

    Each column is cut into ``2**bits`` ranges of about equal size by its approximate
    quantiles, so skewed values spread out too; the range numbers' bits are interleaved.
    Quantiles of numbers come from a sketch, those of strings from a random sample of
    ``SAMPLE`` whole values; either way a short list per column reaches the driver.
    """
    cells = 2**bits
    cuts_of = {c: _cuts(df, c, cells) for c in columns}
    z = F.lit(0).cast("bigint")
    width = cells.bit_length() - 1
    for i, c in enumerate(columns):
        value = _comparable(df, c)
        cut_array = F.array(*[F.lit(x) for x in cuts_of[c]]).cast(
            "array<string>" if _is_text(df, c) else "array<double>"
        )
        cell = F.size(F.filter(cut_array, lambda e: e <= value)).cast("bigint")
        cell = F.coalesce(cell, F.lit(0))
        for b in range(width):
            bit = F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("bigint"))
            z = z.bitwiseOR(F.shiftleft(bit, b * len(columns) + i))
    return z


def _is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "string"


def _comparable(df: DataFrame, column: str) -> Column:
    """A string as it is, anything else as a number."""
    c = F.col(column)
    if _is_text(df, column):
        return c
    if df.schema[column].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _cuts(df: DataFrame, column: str, cells: int) -> list:
    """At most ``cells - 1`` values that cut the column into ranges of about equal size."""
    value = _comparable(df, column)
    if _is_text(df, column):
        some = df.filter(F.col(column).isNotNull()).select(value.alias("v"))
        drawn = sorted(r["v"] for r in some.orderBy(F.rand(7)).limit(SAMPLE).collect())
        return sorted({drawn[len(drawn) * i // cells] for i in range(1, cells)} if drawn else ())
    steps = [i / cells for i in range(1, cells)]
    return sorted(set(df.agg(F.percentile_approx(value, steps, 10_000)).first()[0] or ()))


def path_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength()


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    cluster_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    target_mb: int = 128,
) -> int:
    """Rewrite ``source`` into ``target`` with files of about ``target_mb``; returns the
    number of range partitions used.

    With one clustering column rows are range-partitioned by it, with more by their
    Z-order; inside a file they are sorted.  A partition column cannot cluster: it is
    constant within a file.
    """
    bad = set(cluster_by) & set(partition_by)
    if bad:
        raise ValueError(f"partition columns cannot be clustering columns: {sorted(bad)}")
    df = spark.read.parquet(source)
    parts = max(1, -(-path_bytes(spark, source) // (target_mb * 1024 * 1024)))
    order = [F.col(c) for c in partition_by]
    if len(cluster_by) == 1:
        order.append(F.col(cluster_by[0]))
    elif cluster_by:
        df = df.withColumn("_z", z_value(df, cluster_by))
        order.append(F.col("_z"))
    if order:
        # The random last column lets a value that fills more than one file span several.
        df = df.withColumn("_spread", F.rand(7))
        out = df.repartitionByRange(parts, *order, F.col("_spread")).sortWithinPartitions(*order)
    else:
        out = df.repartition(parts)
    out.drop("_z", "_spread").write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return parts


def analyze(spark: SparkSession, table: str, columns: Sequence[str] = ()) -> None:
    """Collect table statistics, and column statistics for ``columns``."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    if columns:
        cols = ", ".join(f"`{c}`" for c in columns)
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {cols}")


def table_statistics(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").collect()
    return {r["col_name"]: r["data_type"] for r in rows if r["col_name"] == "Statistics"}


@contextmanager
def cached(df: DataFrame):
    """Cache a frame that is used several times and release it afterwards."""
    df.cache()
    try:
        yield df
    finally:
        df.unpersist()
