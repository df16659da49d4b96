"""Parallel JDBC scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def hash_predicates(hash_expression: str, parts: int) -> list[str]:
    """Predicates that split a table by the hash of a (string) key.

    ``hash_expression`` is a non-negative integer expression in the database's dialect.
    Rows whose key is NULL have no hash and go to the first part, so nothing is lost.
    """
    first = f"(MOD({hash_expression}, {parts}) = 0 OR {hash_expression} IS NULL)"
    return [first] + [f"MOD({hash_expression}, {parts}) = {i}" for i in range(1, parts)]


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    num_partitions: int = 8,
    predicates: list[str] | None = None,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """One query per partition.

    Numeric, date and timestamp columns are split by ``bounds``; for string keys give
    ``predicates``.
    """
    props = {"fetchsize": str(fetch_size), **(properties or {})}
    if predicates is not None:
        return spark.read.jdbc(url, table, predicates=predicates, properties=props)
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        lo, hi = bounds
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lo),
            upperBound=str(hi),
            numPartitions=str(num_partitions),
        )
    return reader.options(**props).load()
