"""The columns of a set of tables, as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Schema-name prefix of each layer.
LAYERS = {"b_": "bronze", "s_": "silver", "g_": "gold"}

COLUMNS = (
    "layer string, table_name string, column_name string, ordinal int, data_type string, "
    "nullable boolean, comment string, doc string"
)


def layer_of(schema_name: str) -> str:
    for prefix, layer in LAYERS.items():
        if schema_name.startswith(prefix):
            return layer
    return schema_name


def column_catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], layer: str = "bronze"
) -> DataFrame:
    """One row per table column.  Only schemas are looked at; no data is read.

    The rows are as many as there are columns, so building them on the driver is fine.
    """
    rows = []
    for table, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            kind, comment = f.dataType.simpleString(), f.metadata.get("comment", "")
            doc = f"{layer} | {table}.{f.name} | {kind}" + (f" | {comment}" if comment else "")
            rows.append((layer, table, f.name, i, kind, f.nullable, comment, doc))
    return spark.createDataFrame(rows, COLUMNS)


def schema_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The tables of one catalog schema, ``*_rejects`` left out."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return {n: spark.table(f"{database}.{n}") for n in names if not n.endswith("_rejects")}
