"""File and table scans.  A path may be any URI the cluster's file systems know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    delimiter: str = ",",
    null_value: str = "",
    rescue: str | None = None,
) -> DataFrame:
    """CSV whose header names the columns, typed by a declared schema.

    Columns are matched by name: the header may have another order, lack declared columns
    or hold others, which are read as strings and come last.  The result has the columns
    that the file has.  All files of ``path`` must have the same header; one with another
    header fails the query.

    ``rescue`` names a column that keeps the text of lines that do not fit the schema.
    """
    own = header(spark, path, delimiter=delimiter)
    declared = {f.name: f for f in schema.fields}
    fields = [declared.get(n, T.StructField(n, T.StringType())) for n in own]
    if rescue:
        fields.append(T.StructField(rescue, T.StringType()))
    reader = spark.read.schema(T.StructType(fields)).options(
        header=True, sep=delimiter, nullValue=null_value, escape='"', mode="PERMISSIVE",
        enforceSchema=False,
    )
    if rescue:
        reader = reader.option("columnNameOfCorruptRecord", rescue)
    order = [n for n in declared if n in own] + [n for n in own if n not in declared]
    return reader.csv(path).select(*order, *([rescue] if rescue else []))


def header(spark: SparkSession, path: str, *, delimiter: str = ",") -> list[str]:
    """Column names of a CSV file; reads the first line only."""
    return spark.read.options(header=True, sep=delimiter, escape='"').csv(path).columns


def infer_csv_schema(spark: SparkSession, path: str, *, delimiter: str = ",") -> T.StructType:
    """Propose a schema from the data; for writing a spec, not for loading."""
    return spark.read.options(header=True, sep=delimiter, inferSchema=True).csv(path).schema


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, merge_schema: bool = False
) -> DataFrame:
    reader = spark.read.option("mergeSchema", merge_schema)
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """JSON documents.  ``multi_line`` files cannot be split, so prefer JSON lines."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_json_as_delivered(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """The columns that the documents have: declared ones typed as declared, others as found.

    The names are found by a scan of their own; :func:`read_json` does without it.
    """
    reader = spark.read.option("multiLine", multi_line)
    found = {f.name: f for f in reader.json(path).schema.fields}
    declared = [f for f in schema.fields if f.name in found]
    known = {f.name for f in declared}
    fields = declared + [f for n, f in found.items() if n not in known]
    return reader.schema(T.StructType(fields)).json(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
