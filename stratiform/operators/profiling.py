"""Column profiles, join keys and the join map."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 5
DOC_SAMPLES = 3


def _numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def _atomic(f: T.StructField) -> bool:
    return not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))


def _basics(df: DataFrame, fields: Sequence[T.StructField], distinct) -> DataFrame:
    """(column_name, data_type, n_rows, n_filled, null_pct, min_val, max_val, cardinality?)."""
    total = F.count(F.lit(1))
    aggs = []
    for i, f in enumerate(fields):
        cells = [
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            total.alias("n_rows"),
            F.count(f.name).alias("n_filled"),
            F.round(F.try_divide(100.0 * (total - F.count(f.name)), total), 1).alias("null_pct"),
        ]
        for name, fn in (("min_val", F.min), ("max_val", F.max)):
            v = fn(f.name).cast("string") if _numeric(f) else F.lit(None).cast("string")
            cells.append(v.alias(name))
        if distinct is not None:
            cells.append(distinct(f.name).alias("cardinality"))
        aggs.append(F.struct(*cells).alias(f"_c{i}"))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(f"_c{i}") for i in range(len(fields))])))


def profile(df: DataFrame, *, approx: bool = False, samples: int = SAMPLES) -> DataFrame:
    """One row per column: null share, distinct values, range and sample values.

    Exact: null counts and ranges come from one aggregate over all columns.  Distinct
    counts and the most frequent values share a second one, over (column, value) pairs
    that are counted map-side first.  ``approx`` replaces the pair count by HyperLogLog
    sketches in the first aggregate: one scan, almost no shuffle, no frequent values.

    Numeric columns show their range as samples, boolean columns none.
    """
    fields = [f for f in df.schema.fields if _atomic(f)]
    names = [f.name for f in fields]
    if approx:
        rows = _basics(df, fields, F.approx_count_distinct)
        frequent = F.array().cast("array<string>")
    else:
        basics = _basics(df, fields, None)
        pairs = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot(
            [], names, "column_name", "_v"
        )
        counted = (
            pairs.filter(F.col("_v").isNotNull())
            .groupBy("column_name", "_v")
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        distinct = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("cardinality"))
        shown = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.DateType))
                 or isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        w = Window.partitionBy("column_name").orderBy(F.desc("_n"), F.asc("_v"))
        top = (
            counted.filter(F.col("column_name").isin(shown))
            .withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= samples)
            .groupBy("column_name")
            .agg(F.sort_array(F.collect_list(F.struct("_rn", "_v")))["_v"].alias("_top"))
        )
        rows = (
            basics.join(distinct, "column_name", "left")
            .join(top, "column_name", "left")
            .withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
        )
        frequent = F.coalesce("_top", F.array().cast("array<string>"))
    shown_range = F.when(F.col("min_val").isNotNull(), F.array("min_val", "max_val"))
    return rows.select(
        "column_name", "data_type", "n_rows", "n_filled", "null_pct", "cardinality", "min_val", "max_val",
        F.coalesce(shown_range, frequent).alias("sample_values"),
    )


def profile_tables(tables: Mapping[str, DataFrame], *, approx: bool = False) -> DataFrame:
    """Profiles of several tables; ``*_rejects`` tables are skipped."""
    parts = [
        profile(df, approx=approx).select(F.lit(t).alias("table_name"), "*")
        for t, df in tables.items()
        if not t.endswith("_rejects")
    ]
    return reduce(DataFrame.unionByName, parts)


def strip_prefixes(tables: Mapping[str, DataFrame], pattern: str) -> dict[str, DataFrame]:
    """Rename columns by cutting a leading table prefix, so that keys share their name."""
    return {
        t: df.toDF(*[re.sub(pattern, "", c) for c in df.columns]) for t, df in tables.items()
    }


def join_keys(catalog: DataFrame) -> DataFrame:
    """Column names found in two or more tables, widest spread first."""
    return (
        catalog.groupBy("column_name")
        .agg(F.sort_array(F.collect_set("table_name")).alias("join_tables"))
        .withColumn("n_tables", F.size("join_tables"))
        .filter("n_tables > 1")
        .withColumn(
            "likely_role",
            F.when(F.col("column_name").rlike("(_id|key)$"), "primary/foreign key").otherwise(
                "shared attribute"
            ),
        )
        .orderBy(F.desc("n_tables"), "column_name")
    )


def key_overlaps(tables: Mapping[str, DataFrame], suffix: str = "_id") -> DataFrame | None:
    """(join_key, table_name, other, most, keys, shared, other_most, other_keys), for each pair
    of tables that have a key column in common, both ways.

    ``most`` is the largest number of rows of one value, ``keys`` the number of values, and
    ``shared`` that of the values which both hold.  Each key column is read once: all tables
    of a key are counted in one aggregate by value, from which every pair is read off.
    """
    uses: dict[str, list[str]] = {}
    for table, df in tables.items():
        for c in df.columns:
            if c.endswith(suffix):
                uses.setdefault(c, []).append(table)
    parts = []
    for key, own in uses.items():
        if len(own) < 2:
            continue
        values = [
            tables[t].select(F.col(key).alias("k"), F.lit(i).alias("i")).filter("k IS NOT NULL")
            for i, t in enumerate(own)
        ]
        at = range(len(own))
        held = reduce(DataFrame.unionByName, values).groupBy("k").agg(
            *[F.count_if(F.col("i") == i).alias(f"n{i}") for i in at]
        )
        pairs = [(i, j) for i in at for j in at if i < j]
        one = held.agg(
            *[F.coalesce(F.max(f"n{i}"), F.lit(0)).alias(f"m{i}") for i in at],
            *[F.count_if(F.col(f"n{i}") > 0).alias(f"c{i}") for i in at],
            *[F.count_if((F.col(f"n{i}") > 0) & (F.col(f"n{j}") > 0)).alias(f"b{i}_{j}") for i, j in pairs],
        )
        rows = [
            F.struct(
                F.lit(key).alias("join_key"), F.lit(own[i]).alias("table_name"), F.lit(own[j]).alias("other"),
                F.col(f"m{i}").alias("most"), F.col(f"c{i}").alias("keys"),
                F.col(f"b{min(i, j)}_{max(i, j)}").alias("shared"),
                F.col(f"m{j}").alias("other_most"), F.col(f"c{j}").alias("other_keys"),
            )
            for i in at
            for j in at
            if i != j
        ]
        parts.append(one.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _edges(overlaps: DataFrame, suffix: str) -> DataFrame:
    key = F.col("join_key")
    named = F.contains("table_name", F.substring(key, F.lit(1), F.length(key) - len(suffix)))
    unique = overlaps.filter("most <= 1").withColumn("named", named)
    w = Window.partitionBy("join_key")  # a few rows per key: pairs of tables
    chosen = unique.withColumn("any_named", F.max("named").over(w))
    return chosen.filter(F.col("named") | ~F.col("any_named"))


def relationships(tables: Mapping[str, DataFrame], suffix: str = "_id") -> DataFrame | None:
    """(from_table, to_table, join_key): one edge per parent and child of a shared key.

    A parent holds every key at most once, as measured.  A small child may do so by chance;
    so where one of them is named after the key, the others are not taken for parents.
    """
    overlaps = key_overlaps(tables, suffix)
    if overlaps is None:
        return None
    names = F.col("table_name").alias("from_table"), F.col("other").alias("to_table")
    return _edges(overlaps, suffix).select(*names, "join_key")


def join_map(tables: Mapping[str, DataFrame], suffix: str = "_id") -> DataFrame:
    """The edges with what the data say about them.

    ``containment`` is the share of the child's distinct keys that the parent has;
    ``cardinality`` follows from the largest number of child rows per key and from
    parents without children.
    """
    overlaps = key_overlaps(tables, suffix)
    if overlaps is None:
        raise ValueError("no two tables share a key column")
    low = F.when(F.col("keys") > F.col("shared"), "0..").otherwise("1..")
    many = F.when(F.col("other_most") > 1, "n").otherwise("1")
    return _edges(overlaps, suffix).select(
        F.col("table_name").alias("from_table"),
        F.col("other").alias("to_table"),
        "join_key",
        F.col("other_keys").alias("child_keys"),
        F.round(F.try_divide("shared", "other_keys"), 6).alias("containment"),
        F.concat(F.lit("1:"), low, many).alias("cardinality"),
    )


def column_docs(profiles: DataFrame, layer: Column, keys: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, doc): the text that describes a column for retrieval.

    ``keys`` (from :func:`join_keys`) adds where the column can be joined.
    """
    samples = F.array_join(F.slice("sample_values", 1, DOC_SAMPLES), ", ")
    doc = F.concat(
        layer, F.lit(" | "), F.col("table_name"), F.lit("."), F.col("column_name"),
        F.lit(" | "), F.col("data_type"),
        F.lit("\nSample values: "), F.when(samples == "", "N/A").otherwise(samples),
        F.lit("\nNull %: "), F.col("null_pct").cast("string"),
        F.lit(" | Cardinality: "), F.col("cardinality").cast("string"),
    )
    out = profiles
    if keys is not None:
        out = out.join(keys.select("column_name", "join_tables", "n_tables"), "column_name", "left")
        hint = F.concat(
            F.lit("\nJoin key: appears in "), F.col("n_tables").cast("string"),
            F.lit(" tables: "), F.array_join(F.slice("join_tables", 1, 5), ", "),
        )
        doc = F.concat(doc, F.coalesce(hint, F.lit("")))
    return out.select("table_name", "column_name", doc.alias("doc"))
