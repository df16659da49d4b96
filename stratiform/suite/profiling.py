"""Profiles, join keys and column documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profiling as p
from ..operators import sketches as sk
from ..operators.projections import proposed_type
from ..session import materialise
from ..sources.catalog import column_catalog as catalog_of
from . import TABLES, Tables, query

# Columns to profile per table, with their Spark types.
PROFILED = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderpriority": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        if kind == "string":
            lo = hi = "CAST(NULL AS VARCHAR)"
            samples = (
                f"(SELECT string_agg(v, ' / ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n "
                f"FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"
            )
        else:
            lo, hi = f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)"
            samples = f"concat({lo}, ' / ', {hi})"
        parts.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, "
            f"count(*) AS n_rows, count({c}) AS n_filled, round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct, "
            f"count(DISTINCT {c}) AS cardinality, {lo} AS min_val, {hi} AS max_val, "
            f"{samples} AS samples FROM {table}"
        )
    return " UNION ALL ".join(parts)


PROFILE = " UNION ALL ".join(_profile_sql(t, c) for t, c in PROFILED.items())


def _frames(t: Tables) -> dict[str, DataFrame]:
    return {n: getattr(t, n).select(*c) for n, c in PROFILED.items()}


@query(PROFILE, headline=True)
def profile_table(t: Tables) -> DataFrame:
    rows = p.profile_tables(_frames(t))
    return rows.withColumn("samples", F.array_join("sample_values", " / ")).drop("sample_values")


@query(
    f"""WITH p AS ({PROFILE}) SELECT table_name, column_name, n_rows, null_pct, TRUE AS close,
  min_val, max_val FROM p"""
)
def profile_approx(t: Tables) -> DataFrame:
    """Sketched distinct counts, checked to lie within 10 % of the exact ones."""
    exact = p.profile_tables(_frames(t)).select(
        "table_name", "column_name", F.col("cardinality").alias("exact")
    )
    rough = p.profile_tables(_frames(t), approx=True)
    both = rough.join(exact, ["table_name", "column_name"])
    close = F.abs(F.col("cardinality") - F.col("exact")) <= 0.1 * F.col("exact")
    return both.select(
        "table_name", "column_name", "n_rows", "null_pct", close.alias("close"), "min_val",
        "max_val",
    )


KEYED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
PREFIX = r"^[a-z]{1,2}_"


def _keyed(t: Tables) -> dict[str, DataFrame]:
    """Star-schema tables without column prefixes; orders and customers keep foreign keys."""
    return p.strip_prefixes({n: getattr(t, n) for n in KEYED}, PREFIX)


_KEY_USES = (
    ("custkey", "customer", "c_custkey"), ("custkey", "orders", "o_custkey"),
    ("orderkey", "orders", "o_orderkey"), ("orderkey", "lineitem", "l_orderkey"),
    ("partkey", "part", "p_partkey"), ("partkey", "lineitem", "l_partkey"),
    ("nationkey", "nation", "n_nationkey"), ("nationkey", "customer", "c_nationkey"),
    ("nationkey", "supplier", "s_nationkey"), ("regionkey", "region", "r_regionkey"),
    ("regionkey", "nation", "n_regionkey"), ("suppkey", "supplier", "s_suppkey"),
    ("suppkey", "lineitem", "l_suppkey"),
)


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS column_name, '{tbl}' AS table_name, CAST((SELECT count(*) FROM (VALUES "
        + ", ".join("(1)" for x in _KEY_USES if x[0] == k)
        + f")) AS INTEGER) AS n_tables, 'primary/foreign key' AS likely_role, "
        f"count(DISTINCT {c}) AS n_keys FROM {tbl}"
        for k, tbl, c in _KEY_USES
    )
)
def join_keys(t: Tables) -> DataFrame:
    """Shared key columns, with the number of distinct keys in each table."""
    tables = _keyed(t)
    found = p.join_keys(catalog_of(t.spark, tables)).filter("column_name LIKE '%key'")
    uses = found.select(
        "column_name", F.explode("join_tables").alias("table_name"), "n_tables", "likely_role"
    )
    keyed = {n: df.select(*[c for c in df.columns if c.endswith("key")]) for n, df in tables.items()}
    counts = p.profile_tables(keyed).select(
        "table_name", "column_name", F.col("cardinality").alias("n_keys")
    )
    return uses.join(counts, ["table_name", "column_name"])


_EDGES = (
    ("region", "r_regionkey", "nation", "n_regionkey", "regionkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey", "nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey", "nationkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey", "orderkey"),
    ("part", "p_partkey", "lineitem", "l_partkey", "partkey"),
    ("customer", "c_custkey", "orders", "o_custkey", "custkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey", "suppkey"),
)


@query(
    " UNION ALL ".join(
        f"""SELECT '{p_}' AS from_table, '{c_}' AS to_table, '{k}' AS join_key,
  count(n) AS child_keys, round(count(*) FILTER (pk IS NOT NULL AND n IS NOT NULL) / count(n), 6) AS containment,
  concat('1:', CASE WHEN count(*) FILTER (n IS NULL) > 0 THEN '0..' ELSE '1..' END,
    CASE WHEN max(n) > 1 THEN 'n' ELSE '1' END) AS cardinality
FROM (SELECT DISTINCT {pk} AS pk FROM {p_}) a FULL JOIN
  (SELECT {ck} AS ck, count(*) AS n FROM {c_} GROUP BY 1) b ON pk = ck"""
        for p_, pk, c_, ck, k in _EDGES
    ),
    headline=True,
)
def join_map(t: Tables) -> DataFrame:
    return p.join_map(_keyed(t), suffix="key")


@query(
    f"""WITH p AS ({PROFILE}) SELECT table_name, column_name,
  concat('bronze | ', table_name, '.', column_name, ' | ', data_type, chr(10), 'Sample values: ',
    array_to_string(string_split(samples, ' / ')[1:3], ', '), chr(10), 'Null %: ', CAST(null_pct AS VARCHAR),
    ' | Cardinality: ', cardinality) AS doc FROM p"""
)
def column_docs(t: Tables) -> DataFrame:
    return p.column_docs(p.profile_tables(_frames(t)), F.lit("bronze"))


@query(
    " UNION ALL ".join(
        f"""SELECT 'bronze' AS layer, '{tbl}' AS table_name, '{c}' AS column_name, '{k}' AS data_type,
  concat('bronze | {tbl}.{c} | {k}') AS doc, count({c}) AS filled FROM {tbl}"""
        for tbl, cols in PROFILED.items()
        for c, k in cols.items()
    )
)
def column_catalog(t: Tables) -> DataFrame:
    """The catalogue, with the number of filled cells of every column."""
    frames = _frames(t)
    counts = p.profile_tables(frames, approx=True)
    counts = counts.select("table_name", "column_name", F.col("n_filled").alias("filled"))
    return (
        catalog_of(t.spark, frames)
        .select("layer", "table_name", "column_name", "data_type", "doc")
        .join(counts, ["table_name", "column_name"])
    )


@query(
    """SELECT concat(lower(event_type), CASE WHEN event_type = 'click' THEN '_rate'
  WHEN event_type = 'view' THEN '_date' WHEN event_type = 'error' THEN '_flag' ELSE '' END) AS column_name,
  CASE event_type WHEN 'click' THEN 'DECIMAL(18,6)' WHEN 'view' THEN 'DATE'
    WHEN 'error' THEN 'BOOLEAN' ELSE 'STRING' END AS proposed, count(*) AS n_rows
FROM events GROUP BY event_type"""
)
def propose_types(t: Tables) -> DataFrame:
    """Types proposed for the attribute names of an attribute-value table."""
    suffix = (
        F.when(F.col("event_type") == "click", "_rate")
        .when(F.col("event_type") == "view", "_date")
        .when(F.col("event_type") == "error", "_flag")
        .otherwise("")
    )
    named = t.events.select(F.concat(F.lower("event_type"), suffix).alias("column_name"))
    counted = named.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn("proposed", proposed_type(F.col("column_name")))


# --- sketches -------------------------------------------------------------------------------

#: Every column of the test tables but the vectors, by the family of its values.
COLUMNS = {
    "integer": {
        "region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey",
        "supplier": "s_suppkey s_nationkey", "part": "p_partkey p_size", "orders": "o_orderkey o_custkey",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber", "events": "event_id user_id",
        "documents": "doc_id n_chars", "embeddings": "vec_id label", "pages": "page_id", "benchmark": "item_id",
        "labels": "doc_id quality toxic", "conversations": "conv_id turn",
    },
    "number": {
        "customer": "c_acctbal", "supplier": "s_acctbal", "part": "p_retailprice", "orders": "o_totalprice",
        "lineitem": "l_quantity l_extendedprice l_discount l_tax", "events": "value",
    },
    "text": {
        "region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name",
        "part": "p_name p_brand p_type", "orders": "o_orderstatus o_orderpriority",
        "lineitem": "l_returnflag l_linestatus", "events": "event_type props",
        "documents": "text lang source", "pages": "url html", "benchmark": "text", "conversations": "role text",
    },
    "time": {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"},
}


def _each(family: str) -> list[tuple[str, str]]:
    return [(t, c) for t, cs in COLUMNS[family].items() for c in cs.split()]


def _profiled(table: str, column: str, family: str) -> str:
    number = {"text": "NULL", "time": f"epoch_us({column})"}.get(family, column)
    low, high = (f"{fn}({column})" if family == "text" else "NULL" for fn in ("min", "max"))
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, '{family}' AS family, count(*) AS n_rows,
  count({column}) AS n_filled, round(100.0 * (count(*) - count({column})) / count(*), 1) AS null_pct,
  CAST({low} AS VARCHAR) AS low, CAST({high} AS VARCHAR) AS high,
  CAST(min({number}) AS DOUBLE) AS low_number, CAST(max({number}) AS DOUBLE) AS high_number,
  TRUE AS close FROM {table}"""


@query(" UNION ALL ".join(_profiled(t, c, f) for f in COLUMNS for t, c in _each(f)))
def profile_sketches(t: Tables) -> DataFrame:
    """Profiles of all columns of all tables, stored for three loads each and merged.

    ``close``: the sketched number of values lies within 4 % of the exact one, and the exact
    median between the sketched quantiles 1.5 % of the rows to its sides.
    """
    path = t.scratch("sketches")
    tables = {name: getattr(t, name).drop("embedding") for name in TABLES}
    for name, df in tables.items():
        deal = F.pmod(F.xxhash64(*df.columns), F.lit(3))
        for load in range(3):
            sk.store(df.where(deal == load), path, name, str(load))
    found = materialise(sk.merged(sk.stored(t.spark, path)), "sketches-merged")
    keys = ["table_name", "column_name"]
    middle = sk.estimates(found, [0.49, 0.51]).where("quantiles is not null")
    # One row per column; the exact median doesn't depend on where its search begins.
    guesses = {(r[0], r[1]): tuple(r[2]) for r in middle.select(*keys, "quantiles").collect()}
    exact = sk.distinct_counts(tables).withColumnRenamed("n", "exact").join(sk.medians(tables, guesses), keys, "left")
    told = sk.estimates(found, [0.485, 0.515]).join(exact, keys)
    told = told.join(found.select(*keys, "family", "low_number", "high_number"), keys)
    near = F.abs(F.col("cardinality") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.04 * F.col("exact"))
    around = F.col("median").between(F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1)))
    near = near & F.coalesce(around, F.lit(True))
    text = F.col("family") == "text"
    return told.select(
        *keys, "family", "n_rows", "n_filled", "null_pct",
        F.when(text, F.col("low")).alias("low"), F.when(text, F.col("high")).alias("high"),
        "low_number", "high_number", near.alias("close"),
    )


def _included(family: str) -> str:
    values = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, {c} AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in _each(family)
    )
    return f"""SELECT * FROM (WITH v AS (SELECT t, c, v, count(*) AS n FROM ({values}) GROUP BY ALL),
sizes AS (SELECT t, c, count(*) AS n_keys, max(n) AS most FROM v GROUP BY ALL),
shared AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n FROM v a JOIN v b USING (v)
  WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, s.n AS child_keys,
  1.0::DOUBLE AS containment FROM shared s JOIN sizes x ON x.t = ct AND x.c = cc AND x.n_keys = s.n
JOIN sizes y ON y.t = pt AND y.c = pc AND y.most = 1)"""


@query(" UNION ALL ".join(_included(f) for f in COLUMNS))
def inclusion_keys(t: Tables) -> DataFrame:
    """Columns that lie within a unique column, found by content: no name takes part."""
    return sk.inclusions({n: getattr(t, n).drop("embedding") for n in TABLES})
