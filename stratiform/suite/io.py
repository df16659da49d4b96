"""Sources and sinks, by round trip through the shared folder."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_hash
from ..operators import governance as g
from ..operators import layout, sinks
from ..operators.aggregates import union_counts
from ..operators.projections import conform
from ..plans.conform import conform_table
from ..plans.ingest import ingest_all as load_registry
from ..sources import files
from ..sources.dispatch import read_source
from ..sources.messages import decode_messages as decode
from ..spec import TableSpec, struct
from . import Tables, query
from .history import _SCD2, KEY, N, hashed
from .inputs import DIRTY, FIRST_DAY, NEXT, NEXT_DAY, VERSION, plain
from .quality import _BLOCKED, _REJECTS, DQ, rules

DAY_ONE, DAY_TWO = datetime(2024, 1, 1, 3), datetime(2024, 2, 1, 3)
ORDERS = struct(
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_day date, o_orderpriority string"
)
CUSTOMER = struct(
    "c_custkey long, c_name string, c_nationkey integer, c_acctbal double, c_mktsegment string"
)


def _orders(t: Tables) -> DataFrame:
    return t.orders.withColumn("o_day", F.to_date("o_orderdate")).select(*ORDERS.names)


_ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CAST(o_orderdate AS DATE) AS o_day, o_orderpriority FROM orders"""


# --- sources --------------------------------------------------------------------------------


@query(_ORDERS)
def read_csv(t: Tables) -> DataFrame:
    path = t.scratch("csv")
    _orders(t).write.option("header", True).csv(path)
    return files.read_csv(t.spark, path, ORDERS)


@query(
    f"WITH d AS ({plain(DIRTY)}) SELECT custkey, nullif(trim(name), '') AS name, balance, segment FROM d"
)
def read_csv_quoted(t: Tables) -> DataFrame:
    """Another delimiter; values that hold it are quoted, blanks come back as NULL."""
    path = t.scratch("csv")
    rows = t.view(DIRTY).select("custkey", F.trim("name").alias("name"), "balance", "segment")
    marked = rows.withColumn("name", F.when(F.col("name") != "", F.concat("name", F.lit(';"x"'))))
    marked.write.options(header=True, sep=";", escape='"').csv(path)
    schema = struct("custkey long, name string, balance double, segment string")
    back = files.read_csv(t.spark, path, schema, delimiter=";")
    return back.withColumn("name", F.regexp_replace("name", ';"x"$', ""))


@query(_ORDERS)
def read_json(t: Tables) -> DataFrame:
    path = t.scratch("json")
    _orders(t).write.json(path)
    return files.read_json(t.spark, path, ORDERS, multi_line=False)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority FROM orders"""
)
def read_parquet_merged(t: Tables) -> DataFrame:
    """Files with different columns read as one table."""
    path = t.scratch("merged")
    late = t.orders.filter("o_orderstatus <> 'F'")
    late.select("o_orderkey", F.col("o_totalprice").alias("price")).write.parquet(path)
    early = t.orders.filter("o_orderstatus = 'F'")
    more = early.select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    sinks.append(more, path)
    rows = files.read_parquet(t.spark, path, merge_schema=True)
    return rows.select("o_orderkey", "price", "priority")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def read_paged(t: Tables) -> DataFrame:
    """A paginated source: page documents ``{"data": {"items": [...]}}``, one task each."""
    path, page_size = t.scratch("pages"), 500
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    pages = max(1, rows.count() // (page_size // 2))
    item = F.struct("c_custkey", "c_name", "c_acctbal")
    doc = F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("data")))
    page = F.pmod(F.xxhash64("c_custkey"), F.lit(pages)).alias("page")
    documents = rows.groupBy(page).agg(doc.alias("value"))
    documents.select("page", "value").write.partitionBy("page").text(path)

    def fetch(number: int, _: int) -> str:
        store, root = fs.FileSystem.from_uri(path)
        folder = fs.FileSelector(f"{root}/page={number}", allow_not_found=True)
        found = [f.path for f in store.get_file_info(folder) if f.path.endswith(".txt")]
        return "".join(store.open_input_stream(f).read().decode() for f in found)

    spec = TableSpec(
        "customers", struct("c_custkey long, c_name string, c_acctbal double")
    )
    config = {
        "type": "api", "fetch": fetch, "max_pages": pages, "page_size": page_size,
        "response_path": "data.items",
    }
    return read_source(t.spark, spec, config)


@query(_ORDERS)
def read_by_type(t: Tables) -> DataFrame:
    """One dispatcher for several source types; each status comes from another one."""
    parts = {}
    for status, kind in (("F", "csv"), ("O", "parquet"), ("P", "json")):
        path = t.scratch(kind)
        rows = _orders(t).filter(F.col("o_orderstatus") == status)
        rows.write.format(kind).option("header", True).save(path)
        parts[kind] = path
    spec = TableSpec("orders", ORDERS)
    sources = [
        {"type": "volume", "format": "csv", "path": parts["csv"]},
        {"type": "s3", "format": "parquet", "path": parts["parquet"]},
        {"type": "adls", "format": "json", "path": parts["json"], "multi_line": False},
    ]
    read = [read_source(t.spark, spec, s) for s in sources]
    return reduce(DataFrame.unionByName, read)


@query(
    """SELECT CAST(user_id AS VARCHAR) AS _kafka_key, event_id AS _kafka_offset, ts AS _kafka_timestamp,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    headline=True,
)
def decode_messages(t: Tables) -> DataFrame:
    messages = t.events.select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.col("props").cast("binary").alias("value"),
        F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"),
    )
    return decode(messages, struct("k long"))


# --- sinks ----------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice FROM orders"""
)
def partition_overwrite(t: Tables) -> DataFrame:
    path = t.scratch("partitioned")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.write_table(rows, path, ["o_orderstatus"])
    again = rows.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.expr("o_totalprice + 100"))
    sinks.overwrite_partitions(again, path, ["o_orderstatus"])
    return t.spark.read.parquet(path)


_MERGED = (
    N
    + """SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name,
  coalesce(n.c_nationkey, c.c_nationkey) AS c_nationkey,
  coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal,
  coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey"""
)


@query(_MERGED)
def upsert_buckets(t: Tables) -> DataFrame:
    """The upsert on disk: only the buckets that hold changes are rewritten."""
    path = t.scratch("bucketed")
    for delivery in (t.customer, t.view(NEXT), t.view(NEXT)):
        sinks.upsert_buckets(t.spark, path, hashed(delivery), KEY, buckets=8)
    return t.spark.read.parquet(path).drop("_row_hash", sinks.BUCKET)


@query(_SCD2 + "SELECT * FROM scd", headline=True)
def scd2_buckets(t: Tables) -> DataFrame:
    """The history on disk: only buckets with changes are rewritten, closed versions appended."""
    path = t.scratch("history")
    first, second = hashed(t.customer), hashed(t.view(NEXT))
    for delivery, day, version in ((first, FIRST_DAY, "rules-v0"), (second, NEXT_DAY, VERSION),
                                   (second, NEXT_DAY, VERSION)):
        sinks.scd2_buckets(t.spark, path, delivery, KEY, day, version, buckets=8)
    return sinks.read_history(t.spark, path).drop("_row_hash")


def _snapshots(t: Tables) -> sinks.SnapshotTable:
    table = sinks.SnapshotTable(t.spark, t.scratch("snapshots"))
    table.write(t.customer, "CREATE", at=DAY_ONE)
    table.write(t.view(NEXT), "OVERWRITE", at=DAY_TWO)
    return table


@query("SELECT * FROM customer")
def snapshot_as_of(t: Tables) -> DataFrame:
    """The table as it was between two writes."""
    return _snapshots(t).read(datetime(2024, 1, 20))


@query(N + f"SELECT {', '.join(CUSTOMER.names)} FROM n")
def overwrite_snapshot(t: Tables) -> DataFrame:
    return _snapshots(t).read()


@query(
    N
    + """SELECT CAST(1 AS BIGINT) AS snapshot_id, 'CREATE' AS operation, (SELECT count(*) FROM customer) AS n_rows
UNION ALL SELECT 2, 'OVERWRITE', (SELECT count(*) FROM n)
UNION ALL SELECT 3, 'RESTORE 1', (SELECT count(*) FROM customer)"""
)
def snapshot_history(t: Tables) -> DataFrame:
    table = _snapshots(t)
    table.restore(1)
    restored = table.read().agg(F.count(F.lit(1))).scalar()
    log = table.history().select("snapshot_id", "operation", "n_rows")
    last = F.when(F.col("snapshot_id") == 3, restored).otherwise(F.col("n_rows"))
    return log.withColumn("n_rows", last)


@query(
    """SELECT l_returnflag, l_partkey, count(*) AS n_rows, min(l_suppkey) AS lo, max(l_orderkey) AS hi
FROM lineitem GROUP BY 1, 2"""
)
def compact(t: Tables) -> DataFrame:
    """Many small files rewritten into few, clustered along two columns."""
    source, target = t.scratch("loose"), t.scratch("compact")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    rows.repartition(32).write.parquet(source)
    layout.compact(
        t.spark, source, target, cluster_by=["l_partkey", "l_suppkey"],
        partition_by=["l_returnflag"],
    )
    return t.spark.read.parquet(target).groupBy("l_returnflag", "l_partkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("l_suppkey").alias("lo"),
        F.max("l_orderkey").alias("hi"),
    )


# --- catalogue tables -----------------------------------------------------------------------


def _table(t: Tables, df: DataFrame, purpose: str) -> str:
    path = t.scratch(purpose)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.parquet(path)
    t.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    return name


@query(
    """SELECT column_name, n FROM (VALUES ('c_acctbal'), ('c_mktsegment'), ('c_nationkey')) v(column_name),
  (SELECT count(*) AS n FROM customer)"""
)
def comments(t: Tables) -> DataFrame:
    """Columns that still lack a comment, with the rows they describe."""
    name = _table(t, t.customer, "commented")
    g.set_comments(
        t.spark, name, "Customers, one row each.",
        {"c_custkey": "Customer's key", "c_name": "Customer's name"},
    )
    open_columns = g.missing_comments(t.spark, [name]).select("column_name")
    rows = t.spark.table(name).agg(F.count(F.lit(1)).alias("n"))
    return open_columns.withColumn("n", rows.scalar())


@query(
    """SELECT tag_name, tag_value, n FROM (VALUES ('domain', 'sales'), ('pii', 'false')) v(tag_name, tag_value),
  (SELECT count(*) AS n FROM orders)"""
)
def tags(t: Tables) -> DataFrame:
    name = _table(t, _orders(t), "tagged")
    g.tag(t.spark, name, {"domain": "sales", "pii": "false"})
    rows = files.read_table(t.spark, name).agg(F.count(F.lit(1)).alias("n"))
    found = g.tags(t.spark, [name]).select("tag_name", "tag_value")
    return found.withColumn("n", rows.scalar())


@query("SELECT count(*) AS stat_rows, count(DISTINCT o_custkey) > 0 AS has_columns FROM orders")
def analyze(t: Tables) -> DataFrame:
    """Row count that ANALYZE stored for the optimiser."""
    name = _table(t, _orders(t), "analyzed")
    layout.analyze(t.spark, name, ["o_orderkey", "o_orderstatus"])
    stats = t.spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Statistics'")
    column = t.spark.sql(f"DESCRIBE EXTENDED {name} o_orderkey")
    distinct = column.filter("info_name = 'distinct_count'").select("info_value").scalar()
    count = F.regexp_extract("data_type", r"(\d+) rows", 1).cast("bigint")
    return stats.select(
        count.alias("stat_rows"), (distinct.cast("bigint") > 0).alias("has_columns")
    )


# --- layers ---------------------------------------------------------------------------------


@query(
    N
    + """SELECT unnest(['customer', 'buyer']) AS table_name, count(*) AS n_rows, count(DISTINCT _b) AS n_batches FROM (
  SELECT coalesce(n.c_custkey, c.c_custkey) AS k,
    CASE WHEN n.c_custkey IS NOT NULL AND (c.c_custkey IS NULL OR c.c_acctbal <> n.c_acctbal) THEN 'b2' ELSE 'b1' END AS _b
  FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey)
UNION ALL SELECT 'orders', count(*), 1 FROM orders
UNION ALL SELECT 'nation', count(*), 1 FROM nation""",
    headline=True,
)
def ingest_all(t: Tables) -> DataFrame:
    """Two deliveries through the registry: create, then merge, overwrite and leave out."""
    source, root = t.scratch("delivery"), t.scratch("bronze")

    def specs(batch):
        src = lambda n: {"type": "volume", "path": f"{source}/{batch}/{n}"}
        return [
            TableSpec("nation", t.nation.schema, (), src("nation")),
            TableSpec("customer", CUSTOMER, ("c_custkey",), src("customer"), 1),
            TableSpec("buyer", CUSTOMER, ("c_custkey",), src("customer"), 1, buckets=8),
            TableSpec("orders", ORDERS, ("o_orderkey",), src("orders"), 2, ("_batch_id",)),
        ]

    deliveries = {
        "b1": {"nation": t.nation, "customer": t.customer, "orders": _orders(t)},
        "b2": {"nation": t.nation, "customer": conform(t.view(NEXT), CUSTOMER)},
    }
    for batch, at in (("b1", DAY_ONE), ("b2", DAY_TWO)):
        for name, df in deliveries[batch].items():
            df.write.option("header", True).csv(f"{source}/{batch}/{name}")
        only = {*deliveries[batch], "buyer"}
        load_registry(t.spark, specs(batch), root, batch, only=only, at=at)
    tables = {n: sinks.SnapshotTable(t.spark, f"{root}/{n}").read() for n in deliveries["b1"]}
    tables["buyer"] = t.spark.read.parquet(f"{root}/buyer")
    batches = [
        df.agg(F.count_distinct("_batch_id").alias("n_batches")).select(
            F.lit(n).alias("table_name"), "n_batches"
        )
        for n, df in tables.items()
    ]
    return union_counts(tables).join(reduce(DataFrame.unionByName, batches), "table_name")


@query(
    DQ
    + f""", r AS ({_REJECTS.replace(DQ, "")})
SELECT 'history' AS table_name, count(*) AS n_rows FROM e WHERE coalesce(NOT ({_BLOCKED}), TRUE)
UNION ALL SELECT 'rejects', count(*) FROM r""",
    headline=True,
)
def conform_customers(t: Tables) -> DataFrame:
    """Bronze to silver, repeated: the history stays, and the run's rejects are replaced."""
    root = t.scratch("silver")
    dirty = t.view(DIRTY)
    bronze = dirty.withColumn("_row_hash", row_hash(dirty.columns))
    for _ in range(2):
        conform_table(
            t.spark, "customer", bronze, ["custkey"], rules(), {"nation": t.nation}, root, DAY_ONE
        )
    history = sinks.SnapshotTable(t.spark, f"{root}/customer").read()
    rejects = t.spark.read.parquet(f"{root}/customer_rejects")
    return union_counts({"history": history, "rejects": rejects})
