"""Table writes: plain, per partition, bucketed upsert and versioned snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..spec import struct
from .history import scd2_merge
from .merge import all_present, upsert
from .projections import stamp_current


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """First load.  Rows are brought together by partition value before the write, and AQE
    splits partition values that are large, so each directory gets few, full files."""
    out = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    out.write.partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that occur in ``df``."""
    out = df.hint("rebalance", *[F.col(c) for c in partition_by])
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


# --- bucketed upsert ------------------------------------------------------------------------

BUCKET = "_bucket"


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows with a NULL key share bucket -1."""
    b = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    return df.withColumn(BUCKET, F.when(all_present(keys), b).otherwise(F.lit(-1)))


def keep_layout(spark: SparkSession, path: str, buckets: int) -> None:
    """Remember the number of buckets of a table; refuse another number later on.

    The number decides where a key lies, so a load with another one would miss the rows.
    """
    where = f"{path}/_layout"  # readers pass over names with an underscore
    if path_exists(spark, where):
        kept = spark.read.schema("buckets int").json(where).first()[0]
        if kept != buckets:
            raise ValueError(f"{path} has {kept} buckets, not {buckets}; rewrite it to change that")
    else:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(where)


def _changed_buckets(
    table: DataFrame, src: DataFrame, keys: Sequence[str], hash_col: str
) -> list[int]:
    """The buckets with rows of ``src`` that the table lacks or has differently.

    Only keys and hashes are read, and only from buckets that occur in ``src``; at most
    as many numbers as there are buckets reach the driver.
    """
    present = [r[0] for r in src.select(BUCKET).distinct().collect()]
    known = table.filter(F.col(BUCKET).isin(present)).select(*keys, BUCKET, hash_col)
    same = [src[BUCKET] == known[BUCKET], src[hash_col].eqNullSafe(known[hash_col])]
    same += [src[c].eqNullSafe(known[c]) for c in keys]
    fresh = src.join(known, same, "left_anti")
    return [r[0] for r in fresh.select(BUCKET).distinct().collect()]


def upsert_buckets(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    *,
    buckets: int,
    hash_col: str = "_row_hash",
    newest_by: Sequence[str] = (),
) -> None:
    """Upsert into a table laid out by key hash, rewriting only the buckets with changes.

    ``incoming`` has the table's columns; columns it has beyond them are added, and are
    NULL in the parts that are not rewritten.

    Keys and hashes alone decide which incoming rows differ from the table (a scan of two
    narrow columns in the buckets concerned).  Only buckets that hold such rows are read in
    full and replaced, so a small batch neither reads nor rewrites the whole table.
    """
    src = with_bucket(incoming, keys, buckets)
    if not path_exists(spark, path):
        write_table(src, path, [BUCKET])
        keep_layout(spark, path, buckets)
        return
    keep_layout(spark, path, buckets)
    table = spark.read.schema(src.schema).parquet(path)
    touched = _changed_buckets(table, src, keys, hash_col)
    if not touched:
        return
    old = table.filter(F.col(BUCKET).isin(touched)).select(*src.columns)
    new = src.filter(F.col(BUCKET).isin(touched))
    overwrite_partitions(upsert(old, new, keys, hash_col, newest_by), path, [BUCKET])


def scd2_buckets(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    as_of,
    rule_version: str,
    *,
    buckets: int,
    hash_col: str = "_row_hash",
) -> None:
    """Fold a snapshot into a history kept in two parts: ``current``, by key hash, and
    ``closed``, by the day a version ended and key hash.

    Only buckets with new or changed keys are read and replaced.  Versions closed before
    ``as_of`` are never touched, so a run costs what it changes, however long the history.
    The closed versions are written first and by replacing their partition: a run that was
    cut off half-way can be repeated.
    """
    day = F.lit(as_of).cast("date")
    src = with_bucket(incoming, keys, buckets)
    now, past = f"{path}/current", f"{path}/closed"
    if not path_exists(spark, now):
        write_table(stamp_current(src, as_of, rule_version), now, [BUCKET])
        keep_layout(spark, now, buckets)
        return
    keep_layout(spark, now, buckets)
    current = spark.read.parquet(now)
    touched = _changed_buckets(current, src, keys, hash_col)
    if not touched:
        return
    here = F.col(BUCKET).isin(touched)
    merged = scd2_merge(
        current.filter(here), src.filter(here), [*keys, BUCKET], as_of, rule_version, hash_col
    )
    merged = materialise(merged, "scd2")
    closed = merged.filter(~F.col("is_current")).withColumn("_closed_on", F.col("effective_end_date"))
    if path_exists(spark, past):
        old = spark.read.parquet(past).filter(here & (F.col("_closed_on") == day))
        closed = closed.unionByName(old.select(*closed.columns))
        closed = closed.dropDuplicates([*keys, "effective_start_date"])
    overwrite_partitions(closed, past, ["_closed_on", BUCKET])
    overwrite_partitions(merged.filter("is_current"), now, [BUCKET])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Current and closed versions of a bucketed history."""
    current = spark.read.parquet(f"{path}/current").drop(BUCKET)
    if not path_exists(spark, f"{path}/closed"):
        return current
    closed = spark.read.parquet(f"{path}/closed")
    return current.unionByName(closed.select(*current.columns))


# --- snapshots ------------------------------------------------------------------------------


class SnapshotTable:
    """A table kept as full Parquet snapshots plus a log of commits.

    Data goes to ``data/_snapshot_id=<n>`` first; the log row that makes it visible is
    written last, so a job that dies half-way leaves the table as it was.  One writer at a
    time.
    """

    LOG = struct(
        "snapshot_id long, data_id long, committed_at timestamp, operation string, n_rows long"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def history(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], self.LOG)
        return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log")

    def _entry(self, condition=None):
        log = self.history()
        if condition is not None:
            log = log.filter(condition)
        return log.orderBy(F.desc("snapshot_id")).first()

    def exists(self) -> bool:
        return self._entry() is not None

    def _log(self, snapshot_id, data_id, at, operation, rows) -> None:
        at = at or datetime.now()
        row = self.spark.createDataFrame([(snapshot_id, data_id, at, operation, rows)], self.LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def write(
        self,
        df: DataFrame,
        operation: str,
        *,
        at: datetime | None = None,
        partition_by: Sequence[str] = (),
    ) -> int:
        """Write ``df`` as the new current snapshot and return the number of its rows.

        ``df`` may read this table: a snapshot never overwrites another one.
        """
        last = self._entry()
        new_id = 1 if last is None else last.snapshot_id + 1
        seen = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if partition_by:
            out = out.hint("rebalance", *[F.col(c) for c in partition_by])
        out.write.mode("overwrite").partitionBy(*partition_by).parquet(
            f"{self.path}/data/_snapshot_id={new_id}"
        )
        rows = seen.get["n"]
        self._log(new_id, new_id, at, operation, rows)
        return rows

    def read(self, as_of: int | datetime | None = None) -> DataFrame:
        """The current snapshot, or the one with an id, or the one valid at a time."""
        if isinstance(as_of, int):
            entry = self._entry(F.col("snapshot_id") == as_of)
        elif as_of is not None:
            entry = self._entry(F.col("committed_at") <= F.lit(as_of).cast("timestamp"))
        else:
            entry = self._entry()
        if entry is None:
            raise ValueError(f"{self.path} has no snapshot for {as_of}")
        return self.spark.read.parquet(f"{self.path}/data/_snapshot_id={entry.data_id}")

    def restore(self, snapshot_id: int, *, at: datetime | None = None) -> None:
        """Make an old snapshot current again.  No data is copied."""
        old = self._entry(F.col("snapshot_id") == snapshot_id)
        if old is None:
            raise ValueError(f"{self.path} has no snapshot {snapshot_id}")
        new_id = self._entry().snapshot_id + 1
        self._log(new_id, old.data_id, at, f"RESTORE {snapshot_id}", old.n_rows)
