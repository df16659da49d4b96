"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Words of a text: runs of anything but the six ASCII blanks.
WORDS = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound an Arrow batch by bytes, not by rows alone: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of the whole text; 0 for NULL."""
    found = F.regexp_count(text, F.lit(WORDS)).cast("long")
    return F.coalesce(found, F.lit(0).cast("long"))


def free_name(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, made longer until it clashes with no column (names ignore case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_fields(schema: T.StructType, **added: str) -> T.StructType:
    fields = list(schema.fields)
    fields += [T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items()]
    return T.StructType(fields)


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str], purpose: str):
    """Sort ``df`` globally and add, for each column of ``sums``, what all rows before hold.

    ``sums`` maps the name of a new column to the long column it adds up; ``"*"`` counts
    rows.  Returns the written frame.  A range sort deals the rows out, each task adds up
    its own range, and one offset per range (as many as there are shuffle partitions) goes
    over the driver.  ``order`` should be total but for rows that are equal anyway; a key
    with very many rows is split where a later sort key tells its rows apart.
    """
    spark = df.sparkSession
    names = list(sums)
    schema = with_fields(df.schema, __range="int", **{n: "long" for n in names})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total = dict.fromkeys(names, 0)
        for b in batches:
            arrays = list(b.columns) + [pa.array(np.full(b.num_rows, part, np.int32))]
            for n in names:
                if sums[n] == "*":
                    v = np.ones(b.num_rows, np.int64)
                else:
                    v = b.column(sums[n]).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(v) + total[n]
                arrays.append(pa.array(ends - v))
                total[n] = int(ends[-1]) if len(ends) else total[n]
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names + ["__range", *names])

    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    stored = materialise(dealt.mapInArrow(add_up, schema), purpose)
    last = [
        F.max(F.col(n) + (F.lit(1) if sums[n] == "*" else F.col(sums[n]))).alias(n) for n in names
    ]
    ends = sorted(stored.groupBy("__range").agg(*last).collect())
    at, offsets = [0] * len(names), []
    for r in ends:
        offsets.append((r["__range"], *at))
        at = [a + r[n] for a, n in zip(at, names)]
    shape = "__range int, " + ", ".join(f"__before_{n} long" for n in names)
    table = F.broadcast(spark.createDataFrame(offsets, shape))  # a row per shuffle partition
    whole = stored.join(table, "__range")
    return whole.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in names}).drop(
        "__range", *(f"__before_{n}" for n in names)
    )


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The groups of a partition that is sorted by its first ``keys`` columns, one at a time.

    Cheaper by far than one pandas call per group where groups are small.
    """
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(keys))

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
            piece = b.slice(s, e - s)
            if i == 0 and held and key(held[0], 0) == key(b, 0):
                held.append(piece)
            else:
                if held:
                    yield joined(held)
                held = [piece]
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def matrix(column: pa.ListArray, dtype=np.float64) -> np.ndarray:
    """A list column without NULLs, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """Union-find over ``edges(a, b)``: ``node`` and ``root``, the least node it is joined to.

    The forest is kept as rows (node, parent) in the shared folder.  Each round hooks the
    larger root of every edge onto the smaller one and then halves the paths, until no edge
    joins two roots.  The work is joins and map-side minima on keys: a node with very many
    edges is split as a skewed join, and no component is ever gathered.  Nodes are those that
    occur in ``edges``; rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    live = materialise(pairs.distinct(), purpose)
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    forest = materialise(nodes.withColumn("root", F.col("node")), purpose)
    while not live.isEmpty():
        # Each root takes the least root among the edges that meet it.
        hook = live.groupBy("b").agg(F.min("a").alias("up")).withColumnRenamed("b", "root")
        up = materialise(hook, purpose)
        while True:  # shorten the chains of hooks
            over = up.select(F.col("root").alias("up"), F.col("up").alias("over"))
            longer = up.join(over, "up", "left")
            up = materialise(
                longer.select("root", F.coalesce("over", "up").alias("up"),
                              F.col("over").isNotNull().alias("moved")), purpose
            )
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        joined_up = forest.join(up, "root", "left")
        forest = materialise(
            joined_up.select("node", F.coalesce("up", "root").alias("root")), purpose
        )
        a = up.select(F.col("root").alias("a"), F.col("up").alias("a_up"))
        b = up.select(F.col("root").alias("b"), F.col("up").alias("b_up"))
        moved = live.join(a, "a", "left").join(b, "b", "left")
        moved = moved.select(
            F.coalesce("a_up", "a").alias("x"), F.coalesce("b_up", "b").alias("y")
        ).where("x <> y")
        live = materialise(
            moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            purpose,
        )
    return forest
