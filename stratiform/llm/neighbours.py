"""Approximate nearest neighbours: p-stable hashing with query-directed multiprobe."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, groups, matrix, running_sums
from .vector_duplicates import digest, unit
from .vectors import dimension, usable

#: Vectors of the sample that the scale of distances is read from.
SAMPLE = 4096
#: Indexed vectors that a task compares with the queries of their bucket at once.
BLOCK = 4096
#: Rows aimed at in a bucket; more projections are drawn for larger tables.
BUCKET = 2048
#: Products of unit vectors that are this near may be equal when added up in another order.
ROUNDING = 1e-12


def phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


@dataclass(frozen=True)
class Index:
    """h(x) = floor((a . x + b) / width) per projection, on unit vectors.

    ``a`` is normal, so the difference of two projections is normal with the vectors'
    distance as its deviation (2-stability).  ``scale`` is the distance at which neighbours
    are expected.
    """

    a: np.ndarray  # tables x projections x components
    b: np.ndarray  # tables x projections
    width: float
    scale: float

    def place(self, v: np.ndarray) -> np.ndarray:
        """tables x rows x projections, not yet cut to integers."""
        return (np.einsum("tpd,nd->tnp", self.a, v) + self.b[:, None, :]) / self.width

    def buckets(self, v: np.ndarray) -> np.ndarray:
        return mixed(np.floor(self.place(v)).astype(np.int64))

    def probes(self, place: np.ndarray, mass: float) -> np.ndarray:
        """Cells to visit for one query in one table, likeliest first.

        A neighbour at the expected distance lies ``d`` cells away in one projection with the
        normal probability of that cell seen from the query's own place in its cell; in all
        projections with the product.  Cells are taken in falling order of it until together
        they hold ``mass``.
        """
        home = np.floor(place).astype(np.int64)
        options = []
        for x in place - home:
            step = self.width / self.scale
            reach = int(math.ceil(4 / step)) + 1
            own = [
                (phi((d + 1 - x) * step) - phi((d - x) * step), d) for d in range(-reach, reach + 1)
            ]
            options.append(sorted(((p, d) for p, d in own if p > 1e-9), reverse=True))
        start = (0,) * len(options)
        heap, seen = [(-math.prod(o[0][0] for o in options), start)], {start}
        out, held = [], 0.0
        while heap and held < mass:
            p, at = heapq.heappop(heap)
            held -= p
            out.append([options[m][i][1] for m, i in enumerate(at)])
            for m in range(len(at)):
                if at[m] + 1 < len(options[m]):
                    nxt = at[:m] + (at[m] + 1,) + at[m + 1 :]
                    if nxt not in seen:
                        seen.add(nxt)
                        q = p / options[m][at[m]][0] * options[m][nxt[m]][0]
                        heapq.heappush(heap, (q, nxt))
        return mixed(home + np.array(out, np.int64))


def mixed(cells: np.ndarray) -> np.ndarray:
    """One long per cell; different cells share one with probability 2^-64."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        h = (h ^ cells[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h.astype(np.int64)


def fit(nodes: DataFrame, k: int, size: int, tables: int, width: float, seed: int) -> Index:
    """Draw the projections; read the scale from at most SAMPLE vectors (least hashes)."""
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").collect()
    v = unit(np.array([r["v"] for r in sample]))
    scale = 1.0
    if len(v) > k + 1:
        near = []
        for s in range(0, len(v), 512):
            dots = v[s : s + 512] @ v.T
            kth = -np.partition(-dots, k, axis=1)[:, k]  # itself comes first
            near.append(np.sqrt(np.maximum(0, 2 - 2 * kth)))
        scale = max(1e-3, float(np.quantile(np.concatenate(near), 0.8)))
    step = width * scale
    # A projection of unit vectors is about standard normal: its entropy in cells of ``step``.
    entropy = max(0.5, math.log2(math.sqrt(2 * math.pi * math.e) / step))
    projections = max(4, min(48, round(math.log2(max(2, n / BUCKET)) / entropy)))
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((tables, projections, size))
    return Index(a, rng.uniform(0, step, (tables, projections)), step, scale)


def nearest(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    column: str = "embedding",
    k: int = 5,
    queries: Column | None = None,
    tables: int = 2,
    width: float = 1.4,
    mass: float = 0.85,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` rows of largest cosine found for each row that ``queries`` selects.

    Returns ``query_id``, ``rank`` (from 1), ``key`` and ``score`` (the cosine, in double
    precision).  Every usable row is indexed and is a candidate, but for the query's own.

    * Equal vectors are one node with its k + 1 smallest keys: more can't be asked for.
    * Each table cuts its projections into cells as wide as ``width`` times the distance at
      which neighbours are expected.  A query visits cells in the order of estimated success
      until ``mass`` of it is covered, so with t independent tables a neighbour at the
      expected distance is missed with probability (1 - mass)^t.
    * Vectors and queries meet in their cells; a cell with many vectors is cut into blocks
      that face the queries one by one.  Of each meeting the best k + 1 move on, and the
      tables' candidates are merged by exact score.
    * A query that finds fewer than there could be is compared with all vectors, in blocks.

    Defined results: vectors that are NULL, empty, all zero or hold NULL or non-finite
    components take no part; fewer candidates than ``k`` are all returned; equal scores are
    ordered by the smaller key, NULL keys last; rows that repeat are candidates of their own;
    an empty table or no query gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 8)
    asks = F.coalesce(F.col(key) % 50 == 0 if queries is None else queries, F.lit(False))
    kind = vectors.schema[key].dataType.simpleString()
    v = F.col(column).cast("array<double>")
    good = vectors.where(usable(v)).select(F.col(key).alias("id"), asks.alias("asks"), v.alias("v"))
    size = dimension(good)
    shape = f"query_id {kind}, rank int, {key} {kind}, score double"
    if size is None:
        return spark.createDataFrame([], shape)
    rows = materialise(
        good.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", digest()), "ann-rows"
    )
    # Nodes are numbered by their smallest key, NULL last, so that a tie goes to the smaller node.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head")
    same = rows.groupBy("digest").agg(first).select("digest", "head.*")
    same = running_sums(same, [F.col("none"), F.col("id"), F.col("row")], {"node": "*"}, "ann-order")
    same = same.select("digest", "node", F.col("row").alias("head"))
    placed = rows.select("row", "id", "asks", "digest").join(same, "digest").drop("digest")
    placed = materialise(placed, "ann-placed")
    heads = placed.where("row = head").select("node", "row")
    nodes = materialise(heads.join(rows.select("row", "v"), "row").drop("row"), "ann-nodes")
    index = fit(nodes, k, size, tables, width, seed)
    asked = placed.where("asks").select("node").distinct().join(nodes, "node")
    shared = spark.sparkContext.broadcast(index)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = shared.value.buckets(unit(matrix(b.column(1))))
                for t, bucket in enumerate(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b.num_rows, t, np.int32)), pa.array(bucket), *b.columns],
                        names=["table", "bucket", "node", "v"],
                    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for t, places in enumerate(shared.value.place(unit(matrix(b.column(1))))):
                    cells = [shared.value.probes(p, mass) for p in places]
                    times = [len(c) for c in cells]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(sum(times), t, np.int32)), pa.array(np.concatenate(cells)),
                         pa.array(np.repeat(b.column(0).to_numpy(), times))],
                        names=["table", "bucket", "node"],
                    )

    stored = nodes.mapInArrow(store, "table int, bucket long, node long, v array<double>")
    stored = materialise(stored, "ann-index")
    sizes = stored.groupBy("table", "bucket").agg(F.count("*").alias("size")).select(
        "table", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    )
    sizes = materialise(sizes, "ann-sizes")
    visits = asked.mapInArrow(probe, "table int, bucket long, node long").join(sizes, ["table", "bucket"])
    found = materialise(meet(visits, stored, sizes, asked, k), "ann-found")

    # Fewer than there could be: every bucket of the first table.
    want = min(k + 1, nodes.count())
    got = found.groupBy("query").agg(F.countDistinct("node").alias("n")).where(F.col("n") >= want)
    short = materialise(
        asked.select("node").join(got.select(F.col("query").alias("node")), "node", "left_anti"), "ann-short"
    )
    if not short.isEmpty():
        first = sizes.where("table = 0")
        all_cells = short.withColumn("table", F.lit(0)).join(first, "table")
        found = found.union(meet(all_cells, stored, sizes, asked, k))

    merged = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    merged = merged.withColumn("at", F.row_number().over(best))
    merged = merged.where(F.col("at") <= k + 1).drop("at")
    own = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last(), "row")
    few = placed.select("node", "id", "row").withColumn("at", F.row_number().over(own))
    few = few.where(F.col("at") <= k + 1).drop("at")
    asking = placed.where("asks").select(
        F.col("node").alias("query"), F.col("id").alias("query_id"), F.col("row").alias("query_row")
    )
    out = asking.join(merged, "query").join(few, "node").where("row <> query_row")
    last = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    out = out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(key), "score")


def meet(visits: DataFrame, stored: DataFrame, sizes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, node, score): the best of each cell that a query visits."""
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = visits.select("table", "bucket", "node", block).join(asked, "node").select(
        "table", "bucket", "block", F.lit(0).alias("side"), "node", "v"
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    right = stored.join(sizes, ["table", "bucket"]).select(
        "table", "bucket", own, F.lit(1).alias("side"), "node", "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            side, node = g.column(3).to_numpy(), g.column(4).to_numpy()
            q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(q) or not len(c):
                continue
            v = unit(matrix(g.column(5)))
            for s in range(0, len(q), 256):
                some = q[s : s + 256]
                dots = v[some] @ v[c].T
                n = min(k + 1, len(c))
                least = -np.partition(-dots, n - 1, axis=1)[:, n - 1 :  n]
                a, b = np.nonzero(dots >= least - ROUNDING)  # with all that tie for the last place
                a, b = some[a], c[b]
                exact = np.einsum("ij,ij->i", v[a], v[b])  # in one order for every meeting
                order = np.lexsort((node[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                at = np.arange(len(a)) - np.searchsorted(a, a)
                a, b, exact = (x[at < n] for x in (a, b, exact))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[a]), pa.array(node[b]), pa.array(exact)],
                    names=["query", "node", "score"],
                )

    cells = left.union(right).repartition("table", "bucket", "block")
    cells = cells.sortWithinPartitions("table", "bucket", "block", "side")
    return cells.mapInArrow(run, "query long, node long, score double")
