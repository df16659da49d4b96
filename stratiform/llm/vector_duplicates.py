"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, components, groups, matrix, partitions
from .vectors import as_doubles, dimension, usable

#: Least hash bits of one sort key; more nodes take more.
BITS = 62
#: Planted pairs by which the passes are measured, and the numbers they hold at most.
PROBES, PROBE_NUMBERS = 4096, 1 << 21
#: Vectors of one block when all are compared with all.
WIDE = 4096
#: Rows that one task compares at once with their neighbours; bounds memory only.
STRIP = 4096
#: Members of a component in one block when its links are counted.
BLOCK = 512
#: Rounds of passes before what they can't tell apart is compared exactly.
ROUNDS = 24
#: Slack of single against double precision in the first look at a pair.
SLACK = 1e-4


def keys(v: np.ndarray, planes: np.ndarray) -> pa.Array:
    """Sort keys of all vectors, pass by pass: signs of random projections, first ones first."""
    passes, bits, _ = planes.shape
    packed = np.concatenate([np.packbits(v @ planes[p].T > 0, axis=1) for p in range(passes)])
    width = packed.shape[1]
    fixed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(packed), [None, pa.py_buffer(packed.tobytes())]
    )
    return fixed.cast(pa.binary())


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (unit, double) are at least that alike."""
    return np.einsum("ij,ij->i", *np.broadcast_arrays(a, b)) >= threshold


class Forest:
    """Union-find over the rows of one strip."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def neighbours(ids: np.ndarray, v: np.ndarray, window: int, threshold: float) -> list:
    """Links of a spanning forest of what lies close within ``window`` places.

    A probe (a negative number) links with the node it was planted beside, and nothing else.
    """
    n = len(ids)
    out: list[tuple[int, int]] = []
    forest = Forest(n)
    single = v.astype(np.float32)
    for s in range(0, n, window):
        e, far = min(n, s + window), min(n, s + 2 * window)
        x, y = np.nonzero(single[s:e] @ single[s:far].T >= threshold - SLACK)
        x, y = x + s, y + s
        ahead = (y > x) & (y - x <= window)
        x, y = x[ahead], y[ahead]
        probe = (ids[x] < 0) | (ids[y] < 0)
        for i, j in zip(ids[x[probe]].tolist(), ids[y[probe]].tolist()):
            if i == -1 - j:
                out.append((min(i, j), max(i, j)))
        x, y = x[~probe], y[~probe]
        good = close(v[x], v[y], threshold) if len(x) else np.empty(0, bool)
        for i, j in zip(x[good].tolist(), y[good].tolist()):
            if forest.join(i, j):
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    column: str = "embedding",
    threshold: float = 0.95,
    passes: int = 16,
    window: int = 64,
    rounds: int = ROUNDS,
    seed: int = 7,
) -> DataFrame:
    """Groups of vectors whose cosine reaches ``threshold``, and each vector's links.

    One row per row of ``vectors``: ``key``, ``n_links``, ``component_id`` (least key
    reachable over links) and ``kept`` (key = component_id).

    * Vectors equal in every component are one node with a weight.
    * Each pass sorts all nodes by the signs of random projections and compares every node
      with the ``window`` next ones; all passes are one range sort by (pass, key), so a dense
      region spreads over tasks.  What lies across two ranges is compared from the rows at
      their edges.  A pair at the threshold agrees in one bit with probability 0.90, so it
      falls into a common window of N evenly spread vectors with about 0.9^log2(N / window),
      and far less often within a dense region.
    * So the passes are measured: beside up to 4096 nodes drawn by hash a probe is planted at
      exactly the threshold, and rounds of ``passes`` follow until every probe has met its
      node, whatever the number of vectors.  Where the share met so far tells that ``rounds``
      rounds will not do (a cone of vectors nearly as close as the threshold, which no
      projection tells apart), the exact way for the rest is to compare all nodes, in blocks.
    * Verified pairs of all passes are united.
    * A window can be narrower than a dense group.  So the links are counted exactly within
      every component, in blocks of pairs of blocks, of which only the counts come back.
      Nothing is capped; a component of g different vectors costs g^2 / 2 products.

    Defined results: vectors that are NULL, empty, all zero or hold NULL or non-finite
    components link with nothing and are kept; rows that repeat a vector link with each
    other; rows that repeat key and vector count as links, too; NULL keys are never a
    component's id unless there is no other; an empty table gives an empty result; other
    columns are not read; vectors of different lengths fail.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 8)
    good = as_doubles(vectors, key, column).withColumn("digest", digest())
    size = dimension(good)
    every = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
    if size is None:
        return results(every.withColumn("links", F.lit(0)).withColumn("top", F.col("id")), key)
    # Equal vectors by 128 bits of digest; the node is the least row number among them.
    rows = materialise(good.withColumn("row", F.monotonically_increasing_id()), "vectors-rows")
    same = rows.groupBy("digest").agg(
        F.min("row").alias("node"), F.count("*").alias("weight"), F.min("id").alias("least")
    )
    placed = materialise(
        rows.select("row", "id", "digest").join(same, "digest").drop("digest"), "vectors-nodes"
    )
    heads = placed.where("row = node").select("node", "weight", "least")
    nodes = materialise(heads.join(rows.select(F.col("row").alias("node"), "v"), "node"), "vectors-heads")

    found = close_pairs(nodes, size, threshold, passes, window, rounds, seed)
    joined = components(found, "vectors-union")
    counted = count_links(joined, nodes, threshold)

    least = joined.join(nodes.select("node", "least"), "node").groupBy("root").agg(
        F.min("least").alias("top")
    )
    told = joined.join(least, "root").join(counted, "node").select("node", "top", "others")
    with_all = placed.join(told, "node", "left").select(
        "id",
        (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links"),
        F.coalesce("top", "least").alias("top"),
    )
    bad = every.where(~usable(F.col("v"))).select(
        "id", F.lit(0).cast("long").alias("links"), F.col("id").alias("top")
    )
    return results(with_all.union(bad), key)


def close_pairs(
    nodes: DataFrame, size: int, threshold: float, passes: int, window: int, most: int, seed: int
) -> DataFrame:
    """Links (a, b) that connect the nodes: by rounds of passes until all probes are met; of all
    pairs if more than ``most`` rounds are to be expected."""
    n = nodes.count()
    agree = 1 - math.acos(min(max(threshold, 0.0), 1 - 1e-9)) / math.pi
    bits = max(BITS, math.ceil(math.log(max(n / window, 1)) / -math.log(agree)))
    rng = np.random.default_rng(seed)
    probes = planted(nodes, n, size, threshold, rng)
    total = probes.count()
    with_probes = nodes.select("node", "v").union(probes)
    found, met, rounds = None, set(), 0
    while True:
        planes = rng.standard_normal((passes, bits, size))
        seen = sweep(with_probes, n, planes, window, threshold)
        pairs = seen.where("a >= 0")
        found = pairs if found is None else found.union(pairs)
        met |= {r["a"] for r in seen.where("a < 0").select("a").distinct().collect()}
        rounds += 1
        missed = total - len(met)
        if not missed:
            return found
        # If every round misses the same share, so many are needed in all.
        rest = rounds * math.log(total) / math.log(total / missed) if met else math.inf
        if max(rest, rounds + 1) > most:
            return all_pairs(nodes, n, threshold)


def planted(
    nodes: DataFrame, n: int, size: int, threshold: float, rng: np.random.Generator
) -> DataFrame:
    """(node, v): probes, each at the threshold from the node -1 - ``node``."""
    spark = nodes.sparkSession
    wanted = max(1, min(PROBES, n // 8, PROBE_NUMBERS // size)) if size > 1 else 0
    by_hash = nodes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(wanted)
    rows = by_hash.collect()
    out = []
    if rows:
        v = unit(np.array([r["v"] for r in rows]))
        u = rng.standard_normal(v.shape)
        u = unit(u - (u * v).sum(axis=1, keepdims=True) * v)
        beside = threshold * v + math.sqrt(max(0.0, 1 - threshold * threshold)) * u
        out = [(-1 - r["node"], w) for r, w in zip(rows, beside.tolist())]
    return materialise(spark.createDataFrame(out, "node long, v array<double>"), "vectors-probes")


def sweep(
    nodes: DataFrame, count: int, planes: np.ndarray, window: int, threshold: float
) -> DataFrame:
    """One round of passes: links (a, b) within the windows, met probes among them."""
    spark = nodes.sparkSession
    passes = len(planes)
    shared = spark.sparkContext.broadcast(planes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(b.column(0).to_numpy(), passes)),
                     pa.array(np.repeat(np.arange(passes, dtype=np.int32), b.num_rows)),
                     keys(unit(matrix(b.column(1))), shared.value),
                     pa.concat_arrays([b.column(1)] * passes)],
                    names=["node", "pass", "key", "v"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links as (a, b); the first and last rows of the range with their vectors."""
        part = TaskContext.get().partitionId()
        tail = None
        first = True
        for ids, turn, v in strips(batches):
            if first:
                yield edge_rows(part, ids[:window], turn[:window], v[:window])
                first = False
            if tail is not None:
                ids, turn, v = (np.concatenate(p) for p in zip(tail, (ids, turn, v)))
            found = []
            for p in np.unique(turn):
                own = turn == p
                found += neighbours(ids[own], unit(v[own]), window, threshold)
            yield links(found)
            tail = ids[-window:], turn[-window:], v[-window:]
        if tail is not None:
            yield edge_rows(part + 1, *tail)

    wide = nodes.mapInArrow(project, "node long, pass int, key binary, v array<double>")
    n = max(1, min(partitions(spark), count * passes // (4 * window)))
    order = ["pass", "key", "node"]
    dealt = wide.repartitionByRange(n, *order).sortWithinPartitions(*order).select("node", "pass", "v")
    schema = "a long, b long, edge int, pass int, place int, v array<double>"
    seen = materialise(dealt.mapInArrow(compare, schema), "vectors-links")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            ids, v = g.column(3).to_numpy(), unit(matrix(g.column(4)))
            yield links(neighbours(ids, v, 2 * window, threshold)).select(["a", "b"])

    edges = seen.where("edge is not null").select("edge", "pass", "place", F.col("a").alias("node"), "v")
    edges = edges.repartition("edge", "pass").sortWithinPartitions("edge", "pass", "place")
    over = edges.mapInArrow(across, "a long, b long")
    return materialise(seen.where("edge is null").select("a", "b").union(over), "vectors-round")


def all_pairs(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links of spanning forests over the cells of a grid in which all nodes meet all."""
    blocks = max(-(-n // WIDE), min(8, -(-n // 256)))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("own")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    cells = nodes.select("node", "v", own).select("node", "v", "own", other).select(
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "v"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            ids, v = g.column(2).to_numpy(), unit(matrix(g.column(3)))
            single, of, found = v.astype(np.float32), np.arange(len(ids)), []
            for s in range(0, len(ids), 256):
                near = single[s : s + 256] @ single[s:].T >= threshold - SLACK
                for x in range(s, s + len(near)):
                    y = s + np.flatnonzero(near[x - s])
                    y = y[(y > x) & (of[y] != of[x])]
                    y = y[close(v[y], v[x][None, :], threshold)] if len(y) else y
                    if len(y):
                        labels, first = np.unique(of[y], return_index=True)
                        found += [(int(ids[x]), int(ids[k])) for k in y[first]]
                        of[np.isin(of, labels)] = of[x]
            yield links(found).select(["a", "b"])

    dealt = cells.repartition("i", "j").sortWithinPartitions("i", "j")
    return dealt.mapInArrow(compare, "a long, b long")


def digest():
    """128 bits of a vector's components; -0.0 counts as 0.0."""
    parts = F.transform("v", lambda x: x + F.lit(0.0))
    return F.struct(F.xxhash64(parts), F.xxhash64(F.lit("second"), parts))


def results(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        F.col("id").alias(key), F.col("links").cast("long").alias("n_links"),
        F.col("top").alias("component_id"), F.col("id").eqNullSafe(F.col("top")).alias("kept"),
    )


def links(found: list) -> pa.RecordBatch:
    a, b = (np.array(c, np.int64) for c in (zip(*found) if found else ((), ())))
    none = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()),
         pa.nulls(none, pa.int32()), pa.nulls(none, pa.list_(pa.float64()))],
        names=["a", "b", "edge", "pass", "place", "v"],
    )


def edge_rows(edge: int, ids: np.ndarray, turn: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Rows beside the border ``edge``; those before it come first."""
    n = len(ids)
    after = edge == TaskContext.get().partitionId()
    ends = np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.nulls(n, pa.int64()), pa.array(np.full(n, edge, np.int32)),
         pa.array(turn), pa.array((np.arange(n) + (n if after else -n)).astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))],
        names=["a", "b", "edge", "pass", "place", "v"],
    )


def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for s in range(0, b.num_rows, STRIP):
            p = b.slice(s, STRIP)
            yield p.column(0).to_numpy(), p.column(1).to_numpy(), matrix(p.column(2))


def count_links(joined: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, others): rows other than the node's own that it is linked with."""
    sizes = joined.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = joined.join(sizes, "root").select(
        "node", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
    )
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = placed.select("node", "root", "own", pair).select(
        "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"
    )
    cells = cells.join(nodes.select("node", "weight", "v"), "node")
    cells = cells.select("root", "i", "j", "own", "node", "weight", "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            i, j = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            own, node, weight = (g.column(c).to_numpy() for c in (3, 4, 5))
            v = unit(matrix(g.column(6)))
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(a) or not len(b):
                continue
            near = v[a] @ v[b].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                out_nodes, out = node[a], near @ weight[b]
            else:
                out_nodes = np.concatenate([node[a], node[b]])
                out = np.concatenate([near @ weight[b], near.T @ weight[a]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_nodes), pa.array(out.astype(np.int64))], names=["node", "others"]
            )

    dealt = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    counts = dealt.mapInArrow(count, "node long, others long")
    return counts.groupBy("node").agg(F.sum("others").alias("others"))
