"""Near-duplicate texts: SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORDS, bound_batches, components, groups

GOLD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(2**64 - 1)
#: Words whose signatures are computed together; bounds memory only.
CHUNK = 150_000
#: Members of a bucket that one task compares at once, on the leftover and on the other side.
BLOCK_LEFT, BLOCK_ALL = 512, 2048
#: Members of a family in one block, with their whole sets.
BLOCK_SETS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; ASCII letters lower-cased.

    A text of fewer words is one run; one without words has no runs.
    """
    words = (text or "").encode().lower().split()  # bytes split at the six ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in reversed(range(k)):
        h = mix(w[i : len(words) - k + 1 + i] + GOLD * h)
    return np.unique(h)


def super_minhash(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each.

    Element e draws, for j = 0, 1, ..., a uniform r and the j-th place p of a random
    permutation of the registers, and register p keeps the least j + r it is offered.  Being
    permutations, an element's ranks are correlated and vary less than independent hashes.
    All elements of all sets advance one j at a time; a set stops as soon as its largest
    register is below j + 1, for no later offer can be smaller.  Values are (j << 32) + r.
    """
    if registers > 255:
        raise ValueError("at most 255 registers")
    out = np.full((len(sets), registers), EMPTY, np.uint64)
    if not sets:
        return out
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets)
    places: np.ndarray | None = None  # the permutations so far, from the second step on
    first = None
    step = GOLD * np.arange(1, registers + 1, dtype=np.uint64)
    for j in range(registers):
        draw = mix(element + step[j])
        k = j + (((draw >> np.uint64(32)) * np.uint64(registers - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(32)) + (draw & np.uint64(0xFFFFFFFF))
        if j == 0:
            first, place = k, k
        else:
            if places is None:
                places = np.tile(np.arange(registers, dtype=np.uint8), (len(element), 1))
                here = np.arange(len(element))
                places[here, first] = 0
            place = places[here, k].astype(np.int64)
            places[here, k] = places[:, j]
        np.minimum.at(flat, owner * registers + place, value)
        open_sets = out.max(axis=1) >= (np.uint64(j + 1) << np.uint64(32))
        live = open_sets[owner]
        left = int(live.sum())
        if not left:
            break
        if left < 0.7 * len(live):
            owner, element = owner[live], element[live]
            if j == 0:
                first = first[live]
            else:
                places, here = places[live], np.arange(left)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signatures), bands))
    cut = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        h = mix(cut[:, :, i] + GOLD * h)
    return h.astype(np.int64)


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def describe(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: its set's size and digest, band keys and a short signature."""
    bound_batches(docs.sparkSession, 8)
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"row_key long, key {kind}, n long, digest binary, bands array<long>, signature binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            done = 0
            while done < len(texts):
                sets, words, start = [], 0, done
                while done < len(texts) and words < CHUNK:
                    sets.append(shingle_set(texts[done], size))
                    words += len(sets[-1])
                    done += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = super_minhash([sets[i] for i in full], bands * rows)
                keys = band_keys(sig, bands, rows)
                short = mix(sig).astype(np.uint8)
                lists: list = [[]] * len(sets)
                shorts, digests = [b""] * len(sets), [b""] * len(sets)
                for at, i in enumerate(full):
                    lists[i], shorts[i] = keys[at], short[at].tobytes()
                    digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                part = b.slice(start, done - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64())),
                     pa.array(shorts, pa.binary())],
                    names=["row_key", "key", "n", "digest", "bands", "signature"],
                )

    source = docs.select(row_key(key, text).alias("row_key"), F.col(key).alias("key"), F.col(text))
    return source.mapInArrow(run, schema)


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
) -> DataFrame:
    """Groups of texts whose sets of ``words``-word runs overlap by ``percent`` or more.

    One row per document: ``row_key`` (of key and text), ``key``, ``n_shingles``,
    ``component_id`` (least key reachable over links), ``kept`` (key = component_id) and
    ``first`` (the one row of the group to keep, also where its key repeats).

    * Rows with equal sets become one class first, by a map-side minimum per 128-bit digest.
    * Classes meet in buckets of equal bands.  A pair at the threshold t misses all of them
      with probability (1 - t^rows)^bands: 3e-6 at the defaults, 2e-6 for op2's parameters.
    * First each class is compared with one centre per bucket, the member that meets most
      others over all its buckets.  This is linear in the bucket.
    * What is not joined to the centre's component then faces *all* members of its bucket
      outside its own component.  Texts whose signatures agree make families, and in a family
      every two texts of different components are compared on their full sets.  So each pair
      in a bucket is either tested or already connected; no bucket is capped.  Both steps
      work on grids of blocks and return a spanning forest, never all pairs; their time is
      quadratic where very many texts are alike, but not alike enough.
    * Signatures agree if they do in five standard deviations below the threshold or more
      (one pair in three million at the threshold does not), and sizes must allow it.

    Defined results: NULL texts and texts without words have an empty set, link with nothing
    and are kept; rows that repeat are in one group; a NULL key counts as larger than any
    other, and is the component's id only if the group has no other; an empty table gives an
    empty result; columns of ``docs`` other than ``key`` and ``text`` are not read.
    """
    described = describe(docs, key, text, words, bands, rows)
    table = materialise(
        described.withColumn("row", F.monotonically_increasing_id()), "minhash-rows"
    )
    full = table.where("n > 0")
    classes = full.groupBy("digest").agg(F.min("row").alias("node"))
    ranked = materialise(
        full.select("row", "row_key", "key", "n", "digest").join(classes, "digest"), "minhash-classes"
    )
    heads = ranked.where("row = node").select("node")
    heavy = full.select(F.col("row").alias("node"), "row_key", "n", "digest", "bands", "signature")
    members = materialise(heavy.join(heads, "node"), "minhash-members")

    in_band = members.select("node", F.explode("bands").alias("bucket"))
    counted = in_band.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(in_band.join(counted, "bucket"), "minhash-buckets")
    score = shared.groupBy("node").agg(F.sum("size").alias("score"))
    best = F.max(F.struct("score", F.negate("node").alias("less"))).alias("best")
    centres = shared.join(score, "node").groupBy("bucket").agg(best)
    centres = materialise(
        centres.select("bucket", F.negate("best.less").alias("centre")), "minhash-centres"
    )
    stars = shared.join(centres, "bucket").where("node <> centre")
    ordered = [F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")]
    tested = materialise(alike(stars.select(*ordered).distinct(), members, percent), "minhash-pairs")
    links = materialise(
        overlapping(tested, members, docs, key, text, words, percent), "minhash-links"
    )
    joined = components(links, "minhash-union")
    families = materialise(leftovers(shared, centres, joined, members, percent), "minhash-rest")
    if not families.isEmpty():
        families = components(families, "minhash-families")
        more = within(families, joined, members, docs, key, text, words, percent)
        links = links.union(materialise(more, "minhash-links"))
        joined = components(links, "minhash-union")

    placed = ranked.join(joined, "node", "left").select(
        "row", "row_key", "key", "n", F.coalesce("root", "node").alias("root")
    )
    placed = materialise(placed, "minhash-placed")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    least = placed.groupBy("root").agg(F.min(order).alias("least"))
    grouped = placed.join(least, "root").select(
        "row_key", "key", F.col("n").alias("n_shingles"), F.col("least.key").alias("component_id"),
        F.col("key").eqNullSafe(F.col("least.key")).alias("kept"),
        (F.col("row") == F.col("least.row")).alias("first"),
    )
    alone = table.where("n = 0").select(
        "row_key", "key", F.col("n").alias("n_shingles"), F.col("key").alias("component_id"),
        F.lit(True).alias("kept"), F.lit(True).alias("first"),
    )
    return grouped.union(alone)


def can_reach(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can overlap by ``percent`` of their union."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def without_near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``docs`` with one document of each group of :func:`near_duplicates`, all columns.

    The row with the least key stays; of rows that repeat key and text, one.  Texts without
    words link with nothing, so every such row stays.
    """
    found = near_duplicates(docs, key=key, text=text, **options)
    keep = found.where("first and n_shingles > 0").select(F.col("row_key").alias("__row_key")).distinct()
    has_words = F.coalesce(F.col(text).rlike(WORDS), F.lit(False))
    named = docs.where(has_words).withColumn("__row_key", row_key(key, text))
    one = named.join(keep, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return one.select(*docs.columns).unionByName(docs.where(~has_words))


def agreement(percent: int, registers: int) -> float:
    """Share of equal registers below which a pair is not looked at again."""
    t = percent / 100
    return t - 5 * (t * (1 - t) / registers) ** 0.5


def alike(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    side = lambda c: members.select(
        F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(can_reach(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8) for i in (2, 3))
                same = (x == y).reshape(b.num_rows, -1)
                good = pa.array(same.mean(axis=1) >= agreement(percent, same.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(good)

    return both.mapInArrow(run, "a long, b long")


def full_sets(
    nodes: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str, words: int
) -> DataFrame:
    """(node, runs): the sets of the ``nodes``, from their texts, each read once."""
    wanted = nodes.join(members, "node").select("row_key", "node", "digest")
    texts = docs.select(row_key(key, text).alias("row_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sets = [], []
            asked = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            for node, digest, own in asked:
                s = shingle_set(own, words)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    found.append(node), sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["node", "runs"],
            )

    sets = texts.join(wanted, "row_key").select("node", "digest", "text")
    return materialise(sets.mapInArrow(run, "node long, runs array<long>"), "minhash-sets")


def overlapping(
    pairs: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str, words: int,
    percent: int,
) -> DataFrame:
    """The pairs whose full sets overlap by ``percent`` of their union."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = full_sets(wanted, members, docs, key, text, words)
    a = sets.select(F.col("node").alias("a"), F.col("runs").alias("runs_a"))
    b = sets.select(F.col("node").alias("b"), F.col("runs").alias("runs_b"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    union = F.size("runs_a") + F.size("runs_b") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b").distinct()


def grid(placed: DataFrame, lefts: Column, rights: Column, is_left: Column, *keep: str) -> DataFrame:
    """Rows of a group dealt out to the cells (i, j) of a grid of blocks.

    A row of the left side lies in every cell of one row of the grid, a row of the right side
    in every cell of one column.  Each cell is a group of its own.
    """
    slot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.where(is_left).select(
        *keep, slot(lefts).alias("i"), every(rights).alias("j"), F.lit(0).alias("side")
    )
    right = placed.select(
        *keep, every(lefts).alias("i"), slot(rights).alias("j"), F.lit(1).alias("side")
    )
    return left.union(right)


class Labels:
    """Which rows of a cell are joined already; joining yields the edges of a forest."""

    def __init__(self, node: np.ndarray, root: np.ndarray):
        self.node = node
        self.of = np.unique(root, return_inverse=True)[1]  # rows of one root start as one
        self.edges: list[tuple[int, int]] = []

    def join(self, x: int, ys: np.ndarray) -> None:
        labels, first = np.unique(self.of[ys], return_index=True)
        for y in ys[first].tolist():
            if self.of[y] != self.of[x]:
                a, b = int(self.node[x]), int(self.node[y])
                self.edges.append((min(a, b), max(a, b)))
        self.of[np.isin(self.of, labels)] = self.of[x]

    def batch(self) -> pa.RecordBatch:
        a, b = zip(*self.edges) if self.edges else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
        )


def blocks(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(size)).cast("int")


def cell(g: pa.RecordBatch):
    """Rows of a cell: side, node, root, set size and signature; the left rows; the right."""
    side, node, root, n = (g.column(c).to_numpy() for c in (3, 4, 5, 6))
    sig = np.frombuffer(b"".join(g.column(7).to_pylist()), np.uint8).reshape(len(side), -1)
    return node, root, n, sig, np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def candidates(x: int, ys: np.ndarray, labels: Labels, n, sig, percent: int) -> np.ndarray:
    ys = ys[labels.of[ys] != labels.of[x]]
    small, large = np.minimum(n[ys], n[x]), np.maximum(n[ys], n[x])
    ys = ys[small * 100 >= large * percent]
    if not len(ys):
        return ys
    return ys[(sig[ys] == sig[x]).mean(axis=1) >= agreement(percent, sig.shape[1])]


def leftovers(
    shared: DataFrame, centres: DataFrame, joined: DataFrame, members: DataFrame, percent: int
) -> DataFrame:
    """A forest (a, b) over texts of one bucket and two components whose signatures agree.

    In each bucket of three or more the members outside the centre's component face all
    members; in smaller ones every pair has been tested.  Agreeing signatures are no link yet,
    so each text stands for itself, not for its component: any two texts of different
    components that agree are connected by the forest.
    """
    roots = joined.select("node", "root")
    placed = shared.where("size > 2").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    top = centres.join(roots.withColumnRenamed("node", "centre"), "centre", "left").select(
        "bucket", F.coalesce("root", "centre").alias("main")
    )
    placed = placed.join(top, "bucket").withColumn("left", F.col("root") != F.col("main"))
    counts = placed.groupBy("bucket").agg(F.sum(F.col("left").cast("long")).alias("n_left"))
    placed = materialise(
        placed.join(counts.where("n_left > 0"), "bucket").select(
            "bucket", "node", "root", "left", "size", "n_left"
        ),
        "minhash-leftovers",
    )
    lefts, alls = blocks(F.col("n_left"), BLOCK_LEFT), blocks(F.col("size"), BLOCK_ALL)
    cells = grid(placed, lefts, alls, F.col("left"), "bucket", "node", "root")
    cells = cells.join(members.select("node", "n", "signature"), "node")
    cells = cells.select("bucket", "i", "j", "side", "node", "root", "n", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            node, root, n, sig, left, right = cell(g)
            labels = Labels(node, node)
            for x in left:
                ys = candidates(x, right[root[right] != root[x]], labels, n, sig, percent)
                if len(ys):
                    labels.join(x, ys)
            yield labels.batch()

    dealt = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def within(
    families: DataFrame, joined: DataFrame, members: DataFrame, docs: DataFrame, key: str,
    text: str, words: int, percent: int,
) -> DataFrame:
    """A forest of links between texts of one family and two components.

    The members outside the family's largest component face all members.
    """
    sets = full_sets(families.select("node"), members, docs, key, text, words)
    placed = families.withColumnRenamed("root", "family").join(joined, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("family", "root").agg(F.count("*").alias("part"))
    top = parts.groupBy("family").agg(
        F.sum("part").alias("size"), F.max(F.struct("part", "root")).alias("top")
    )
    top = top.select("family", "size", F.col("top.root").alias("main"), F.col("top.part").alias("part"))
    placed = placed.join(top.where("size > part"), "family")
    lefts = blocks(F.col("size") - F.col("part"), BLOCK_SETS)
    alls = blocks(F.col("size"), BLOCK_SETS)
    cells = grid(placed, lefts, alls, F.col("root") != F.col("main"), "family", "node", "root")
    cells = cells.join(members.select("node", "n", "signature"), "node").join(sets, "node")
    cells = cells.select("family", "i", "j", "side", "node", "root", "n", "signature", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            node, root, n, sig, left, right = cell(g)
            runs, ends = g.column(8).flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
            labels = Labels(node, root)
            for x in left:
                ys = candidates(x, right, labels, n, sig, percent)
                own = runs[ends[x] : ends[x + 1]]  # sorted as unsigned numbers
                linked = [y for y in ys if common(own, runs[ends[y] : ends[y + 1]], percent)]
                if linked:
                    labels.join(x, np.array(linked))
            yield labels.batch()

    dealt = cells.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def common(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted as unsigned numbers, overlap by ``percent`` of their union."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)
