"""A Merkle manifest of a table: stored digest-to-children records, proofs by descent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import running_sums

#: Levels of a tree that one stored record spans: it names at most 2 * 2**SPAN digests.
SPAN = 8
#: A level of records is broadcast up to this many bytes, counted from its number of records.
BROADCAST = 8 << 20
RECORD_BYTES = 2 * 2**SPAN * 48
#: The two trees: over the rows of each group, and over the groups.
ROWS, GROUPS = "rows", "groups"


def digest(content: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(content, 256))


def hexed(raw: Column) -> Column:
    """Digests, one after the other, as the lower-case text that is hashed."""
    return F.lower(F.hex(raw))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: per value ``-`` if NULL, else its UTF-8 length, ``:`` and itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        told = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(told, F.lit("-")))
    return digest(F.concat(*parts))


def _right(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: 0 for one leaf, else the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _above(nodes: Column) -> Column:
    """The level above ``nodes``: a digest per two, the last one perhaps of one alone."""

    def parent(i: Column) -> Column:
        last = F.coalesce(F.get(nodes, i + 1), F.lit(b""))
        return digest(hexed(F.concat(F.get(nodes, i), last)))

    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2)), parent)


@dataclass
class Manifest:
    """A stored manifest.

    ``leaves``: ``kept`` (the kept columns as a struct), ``g`` (key of the group), ``n`` (rows
    of the group), ``rank`` and ``leaf``.  ``groups``: ``g``, ``n``, ``place``, ``subroot``.
    ``records[tree][level]``: ``digest`` and ``levels``, the rows of nodes below it from the
    farthest to its own two children.  ``sizes`` tells the number of records of each.
    """

    leaves: DataFrame
    groups: DataFrame
    records: dict[str, list[DataFrame]]
    sizes: dict[str, list[int]]
    root: bytes | None
    places: int


def build(
    docs: DataFrame,
    values: Sequence[str],
    *,
    group: str = "lang",
    key: str = "doc_id",
    keep: Sequence[str] | None = None,
    path: str | None = None,
) -> Manifest:
    """Store the manifest of ``docs`` under ``path`` (a fresh scratch folder by default).

    A row is a leaf, the digest of its ``values``.  Leaves of a ``group`` are ordered by
    ``key`` and hashed two by two up to one subroot; the subroots, ordered by group, likewise
    to the root.  ``keep`` names the columns that stay with the leaves.

    The texts are read once and never shuffled: the leaf digest is a SQL expression of the
    scan.  Leaves are ranked along one range sort; a record is built from the at most 256
    nodes below it, so no group is gathered, however large.  Each pass over the nodes leaves
    a 256th of them.

    Defined results: NULL values are told apart from all texts; a NULL group comes first and
    a NULL key sorts first in its group; rows of equal keys are ordered by digest, and equal
    rows are leaves of their own (equal records are stored once when they are read); a group of one
    row has its leaf as subroot; an empty table has no root.  Other columns may have any name.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "manifest")
    keep = list(docs.columns if keep is None else keep)
    own = docs.select(
        F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).alias("key"),
        leaf_digest(*(F.col(v) for v in values)).alias("leaf"),
    )
    ranked = running_sums(own, [F.col("g"), F.col("key"), F.col("leaf")], {"row": "*"}, "manifest-rank")
    counted = ranked.groupBy("g").agg(F.count("*").alias("n"), F.min("row").alias("start"))
    placed = materialise(
        running_sums(counted, [F.col("g")], {"place": "*"}, "manifest-place"), "manifest-groups"
    )
    leaves = ranked.join(placed.select("g", "n", "start"), "g")
    leaves = leaves.select("kept", "g", "n", (F.col("row") - F.col("start")).alias("rank"), "leaf")
    leaves.write.parquet(f"{path}/leaves")
    leaves = spark.read.schema(leaves.schema).parquet(f"{path}/leaves")
    nodes = leaves.select("g", "n", "rank", F.col("leaf").alias("digest"))
    most = placed.agg(F.max("n")).first()[0] or 0
    subroots = _grow(nodes, most, f"{path}/{ROWS}").select("g", F.col("digest").alias("subroot"))
    groups = placed.select("g", "n", "place").join(subroots, "g")
    groups.write.parquet(f"{path}/groups")
    groups = spark.read.schema(groups.schema).parquet(f"{path}/groups")
    places = groups.count()
    tops = groups.select(
        F.lit("").alias("g"), F.lit(places).cast("long").alias("n"),
        F.col("place").alias("rank"), F.col("subroot").alias("digest"),
    )
    _grow(tops, places, f"{path}/{GROUPS}").write.parquet(f"{path}/root")
    return load(spark, path)


def _grow(nodes: DataFrame, most: int, path: str) -> DataFrame:
    """Store the records above ``nodes`` (g, n, rank, digest); return the top of each group."""
    spark = nodes.sparkSession
    tops, level = nodes.where("n = 1").select("g", "digest"), 0
    while most > 2 ** (SPAN * level):
        inside = nodes.where(F.col("n") > 2 ** (SPAN * level))
        gathered = inside.groupBy("g", "n", F.shiftright("rank", SPAN).alias("rank")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("row")
        )
        rise = F.least(F.lit(SPAN), _height(F.col("n")) - SPAN * level)
        rows = F.aggregate(
            F.sequence(F.lit(2), rise + 1),
            F.array(F.col("row.digest")),
            lambda done, _: F.concat(done, F.array(_above(F.element_at(done, -1)))),
        )
        stored = gathered.select(
            "g", "n", "rank",
            F.slice(rows, 1, F.size(rows) - 1).alias("levels"),
            F.element_at(F.element_at(rows, -1), 1).alias("digest"),
        )
        stored.write.parquet(f"{path}/{level}")
        stored = spark.read.schema(stored.schema).parquet(f"{path}/{level}")
        nodes = stored.select("g", "n", "rank", "digest")
        level += 1
        ended = (F.col("n") <= 2 ** (SPAN * level)) & (F.col("n") > 2 ** (SPAN * (level - 1)))
        tops = tops.union(nodes.where(ended).select("g", "digest"))
    return tops


def load(spark: SparkSession, path: str) -> Manifest:
    """The manifest that :func:`build` stored under ``path``."""
    groups = spark.read.parquet(f"{path}/groups")
    largest, places = groups.agg(F.max("n"), F.count("*")).first()
    records, sizes = {}, {}
    for tree, most in ((ROWS, largest or 0), (GROUPS, places)):
        records[tree], sizes[tree] = [], []
        while most > 2 ** (SPAN * len(sizes[tree])):
            stored = spark.read.parquet(f"{path}/{tree}/{len(sizes[tree])}")
            records[tree].append(stored.select("digest", "levels"))
            sizes[tree].append(stored.count())
    root = spark.read.parquet(f"{path}/root").first()
    return Manifest(
        spark.read.parquet(f"{path}/leaves"), groups, records, sizes,
        bytes(root["digest"]) if root else None, places,
    )


def _descend(asked: DataFrame, manifest: Manifest, tree: str) -> DataFrame:
    """Follow the digits of ``rank`` down from ``node``; ``path`` gains the children passed by.

    One join per stored level.  A level of few records is broadcast, by their counted bytes;
    in a larger one a request meets its record by a shuffle, and requests that share a digest
    are split by the skew join.
    """
    own = [c for c in asked.columns if c not in ("node", "path")]
    for level in reversed(range(len(manifest.records[tree]))):
        records = manifest.records[tree][level].dropDuplicates(["digest"])
        if manifest.sizes[tree][level] * RECORD_BYTES <= BROADCAST:
            records = F.broadcast(records)
        found = asked.join(records, F.col("node") == F.col("digest"), "left")
        levels = F.col("levels")

        def digit(j: Column) -> Column:
            """Place of the chosen node in row ``j`` of the record."""
            at = _right(F.col("rank"), j + SPAN * level)  # noqa: B023
            return F.pmod(at, F.call_function("shiftleft", F.lit(1), F.lit(SPAN) - j)).cast("int")

        downwards = F.sequence(F.size(levels) - 1, F.lit(0), F.lit(-1))
        beside = F.transform(
            downwards,
            lambda j: F.get(F.get(levels, j), digit(j).bitwiseXOR(F.lit(1))),  # noqa: B023
        )
        asked = found.select(
            *own,
            F.coalesce(F.get(F.get(levels, F.lit(0)), digit(F.lit(0))), F.col("node")).alias("node"),
            F.when(levels.isNull(), F.col("path"))
            .otherwise(F.concat("path", F.filter(beside, lambda s: s.isNotNull())))
            .alias("path"),
        )
    return asked


def prove(manifest: Manifest, requests: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """A proof for every leaf, or for those whose kept columns ``on`` occur in ``requests``.

    Requests descend from the root by the digits of their group's place and of their rank in
    it.  Adds to the kept columns ``leaf`` (the digest at which the descent ends), ``subroot``,
    ``root`` and ``path`` (siblings from the leaf up to the root), all binary, and ``rank``,
    ``rows``, ``place`` and ``places``, which tell on which side each sibling stands.  Kept
    columns of these names are replaced.  NULL keys of ``requests`` ask for nothing.
    """
    leaves = manifest.leaves
    if requests is not None:
        wanted = requests.select(*(F.col(c).alias(f"on_{i}") for i, c in enumerate(on)))
        match = [F.col(f"kept.`{c}`") == F.col(f"on_{i}") for i, c in enumerate(on)]
        leaves = leaves.join(wanted, match, "semi")
    root = F.lit(manifest.root).cast("binary")
    none = F.array().cast("array<binary>")
    tops = manifest.groups.select(
        "g", "subroot", F.col("place").alias("rank"), root.alias("node"), none.alias("path")
    )
    tops = materialise(_descend(tops, manifest, GROUPS), "manifest-tops").select(
        "g", F.col("rank").alias("place"), "subroot", "node", "path"
    )
    asked = leaves.drop("leaf").join(tops, "g")
    down = _descend(asked, manifest, ROWS)
    added = {
        "leaf": F.col("node"), "subroot": F.col("subroot"), "root": root,
        "path": F.reverse("path"), "rank": F.col("rank"), "rows": F.col("n"),
        "place": F.col("place"), "places": F.lit(manifest.places).cast("long"),
    }
    kind = manifest.leaves.schema["kept"].dataType
    kept = [c for c in getattr(kind, "names", []) if c not in added]
    return down.select(
        *(F.col(f"kept.`{c}`").alias(c) for c in kept), *(v.alias(k) for k, v in added.items())
    )


def fold(leaf: Column) -> Column:
    """The root that ``leaf`` and the columns of :func:`prove` give."""

    def climb(start: Column, rank: Column, n: Column) -> Column:
        steps = F.slice(F.sequence(F.lit(0), _height(n)), F.lit(1), _height(n))

        def step(at: Column, j: Column) -> Column:
            place = _right(rank, j)
            paired = place.bitwiseXOR(F.lit(1).cast("long")) <= _right(n - 1, j)
            node, used = at["node"], at["used"]
            beside = F.get(F.col("path"), used)
            both = F.when(F.pmod(place, F.lit(2)) == 1, F.concat(beside, node)).otherwise(
                F.concat(node, beside)
            )
            up = digest(hexed(F.when(paired, both).otherwise(node)))
            return F.struct(up.alias("node"), (used + paired.cast("int")).alias("used"))

        return F.aggregate(steps, start, step)

    at = F.struct(leaf.alias("node"), F.lit(0).alias("used"))
    at = climb(at, F.col("rank"), F.col("rows"))
    return climb(at, F.col("place"), F.col("places"))["node"]


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of the hex digests of a path, run together."""
    return F.sha2(F.array_join(F.transform(path, hexed), ""), 256)
