"""Merkle manifests against a plain tree, with NULLs, ties, repeated rows and clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratiform.llm import manifest as m
from stratiform.session import scratch_path

VALUES = ["doc_id", "source", "lang", "n_chars", "text"]
SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root and one proof per leaf, as lists of (sibling, stands left)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            if p ^ 1 < len(nodes):
                proofs[i].append(nodes[p ^ 1])
            at[i] = p // 2
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, own = [], []
    for g in order:
        rs = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, proofs = tree([leaf(r) for r in rs])
        tops.append(top)
        own.append(list(zip(rs, proofs)))
    root, over = tree(tops)
    return sorted(
        ((r[0], leaf(r), top, root, sha(*p, *above)) for rs, top, above in zip(own, tops, over) for r, p in rs),
        key=repr,
    )


def told(proofs):
    out = proofs.select(
        "doc_id", *(m.hexed(F.col(c)) for c in ("leaf", "subroot", "root")), m.proof_digest(F.col("path"))
    )
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    made = [(i, f"s{i % 3}", "en", i, "x" * (i % 50)) for i in range(1, 700)]  # three levels of 256
    made += [(i, None, "de", None, "ü") for i in range(256)] + [(i, "a", "fr", 1, "") for i in range(257)]
    made += [(5, "b", "lone", 1, "a"), (7, "b", None, 3, None), (None, "b", None, 3, None), (7, "b", None, 4, None)]
    made += [(9, "r", "same", 1, "twin")] * 600 + [(9, "r", "", 1, "twin"), (1, "é", "é", 2, "z"), (1, "é", "z", 2, "z")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {c: F.lit(i) for i, c in enumerate(("g", "key", "n", "row", "rank", "digest", "levels", "node", "kept", "__range"))}
    return spark.createDataFrame(rows, SHAPE).repartition(5).withColumns(clash)


def test_equals_a_plain_tree(docs, rows):
    built = m.build(docs, VALUES)
    proofs = m.prove(built)
    assert told(proofs) == plain(rows)
    folded = proofs.select(m.fold(F.col("leaf")).alias("f"), "root")
    assert folded.where("f <> root").count() == 0
    forged = proofs.select(m.fold(F.unhex(F.sha2(F.lit("x"), 256))).alias("f"), "root")
    assert forged.where("f = root").count() == 0


def test_kept_columns_survive(docs):
    proofs = m.prove(m.build(docs, VALUES))
    assert set(docs.columns) <= set(proofs.columns)
    same = ["doc_id", "text", "g", "key", "n", "row", "digest", "levels", "node", "kept", "__range"]
    assert proofs.select(same).exceptAll(docs.select(same)).count() == 0


def test_some_requests(spark, docs, rows):
    path = scratch_path(spark, "test-manifest")
    m.build(docs, VALUES, path=path)
    wanted = spark.createDataFrame([(3, "en"), (3, "de"), (999, "en"), (None, None)], "i long, l string")
    got = told(m.prove(m.load(spark, path), wanted.toDF("doc_id", "lang"), ["doc_id", "lang"]))
    want = {leaf(r) for r in rows if r[0] == 3 and r[2] in ("en", "de")}
    assert [g for g in plain(rows) if g[1] in want] == got and len(got) == 2


def test_small_and_empty(spark):
    one = [(1, "a", "en", 3, "abc")]
    assert told(m.prove(m.build(spark.createDataFrame(one, SHAPE), VALUES))) == plain(one)
    assert plain(one)[0][4] == sha() and plain(one)[0][1] == plain(one)[0][3]
    empty = m.build(spark.createDataFrame([], SHAPE), VALUES)
    assert empty.root is None and m.prove(empty).count() == 0
