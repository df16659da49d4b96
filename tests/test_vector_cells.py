"""Cells of vectors against the exact scan, and the share of cells that is visited."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import retrieval as r
from stratiform.operators import vector_cells as vc

NAMES = {"item_id": "i", "vector": "v"}


def frame(spark, rows, key="i"):
    return spark.createDataFrame(rows, f"{key} long, v array<double>")


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(1)
    centre = 4 * rng.standard_normal((30, 16))
    v = centre[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16))
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    rows += [(5000 + i, x) for i, x in enumerate(v[:20].tolist())] + [(9000, None), (9001, [0.0] * 16), (9002, [0.0] * 16)]
    return frame(spark, rows).withColumn("kind", F.col("i") % 3)


@pytest.fixture(scope="module")
def queries(spark, items):
    some = [(r["i"], r["v"]) for r in items.where("i % 97 = 0").collect()]
    far = np.random.default_rng(2).standard_normal((5, 16)).tolist()
    rows = some + [(100_000 + i, x) for i, x in enumerate(far)] + [(200_000, [0.0] * 16), (200_001, None)]
    return frame(spark, rows, "q")


@pytest.fixture(scope="module")
def path(items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "c")
    vc.create_cells(items, path, **NAMES)
    return path


@pytest.mark.parametrize("k", [1, 7, 4000])
def test_equals_the_exact_scan(spark, rows, items, queries, path, k):
    got = vc.search_cells(spark, path, queries, k, query_id="q", **NAMES).ranked
    want = r.vector_topk(queries, items, k, query_id="q", **NAMES)
    assert rows(got, "q", "rank", "i", "score") == rows(want, "q", "rank", "i", "score")


def test_filtered_items(spark, rows, items, queries, path):
    got = vc.search_cells(spark, path, queries, 5, query_id="q", where=F.col("_rest.kind") == 1, **NAMES).ranked
    want = r.vector_topk(queries, items, 5, query_id="q", where=F.col("kind") == 1, **NAMES)
    assert rows(got, "q", "rank", "i", "score") == rows(want, "q", "rank", "i", "score")


def test_most_cells_are_not_visited(spark, queries, path):
    seen = vc.search_cells(spark, path, queries.where("q < 5000"), 5, query_id="q", **NAMES).cells
    told = seen.agg(F.sum("visited"), F.sum("cells")).first()
    assert told[0] < told[1] / 3


def test_every_item_lies_in_its_radius(spark, items, path):
    cells = {x["cell"]: x for x in spark.read.parquet(f"{path}/cells").collect()}
    laid = spark.read.parquet(f"{path}/items").collect()
    assert len(laid) == items.where("v is not null").count() == sum(c["n"] for c in cells.values())
    for x in laid:
        v = np.array(x["_v"])
        if x["cell"] >= 0:
            v /= np.linalg.norm(v)
            assert np.linalg.norm(v - cells[x["cell"]]["centre"]) <= cells[x["cell"]]["radius"]
        else:
            assert not v.any()


def test_large_cells_are_cut_into_blocks(spark, rows, monkeypatch, items, queries, tmp_path):
    monkeypatch.setattr(vc, "BLOCK", 100)
    monkeypatch.setattr(vc, "QUERIES", 8)
    path = str(tmp_path / "c")
    vc.create_cells(items, path, cells=3, **NAMES)
    assert spark.read.parquet(f"{path}/items").agg(F.max("block")).first()[0] > 3
    got = vc.search_cells(spark, path, queries, 6, query_id="q", **NAMES).ranked
    want = r.vector_topk(queries, items, 6, query_id="q", **NAMES)
    assert rows(got, "q", "rank", "i", "score") == rows(want, "q", "rank", "i", "score")


def test_nothing_to_find(spark, tmp_path, items, queries):
    for name, some in (("none", items.limit(0)), ("zero", items.where("i > 9000"))):
        vc.create_cells(some, str(tmp_path / name), **NAMES)
        got = vc.search_cells(spark, str(tmp_path / name), queries, 3, query_id="q", **NAMES).ranked
        assert got.count() == (0 if name == "none" else 2 * queries.where("v is not null").count())
    path = str(tmp_path / "some")
    vc.create_cells(items, path, **NAMES)
    assert vc.search_cells(spark, path, queries.limit(0), 3, query_id="q", **NAMES).ranked.count() == 0
