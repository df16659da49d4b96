import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratiform.operators import aggregates as A
from stratiform.operators import joins as J
from stratiform.operators import ordered
from stratiform.operators import windows as W
from stratiform.operators.ordered import carry


def _skewed(spark, n=600):
    """Rows of one hot key, some cold ones and some without a key or a time."""
    rng = random.Random(3)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 40))
        data.append((key, None if i % 97 == 0 else at, i, rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "k string, at timestamp, seq int, v int")


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_carry_equals_the_plain_window(spark, rows, backwards, inclusive):
    df = _skewed(spark)
    order = [F.col(c).desc() if backwards else F.col(c).asc() for c in ("at", "seq")]
    w = Window.partitionBy("k").orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = df.withColumn("x", F.last("v", ignorenulls=True).over(w))
    ranged = carry(
        df, ["k"], ["at", "seq"], F.col("v"), "x", inclusive=inclusive, backwards=backwards
    )
    assert rows(ranged) == rows(plain)


def test_carry_cuts_a_hot_key(spark, monkeypatch):
    """The key with a third of the rows lies in several ranges of the written table."""
    written = []

    def keep(df, purpose):
        written.append(df.cache())
        return written[-1]

    monkeypatch.setattr(ordered, "materialise", keep)
    carry(_skewed(spark), ["k"], ["at", "seq"], F.col("v"), "x").count()
    assert written[0].filter("k = 'hot'").select("_range").distinct().count() > 1


def test_lookup_refuses_a_key_that_occurs_twice(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ref = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "r int, v string")
    assert rows(J.lookup(df, ref, "k", "r", {"v": "v"})) == [(1, "a"), (2, None), (None, None)]
    with pytest.raises(Exception, match="duplicate merge key"):
        J.lookup(df, ref.union(ref), "k", "r", {"v": "v"}).collect()


def test_as_of_join_against_brute_force(spark, rows):
    rng = random.Random(5)
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    history = []
    for k in ("hot", "b", "c"):
        cuts = sorted(rng.sample(range(300), 12))
        history += [(k, day(a), day(b), f"{k}{a}") for a, b in zip(cuts, cuts[1:])]
    history.append((None, day(0), day(300), "nobody"))
    facts = [
        ("hot" if i % 3 == 0 else rng.choice(["b", "c", "d", None]), day(rng.randrange(320)), i)
        for i in range(400)
    ]
    want = []
    for k, d, i in facts:
        hit = [v for hk, s, e, v in history if k is not None and hk == k and s <= d < e]
        want.append((k, d, i, hit[0] if hit else None))
    got = J.as_of_join(
        spark.createDataFrame(facts, "k string, d date, i int"),
        spark.createDataFrame(history, "k string, s date, e date, v string"),
        "k", "d", "s", "e", ["v"],
    )
    assert rows(got) == sorted(want, key=repr)


def test_flatten_keeps_the_root_when_a_branch_is_not_current(spark, rows):
    root = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "product_id string")
    bond = spark.createDataFrame(
        [("P1", "USD", True), ("P2", "EUR", False)], "product_id string, ccy string, is_current boolean"
    )
    out = J.flatten(root, [J.Branch(bond, "product_id", "product_id", {"c": "ccy"}, current=True)])
    assert rows(out) == [("P1", "USD"), ("P2", None), ("P3", None)]


def test_orphans_skip_blank_keys(spark, rows):
    child = spark.createDataFrame([("1", "A"), ("2", "X"), ("3", None), ("4", ""), ("5", " ")], "id string, fk string")
    parent = spark.createDataFrame([("A",), (None,)], "pk string")
    assert rows(J.orphans(child, parent, "fk", "pk")) == [("2", "X")]


def test_latest_per_key_breaks_ties(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "z"), ("a", 2, "y"), (None, 1, "n")], "k string, d int, t string"
    )
    got = W.latest_per_key(df, ["k"], [F.desc("d")], [F.asc("t")])
    assert rows(got) == [("a", 2, "y"), (None, 1, "n")]
    with pytest.raises(ValueError):
        W.latest_per_key(df, ["k"], [F.desc("d")], [])


def test_duplicate_rows_group_null_keys(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "k string, v int")
    assert rows(W.duplicate_rows(df, ["k"])) == [("a", 1), ("a", 3), (None, 4), (None, 5)]


def test_top_values_ignores_null(spark, rows):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("z",), (None,), (None,), (None,)], "v string")
    assert [tuple(r) for r in W.top_values(df, "v", 2).collect()] == [("x", 2), ("y", 1)]


def test_grain_fails_on_duplicates_and_nulls(spark):
    ok = spark.createDataFrame([("a",), ("b",)], "k string")
    assert A.check_grain(ok, ["k"]).first().result == "PASS"
    assert A.check_grain(ok.union(ok), ["k"]).first().result == "FAIL"
    null = spark.createDataFrame([("a",), (None,)], "k string")
    assert A.check_grain(null, ["k"]).first().result == "FAIL"
    empty = A.check_grain(ok.limit(0), ["k"]).first()
    assert (empty.total_rows, empty.result) == (0, "PASS")


def test_checks_on_an_empty_mart(spark, rows):
    df = spark.createDataFrame([], "k string, type string")
    got = A.run_checks(df, "k", {"DOMAIN": ~F.col("type").isin("A")})
    assert rows(got) == [
        ("CHECK-DOMAIN", 0, "PASS"), ("CHECK-GRAIN", 0, "PASS"), ("CHECK-NONEMPTY", 0, "FAIL"),
    ]


def test_psi_survives_an_empty_bin(spark):
    a = spark.createDataFrame([(1.0,)] * 10, "x double")
    b = spark.createDataFrame([(5.0,)] * 10, "x double")
    assert all(r.psi is not None and r.psi > 0 for r in A.psi(a, b, "x", [3.0]).collect())
    assert [r.psi for r in A.psi(a, a, "x", [3.0]).collect()] == [0.0]


def test_run_costs(spark):
    df = spark.createDataFrame(
        [(1000, 200, 5, "pass"), (0, 0, 7, "fail")],
        "input_tokens bigint, output_tokens bigint, latency_ms bigint, status string",
    )
    got = A.run_kpis(df).first()
    assert (got.total_cost_usd, got.total_runs, got.n_pass, got.total_latency_ms) == (0.006, 2, 1, 12)


def test_hash_collision_rate(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "_row_hash string")
    got = A.hash_collision_rate(df).first()
    assert got.n_hashes == 2 and not got.passed
