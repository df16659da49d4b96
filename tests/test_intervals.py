"""Interval joins against the plain comparison of all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratiform.operators import intervals as iv


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("first,last", [(0, 0), (0, 7), (1, 8), (5, 700), (-20, 20), (-513, 511), (63, 4096), (100, iv.LAST_DAY)])
def test_bins_cover_each_day_once(spark, first, last):
    one = spark.range(1).select(F.explode(iv.cover(F.lit(first), F.lit(last))).alias("b")).select("b.*").collect()
    spans = sorted((r["bin"] << (iv.BITS * r["level"]), (r["bin"] + 1) << (iv.BITS * r["level"])) for r in one)
    assert spans[0][0] == first and spans[-1][1] == last + 1
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(spans) <= 2 * 7 * iv.LEVELS


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    hot = lambda: rng.choice(["hot", "hot", "a", "b", None])
    points = [(i, hot(), day(rng.randrange(900)) if i % 50 else None) for i in range(1500)]
    spans = []
    for i in range(400):
        s = rng.randrange(-100, 900)
        e = rng.choice([None, day(s), day(s + rng.choice([1, 3, 40, 900])), day(s - 2)])
        spans.append((i, hot(), day(s) if i % 40 else None, e))
    return points + points[:3], spans + spans[:3]


def plain(points, spans):
    return sorted(
        (p[0], s[0])
        for p in points
        for s in spans
        if p[1] and p[1] == s[1] and p[2] and s[2] and s[2] <= p[2] and (s[3] is None or (p[2] < s[3] and s[2] < s[3]))
    )


def test_dates(spark, data):
    points = spark.createDataFrame(data[0], "i long, k string, at date").repartition(4)
    spans = spark.createDataFrame(data[1], "i long, k string, since date, till date").repartition(3)
    met = iv.interval_join(points, spans, "k", "at", "since", "till")
    want = plain(*data)
    assert sorted((r["point"]["i"], r["interval"]["i"]) for r in met.collect()) == want and len(want) > 5000
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "bin" in plan and "Cross" not in plan
    assert iv.interval_join(points, spans.limit(0), "k", "at", "since", "till").count() == 0
    assert iv.interval_join(points.limit(0), spans, "k", "at", "since", "till").count() == 0


def test_times_within_a_day(spark):
    t = lambda h, m=0: dt.datetime(2024, 3, 1, h, m)
    points = spark.createDataFrame([(1, "a", t(9)), (2, "a", t(10)), (3, "a", t(12)), (4, "a", t(23, 59))], "i int, k string, at timestamp_ntz")
    rows = [(1, "a", t(9), t(10)), (2, "a", t(8), t(12)), (3, "a", t(12), None), (4, "a", t(9, 30), dt.datetime(2024, 3, 2))]
    spans = spark.createDataFrame(rows, "i int, k string, since timestamp_ntz, till timestamp_ntz")
    met = iv.interval_join(points, spans, "k", "at", "since", "till").collect()
    assert sorted((r["point"]["i"], r["interval"]["i"]) for r in met) == [
        (1, 1), (1, 2), (2, 2), (2, 4), (3, 3), (3, 4), (4, 3), (4, 4)
    ]


def test_a_hot_key_is_spread(spark):
    points = spark.range(4000).select("id", F.lit("hot").alias("k"), F.date_add(F.lit("2020-01-01"), (F.col("id") % 2000).cast("int")).alias("at"))
    spans = points.select("k", F.col("at").alias("since"), F.date_add("at", 5).alias("till"), "id").where("id < 500")
    bins = spans.select(F.explode(iv.cover(F.unix_date("since"), F.unix_date("till"))).alias("b")).select("b.*")
    assert bins.distinct().count() > 100
    assert iv.interval_join(points, spans, "k", "at", "since", "till").count() == spans.join(
        points.withColumnRenamed("at", "x").select("x"), (F.col("since") <= F.col("x")) & (F.col("x") < F.col("till"))
    ).count()


@pytest.mark.parametrize("base", [1, 2, 5, 7])
@pytest.mark.parametrize("first,last", [(0, 0), (5, 700), (-20, 20), (-513, 511), (100, iv.LAST_DAY)])
def test_coarse_bins_reach_just_beyond_the_days(spark, first, last, base):
    one = spark.range(1).select(F.explode(iv.cover(F.lit(first), F.lit(last), base)).alias("b")).select("b.*").collect()
    spans = sorted((r["bin"] << (iv.BITS * r["level"]), (r["bin"] + 1) << (iv.BITS * r["level"])) for r in one)
    width = 1 << (iv.BITS * base)
    assert 0 <= first - spans[0][0] < width and 0 < spans[-1][1] - last <= width
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and min(r["level"] for r in one) >= base


@pytest.mark.parametrize("mixed", [False, True])
def test_bins_follow_the_usual_length(spark, mixed):
    """Intervals of some weeks aren't shuffled for each of their days, nor points per level."""
    rng = random.Random(9)
    points = [(i, rng.choice("ab"), day(rng.randrange(2000))) for i in range(800)]
    spans = [(i, rng.choice("ab"), day(s := rng.randrange(2000)), day(s + rng.randrange(1, 51))) for i in range(800)]
    spans += [(-1, "a", day(-4000), None), (-2, "b", day(3), day(1900))] * mixed
    p = spark.createDataFrame(points, "i long, k string, at date")
    s = spark.createDataFrame(spans, "i long, k string, since date, till date")
    met = iv.interval_join(p, s, "k", "at", "since", "till")
    got = met.collect()
    assert sorted((r["point"]["i"], r["interval"]["i"]) for r in got) == plain(points, spans)

    def sides(node):
        name = node.getClass().getSimpleName()
        below = [node.children().apply(i) for i in range(node.children().size())]
        return below if name == "Join" else [x for b in below for x in sides(b)]

    left, right = sides(met._jdf.queryExecution().optimizedPlan())
    count = lambda x: spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, x).count()
    assert count(left) <= (5 if mixed else 1) * len(points)
    assert count(right) < 1.6 * len(spans) + 40 * mixed
