from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stratiform.functions.hashing import row_hash
from stratiform.operators import capture as cc
from stratiform.operators import history as h
from stratiform.operators import merge as mg
from stratiform.operators.projections import stamp_current

DAY1, DAY2, DAY3 = "2024-01-01", "2024-02-01", "2024-03-01"


def table(spark, data):
    df = spark.createDataFrame(data, "id string, v string")
    return df.withColumn("_row_hash", row_hash(df.columns))


def test_upsert_inserts_updates_and_keeps(spark, rows):
    old = table(spark, [("a", "1"), ("b", "2"), ("c", None)])
    new = table(spark, [("b", "9"), ("c", None), ("d", "4")])
    got = mg.upsert(old, new, ["id"])
    assert rows(got, "id", "v") == [("a", "1"), ("b", "9"), ("c", None), ("d", "4")]
    assert rows(mg.upsert(got, new, ["id"])) == rows(got)
    assert rows(mg.upsert(got, got, ["id"])) == rows(got)


def test_upsert_null_keys_match_nothing(spark, rows):
    old = table(spark, [(None, "1")])
    assert rows(mg.upsert(old, table(spark, [(None, "2")]), ["id"]), "v") == [("1",), ("2",)]


def test_upsert_refuses_duplicate_keys(spark):
    old = table(spark, [("a", "1")])
    with pytest.raises(Exception, match="duplicate merge key: a"):
        mg.upsert(old, table(spark, [("a", "2"), ("a", "3")]), ["id"]).collect()


def test_upsert_ignores_older_rows(spark, rows):
    old = table(spark, [("a", "5")])
    late, new = table(spark, [("a", "4")]), table(spark, [("a", "6")])
    assert rows(mg.upsert(old, late, ["id"], newest_by=["v"]), "v") == [("5",)]
    assert rows(mg.upsert(old, new, ["id"], newest_by=["v"]), "v") == [("6",)]


def test_upsert_takes_the_targets_layout(spark):
    old = table(spark, [("a", "1")])
    got = mg.upsert(old, table(spark, [("b", "2")]).select("_row_hash", "v", "id"), ["id"])
    assert got.columns == old.columns
    with pytest.raises(ValueError, match="lack columns"):
        mg.upsert(old, table(spark, [("b", "2")]).drop("v"), ["id"])


def test_composite_keys(spark, rows):
    make = lambda data: spark.createDataFrame(data, "a string, b int, _row_hash string")
    got = mg.upsert(make([("x", 1, "h"), ("x", 2, "h")]), make([("x", 2, "n")]), ["a", "b"])
    assert rows(got) == [("x", 1, "h"), ("x", 2, "n")]


def test_diff(spark, rows):
    old, new = table(spark, [("a", "1"), ("b", "2")]), table(spark, [("b", "3"), ("c", "4")])
    assert rows(mg.diff(old, new, ["id"])) == [("a", "ABSENT"), ("b", "CHANGED"), ("c", "NEW")]
    assert rows(mg.diff(old, old, ["id"])) == [("a", "UNCHANGED"), ("b", "UNCHANGED")]


def versions(df):
    return sorted(
        (r.id, r.v, str(r.effective_start_date), str(r.effective_end_date), r.is_current)
        for r in df.collect()
    )


def test_scd2_closes_and_opens_in_one_run(spark):
    history = stamp_current(table(spark, [("a", "1"), ("b", "2"), ("c", "3")]), DAY1, "v1")
    got = h.scd2_merge(history, table(spark, [("a", "9"), ("b", "2"), ("d", "4")]), ["id"], DAY2, "v2")
    assert versions(got) == [
        ("a", "1", DAY1, DAY2, False), ("a", "9", DAY2, "9999-12-31", True),
        ("b", "2", DAY1, "9999-12-31", True), ("c", "3", DAY1, "9999-12-31", True),
        ("d", "4", DAY2, "9999-12-31", True),
    ]
    assert all(r.violations == 0 for r in h.check_scd2(got, ["id"]).collect())


def test_scd2_same_day_rerun_and_change(spark):
    history = stamp_current(table(spark, [("a", "1")]), DAY1, "v1")
    once = h.scd2_merge(history, table(spark, [("a", "2")]), ["id"], DAY2, "v1")
    assert versions(h.scd2_merge(once, table(spark, [("a", "2")]), ["id"], DAY2, "v1")) == versions(once)
    again = h.scd2_merge(once, table(spark, [("a", "3")]), ["id"], DAY2, "v1")
    assert versions(again) == [("a", "1", DAY1, DAY2, False), ("a", "3", DAY2, "9999-12-31", True)]
    third = h.scd2_merge(again, table(spark, [("a", "4")]), ["id"], DAY3, "v1")
    assert len(versions(third)) == 3


def test_scd2_read_as_of(spark, rows):
    history = stamp_current(table(spark, [("a", "1")]), DAY1, "v1")
    both = h.scd2_merge(history, table(spark, [("a", "2")]), ["id"], DAY2, "v1")
    assert rows(h.as_of(both, "2024-01-31"), "v") == [("1",)]
    assert rows(h.as_of(both, DAY2), "v") == [("2",)]
    assert rows(h.as_of(both, "2023-12-31"), "v") == []


def test_scd2_integrity_finds_faults(spark):
    bad = stamp_current(table(spark, [("a", "1"), ("a", "2")]), DAY1, "v1")
    bad = bad.withColumn("effective_end_date", F.lit(DAY1).cast("date"))
    got = {r.check_id: r.violations for r in h.check_scd2(bad, ["id"]).collect()}
    assert got == {"multiple_current": 1, "open_end_missing": 2, "empty_interval": 2}


def test_history_from_events_merges_equal_neighbours(spark, rows):
    at = lambda d: datetime(2024, 1, d)
    events = spark.createDataFrame(
        [("k", at(1), 1, "x"), ("k", at(2), 2, "x"), ("k", at(9), 3, None), ("k", at(20), 4, None), ("k", at(30), 5, "x")],
        "k string, ts timestamp, n int, a string",
    )
    got = h.history_from_events(events, ["k"], "ts", ["n"], ["a"])
    assert rows(got, "a", "start", "end", "is_current") == sorted(
        [("x", at(1), at(9), False), (None, at(9), at(30), False), ("x", at(30), None, True)], key=repr
    )


def test_intervals_report_gaps_and_overlaps(spark, rows):
    d = lambda n: date(2024, 1, n)
    df = spark.createDataFrame(
        [("a", d(1), d(5)), ("a", d(5), d(9)), ("a", d(8), d(12)), ("a", d(20), d(25))], "k string, s date, e date"
    )
    got = h.check_intervals(df, ["k"], "s", "e")
    assert set(rows(got, "s", "problem")) == {(d(8), "OVERLAP"), (d(20), "GAP")}


def feed(spark, data):
    return spark.createDataFrame(data, "id string, v string, status string, _seq bigint, _op int")


def test_changes_last_operation_wins(spark, rows):
    target = spark.createDataFrame([("a", "0", "ACTIVE"), ("b", "0", "ACTIVE"), ("e", "0", "ACTIVE")], "id string, v string, status string")
    changes = feed(
        spark,
        [
            ("a", "1", "ACTIVE", 1, 4), ("a", "2", "ACTIVE", 3, 4), ("a", "x", "ACTIVE", 2, 3),
            ("b", None, None, 4, 1),
            ("c", "7", "ACTIVE", 5, 2), ("c", None, None, 6, 1),
            ("d", None, None, 7, 1),
            ("f", None, None, 8, 1), ("f", "9", "ACTIVE", 9, 2),
        ],
    )
    assert rows(cc.apply_changes(target, changes, ["id"])) == [
        ("a", "2", "ACTIVE"), ("b", "0", "DELETED"), ("c", "7", "DELETED"),
        ("e", "0", "ACTIVE"), ("f", "9", "ACTIVE"),
    ]


def test_before_images_never_apply(spark, rows):
    target = spark.createDataFrame([("a", "0", "ACTIVE")], "id string, v string, status string")
    got = cc.apply_changes(target, feed(spark, [("a", "x", "OLD", 1, 3)]), ["id"])
    assert rows(got) == [("a", "0", "ACTIVE")]


def test_changes_between_sequences(spark, rows):
    changes = feed(spark, [("a", "", "", n, 2) for n in range(1, 6)])
    assert rows(cc.read_changes(changes, "_seq", 2, 4), "_seq") == [(3,), (4,)]


def test_checkpoint_never_moves_back(spark, rows):
    cp = spark.createDataFrame([("t", 9, datetime(2024, 1, 1))], "source_name string, last_seq bigint, updated_at timestamp")
    changes = feed(spark, [("a", "", "", 4, 2)])
    got = cc.advance_checkpoint(cp, changes, "t", "_seq", "2024-02-01 00:00:00")
    assert rows(got, "source_name", "last_seq") == [("t", 9)]
    none = cc.advance_checkpoint(cp, changes.limit(0), "t", "_seq", "2024-02-01 00:00:00")
    assert rows(none, "last_seq") == [(9,)]
