import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.functions.hashing import row_hash
from stratiform.operators import layout, sinks
from stratiform.operators import quality as q
from stratiform.operators.capture import apply_changes
from stratiform.plans.conform import conform_table
from stratiform.plans.ingest import ingest_all, ingest_table
from stratiform.session import scratch_path, shared_dir
from stratiform.sources import files, jdbc, paged
from stratiform.sources.dispatch import read_source
from stratiform.spec import TableSpec, struct

D1, D2, D3 = datetime(2024, 1, 1, 5), datetime(2024, 2, 1, 5), datetime(2024, 3, 1, 5)


def frame(spark, data):
    df = spark.createDataFrame(data, "id string, v string")
    return df.withColumn("_row_hash", row_hash(df.columns))


def files_in(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def test_snapshots_read_by_id_and_time(spark, rows, tmp_path):
    t = sinks.SnapshotTable(spark, str(tmp_path / "t"))
    assert not t.exists()
    assert t.write(frame(spark, [("a", "1")]), "CREATE", at=D1) == 1
    # A table may be rewritten from itself.
    assert t.write(t.read().union(frame(spark, [("b", "2")])), "APPEND", at=D2) == 2
    assert rows(t.read(), "id") == [("a",), ("b",)]
    assert rows(t.read(1), "id") == rows(t.read(datetime(2024, 1, 15)), "id") == [("a",)]
    with pytest.raises(ValueError):
        t.read(datetime(2023, 1, 1))
    t.restore(1, at=D3)
    assert rows(t.read(), "id") == [("a",)]
    assert [r.operation for r in t.history().orderBy("snapshot_id").collect()] == ["CREATE", "APPEND", "RESTORE 1"]


def test_a_failed_write_leaves_the_table(spark, rows, tmp_path):
    t = sinks.SnapshotTable(spark, str(tmp_path / "t"))
    t.write(frame(spark, [("a", "1")]), "CREATE", at=D1)
    broken = frame(spark, [("b", "2")]).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        t.write(broken, "APPEND", at=D2)
    assert rows(t.read(), "id") == [("a",)]


def test_bucketed_upsert_rewrites_only_changed_buckets(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    data = [(f"k{i}", "0") for i in range(60)]
    sinks.upsert_buckets(spark, path, frame(spark, data), ["id"], buckets=6)
    before = files_in(path)
    sinks.upsert_buckets(spark, path, frame(spark, data), ["id"], buckets=6)
    assert files_in(path) == before
    sinks.upsert_buckets(spark, path, frame(spark, [("k7", "new"), ("k8", "0")]), ["id"], buckets=6)
    changed = {os.path.dirname(f) for f in set(before) ^ set(files_in(path))}
    assert len(changed) == 1
    got = dict(rows(spark.read.parquet(path), "id", "v"))
    assert len(got) == 60 and got["k7"] == "new"


def test_partition_overwrite_keeps_the_others(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "v string, day int")
    sinks.write_table(df, path, ["day"])
    sinks.overwrite_partitions(spark.createDataFrame([("c", 2)], "v string, day int"), path, ["day"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("c", 2)]


def test_csv_quotes_blanks_and_rescued_lines(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n\n1,"x, ""y""",5\n2,,7\n3,z,oops\n')
    schema = struct("id integer, name string, n integer")
    got = files.read_csv(spark, str(tmp_path), schema, rescue="_rescued")
    assert rows(got) == [(1, 'x, "y"', 5, None), (2, None, 7, None), (3, "z", None, "3,z,oops")]
    assert files.infer_csv_schema(spark, str(tmp_path))["id"].dataType == T.IntegerType()


def test_multi_line_json(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1,\n "v": "x"},\n {"id": 2}]')
    assert rows(files.read_json(spark, str(tmp_path), struct("id integer, v string"))) == [(1, "x"), (2, None)]


def test_dispatch(spark, rows, tmp_path):
    (tmp_path / "product.csv").write_text("product_id,type,status\nP1,EQUITY,ACTIVE\nP2,DEBT,ACTIVE\n")
    spec = TableSpec("product", struct("product_id string, type string, status string"))
    volume = {"type": "volume", "path": str(tmp_path), "file": "product.csv"}
    assert read_source(spark, spec, volume).count() == 2
    with pytest.raises(ValueError, match="Unsupported source type"):
        read_source(spark, spec, {"type": "ftp"})


def test_hash_predicates_cover_null():
    got = jdbc.hash_predicates("ABS(CHECKSUM(id))", 3)
    assert len(got) == 3 and "IS NULL" in got[0] and all("IS NULL" not in p for p in got[1:])


def test_response_path():
    assert paged.dig({"data": {"items": [1]}}, "data.items") == [1]
    assert paged.dig({"data": None}, "data.items") == [] and paged.dig([1], "") == [1]


CSV = struct("id string, v string")


def deliver(path, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.csv").write_text(text)
    return {"type": "volume", "path": str(path)}


def test_ingest_creates_then_merges(spark, rows, tmp_path):
    root = str(tmp_path / "bronze")
    one = TableSpec("t", CSV, ("id",), deliver(tmp_path / "1", "id,v\na,1\nb,2\n"))
    two = TableSpec("t", CSV, ("id",), deliver(tmp_path / "2", "id,v\nb,3\nc,4\n"))
    assert ingest_table(spark, one, root, "b1", at=D1)[1:4] == ("CREATE", 2, "SUCCESS")
    assert ingest_table(spark, two, root, "b2", at=D2)[1:4] == ("MERGE", 3, "SUCCESS")
    assert ingest_table(spark, two, root, "b3", at=D3)[1:4] == ("MERGE", 3, "SUCCESS")
    got = sinks.SnapshotTable(spark, f"{root}/t").read()
    assert rows(got, "id", "v", "_batch_id") == [("a", "1", "b1"), ("b", "3", "b2"), ("c", "4", "b2")]


def test_ingest_drift(spark, rows, tmp_path):
    root = str(tmp_path / "bronze")
    one = TableSpec("t", CSV, ("id",), deliver(tmp_path / "1", "id,v\na,1\n"))
    ingest_table(spark, one, root, "b1", at=D1)
    wide = struct("id string, v string, extra string")
    two = TableSpec("t", wide, ("id",), deliver(tmp_path / "2", "id,v,extra\nb,2,x\n"))
    ingest_table(spark, two, root, "b2", at=D2)
    table = sinks.SnapshotTable(spark, f"{root}/t")
    assert rows(table.read(), "id", "v", "extra") == [("a", "1", None), ("b", "2", "x")]
    assert spark.read.parquet(f"{root}/_schema_changes").first().columns_affected == "extra"
    bad = TableSpec("t", struct("id string"), ("id",), deliver(tmp_path / "3", "id\nc\n"))
    with pytest.raises(ValueError, match="Breaking change"):
        ingest_table(spark, bad, root, "b3", at=D3)
    assert spark.read.parquet(f"{root}/_schema_quarantine").first().batch_id == "b3"
    assert table.read().count() == 2


def test_one_failing_table_does_not_stop_the_rest(spark, rows, tmp_path):
    good = TableSpec("good", CSV, ("id",), deliver(tmp_path / "g", "id,v\na,1\n"), 1)
    bad = TableSpec("bad", CSV, ("id",), {"type": "ftp"})
    root = str(tmp_path / "bronze")
    summary = ingest_all(spark, [good, bad], root, "b1", at=D1, fail=False)
    assert rows(summary, "table_name", "status") == [("bad", "FAILED"), ("good", "SUCCESS")]
    with pytest.raises(RuntimeError, match="bad"):
        ingest_all(spark, [good, bad], root, "b1", at=D1)
    assert rows(ingest_all(spark, [good, bad], root, "b1", only=["good"], at=D1), "table_name") == [("good",)]


def test_conform_reruns_leave_the_history(spark, rows, tmp_path):
    rules = [q.not_null_rule("R1", "t", "v"), q.enum_rule("R2", "t", "v", ["1", "2"], q.MEDIUM)]
    root = str(tmp_path / "silver")
    for at, data in ((D1, [("a", "1"), ("b", None)]), (D2, [("a", "2"), ("c", "9")]), (D2, [("a", "2"), ("c", "9")])):
        conform_table(spark, "t", frame(spark, data), ["id"], rules, {}, root, at)
    got = sinks.SnapshotTable(spark, f"{root}/t").read()
    assert rows(got, "id", "v", "is_current") == [("a", "1", False), ("a", "2", True), ("c", "9", True)]
    assert rows(spark.read.parquet(f"{root}/t_rejects"), "id", "_rule_id") == [("b", "R1")]


def test_compaction_clusters_and_refuses_partition_columns(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(20_000).selectExpr("id % 97 AS x", "id % 89 AS y", "id % 2 AS p", "repeat('v', 20) AS v").repartition(20).write.parquet(source)
    assert layout.compact(spark, source, target, cluster_by=["x", "y"]) == 1
    assert spark.read.parquet(target).count() == 20_000
    assert len(files_in(target)) < len(files_in(source))
    with pytest.raises(ValueError, match="partition columns"):
        layout.compact(spark, source, target, cluster_by=["p"], partition_by=["p"])


def test_z_order_narrows_both_columns(spark):
    df = spark.range(40_000).selectExpr("id % 200 AS x", "cast(id / 200 AS int) AS y")
    z = df.withColumn("z", layout.z_value(df, ["x", "y"])).repartitionByRange(16, "z")
    part = z.groupBy(F.spark_partition_id().alias("p")).agg(
        (F.max("x") - F.min("x")).alias("x"), (F.max("y") - F.min("y")).alias("y")
    )
    spread = part.agg(F.avg("x"), F.avg("y")).first()
    assert spread[0] < 120 and spread[1] < 120


def test_cached_releases(spark):
    df = spark.range(10)
    with layout.cached(df) as c:
        assert c.is_cached and c.count() == 10
    assert not df.is_cached


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or shared_dir(spark) == base.rstrip("/")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(shared_dir(spark))


def test_profile_of_dates_and_missing_values(spark, rows):
    from stratiform.operators.profiling import profile

    df = spark.createDataFrame(
        [("a", 1, date(2024, 1, 1), True), ("a", None, None, None), (None, 3, date(2024, 1, 1), False)],
        "s string, n int, d date, b boolean",
    )
    got = {r.column_name: r for r in profile(df).collect()}
    assert (got["s"].null_pct, got["s"].cardinality, got["s"].sample_values) == (33.3, 1, ["a"])
    assert got["n"].sample_values == ["1", "3"] and got["b"].sample_values == []
    assert got["d"].sample_values == ["2024-01-01"]
    assert all(r.cardinality == 0 for r in profile(df.limit(0)).collect())


def test_bucketed_history_equals_the_merge(spark, rows, tmp_path):
    from stratiform.operators.history import check_scd2, scd2_merge
    from stratiform.operators.projections import stamp_current

    path, days = str(tmp_path / "h"), ["2024-01-01", "2024-02-01", "2024-02-01", "2024-03-01"]
    deliveries = [
        [(f"k{i}", "0") for i in range(40)],
        [("k1", "1"), ("k2", "0"), ("new", "1")],
        [("k1", "2"), ("k3", "2")],
        [("k1", "3"), ("k4", "0")],
    ]
    want = None
    for day, data in zip(days, deliveries):
        df = frame(spark, data)
        want = stamp_current(df, day, "v") if want is None else scd2_merge(want, df, ["id"], day, "v")
        sinks.scd2_buckets(spark, path, df, ["id"], day, "v", buckets=4)
    got = sinks.read_history(spark, path)
    assert rows(got, *want.columns) == rows(want)
    assert all(r.violations == 0 for r in check_scd2(got, ["id"]).collect())
    before = files_in(path)
    sinks.scd2_buckets(spark, path, frame(spark, deliveries[3]), ["id"], days[3], "v", buckets=4)
    assert files_in(path) == before


def test_bucketed_ingest(spark, rows, tmp_path):
    root = str(tmp_path / "bronze")
    make = lambda n, schema, text: TableSpec(
        "t", schema, ("id",), deliver(tmp_path / n, text), buckets=4
    )
    one = make("1", CSV, "id,v\na,1\nb,2\n")
    wide = make("2", struct("id string, v string, extra string"), "id,v,extra\nb,3,x\n")
    assert ingest_table(spark, one, root, "b1", at=D1)[1:4] == ("CREATE", 2, "SUCCESS")
    assert ingest_table(spark, wide, root, "b2", at=D2)[1:4] == ("MERGE", 1, "SUCCESS")
    got = spark.read.option("mergeSchema", True).parquet(f"{root}/t")
    assert rows(got, "id", "v", "extra", "_batch_id") == [("a", "1", None, "b1"), ("b", "3", "x", "b2")]


def test_conform_into_buckets(spark, rows, tmp_path):
    root = str(tmp_path / "silver")
    for at, data in ((D1, [("a", "1"), ("b", None)]), (D2, [("a", "2")])):
        rules = [q.not_null_rule("R1", "t", "v")]
        conform_table(spark, "t", frame(spark, data), ["id"], rules, {}, root, at, buckets=2)
    got = sinks.read_history(spark, f"{root}/t")
    assert rows(got, "id", "v", "is_current") == [("a", "1", False), ("a", "2", True)]


def test_compaction_splits_a_hot_value(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    hot = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) AS x", "uuid() AS v")
    hot.write.parquet(source)
    monkeypatch.setattr(layout, "path_bytes", lambda *_: 12 * 1024 * 1024)
    assert layout.compact(spark, source, target, cluster_by=["x"], target_mb=1) == 12
    per_file = spark.read.parquet(target).groupBy(F.input_file_name()).count()
    assert per_file.agg(F.max("count")).first()[0] < 30_000 / 6


def test_bucketed_upserts_can_be_replayed(spark, rows, tmp_path):
    """Rows with a NULL key come once, however often they are delivered."""
    path = str(tmp_path / "t")
    batch = spark.createDataFrame(
        [("a", "1", "h1"), (None, "2", "h2"), (None, "3", "h3")], "id string, v string, _row_hash string"
    )
    for _ in range(3):
        sinks.upsert_buckets(spark, path, batch, ["id"], buckets=4)
    assert rows(spark.read.parquet(path), "id", "v") == [("a", "1"), (None, "2"), (None, "3")]
    with pytest.raises(ValueError, match="has 4 buckets, not 6"):
        sinks.upsert_buckets(spark, path, batch, ["id"], buckets=6)


def test_a_key_deleted_and_inserted_again_is_live(spark, rows):
    columns = "id string, v string, status string, _row_hash string"
    table = spark.createDataFrame([("a", "1", "DELETED", "h1")], columns)
    again = spark.createDataFrame(
        [("a", "1", "ACTIVE", "h1", 2, 5), (None, "2", "ACTIVE", "h2", 2, 6)], columns + ", _op int, _seq int"
    )
    for _ in range(2):
        table = apply_changes(table, again, ["id"], hash_col="_row_hash")
    assert rows(table, "id", "status") == [("a", "ACTIVE"), (None, "ACTIVE")]


def test_z_order_tells_strings_with_a_common_head_apart(spark):
    df = spark.range(10_000).selectExpr("format_string('Customer#%09d', id) name", "id % 50 n")
    cells = df.select(layout.z_value(df, ["name", "n"]).alias("z")).distinct().count()
    assert cells > 1000
