from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratiform.operators import drift as d
from stratiform.operators.sinks import SnapshotTable
from stratiform.plans.ingest import ingest_table
from stratiform.spec import TableSpec


@pytest.fixture
def base(spark):
    return spark.createDataFrame(
        [("P001", "EQUITY", "ACTIVE", 100.0), ("P002", "DEBT", "ACTIVE", 200.0)],
        "product_id string, type string, status string, issue_price double",
    )


def test_additive(base):
    got = d.detect_drift(base.schema, base.withColumn("new_column", F.lit("x")).schema)
    assert got["additive"] == ["new_column"] and got["breaking"] == []


def test_additive_merge_fills_null_and_keeps_rows(base):
    wider = base.withColumn("added", F.lit(1))
    got = d.merge_additive(base, wider.schema)
    assert got.count() == 2 and got.filter("added IS NULL").count() == 2
    assert got.schema["added"].dataType == wider.schema["added"].dataType


def test_type_change_and_removal_break(base):
    retyped = base.withColumn("issue_price", F.col("issue_price").cast("string"))
    assert d.detect_drift(base.schema, retyped.schema)["breaking"] == ["issue_price"]
    assert d.detect_drift(base.schema, base.drop("status").schema)["breaking"] == ["status"]


def test_breaking_raises_with_the_quarantine_row(spark, base):
    drift = d.detect_drift(base.schema, base.drop("status").schema)
    with pytest.raises(ValueError, match="Breaking change") as stop:
        d.guard_breaking(spark, drift, "b1", "product", datetime(2024, 1, 1))
    row = stop.value.record.first()
    assert (row.batch_id, row.change_type, row.columns_affected) == ("b1", "BREAKING", "status")
    d.guard_breaking(spark, d.detect_drift(base.schema, base.schema), "b1", "product", None)


def test_new_table_and_metadata(base):
    new = d.detect_drift(None, base.schema)
    assert new["new_table"] and new["additive"] == [] and new["breaking"] == []
    stamped = base.withColumn("_ingestion_ts", F.current_timestamp()).withColumn("_row_hash", F.lit("h"))
    for a, b in ((base, stamped), (stamped, base)):
        got = d.detect_drift(a.schema, b.schema)
        assert got["additive"] == [] and got["breaking"] == []


def test_rename_hint_needs_equal_values(base, rows):
    renamed = base.withColumnRenamed("type", "kind").withColumn("other", F.lower("status"))
    assert rows(d.rename_candidates(base, renamed)) == [("type", "kind", 2)]
    assert rows(d.rename_candidates(base, base)) == []


def test_resolution_touches_one_batch(spark, rows):
    q = spark.createDataFrame(
        [("b1", "t", "BREAKING", "c", datetime(2024, 1, 1), None, None, None), ("b2", "t", "BREAKING", "c", datetime(2024, 1, 1), None, None, None)],
        d.QUARANTINE,
    )
    done = d.resolve(q, "b1", "me", "fixed", datetime(2024, 1, 2))
    assert rows(done, "batch_id", "resolved_by") == [("b1", "me"), ("b2", None)]


def deliver(spark, folder, kind, df):
    if kind == "csv":
        df.write.option("header", True).csv(folder)
    else:
        getattr(df.write, kind)(folder)
    return {"type": "volume", "format": kind, "path": folder, "multi_line": False}


@pytest.mark.parametrize("kind", ["csv", "parquet", "json"])
def test_drift_is_seen_in_the_delivered_files(spark, base, rows, tmp_path, kind):
    root = str(tmp_path / "bronze")
    schema = "product_id type status issue_price".split()

    def load(batch, df):
        source = deliver(spark, str(tmp_path / batch), kind, df)
        spec = TableSpec("t", base.schema, ("product_id",), source)
        ingest_table(spark, spec, root, batch, at=datetime(2024, 1, int(batch[1:])))
        return SnapshotTable(spark, f"{root}/t").read()

    reordered = base.select(*reversed(schema))
    first = rows(load("b1", reordered), *schema)
    assert first == rows(base, *schema)  # by name, not by place
    wider = load("b2", base.withColumn("extra", F.lit("x")).select("extra", *schema))
    assert rows(wider, "product_id", "extra") == [("P001", None), ("P002", None)] or rows(
        wider, "product_id", "extra"
    ) == [("P001", "x"), ("P002", "x")]
    assert spark.read.parquet(f"{root}/_schema_changes").first().columns_affected == "extra"
    with pytest.raises(ValueError, match="Breaking change"):
        load("b3", base.withColumn("extra", F.lit("x")).drop("status"))
    if kind == "parquet":
        retyped = base.withColumn("issue_price", F.col("issue_price").cast("string"))
        with pytest.raises(ValueError, match="Breaking change"):
            load("b4", retyped.withColumn("extra", F.lit("x")))


def test_a_first_load_must_bring_the_declared_columns(spark, base, tmp_path):
    source = deliver(spark, str(tmp_path / "b1"), "csv", base.drop("type"))
    with pytest.raises(ValueError, match="Breaking change"):
        ingest_table(spark, TableSpec("t", base.schema, ("product_id",), source), str(tmp_path / "x"), "b1")
