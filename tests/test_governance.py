from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratiform.operators import governance as g
from stratiform.operators import profiling as p
from stratiform.sources.catalog import column_catalog, layer_of


def test_masks_by_role(spark):
    df = spark.createDataFrame([("Acme", "US1234", 5.0), (None, None, None)], "name string, isin string, rate double")
    policy = {"name": ("head", {"steward"}), "isin": ("tail", {"licensed"}), "rate": ("null", {"analyst"})}
    assert [tuple(r) for r in g.mask(df, policy, []).collect()] == [("Ac***", "***34", None), (None, None, None)]
    assert tuple(g.mask(df, policy, ["steward", "analyst"]).first()) == ("Acme", "***34", 5.0)
    assert g.mask(df, policy, []).schema == df.schema


def test_row_filter(spark, rows):
    df = spark.createDataFrame([("EU", 1), ("US", 2), (None, 3)], "region string, n int")
    assert rows(g.row_filter(df, "region", ["EU"]), "n") == [(1,)]
    own = spark.createDataFrame([("US",), ("US",)], "r string")
    assert rows(g.row_filter(df, "region", own), "n") == [(2,)]
    assert g.row_filter(df, "region", [], roles=["global-access"]).count() == 3


def test_lineage_both_ways_and_cycles(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")], "source string, target string")
    assert rows(g.lineage(edges, ["a"])) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(g.lineage(edges, ["c"], "upstream")) == [("a", 2), ("b", 1), ("c", 0), ("x", 1)]
    chain = spark.range(130).selectExpr("cast(id as string) source", "cast(id + 1 as string) target")
    assert g.lineage(chain.filter("source >= '0'").limit(12), ["0"]).count() > 1


def test_sla(spark):
    audit = spark.createDataFrame(
        [("bronze", "SUCCESS", datetime(2024, 1, 2, 1), datetime(2024, 1, 2, 2)), ("silver", "FAILED", datetime(2024, 1, 2, 1), datetime(2024, 1, 2, 9))],
        "stage string, status string, started_at timestamp, completed_at timestamp",
    )
    late = lambda stage, now: g.sla_check(audit, stage, "2 HOURS", now).first().breach
    assert not late("bronze", "2024-01-02 03:30:00") and late("bronze", "2024-01-02 05:00:00")
    assert late("silver", "2024-01-02 09:30:00") and late("none", "2024-01-02 09:30:00")


def test_audit_rejects_unknown_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="audit"):
        g.audit_row(spark, run="x")
    for n in range(2):
        g.append_audit(g.audit_row(spark, run_id=str(n), use_case_name="u"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_retention_never_touches_audit(spark, rows):
    inv = spark.createDataFrame([("audit", "2000-01-01"), ("bronze", "2000-01-01"), ("rejects", "2023-01-01"), ("rejects", "2024-01-01")], "layer string, d string")
    inv = inv.select("layer", F.to_date("d").alias("created_on"))
    assert [r.layer for r in g.retention_plan(inv, "2024-06-01").collect()] == ["rejects"]


def test_join_keys_and_relationships(spark, rows):
    t = {
        "product": spark.createDataFrame([("P1",), ("P2",)], "product_id string"),
        "bond": spark.createDataFrame([("P1", "n"), ("P9", "n")], "product_id string, note string"),
        "coupon": spark.createDataFrame([("P1", "n"), ("P1", "n")], "product_id string, note string"),
    }
    keys = p.join_keys(column_catalog(spark, t))
    assert rows(keys, "column_name", "n_tables", "likely_role") == [
        ("note", 2, "shared attribute"), ("product_id", 3, "primary/foreign key"),
    ]
    got = rows(p.join_map(t), "from_table", "to_table", "containment", "cardinality")
    assert got == [("product", "bond", 0.5, "1:0..1"), ("product", "coupon", 1.0, "1:0..n")]
    assert [layer_of(x) for x in ("b_x", "s_x", "g_x", "other")] == ["bronze", "silver", "gold", "other"]


def test_column_documents_name_join_tables(spark):
    t = {"a": spark.createDataFrame([("x",)], "k string"), "b": spark.createDataFrame([("x",)], "k string")}
    docs = p.column_docs(p.profile_tables(t), F.lit("silver"), p.join_keys(column_catalog(spark, t)))
    doc = docs.filter("table_name = 'a'").first().doc
    assert doc == "silver | a.k | string\nSample values: x\nNull %: 0.0 | Cardinality: 1\nJoin key: appears in 2 tables: a, b"


def test_reject_tables_are_not_profiled(spark):
    df = spark.createDataFrame([("x",)], "k string")
    assert p.profile_tables({"a": df, "a_rejects": df}).count() == 1
