"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from stratiform.operators import joins as J
from stratiform.operators import quality as q
from stratiform.operators import windows as W
from stratiform.suite import Tables, load

FOLDER = "/root/testdata/sf0.001"
# These run jobs of their own (writes, streams, loops) before they return a frame.
EAGER = re.compile(
    "read_|stream|ingest|conform_c|snapshot|upsert_b|partition|compact|comments|^tags|analyze|audit_a|column_t|lineage_c|overwrite|history_from|check_int|as_of_j|scd2_b"
)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



@pytest.fixture
def large(spark):
    """Plan as if no side were small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", [n for n in load() if not EAGER.search(n)])
def test_no_query_pairs_rows_without_a_key(large, tables, name):
    text = plan(load()[name].run(tables))
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_orphans_are_an_anti_join(tables):
    text = plan(J.orphans(tables.orders, tables.customer, "o_custkey", "c_custkey"))
    assert "LeftAnti" in text and "ReadSchema: struct<c_custkey:bigint>" in text


def test_filters_and_columns_reach_the_scan(tables):
    df = tables.orders.filter("o_totalprice > 1000")
    text = plan(W.duplicate_keys(df, ["o_custkey"]))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text


def test_rank_one_is_limited_before_the_shuffle(tables):
    got = W.latest_per_key(tables.orders, ["o_custkey"], [F.desc("o_orderdate")], [F.asc("o_orderkey")])
    text = plan(got)
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_branches_on_one_key_share_the_roots_exchange(large, tables):
    by = lambda n: J.Branch(tables.model[n], "product_id", "product_id", {f"{n}_now": "is_current"})
    root = tables.model["product"].select("product_id", "type")
    text = plan(J.flatten(root, [by(n) for n in ("stock", "fund", "debt", "bond", "option")]))
    # One exchange per table, plus those that derive the root itself.
    alone = plan(root).count("Exchange hashpartitioning")
    assert text.count("Exchange hashpartitioning") <= 5 + 1 + alone


def test_row_rules_take_one_scan(tables):
    rules = [
        q.enum_rule("A", "t", "o_orderstatus", ["F"]),
        q.not_null_rule("B", "t", "o_custkey"),
        q.range_rule("C", "t", "o_totalprice", 0),
    ]
    text = plan(q.dq_report(tables.orders, rules))
    assert text.count("FileScan") == 1
    assert plan(q.evaluate(tables.orders, rules)).count("Exchange") == 0


def test_key_rules_group_the_bare_input(tables):
    """Five key rules: one wide scan and five narrow ones, not two to the fifth."""
    keys = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"]
    rules = [q.unique_rule(f"U{i}", "t", [k]) for i, k in enumerate(keys)]
    got = q.evaluate(tables.orders, rules)
    assert plan(got).count("FileScan") <= 6


def test_text_work_stays_in_the_row(tables):
    from stratiform.operators import text as tx

    got = tx.find_mentions(tables.documents, ["doc_id"], "text", ["the"])
    assert "Exchange" not in plan(got) and "Python" not in plan(got)
    source = F.col("doc_id").cast("string")
    assert "Exchange" not in plan(tx.chunk(tables.documents, source, "text", F.col("source")))


def test_a_hot_key_is_split(spark, large):
    """AQE cuts the partition of a key that holds most rows, in each of the key joins."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60_000).repartition(6).selectExpr(
            "if(id % 3 < 2, -1, id) AS k", "uuid() AS payload", "cast(id % 7 AS string) AS t"
        )
        parent = spark.range(0, 60_000, 2).selectExpr("id AS k", "cast(id % 7 AS string) AS t")
        found = {
            "orphans": J.orphans(df, parent, "k", "k"),
            "duplicates": W.duplicate_rows(df, ["k"]),
            "lookup": J.lookup(df, parent, "k", "k", {"other": "t"}),
            "rule": q.failing_rows(df, q.fk_rule("R", "t", "k", "p", "k"), {"p": parent}),
        }
        for name, out in found.items():
            out.write.format("noop").mode("overwrite").save()
            out.collect()
            assert "skew=true" in plan(out), name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
