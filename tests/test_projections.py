from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.functions import predicates as P
from stratiform.functions.hashing import row_hash
from stratiform.operators import projections as pr
from stratiform.spec import BRONZE_META


def test_hash_modes_differ_on_moved_nulls(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    compat = df.select(row_hash(df.columns, "compat").alias("h")).distinct().count()
    strict = df.select(row_hash(df.columns).alias("h")).distinct().count()
    assert (compat, strict) == (1, 2)


def test_strict_hash_keeps_separators_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert df.select(row_hash(df.columns).alias("h")).distinct().count() == 2


def test_hash_ignores_metadata(spark):
    df = spark.createDataFrame([("P1", 1.0)], "id string, price double")
    first = pr.add_metadata(df, "a.csv", "b1", as_of="2024-01-01 00:00:00").first()
    second = pr.add_metadata(df, "z.csv", "b2", as_of="2024-05-01 00:00:00").first()
    assert first._row_hash == second._row_hash and len(first._row_hash) == 64
    assert set(pr.add_metadata(df, "a", "b", source_type="volume").columns) == {
        "id", "price", *BRONZE_META,
    }
    assert str(second._ingestion_date) == "2024-05-01"


def test_priority_takes_first_non_null(spark, rows):
    df = spark.createDataFrame(
        [(None, "c", "s"), ("i", "c", None), (None, None, None)], "isin string, cusip string, sedol string"
    )
    label, value = pr.coalesce_priority([("ISIN", "isin"), ("CUSIP", "cusip"), ("SEDOL", "sedol")])
    assert rows(df.select(label, value)) == [("CUSIP", "c"), ("ISIN", "i"), (None, None)]


def test_conform_orders_casts_and_fills(spark):
    df = spark.createDataFrame([("x1", "12", "keep")], "code string, n string, extra string")
    schema = T.StructType.fromDDL("n int, code int, day date")
    out = pr.conform(df, schema)
    assert out.columns == ["n", "code", "day"]
    assert tuple(out.first()) == (12, None, None)
    assert pr.conform(df, schema, extra="keep").columns[-1] == "extra"


def test_wide_and_long_are_inverse(spark, rows):
    wide = spark.createDataFrame([("P1", "i1", None), ("P2", None, "c2")], "id string, isin string, cusip string")
    long = pr.unpivot_wide(wide, ["id"], ["isin", "cusip"])
    assert rows(long) == [("P1", "isin", "i1"), ("P2", "cusip", "c2")]
    back = pr.pivot_eav(long, ["id"], "id_type", "identifier_value", ["isin", "cusip"])
    assert rows(back) == rows(wide)


def test_derived_metric_is_null_elsewhere(spark):
    df = spark.createDataFrame(
        [("BOND", "100", "0.05"), ("STOCK", "100", "0.05"), ("MUNI", "100", None)],
        "sub_type string, f string, r string",
    ).selectExpr("sub_type", "CAST(f AS DECIMAL(28,8)) f", "CAST(r AS DECIMAL(28,8)) r")
    value = F.col("f") * (F.lit(1).cast("decimal(1,0)") + F.col("r"))
    out = df.select(pr.derive_when("net", F.col("sub_type").isin("BOND", "MUNI"), value))
    assert out.schema["net"].dataType == T.DecimalType(18, 6)
    assert [None if r.net is None else float(r.net) for r in out.collect()] == [105.0, None, None]


def test_types_proposed_by_name(spark, rows):
    names = ["net_amount", "issue_price", "due_date", "is_current", "call_flag", "name"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = [r[1] for r in df.select("c", pr.proposed_type(F.col("c"))).collect()]
    assert got == ["DECIMAL(18,6)", "DECIMAL(18,6)", "DATE", "BOOLEAN", "BOOLEAN", "STRING"]


def test_predicates_on_null_and_blank(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), (" a",), ("a",)], "s string")
    got = df.select(P.is_blank("s"), P.untrimmed("s"), P.not_in_set("s", ["a"])).collect()
    assert [r[0] for r in got] == [True, True, True, False, False]
    assert [r[1] for r in got] == [False, False, True, True, False]
    assert [r[2] for r in got] == [False, True, True, True, False]


def test_range_bounds(spark):
    df = spark.createDataFrame([(None,), (0,), (25,), (26,)], "n int")
    got = df.select(P.in_range("n", 0, 25), P.in_range("n", 0, strict=True)).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (True, True), (False, True)]
