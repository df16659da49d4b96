from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stratiform.operators import quality as q
from stratiform.plans.security_rules import REGISTRY, security_rules

AT = datetime(2024, 1, 1)


def ids(rows_, df):
    return [r[0] for r in rows_(df, "id")]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(
        [
            (1, "A", " x", 5.0, date(2024, 1, 1), "k1"),
            (2, "Z", "", -1.0, date(2025, 1, 1), "k1"),
            (3, None, None, None, None, None),
            (4, "B", "ok", 0.0, date(2023, 1, 1), ""),
        ],
        "id int, code string, name string, n double, day date, key string",
    )


@pytest.mark.parametrize(
    "rule, want",
    [
        (q.enum_rule("R", "t", "code", ["A", "B"]), [2]),
        (q.not_null_rule("R", "t", "name"), [2, 3]),
        (q.regex_rule("R", "t", "name", "^[a-z]+$"), [1]),
        (q.regex_rule("R", "t", "name", "^[a-z]+$", blank_ok=False), [1, 2]),
        (q.trim_rule("R", "t", "name"), [1]),
        (q.range_rule("R", "t", "n", 0), [2]),
        (q.range_rule("R", "t", "n", 0, strict=True), [2, 4]),
        (q.range_rule("R", "t", "n", 0, 4), [1, 2]),
        (q.not_future_rule("R", "t", "day", date(2024, 1, 1)), [2]),
        (q.field_order_rule("R", "t", "id", "n"), [2, 4]),
        (q.unique_rule("R", "t", ["key"]), [1, 2]),
        (q.unique_rule("R", "t", ["key"], scope=lambda: F.col("id") > 1), [2]),
        (q.owner_rule("R", "t", "key", "code"), [1, 2]),
        (q.complete_when_rule("R", "t", "name", lambda: F.col("n") < 0), [2]),
        (q.fresh_rule("R", "t", "day", "2024-01-02 00:00:00", "30 DAYS"), [4]),
    ],
)
def test_row_rules_and_null(df, rows, rule, want):
    assert ids(rows, q.failing_rows(df, rule)) == want


def test_relational_rules(spark, rows):
    child = spark.createDataFrame(
        [(1, "p1", date(2024, 1, 1)), (2, "p2", date(2024, 1, 1)), (3, "p9", date(2024, 1, 1)), (4, None, None), (5, "", None), (6, "p3", date(2024, 1, 1))],
        "id int, pid string, day date",
    )
    parent = spark.createDataFrame(
        [("p1", "DEBT", date(2024, 5, 1)), ("p2", "FUND", date(2023, 1, 1)), ("p3", None, date(2024, 1, 1))],
        "pid string, type string, issued date",
    )
    bond = spark.createDataFrame([("p1",), ("p1",)], "pid string")
    t = {"parent": parent, "bond": bond}
    run = lambda rule: ids(rows, q.failing_rows(child, rule, t))
    assert run(q.fk_rule("R", "c", "pid", "parent", "pid")) == [3]
    assert run(q.table_order_rule("R", "c", "day", "pid", "parent", "pid", "issued")) == [1]
    inclusive = q.table_order_rule("R", "c", "day", "pid", "parent", "pid", "issued", inclusive=True)
    assert run(inclusive) == [1, 6]
    disc = ("R", "c", "pid", "parent", "pid", "type", "DEBT")
    assert run(q.discriminator_rule(*disc)) == [2]
    assert run(q.discriminator_rule(*disc, sibling=("bond", "pid"))) == [2, 6]
    assert run(q.consistency_rule("R", "c", "pid", "bond", "pid", "excludes")) == [1]
    assert run(q.consistency_rule("R", "c", "pid", "bond", "pid", "requires")) == [2, 3, 4, 5, 6]


def test_numeric_foreign_key(spark, rows):
    child = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, fk bigint")
    t = {"p": spark.createDataFrame([(10,)], "k bigint")}
    assert ids(rows, q.failing_rows(child, q.fk_rule("R", "c", "fk", "p", "k"), t)) == [2]


def rules():
    return [
        q.enum_rule("R1", "t", "code", ["A", "B"], q.HIGH),
        q.not_null_rule("R2", "t", "name", q.CRITICAL),
        q.range_rule("R3", "t", "n", 1.0, severity=q.MEDIUM),
        q.trim_rule("R4", "t", "name", q.LOW),
        q.not_null_rule("R5", "t", "day", q.HIGH, enabled=False),
    ]


def test_routing_splits_every_row_once(df, rows):
    clean, rejects = q.route(q.evaluate(df, rules()), "v1", AT)
    assert ids(rows, clean) == [1, 4]
    assert rows(rejects, "id", "_rule_id") == [(2, "R1"), (2, "R2"), (3, "R2")]
    assert sorted(ids(rows, clean) + [r[0] for r in rows(rejects.select("id").distinct())]) == [1, 2, 3, 4]
    assert [r[1] for r in rows(clean, "id", "_dq_warnings")] == [[], ["R3: RANGE_CHECK n: 0.0"]]
    assert rejects.columns[-4:] == ["_rule_id", "_violation_detail", "_rejected_ts", "_dq_rule_version"]


def test_policy_can_reject_warnings(df, rows):
    strict = {**q.POLICY, q.MEDIUM: q.REJECT}
    clean, _ = q.route(q.evaluate(df, rules()), "v1", AT, strict)
    assert ids(rows, clean) == [1]


def test_evaluate_keeps_row_count_with_relational_rules(spark, df):
    extra = [q.unique_rule("U", "t", ["key"]), q.fk_rule("F", "t", "code", "p", "k")]
    t = {"p": spark.createDataFrame([("A",), ("A",), ("Z",)], "k string")}
    got = q.evaluate(df, rules() + extra, t)
    assert got.count() == 4 and got.columns == [*df.columns, "_failed"]


def test_no_rules_means_all_clean(df):
    clean, rejects = q.route(q.evaluate(df, []), "v1", AT)
    assert clean.count() == 4 and rejects.count() == 0


def test_report_counts_match_routing(df, rows):
    got = rows(q.dq_report(df, rules()), "rule_id", "failures", "pass_rate")
    assert got == [("R1", 1, 0.75), ("R2", 2, 0.5), ("R3", 2, 0.5), ("R4", 1, 0.75)]
    empty = q.dq_report(df.limit(0), rules()).collect()
    assert all(r.pass_rate == 1.0 for r in empty)


def test_rule_version_follows_the_rules():
    one, two = rules(), rules()
    assert q.rule_version(one) == q.rule_version(two) and len(q.rule_version(one)) == 16
    two[0] = q.enum_rule("R1", "t", "code", ["A"], q.HIGH)
    assert q.rule_version(one) != q.rule_version(two)


def test_expected_rejects(spark, rows):
    rejects = spark.createDataFrame([("a",), ("a",), ("b",)], "table_name string")
    expected = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "table_name string, expected bigint")
    assert rows(q.compare_expected(rejects, expected)) == [
        ("a", 2, 2, True), ("b", 3, 1, False), ("c", 1, 0, False),
    ]


def test_catalogue_census():
    rules_ = security_rules(date(2024, 1, 1))
    count = lambda key: {k: sum(1 for r in rules_ if getattr(r, key) == k) for k in {getattr(r, key) for r in rules_}}
    assert len(rules_) == 128 and len({r.rule_id for r in rules_}) == 128
    assert count("rule_type") == {
        "ENUM_MEMBERSHIP": 23, "NOT_NULL": 17, "PRIMARY_KEY_UNIQUE": 25, "COMPOSITE_KEY_UNIQUE": 2,
        "BUSINESS_KEY_UNIQUE": 1, "REGEX_FORMAT": 4, "TRIM_WHITESPACE": 1, "RANGE_CHECK": 12,
        "NOT_IN_FUTURE": 4, "CROSS_FIELD_LOGIC": 1, "CROSS_TABLE_LOGIC": 1, "FOREIGN_KEY": 30,
        "CROSS_TABLE_DISCRIMINATOR": 7,
    }
    assert count("severity") == {"CRITICAL": 65, "HIGH": 41, "MEDIUM": 21, "LOW": 1}
    assert len(REGISTRY) == 29
    assert [r.rule_id for r in rules_ if not r.enabled] == ["RULE0049"]


def test_catalogue_on_seeded_faults(spark, rows):
    product = spark.createDataFrame(
        [
            ("P1", "CUSIP", "DEBT", "ACTIVE", "T+1", "ok", "E1", "L1", date(2020, 1, 1), 1.0, 1.0),
            ("P2", "BAD", "EQUITY", "ACTIVE", None, "pad ", "E9", "L1", date(2030, 1, 1), -1.0, 1.0),
            ("P3", "ISIN", "DEBT", "ACTIVE", "T+9", "ok", None, "", None, None, None),
            ("P3", "ISIN", "DEBT", "ACTIVE", "CASH", "ok", "E1", "L1", None, None, -5.0),
        ],
        "product_id string, id_type string, type string, status string, settlement_type string, "
        "description string, issuer_legal_entity_id string, tick_ladder_scale_id string, "
        "issue_date date, issue_price double, current_face_value double",
    )
    tables = {
        "legal_entity": spark.createDataFrame([("E1",)], "legal_entity_id string"),
        "tick_ladder_scale": spark.createDataFrame([("L1",)], "tick_ladder_scale_id string"),
    }
    report = q.dq_report(product, security_rules(date(2024, 1, 1)), tables, "product")
    found = {r.rule_id: r.failures for r in report.filter("failures > 0").collect()}
    assert found == {
        "RULE0001": 1, "RULE0004": 1, "RULE0028": 1, "RULE0029": 1, "RULE0041": 2, "RULE0073": 1,
        "RULE0074": 1, "RULE0075": 1, "RULE0086": 1, "RULE0092": 1,
    }
