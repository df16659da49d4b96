"""Data-quality rules: evaluate a whole rule set in one pass, then route the rows.

A rule says which rows *fail*.  Row rules are expressions over the row.  Relational rules
(uniqueness, foreign keys, cross-table checks) first attach one column by a left join to a
side with unique keys, so they never multiply rows; from there on they are row rules too.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from .windows import duplicate_keys, mark_by_key

# Severities and what each of them does to a failing row.
CRITICAL, HIGH, MEDIUM, LOW = "CRITICAL", "HIGH", "MEDIUM", "LOW"
REJECT, WARN, LOG = "reject", "warn", "log"
POLICY = {CRITICAL: REJECT, HIGH: REJECT, MEDIUM: WARN, LOW: LOG}

Tables = Mapping[str, DataFrame]
Attach = Callable[[DataFrame, str, Tables], DataFrame]
Fails = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    table: str
    rule_type: str
    severity: str
    dimension: str
    column: str
    params: dict = field(default_factory=dict)
    # Expression for "this row fails"; gets the name of the column attached by ``attach``.
    fails: Fails | None = None
    attach: Attach | None = None
    # Rows outside the scope never fail.
    scope: Callable[[], Column] | None = None
    enabled: bool = True
    issues: str = ""
    # A key rule: all rows of a key fail that more than one row has, or more than one owner.
    keys: tuple[str, ...] = ()
    owner: str | None = None

    @property
    def flag(self) -> str:
        return f"_f_{self.rule_id}"

    def describe(self) -> dict:
        keys = ("rule_id", "table", "rule_type", "severity", "dimension", "column", "enabled")
        return {k: getattr(self, k) for k in keys} | {"params": self.params}


def _rule(rule_id, table, rule_type, severity, dimension, column, fails, params, attach=None, **kw):
    return Rule(
        rule_id, table, rule_type, severity, dimension, column, params, fails, attach, **kw
    )


# --- row rules ------------------------------------------------------------------------------


def enum_rule(rule_id, table, column, values, severity=HIGH, **kw) -> Rule:
    """Non-null and not one of ``values``."""
    return _rule(
        rule_id, table, "ENUM_MEMBERSHIP", severity, "Validity", column,
        lambda _: P.not_in_set(column, values), {"values": list(values)}, **kw,
    )


def not_null_rule(rule_id, table, column, severity=CRITICAL, **kw) -> Rule:
    """NULL or blank."""
    return _rule(
        rule_id, table, "NOT_NULL", severity, "Completeness", column,
        lambda _: P.is_blank(column), {}, **kw,
    )


def regex_rule(rule_id, table, column, pattern, severity=HIGH, blank_ok=True, **kw) -> Rule:
    """Not NULL (and, if blanks are fine, not blank) and not matching the anchored pattern."""

    def fails(_):
        checked = F.col(column).isNotNull()
        if blank_ok:
            checked = checked & (F.col(column) != "")
        return checked & ~P.matches(column, pattern)

    return _rule(
        rule_id, table, "REGEX_FORMAT", severity, "Validity", column,
        fails, {"pattern": pattern}, **kw,
    )


def trim_rule(rule_id, table, column, severity=LOW, **kw) -> Rule:
    return _rule(
        rule_id, table, "TRIM_WHITESPACE", severity, "Consistency", column,
        lambda _: P.untrimmed(column), {}, **kw,
    )


def range_rule(rule_id, table, column, lo=None, hi=None, strict=False, severity=MEDIUM, **kw):
    """Non-null and outside the bounds."""
    return _rule(
        rule_id, table, "RANGE_CHECK", severity, "Validity", column,
        lambda _: ~P.in_range(column, lo, hi, strict),
        {"lo": lo, "hi": hi, "strict": strict}, **kw,
    )


def not_future_rule(rule_id, table, column, as_of, severity=MEDIUM, **kw) -> Rule:
    return _rule(
        rule_id, table, "NOT_IN_FUTURE", severity, "Timeliness", column,
        lambda _: P.after(column, F.lit(as_of).cast("date")), {}, **kw,
    )


def field_order_rule(rule_id, table, first, last, severity=MEDIUM, **kw) -> Rule:
    """``first`` later than ``last``; NULL passes."""
    return _rule(
        rule_id, table, "CROSS_FIELD_LOGIC", severity, "Consistency", first,
        lambda _: F.col(first) > F.col(last), {"last": last}, **kw,
    )


def complete_when_rule(rule_id, table, column, when: Callable[[], Column], severity=HIGH, **kw):
    """Blank although ``when`` holds for the row."""
    return _rule(
        rule_id, table, "COMPLETENESS", severity, "Completeness", column,
        lambda _: when() & P.is_blank(column), {"when": kw.pop("label", "")}, **kw,
    )


def fresh_rule(rule_id, table, ts, as_of, max_age, severity=LOW, **kw) -> Rule:
    """Older than ``max_age`` (for example ``1 DAY``) at ``as_of``."""
    return _rule(
        rule_id, table, "TIMELINESS", severity, "Timeliness", ts,
        lambda _: ~P.since(ts, F.lit(as_of).cast("timestamp"), max_age),
        {"max_age": max_age}, **kw,
    )


# --- relational rules -----------------------------------------------------------------------


def _attach_by_key(df: DataFrame, column: str, side: DataFrame, value: Column, flag: str):
    """Left-join ``value`` of ``side`` (unique in ``_k``) as column ``flag``."""
    right = side.select(F.col("_k").alias("_ak"), value.alias(flag))
    return df.join(right, df[column] == right["_ak"], "left").drop("_ak")


def unique_rule(rule_id, table, keys: Sequence[str], severity=CRITICAL, **kw) -> Rule:
    """All rows of a key that occurs more than once; NULL keys count as equal."""
    kind = "PRIMARY_KEY_UNIQUE" if len(keys) == 1 else "COMPOSITE_KEY_UNIQUE"
    return _rule(
        rule_id, table, kind, severity, "Uniqueness", ", ".join(keys),
        lambda flag: F.col(flag), {"keys": list(keys)},
        lambda df, flag, _, bare: mark_by_key(df, keys, duplicate_keys(bare, keys), flag),
        keys=tuple(keys), **kw,
    )


def owner_rule(rule_id, table, key, owner, severity=MEDIUM, **kw) -> Rule:
    """All rows of a non-blank key with more than one owner.

    Smallest and largest owner differ exactly if there are two, so no distinct is needed.
    """

    def attach(df, flag, _, bare):
        rows = bare.filter(~P.is_blank(key))
        shared = rows.groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
        return mark_by_key(df, [key], shared.filter("_lo <> _hi"), flag)

    return _rule(
        rule_id, table, "BUSINESS_KEY_UNIQUE", severity, "Uniqueness", key,
        lambda flag: F.col(flag), {"owner": owner}, attach, keys=(key,), owner=owner, **kw,
    )


def fk_rule(rule_id, table, column, parent, parent_column, severity=CRITICAL, **kw) -> Rule:
    """Non-blank key without a parent."""

    def attach(df, flag, tables, _):
        side = tables[parent].select(F.col(parent_column).alias("_k")).distinct()
        return _attach_by_key(df, column, side, F.lit(True), flag)

    return _rule(
        rule_id, table, "FOREIGN_KEY", severity, "Accuracy/Integrity", column,
        lambda flag: ~P.is_blank(column) & F.col(flag).isNull(),
        {"parent": parent, "parent_column": parent_column}, attach, **kw,
    )


def table_order_rule(
    rule_id, table, column, key, parent, parent_key, parent_column,
    inclusive=False, severity=MEDIUM, **kw,
) -> Rule:
    """Earlier than (``inclusive``: not later than) the value of a parent row.

    Some parent is later exactly if the latest one is, so parents are reduced to that.
    """

    def attach(df, flag, tables, _):
        p = tables[parent]
        side = p.groupBy(F.col(parent_key).alias("_k")).agg(F.max(parent_column).alias("_v"))
        return _attach_by_key(df, key, side, F.col("_v"), flag)

    return _rule(
        rule_id, table, "CROSS_TABLE_LOGIC", severity, "Consistency", column,
        lambda flag: (F.col(column) <= F.col(flag)) if inclusive
        else (F.col(column) < F.col(flag)),
        {"parent": parent, "parent_column": parent_column}, attach, **kw,
    )


def discriminator_rule(
    rule_id, table, key, parent, parent_key, type_column, expected,
    sibling: tuple[str, str] | None = None, severity=HIGH, **kw,
) -> Rule:
    """The parent row has another type; with ``sibling`` also rows without a sibling row.

    A row without a parent passes, and so does a parent whose type is NULL.
    """

    def attach(df, flag, tables, _):
        p = tables[parent]
        wrong = F.count_if(F.col(type_column) != expected) > 0
        side = p.groupBy(F.col(parent_key).alias("_k")).agg(wrong.alias("_v"))
        if sibling is None:
            return _attach_by_key(df, key, side, F.col("_v"), flag)
        name, sibling_key = sibling
        sib = tables[name].select(F.col(sibling_key).alias("_sk")).distinct()
        side = side.join(sib, side["_k"] == sib["_sk"], "left")
        return _attach_by_key(df, key, side, F.col("_v") | F.col("_sk").isNull(), flag)

    return _rule(
        rule_id, table, "CROSS_TABLE_DISCRIMINATOR", severity, "Consistency", key,
        lambda flag: F.col(flag), {"parent": parent, "expected": expected}, attach, **kw,
    )


def consistency_rule(
    rule_id, table, key, other, other_key, kind,
    when: Callable[[], Column] | None = None, severity=HIGH, **kw,
) -> Rule:
    """``excludes``: the key must not appear in ``other``.  ``requires``: it must.

    ``when`` limits the rule to some rows.
    """
    if kind not in ("excludes", "requires"):
        raise ValueError(f"unknown consistency kind: {kind}")

    def attach(df, flag, tables, _):
        side = tables[other].select(F.col(other_key).alias("_k")).distinct()
        return _attach_by_key(df, key, side, F.lit(True), flag)

    def fails(flag):
        bad = F.col(flag).isNotNull() if kind == "excludes" else F.col(flag).isNull()
        return bad if when is None else when() & bad

    return _rule(
        rule_id, table, "CROSS_TABLE_CONSISTENCY", severity, "Consistency", key,
        fails, {"other": other, "kind": kind}, attach, **kw,
    )


# --- evaluation and routing -----------------------------------------------------------------


def _active(rules: Sequence[Rule], table: str | None) -> list[Rule]:
    return [r for r in rules if r.enabled and (table is None or r.table == table)]


def _failing(rule: Rule) -> Column:
    pred = rule.fails(rule.flag)
    if rule.scope is not None:
        pred = rule.scope() & pred
    return F.coalesce(pred, F.lit(False))


def _detail(df: DataFrame, rule: Rule) -> Column:
    names = [c.strip() for c in rule.column.split(",")]
    values = [
        F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in names if c in df.columns
    ]
    return F.concat(F.lit(f"{rule.rule_type} {rule.column}: "), F.concat_ws(", ", *values))


def attach_all(df: DataFrame, rules: Sequence[Rule], tables: Tables) -> DataFrame:
    """Join what the relational rules need.  Keys are grouped on the bare input, of which a
    rule reads its key columns only; grouping the joined frame would redo all joins per rule."""
    bare = df
    for r in rules:
        if r.attach is not None:
            df = r.attach(df, r.flag, tables, bare)
    return df


def evaluate(
    df: DataFrame, rules: Sequence[Rule], tables: Tables | None = None, table: str | None = None
) -> DataFrame:
    """Add ``_failed``: one struct (rule_id, severity, detail) per rule the row fails."""
    active = _active(rules, table)
    flagged = attach_all(df, active, tables or {})
    hits = [_hit(flagged, r) for r in active]
    failed = F.array_compact(F.array(*hits)) if hits else F.array().cast(FAILED)
    return flagged.select(*df.columns, failed.alias("_failed"))


FAILED = "array<struct<rule_id:string,severity:string,detail:string>>"


def _hit(df: DataFrame, rule: Rule) -> Column:
    found = F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.severity).alias("severity"),
        _detail(df, rule).alias("detail"),
    )
    return F.when(_failing(rule), found)


def add_key_failures(
    evaluated: DataFrame,
    rules: Sequence[Rule],
    bad_keys: Mapping[str, DataFrame],
    table: str | None = None,
) -> DataFrame:
    """Complete ``_failed`` where the key rules were left out of :func:`evaluate`.

    ``bad_keys`` holds the failing keys of each key rule (unique rows, named as the rule's
    keys).  The result is that of evaluating all ``rules`` at once, in their order.
    """
    active = _active(rules, table)
    flagged = evaluated
    for r in active:
        if r.keys:
            flagged = mark_by_key(flagged, r.keys, bad_keys[r.rule_id], r.flag)
    bare = flagged.drop("_failed")
    hits = [
        _hit(bare, r)
        if r.keys
        else F.get(F.filter("_failed", lambda f: f["rule_id"] == r.rule_id), F.lit(0))  # noqa: B023
        for r in active
    ]
    failed = F.array_compact(F.array(*hits)) if hits else F.array().cast(FAILED)
    kept = [c for c in evaluated.columns if c != "_failed"]
    return flagged.select(*kept, failed.alias("_failed"))


def route(
    evaluated: DataFrame,
    rule_version: str,
    as_of,
    policy: Mapping[str, str] = POLICY,
) -> tuple[DataFrame, DataFrame]:
    """Split into (clean, rejects).

    Clean rows carry their warnings in ``_dq_warnings``.  A rejected row appears once per
    rejecting rule it fails.  Clean rows are exactly the rows without a rejecting rule.
    """

    def does(action):
        names = [s for s, a in policy.items() if a == action]
        return lambda f: f["severity"].isin(names)

    columns = [c for c in evaluated.columns if c != "_failed"]
    blocked = F.exists("_failed", does(REJECT))
    warnings = F.transform(
        F.filter("_failed", does(WARN)),
        lambda f: F.concat(f["rule_id"], F.lit(": "), f["detail"]),
    )
    clean = evaluated.filter(~blocked).select(*columns, warnings.alias("_dq_warnings"))
    rejects = (
        evaluated.filter(blocked)
        .select(*columns, F.explode(F.filter("_failed", does(REJECT))).alias("_f"))
        .select(
            *columns,
            F.col("_f.rule_id").alias("_rule_id"),
            F.col("_f.detail").alias("_violation_detail"),
            F.lit(as_of).cast("timestamp").alias("_rejected_ts"),
            F.lit(rule_version).alias("_dq_rule_version"),
        )
    )
    return clean, rejects


def failing_rows(df: DataFrame, rule: Rule, tables: Tables | None = None) -> DataFrame:
    """The rows that fail one rule, as a rule's own query returns them."""
    return attach_all(df, [rule], tables or {}).filter(_failing(rule)).select(*df.columns)


def rule_version(rules: Sequence[Rule]) -> str:
    """First 16 hex digits of the SHA-256 over the rule set's canonical text."""
    text = json.dumps([r.describe() for r in rules], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (r.rule_id, r.table, r.column, r.rule_type, r.severity, r.dimension, r.enabled, r.issues)
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, table_name string, column_name string, rule_type string, "
        "severity string, dimension string, enabled boolean, related_issues string",
    )


def dq_report(
    df: DataFrame, rules: Sequence[Rule], tables: Tables | None = None, table: str | None = None
) -> DataFrame:
    """One row per rule: rows checked, failures and pass rate.

    All failure counters are taken in a single global aggregate.
    """
    active = _active(rules, table)
    flagged = attach_all(df, active, tables or {})
    counts = flagged.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_failing(r)).alias(f"_n{i}") for i, r in enumerate(active)],
    )
    rows = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.table).alias("table_name"),
            F.lit(r.dimension).alias("dimension"),
            F.lit(r.severity).alias("severity"),
            F.col("_rows").alias("n_rows"),
            F.col(f"_n{i}").alias("failures"),
        )
        for i, r in enumerate(active)
    ]
    rate = F.when(F.col("n_rows") == 0, F.lit(1.0)).otherwise(
        1 - F.col("failures") / F.col("n_rows")
    )
    return counts.select(F.inline(F.array(*rows))).withColumn("pass_rate", F.round(rate, 6))


def rule_issues(rules: DataFrame, issues: DataFrame) -> DataFrame:
    """Rules joined to the known issues they name (``;``-separated ids)."""
    long = rules.select(
        "rule_id", "severity", F.explode(F.split("related_issues", ";")).alias("issue_id")
    ).filter("issue_id <> ''")
    return long.join(issues, "issue_id", "left")


def compare_expected(rejects: DataFrame, expected: DataFrame) -> DataFrame:
    """Seeded reject counts against actual ones, per table."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    wanted = expected.select("table_name", F.col("expected").cast("bigint"), zero.alias("actual"))
    found = rejects.select("table_name", zero.alias("expected"), one.alias("actual"))
    both = wanted.unionByName(found).groupBy("table_name")
    counts = both.agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    return counts.withColumn("matches", F.col("expected") == F.col("actual"))


def compare_reports(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """Failures per rule in two reports and whether they agree."""
    a = batch.select("rule_id", F.col("failures").alias("batch_failures"))
    b = stream.select("rule_id", F.col("failures").alias("stream_failures"))
    both = a.join(b, "rule_id", "full_outer").fillna(0)
    same = F.col("batch_failures") == F.col("stream_failures")
    return both.withColumn("equal", same)
