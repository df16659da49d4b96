"""Checks and summaries.  Each is one aggregate over its input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, columns: Sequence[str], name: str = "row_count") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name)).orderBy(*columns)


def multi_owner(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Non-blank keys that belong to more than one owner, with the owner count ``n``."""
    rows = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return rows.groupBy(key).agg(F.count_distinct(owner).alias("n")).filter("n > 1")


def check_grain(df: DataFrame, keys: Sequence[str], check_id: str = "grain") -> DataFrame:
    """One row: total rows, distinct keys and PASS or FAIL.

    Grouping by key first keeps the distinct count spread over all tasks.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    return per_key.agg(
        F.lit(check_id).alias("check_id"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count_if(has_key).alias("distinct_keys"),
    ).withColumn(
        "result", F.when(F.col("total_rows") == F.col("distinct_keys"), "PASS").otherwise("FAIL")
    )


def run_checks(
    df: DataFrame, key: str, zero: Mapping[str, Column], prefix: str = "CHECK"
) -> DataFrame:
    """A mart's check suite as rows: grain, each predicate of ``zero`` and non-empty.

    All counters come from a single pass that is grouped by key.
    """
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(p).alias(f"_z{i}") for i, p in enumerate(zero.values())],
    )
    totals = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(key).alias("keys"),
        *[F.coalesce(F.sum(f"_z{i}"), F.lit(0)).alias(f"z{i}") for i in range(len(zero))],
    )
    checks = [
        F.struct(
            F.lit(f"{prefix}-GRAIN").alias("check_id"),
            (F.col("rows") - F.col("keys")).alias("measure"),
            (F.col("rows") == F.col("keys")).alias("passed"),
        )
    ]
    for i, name in enumerate(zero):
        checks.append(
            F.struct(
                F.lit(f"{prefix}-{name}").alias("check_id"),
                F.col(f"z{i}").alias("measure"),
                (F.col(f"z{i}") == 0).alias("passed"),
            )
        )
    checks.append(
        F.struct(
            F.lit(f"{prefix}-NONEMPTY").alias("check_id"),
            F.col("rows").alias("measure"),
            (F.col("rows") > 0).alias("passed"),
        )
    )
    rows = totals.select(F.inline(F.array(*checks)))
    return rows.select(
        "check_id", "measure", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("result")
    )


def reject_summary(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("_rule_id").agg(
        F.count(F.lit(1)).alias("reject_count"), F.max("_rejected_ts").alias("last_rejected_at")
    )


def version_mix(df: DataFrame) -> DataFrame:
    return df.groupBy("_dq_rule_version").agg(F.count(F.lit(1)).alias("n_rows"))


def stale_rows(df: DataFrame, version: str) -> DataFrame:
    return df.agg(F.count_if(F.col("_dq_rule_version") != version).alias("stale_rows"))


def union_counts(tables: Mapping[str, DataFrame], name: str = "n_rows") -> DataFrame:
    """Row count per table, one row each."""
    parts = [
        df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias("table_name"), name)
        for t, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def needs_rescan(tables: Mapping[str, DataFrame], version: str) -> DataFrame:
    """Tables with rows under another rule version; ``*_rejects`` tables are skipped."""
    parts = [
        stale_rows(df, version).select(F.lit(t).alias("table_name"), "stale_rows")
        for t, df in tables.items()
        if not t.endswith("_rejects")
    ]
    return reduce(DataFrame.unionByName, parts).filter("stale_rows > 0")


def hash_collision_rate(df: DataFrame, hash_col: str = "_row_hash", limit: float = 0.1):
    """Share of rows whose hash repeats an earlier one, and whether it stays below ``limit``."""
    per_hash = df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_n"))
    rate = 1 - F.try_divide(F.count(hash_col), F.sum("_n"))
    return per_hash.agg(
        F.sum("_n").alias("n_rows"), F.count(hash_col).alias("n_hashes"), rate.alias("dup_rate")
    ).withColumn("passed", F.col("dup_rate") < limit)


def completeness_by(df: DataFrame, type_col: str, required: Mapping[str, Sequence[str]]):
    """NULLs in the columns each business type requires: (type, column, rows, missing)."""
    columns = sorted({c for cols in required.values() for c in cols})
    per_type = (
        df.filter(F.col(type_col).isin(list(required)))
        .groupBy(type_col)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)],
        )
    )
    cells = [
        F.when(
            F.col(type_col).isin([t for t, cols in required.items() if c in cols]),
            F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("missing")),
        )
        for i, c in enumerate(columns)
    ]
    return per_type.select(
        F.col(type_col).alias("type"), "n_rows", F.inline(F.array_compact(F.array(*cells)))
    )


# Price in US dollars of one input token and of one output token.
INPUT_PRICE = 3.00 / 1_000_000
OUTPUT_PRICE = 15.00 / 1_000_000


def run_kpis(runs: DataFrame) -> DataFrame:
    """Totals over runs(input_tokens, output_tokens, latency_ms, status) as one row.

    Cost is rounded to 6 digits per run and its sum to 4; run costs are summed as decimals
    so that the total does not depend on the order of addition.
    """
    cost = F.round(
        F.col("input_tokens") * F.lit(INPUT_PRICE) + F.col("output_tokens") * F.lit(OUTPUT_PRICE), 6
    )
    return runs.withColumn("_cost", cost.cast("decimal(18,6)")).agg(
        F.round(F.sum("_cost").cast("double"), 4).alias("total_cost_usd"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.count(F.lit(1)).alias("total_runs"),
        *[
            F.count_if(F.col("status") == s).alias(f"n_{s}")
            for s in ("pass", "fail", "fixed", "skipped")
        ],
    )


def psi(
    baseline: DataFrame, current: DataFrame, column: str, edges: Sequence[float]
) -> DataFrame:
    """Population stability index of ``column`` over the bins between ``edges``.

    Per bin: both shares and the bin's part of the index.  A bin that is empty on one side
    counts half a row there, so the logarithm stays finite.
    """

    def binned(df, name):
        bin_no = reduce(
            lambda acc, e: acc + F.when(F.col(column) >= F.lit(float(e)), 1).otherwise(0),
            edges,
            F.lit(0),
        )
        return (
            df.filter(F.col(column).isNotNull())
            .groupBy(bin_no.alias("bin"))
            .agg(F.count(F.lit(1)).alias(name))
        )

    bins = binned(baseline, "n_base").join(binned(current, "n_cur"), "bin", "full_outer")
    bins = bins.fillna(0, ["n_base", "n_cur"])
    sums = bins.agg(F.sum("n_base").alias("b"), F.sum("n_cur").alias("c"))
    p = F.greatest(F.col("n_base").cast("double"), F.lit(0.5))
    q = F.greatest(F.col("n_cur").cast("double"), F.lit(0.5))
    p = F.try_divide(p, sums.select("b").scalar())
    q = F.try_divide(q, sums.select("c").scalar())
    return bins.select("bin", "n_base", "n_cur", ((q - p) * (F.log(q) - F.log(p))).alias("psi"))
