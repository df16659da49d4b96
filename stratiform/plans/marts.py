"""Gold marts over a security model with class-table inheritance.

``t`` maps table names to silver frames.  Every mart names the build time it stamps, so a
rebuild of the same data gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import count_by, run_checks
from ..operators.joins import Branch, current_only, flatten, lookup
from ..operators.projections import coalesce_priority, derive_when, select_as, typed_null
from ..operators.windows import dedupe, latest_per_key

Tables = Mapping[str, DataFrame]

# Identifier columns in order of preference, with their labels.
IDENTIFIERS = (
    ("ISIN", "isin"),
    ("CUSIP", "cusip"),
    ("SEDOL", "sedol"),
    ("BLOOMBERG_ID", "bloomberg_id"),
    ("TICKER", "bloomberg_ticker"),
)
# Known security types, and the sub-types with a settlement amount.
TYPES = ("EQUITY", "DEBT", "FUND", "DERIVATIVE", "RIGHT")
SETTLED = ("BOND", "MUNI")


def latest_coupon(coupon: DataFrame) -> DataFrame:
    """(bond_id, coupon_rate, payment_date) of each bond's last payment date."""
    rows = coupon.select("bond_id", "coupon_rate", "payment_date")
    return latest_per_key(
        rows, ["bond_id"], [F.desc("payment_date")], [F.desc("coupon_rate")]
    )


def latest_rating(rating: DataFrame) -> DataFrame:
    columns = ["rating_code", "effective_from_date", "rating_agency", "product_rating_type_id"]
    rows = current_only(rating).select("product_id", *columns)
    tie = [F.asc(c) for c in ("rating_code", "rating_agency", "product_rating_type_id")]
    return latest_per_key(rows, ["product_id"], [F.desc("effective_from_date")], tie)


def primary_identifier(identifiers: DataFrame) -> DataFrame:
    """The preferred identifier of each product."""
    label, value = coalesce_priority(IDENTIFIERS)
    rows = identifiers.filter(F.col("product_id").isNotNull()).select(
        "product_id", label.alias("primary_id_type"), value.alias("primary_identifier_value")
    )
    order = F.array_position(F.array(*[F.lit(n) for n, _ in IDENTIFIERS]), F.col("primary_id_type"))
    return dedupe(
        rows, ["product_id"], [F.asc_nulls_last(order), F.asc("primary_identifier_value")]
    )


def wide_mart(t: Tables, built_at) -> DataFrame:
    """One row per current product with the attributes of all its subtype tables.

    The issuer comes first, while the rows are narrow: its key is the one that may be hot,
    and a skewed join before the exchange on ``product_id`` can be split freely.  All other
    branches join on ``product_id`` and share that one exchange, however many there are.
    """
    by_id = lambda name, columns: Branch(
        t[name], "product_id", "product_id", columns, current=True
    )
    root = current_only(t["product"]).select(
        "product_id", "id_type", "type", "sub_type", "status", "description",
        "issuer_legal_entity_id", "issue_date", "issue_price", "current_face_value",
        "effective_start_date", "effective_end_date", "_dq_rule_version",
    )
    same = lambda *names: {n: n for n in names}
    branches = [
        Branch(
            t["legal_entity"], "issuer_legal_entity_id", "legal_entity_id",
            {"issuer_legal_name": "legal_name", "issuer_legal_structure": "legal_structure"},
            current=True,
        ),
        Branch(
            primary_identifier(t["identifiers"]), "product_id", "product_id",
            same("primary_id_type", "primary_identifier_value"),
        ),
        by_id("stock", {"common_stock_voting_rights": "has_voting_rights",
                        "stock_series_id": "series_id"}),
        by_id("preferred_stock", {"preferred_stock_dividend_type": "dividend_right"}),
        by_id("fund", {"fund_endness_type": "endness_type",
                       "fund_mutual_fund_type": "mutual_fund_type"}),
        by_id("debt", {"debt_face_amount": "total_amount_issued"}),
        by_id("bond", {"bond_face_currency_code": "issue_currency_code"}),
        by_id("muni", {"muni_pledge_type": "pledge_type"}),
        by_id("pool_backed_security", {"pool_backed_wac": "weighted_average_coupon",
                                       "pool_backed_net_coupon": "net_coupon"}),
        Branch(
            latest_coupon(t["coupon"]), "product_id", "bond_id",
            {"latest_coupon_rate": "coupon_rate", "latest_coupon_payment_date": "payment_date"},
        ),
        by_id("listed_derivative", {"derivative_series_id": "series_id"}),
        by_id("option", {"option_type": "option_type", "option_exercise_style": "exercise_style",
                         "option_strike_price": "strike_price"}),
        by_id("future", {"future_first_delivery_dt": "first_delivery_datetime_utc",
                         "future_valuation_method": "valuation_method"}),
        Branch(
            latest_rating(t["product_rating"]), "product_id", "product_id",
            {"latest_rating_value": "rating_code", "latest_rating_date": "effective_from_date",
             "latest_rating_agency": "rating_agency",
             "latest_rating_type_id": "product_rating_type_id"},
        ),
    ]
    return flatten(root, branches).select(
        "product_id", "id_type", "type", "sub_type", "status", "description",
        "primary_id_type", "primary_identifier_value",
        "issuer_legal_entity_id", "issuer_legal_name", "issuer_legal_structure",
        "issue_date", "issue_price", "current_face_value",
        "effective_start_date", "effective_end_date",
        "common_stock_voting_rights", "preferred_stock_dividend_type", "stock_series_id",
        "fund_endness_type", "fund_mutual_fund_type",
        "debt_face_amount", "bond_face_currency_code", "muni_pledge_type",
        "pool_backed_wac", "pool_backed_net_coupon",
        "latest_coupon_rate", "latest_coupon_payment_date",
        typed_null("derivative_underlying_product_id", "string"),
        "derivative_series_id", "option_type", "option_exercise_style", "option_strike_price",
        "future_first_delivery_dt", "future_valuation_method",
        "latest_rating_value", "latest_rating_date", "latest_rating_agency",
        "latest_rating_type_id", "_dq_rule_version",
        F.lit(built_at).cast("timestamp").alias("_gold_built_at"),
    )


def net_settlement(face: str = "current_face_value", rate: str = "latest_coupon_rate") -> Column:
    """Face value times one plus the rate for bonds and munis, else NULL."""
    return derive_when(
        "net_settlement_amount",
        F.col("sub_type").isin(*SETTLED),
        F.col(face) * (F.lit(1).cast("decimal(1,0)") + F.col(rate)),
    )


def add_gold_column(
    mart: DataFrame,
    column: Column | None = None,
    *,
    source: DataFrame | None = None,
    mart_key: str = "",
    source_key: str = "",
    source_column: str = "",
    name: str = "",
) -> DataFrame:
    """The mart plus one column: derived from its own columns, or surfaced from a source
    with a unique key.  All other columns stay as they are."""
    if column is not None:
        return mart.select("*", column)
    return lookup(mart, source, mart_key, source_key, {name: source_column})


def product_dimension(t: Tables, built_at) -> DataFrame:
    """Flattened product dimension; the series comes from the stock or the derivative."""
    b = lambda name, columns: Branch(
        t[name], "product_id", "product_id", columns, current=True
    )
    root = current_only(t["product"])
    wide = flatten(
        root,
        [
            Branch(
                t["legal_entity"], "issuer_legal_entity_id", "legal_entity_id",
                {"issuer_legal_name": "legal_name"}, current=True,
            ),
            b("stock", {"_stock_series": "series_id"}),
            b("preferred_stock", {"dividend_right": "dividend_right"}),
            b("fund", {"endness_type": "endness_type", "mutual_fund_type": "mutual_fund_type"}),
            b("debt", {"total_amount_issued": "total_amount_issued"}),
            b("bond", {"coupon_type": "coupon_type", "maturity_date": "maturity_date"}),
            b("muni", {"pledge_type": "pledge_type"}),
            b("listed_derivative", {"_derivative_series": "series_id"}),
            b("option", {"option_type": "option_type", "strike_price": "strike_price"}),
            b("future", {"valuation_method": "valuation_method"}),
        ],
    )
    return wide.select(
        "product_id", "id_type", "type", "sub_type", "status", "description", "issue_date",
        "issue_price", "current_face_value", "issuer_legal_entity_id", "issuer_legal_name",
        F.coalesce("_stock_series", "_derivative_series").alias("series_id"),
        "dividend_right", "endness_type", "mutual_fund_type", "total_amount_issued",
        "coupon_type", "maturity_date", "pledge_type", "option_type", "strike_price",
        "valuation_method", "effective_start_date", "effective_end_date", "_dq_rule_version",
        F.lit(built_at).cast("timestamp").alias("_gold_build_ts"),
    )


def entity_dimension(t: Tables, built_at) -> DataFrame:
    columns = [
        "legal_entity_id", "legal_name", "country", "entity_type",
        "effective_start_date", "effective_end_date", "_dq_rule_version",
    ]
    stamp = F.lit(built_at).cast("timestamp")
    return select_as(
        current_only(t["legal_entity"]), {c: c for c in columns} | {"_gold_build_ts": stamp}
    )


def rating_fact(t: Tables, built_at) -> DataFrame:
    """One row per product, start date and rating type."""
    wide = flatten(
        current_only(t["product_rating"]),
        [
            Branch(
                t["product_rating_type"], "product_rating_type_id", "product_rating_type_id",
                {"rating_scale": "rating_scale", "rating_type_code": "rating_type_code"},
            ),
            Branch(
                t["product"], "product_id", "product_id",
                {"product_type": "type", "product_status": "status"}, current=True,
            ),
        ],
    )
    return wide.select(
        "product_rating_id", "product_id", "product_rating_type_id", "rating_agency",
        F.col("rating_code").alias("rating_value"), "effective_from_date", "watch_code",
        "rating_scale", "rating_type_code", "product_type", "product_status",
        "effective_start_date", "effective_end_date", "_dq_rule_version",
        F.lit(built_at).cast("timestamp").alias("_gold_build_ts"),
    )


def coupon_schedule(t: Tables, built_at) -> DataFrame:
    """One row per bond and coupon."""
    product = current_only(t["product"]).select(
        F.col("product_id").alias("_pid"),
        F.col("status").alias("product_status"),
        "issuer_legal_entity_id",
        "issue_date",
    )
    rows = t["coupon"].join(product, F.col("bond_id") == F.col("_pid")).drop("_pid")
    wide = flatten(
        rows,
        [
            Branch(
                t["bond"], "bond_id", "product_id",
                {"bond_coupon_type": "coupon_type", "maturity_date": "maturity_date",
                 "face_currency_code": "issue_currency_code"},
                current=True,
            )
        ],
    )
    return wide.select(
        "coupon_id", F.col("bond_id").alias("product_id"), "coupon_rate", "payment_date",
        "coupon_type", "frequency", "bond_coupon_type", "maturity_date", "face_currency_code",
        "product_status", "issuer_legal_entity_id", "issue_date",
        F.lit(built_at).cast("timestamp").alias("_gold_build_ts"),
    )


def mart_checks(mart: DataFrame) -> DataFrame:
    """The mart's own checks: grain, no NULL key, known types, non-empty."""
    return run_checks(
        mart,
        "product_id",
        {
            "NULL-KEY": F.col("product_id").isNull(),
            "DOMAIN": ~F.col("type").isin(*TYPES),
        },
        prefix="GOLD",
    )


def reconcile(mart: DataFrame, source: DataFrame) -> DataFrame:
    """One row: mart rows against current source rows."""
    n = F.count(F.lit(1))
    source_rows = current_only(source).agg(n.alias("source_rows"))
    return (
        mart.agg(n.alias("mart_rows"))
        .withColumn("source_rows", source_rows.scalar())
        .withColumn(
            "result",
            F.when(F.col("mart_rows") == F.col("source_rows"), "PASS").otherwise("FAIL"),
        )
    )


# --- questions asked of the mart ------------------------------------------------------------


def by_type(mart: DataFrame) -> DataFrame:
    return count_by(mart, ["type"], "n_securities")


def by_type_and_subtype(mart: DataFrame) -> DataFrame:
    return count_by(mart, ["type", "sub_type"])


def by_currency(mart: DataFrame) -> DataFrame:
    return count_by(mart, ["bond_face_currency_code"], "n_securities")


def by_issuer(mart: DataFrame) -> DataFrame:
    return count_by(mart, ["issuer_legal_name"], "n_securities")


def average_rate_by_type(mart: DataFrame) -> DataFrame:
    rate = F.avg(F.col("latest_coupon_rate").cast("double"))
    return mart.groupBy("type").agg(F.round(rate, 6).alias("avg_coupon_rate"))


def total_by_type(mart: DataFrame, measure: str) -> DataFrame:
    return mart.groupBy("type").agg(F.sum(measure).alias("total"))


def rated(mart: DataFrame, value: str, agency: str | Sequence[str]) -> DataFrame:
    agencies = [agency] if isinstance(agency, str) else list(agency)
    return mart.filter(
        (F.col("latest_rating_value") == value) & F.col("latest_rating_agency").isin(agencies)
    ).select("product_id", "description", "type")
