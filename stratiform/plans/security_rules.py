"""The rule catalogue and the table registry of the security model."""

from __future__ import annotations

from ..operators import quality as q

# Table, column, allowed values, known issues.
ENUMS = (
    ("product", "id_type", ("CUSIP", "ISIN", "SEDOL", "TICKER", "BLOOMBERG_ID"), "DQ00022"),
    ("product", "type", ("DEBT", "EQUITY", "FUND", "DERIVATIVE", "RIGHT"), ""),
    ("product", "status", ("ACTIVE", "INACTIVE", "MATURED", "SUSPENDED", "DELISTED"), "DQ00023"),
    ("product", "settlement_type", ("T+1", "T+2", "T+3", "CASH"), "DQ00024"),
    ("legal_entity", "legal_structure", ("CORP", "LLC", "LP", "TRUST", "GOVERNMENT"), "DQ00005"),
    ("fund", "endness_type", ("OPEN_END", "CLOSED_END"), "DQ00015"),
    ("fund", "mutual_fund_load_type", ("FRONT_LOAD", "BACK_LOAD", "NO_LOAD", "LEVEL_LOAD"), ""),
    ("fund", "mutual_fund_type", ("EQUITY", "FIXED_INCOME", "BALANCED", "MONEY_MARKET", "ALTERNATIVE"), ""),
    ("right", "exercise_style", ("AMERICAN", "EUROPEAN", "BERMUDAN"), ""),
    ("right", "option_type", ("CALL", "PUT"), ""),
    ("option", "option_type", ("CALL", "PUT"), ""),
    ("option", "exercise_style", ("AMERICAN", "EUROPEAN", "BERMUDAN"), "DQ00019"),
    ("option", "margin_style", ("PREMIUM", "FUTURES_STYLE"), ""),
    ("future", "valuation_method", ("MARK_TO_MARKET", "CASH_SETTLED", "PHYSICAL_DELIVERY"), ""),
    ("bond", "reference_index_rate", ("CPI", "LIBOR", "SOFR", "RPI"), ""),
    ("bond", "conversion_rule", ("MANDATORY", "OPTIONAL", "CONTINGENT", "NONE"), ""),
    ("muni", "pledge_type", ("GENERAL_OBLIGATION", "REVENUE", "DOUBLE_BARRELED"), ""),
    ("stock", "depository_type", ("DTC", "EUROCLEAR", "CLEARSTREAM", "PHYSICAL"), ""),
    ("preferred_stock", "dividend_right", ("CUMULATIVE", "NON_CUMULATIVE", "PARTICIPATING"), ""),
    ("tick", "price_range", ("TIER1", "TIER2", "TIER3"), ""),
    ("product_rating", "rating_agency", ("MOODYS", "SP", "FITCH", "DBRS"), "DQ00037"),
    ("product_rating", "watch_code", ("POSITIVE", "NEGATIVE", "STABLE", "DEVELOPING", "NONE"), ""),
    ("product_rating_type", "rating_type_code", ("ISSUER", "ISSUE", "SHORT_TERM", "LONG_TERM"), ""),
)
# Table, column, severity, known issues.
REQUIRED = (
    ("product", "product_id", q.CRITICAL, "DQ00021"),
    ("product", "id_type", q.HIGH, "DQ00022"),
    ("product", "type", q.HIGH, ""),
    ("product", "status", q.HIGH, "DQ00023"),
    ("product", "issuer_legal_entity_id", q.CRITICAL, "DQ00027"),
    ("product", "tick_ladder_scale_id", q.CRITICAL, "DQ00028"),
    ("legal_entity", "legal_entity_id", q.CRITICAL, ""),
    ("legal_entity", "legal_name", q.HIGH, "DQ00003"),
    ("currency", "code", q.CRITICAL, "DQ00001;DQ00002"),
    ("stock", "product_id", q.CRITICAL, ""),
    ("stock", "has_voting_rights", q.HIGH, "DQ00009"),
    ("debt", "product_id", q.CRITICAL, ""),
    ("option", "product_id", q.CRITICAL, ""),
    ("option", "exercise_style", q.HIGH, "DQ00019"),
    ("identifiers", "product_id", q.CRITICAL, ""),
    ("product_rating", "product_id", q.CRITICAL, "DQ00039"),
    ("product_rating", "rating_agency", q.HIGH, "DQ00037"),
)
# Table, key, known issues.  One column is a primary key, more are composite.
UNIQUE = (
    ("product", ("product_id",), "DQ00021"),
    ("legal_entity", ("legal_entity_id",), ""),
    ("currency", ("code",), "DQ00001;DQ00002"),
    ("series", ("series_id",), ""),
    ("tick_ladder_scale", ("tick_ladder_scale_id",), ""),
    ("product_rating_type", ("product_rating_type_id",), ""),
    ("tick", ("tick_id",), ""),
    ("principal_redemption_provision", ("principal_redemption_provision_id",), ""),
    ("generic_product", ("generic_product_id",), ""),
    ("classification", ("classification_id",), ""),
    ("identifiers", ("identifiers_id",), ""),
    ("product_rating", ("product_rating_id",), ""),
    ("coupon", ("coupon_id",), ""),
    ("stock", ("product_id",), ""),
    ("common_stock", ("product_id",), "DQ00008"),
    ("preferred_stock", ("product_id",), ""),
    ("debt", ("product_id",), ""),
    ("bond", ("product_id",), ""),
    ("muni", ("product_id",), "DQ00012"),
    ("pool_backed_security", ("product_id",), ""),
    ("fund", ("product_id",), ""),
    ("right", ("product_id",), ""),
    ("listed_derivative", ("product_id",), ""),
    ("option", ("product_id",), ""),
    ("future", ("product_id",), ""),
    ("listed_derivative_tick", ("product_id", "tick_id"), ""),
    ("debt_principal_redemption_provision", ("product_id", "principal_redemption_provision_id"), ""),
)
# The legacy shadow table has no key by design; its uniqueness rule is switched off.
NOT_UNIQUE = {"generic_product"}
# Table, column, pattern, whether a blank passes, known issues.
FORMATS = (
    ("identifiers", "cusip", "^[A-Z0-9]{9}$", True, "DQ00032"),
    ("identifiers", "isin", "^[A-Z]{2}[A-Z0-9]{9}[0-9]$", True, "DQ00033;DQ00035"),
    ("identifiers", "sedol", "^[A-Z0-9]{7}$", True, "DQ00034"),
    ("currency", "code", "^[A-Z]{3}$", False, "DQ00001;DQ00002"),
)
# Table, column, lower and upper bound, strict, known issues.
RANGES = (
    ("product", "issue_price", 0, None, False, "DQ00026"),
    ("product", "current_face_value", 0, None, False, ""),
    ("debt", "total_amount_issued", 0, None, False, "DQ00010"),
    ("debt", "par_value", 0, None, False, ""),
    ("right", "strike_price", 0, None, False, "DQ00016"),
    ("option", "strike_price", 0, None, False, ""),
    ("preferred_stock", "par_value", 0, None, False, ""),
    ("tick", "tick_size", 0, None, True, "DQ00006"),
    ("tick_ladder_scale", "tick_size", 0, None, True, ""),
    ("coupon", "coupon_rate", 0, 25, False, "DQ00013"),
    ("listed_derivative", "contract_month", 1, 12, False, "DQ00017"),
    ("principal_redemption_provision", "amount_outstanding", 0, None, False, ""),
)
# Table, date column, known issues.
PAST_DATES = (
    ("product", "issue_date", "DQ00025"),
    ("legal_entity", "formation_date", "DQ00004"),
    ("product_rating", "effective_from_date", "DQ00036"),
    ("listed_derivative", "last_trade_date", "DQ00018"),
)
# Table, column, parent table, parent column, known issues.
FOREIGN_KEYS = (
    ("product", "issuer_legal_entity_id", "legal_entity", "legal_entity_id", "DQ00027"),
    ("product", "tick_ladder_scale_id", "tick_ladder_scale", "tick_ladder_scale_id", "DQ00028"),
    ("generic_product", "product_id", "product", "product_id", ""),
    ("generic_product", "gs_legacy_prime_issue_currency", "currency", "code", "DQ00030"),
    ("classification", "product_id", "product", "product_id", "DQ00031"),
    ("identifiers", "product_id", "product", "product_id", ""),
    ("product_rating", "product_id", "product", "product_id", "DQ00039"),
    (
        "product_rating",
        "product_rating_type_id",
        "product_rating_type",
        "product_rating_type_id",
        "DQ00038",
    ),
    ("stock", "product_id", "product", "product_id", ""),
    ("stock", "series_id", "series", "series_id", ""),
    ("common_stock", "product_id", "stock", "product_id", "DQ00008"),
    ("preferred_stock", "product_id", "stock", "product_id", ""),
    ("debt", "product_id", "product", "product_id", ""),
    ("bond", "product_id", "debt", "product_id", ""),
    ("bond", "issue_currency_code", "currency", "code", "DQ00011"),
    ("muni", "product_id", "bond", "product_id", "DQ00012"),
    ("pool_backed_security", "product_id", "debt", "product_id", ""),
    ("fund", "product_id", "product", "product_id", ""),
    ("right", "product_id", "product", "product_id", ""),
    ("listed_derivative", "product_id", "product", "product_id", ""),
    ("listed_derivative", "series_id", "series", "series_id", ""),
    ("option", "product_id", "listed_derivative", "product_id", ""),
    ("option", "strike_currency_code", "currency", "code", ""),
    ("future", "product_id", "listed_derivative", "product_id", ""),
    ("coupon", "bond_id", "bond", "product_id", "DQ00014"),
    ("tick", "tick_currency_code", "currency", "code", "DQ00007"),
    ("listed_derivative_tick", "product_id", "listed_derivative", "product_id", ""),
    ("listed_derivative_tick", "tick_id", "tick", "tick_id", ""),
    ("debt_principal_redemption_provision", "product_id", "debt", "product_id", ""),
    (
        "debt_principal_redemption_provision",
        "principal_redemption_provision_id",
        "principal_redemption_provision",
        "principal_redemption_provision_id",
        "DQ00041",
    ),
)
# Subtype table, type its product must have, known issues.
SUBTYPES = (
    ("common_stock", "EQUITY", "DQ00008"),
    ("preferred_stock", "EQUITY", ""),
    ("debt", "DEBT", ""),
    ("fund", "FUND", ""),
    ("right", "RIGHT", ""),
    ("listed_derivative", "DERIVATIVE", ""),
)

# Tables in load order with their key columns and level; parents come first.
REGISTRY = (
    ("legal_entity", ("legal_entity_id",), 0),
    ("currency", ("currency_code",), 0),
    ("series", ("series_id",), 0),
    ("tick_ladder_scale", ("tick_ladder_scale_id",), 0),
    ("tick", ("tick_id",), 0),
    ("principal_redemption_provision", ("principal_redemption_provision_id",), 0),
    ("product_rating_type", ("product_rating_type_id",), 0),
    ("product", ("product_id",), 0),
    ("debt", ("product_id",), 1),
    ("bond", ("product_id",), 1),
    ("muni", ("product_id",), 1),
    ("pool_backed_security", ("product_id",), 1),
    ("stock", ("product_id",), 1),
    ("common_stock", ("product_id",), 1),
    ("preferred_stock", ("product_id",), 1),
    ("fund", ("product_id",), 1),
    ("right", ("product_id",), 1),
    ("listed_derivative", ("product_id",), 1),
    ("option", ("product_id",), 1),
    ("future", ("product_id",), 1),
    ("identifiers", ("identifier_id",), 2),
    ("classification", ("classification_id",), 2),
    ("product_rating", ("product_rating_id",), 2),
    ("coupon", ("coupon_id",), 2),
    ("listed_derivative_tick", ("product_id", "tick_id"), 3),
    ("debt_principal_redemption_provision", ("product_id", "principal_redemption_provision_id"), 3),
    ("generic_product", (), 4),
    ("dq_rules_catalog", ("rule_id",), 4),
    ("dq_issues_catalog", ("issue_id",), 4),
)


def security_rules(as_of) -> list[q.Rule]:
    """The whole catalogue, numbered in the order above.  ``as_of`` is "today"."""
    makers = []
    for table, column, values, issues in ENUMS:
        makers.append((q.enum_rule, (table, column, values), {"issues": issues}))
    for table, column, severity, issues in REQUIRED:
        makers.append((q.not_null_rule, (table, column, severity), {"issues": issues}))
    for table, keys, issues in UNIQUE:
        severity = q.CRITICAL if len(keys) == 1 else q.MEDIUM
        options = {"issues": issues, "enabled": table not in NOT_UNIQUE}
        makers.append((q.unique_rule, (table, keys, severity), options))
    makers.append(
        (q.owner_rule, ("identifiers", "isin", "product_id"), {"issues": "DQ00033;DQ00035"})
    )
    for table, column, pattern, blank_ok, issues in FORMATS:
        options = {"blank_ok": blank_ok, "issues": issues}
        makers.append((q.regex_rule, (table, column, pattern), options))
    makers.append((q.trim_rule, ("product", "description"), {"issues": "DQ00029"}))
    for table, column, lo, hi, strict, issues in RANGES:
        makers.append((q.range_rule, (table, column, lo, hi, strict), {"issues": issues}))
    for table, column, issues in PAST_DATES:
        makers.append((q.not_future_rule, (table, column, as_of), {"issues": issues}))
    delivery = ("future", "first_delivery_datetime_utc", "last_delivery_datetime_utc")
    makers.append((q.field_order_rule, delivery, {"issues": "DQ00020"}))
    trading = (
        "listed_derivative", "last_trade_date", "product_id", "product", "product_id", "issue_date",
    )
    makers.append((q.table_order_rule, trading, {"issues": "DQ00018"}))
    for table, column, parent, parent_column, issues in FOREIGN_KEYS:
        makers.append((q.fk_rule, (table, column, parent, parent_column), {"issues": issues}))
    by_type = ("product_id", "product", "product_id", "type")
    for table, expected, issues in SUBTYPES:
        makers.append((q.discriminator_rule, (table, *by_type, expected), {"issues": issues}))
    muni = {"sibling": ("bond", "product_id"), "issues": "DQ00012"}
    makers.append((q.discriminator_rule, ("muni", *by_type, "DEBT"), muni))
    return [
        make(f"RULE{n:04d}", *args, **options)
        for n, (make, args, options) in enumerate(makers, start=1)
    ]
