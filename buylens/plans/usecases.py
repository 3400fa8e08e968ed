"""Use-case queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from buylens.plans.features import AS_OF, rounded
from buylens.session import splittable
from buylens.usecases import finance, invoice_match as im, masterdata, sourcing, vendors

FLOAT_SUMS = ["p_std_unit_price", *im.BEHAVIOR]


def base(t):
    return im.uc02_base(t)


def trend(metric, by_reason=False):
    return lambda t: vendors.vendor_trend(t, metric, by_reason)


QUERIES = {
    "u201_uc02_base": base,
    "u202_temporal_features": lambda t: im.temporal_features(base(t)).select("invoice_id", "invoice_line_number", *im.TEMPORAL),
    "u203_uc02_features": lambda t: im.uc02_features(base(t)).select("invoice_id", "invoice_line_number", *im.SPECIFIC),
    # The numbering reads its rows twice: they are written out narrow first.
    "u204_vendor_invoice_seq": lambda t: im.vendor_invoice_seq(splittable(base(t).select("invoice_id", "invoice_line_number", "vendor_id", "invoice_date"))).select(
        "invoice_id", "invoice_line_number", "vendor_id", "uc02_vendor_invoice_seq"),
    "u205_invoice_amount_ratio": im.invoice_amount_ratio,
    "u206_match_labels": lambda t: im.match_labels(base(t)).select("invoice_id", "invoice_line_number", "target_binary", "target_multiclass"),
    "u207_uc02_table_train": lambda t: rounded(im.feature_columns(im.uc02_table(t)), *FLOAT_SUMS, places=4),
    "u207_uc02_table_serve": lambda t: rounded(im.feature_columns(im.uc02_table(t, leave_one_out=False)), *FLOAT_SUMS, places=4),
    "u208_feature_matrix_class": lambda t: im.feature_columns(im.uc02_table(t), "target_multiclass", im.SPECIFIC + im.TEMPORAL),
    "u208_feature_vector": lambda t: im.feature_matrix(im.uc02_table(t), "target_multiclass", im.SPECIFIC + im.TEMPORAL).select(
        "invoice_id", "invoice_line_number", vector_to_array("features").alias("features"), "label"),
    "u208_feature_matrix_all": lambda t: rounded(im.feature_columns(im.uc02_table(t), "target_multiclass"), *FLOAT_SUMS, places=4),
    "u209_missing_flag": lambda t: im.missing_flag(base(t), "contract_agreed_price").select(
        "invoice_id", "invoice_line_number", "has_contract_agreed_price"),
    "u210_leakage_report": lambda t: rounded(im.leakage_report(
        im.feature_columns(im.uc02_table(t), features=im.SPECIFIC + im.PROFILE + im.SCORES), im.SPECIFIC + im.PROFILE + im.SCORES), "abs_corr"),
    "u210_leakage_report_all": lambda t: rounded(im.leakage_report(
        rounded(im.feature_columns(im.uc02_table(t)), *FLOAT_SUMS, places=4), im.FEATURES), "abs_corr", places=4),
    "u211_drop_leakage": lambda t: im.drop_leakage(t["invoice_header"].join(t["invoice_line_item"].drop("po_id"), "invoice_id")),
    "u101_uc01_features": lambda t: sourcing.uc01_features(t, with_notes=True),
    "u102_maverick_rule": lambda t: sourcing.maverick_rule(sourcing.uc01_features(t)),
    "u301_uc03_features": vendors.uc03_features,
    "u302_derived_risk": lambda t: rounded(vendors.derived_risk(t), "risk_derived"),
    "u401_uc04_features": lambda t: rounded(sourcing.uc04_features(t), "uc04_price_zscore", "uc04_vendor_avg_premium", places=4),
    "u402_price_anomalies": lambda t: sourcing.price_anomalies(sourcing.uc04_features(t)).select("po_id", "po_line_number", "material_id"),
    "u402_price_anomalies_top": lambda t: sourcing.price_anomalies(sourcing.uc04_features(t), k=50).select("po_id", "po_line_number"),
    "u403_price_outliers_mad": lambda t: sourcing.price_outliers_robust(t),
    "u403_price_outliers_iqr": lambda t: sourcing.price_outliers_robust(t, "iqr"),
    "u501_uc05_features": sourcing.uc05_features,
    "u502_late_label": lambda t: sourcing.late_label(t["po_line_item"]),
    "u601_uc06_features": lambda t: rounded(finance.uc06_features(t, AS_OF), "c_consumption_pct", "uc06_consumption_velocity", "uc06_vendor_performance_score"),
    "u602_renewal_rule": lambda t: finance.renewal_rule(finance.uc06_features(t, AS_OF), pct=0.4),
    "u602_renewal_rule_70": lambda t: finance.renewal_rule(finance.uc06_features(t, AS_OF)),
    "u701_uc07_features": lambda t: rounded(finance.uc07_features(t, AS_OF), "uc07_vendor_strategic_score"),
    "u702_payment_plan": finance.payment_plan,
    "u703_discount_portfolio": lambda t: rounded(finance.discount_portfolio(finance.payment_plan(t)), "annual_return"),
    "u801_concentration": lambda t: rounded(vendors.concentration(t), "hhi"),
    "u801_concentration_by_category": lambda t: rounded(vendors.concentration(t, "category_id", "legal_entity_id"), "hhi"),
    "u801_uc08_features": lambda t: rounded(vendors.uc08_features(t), "uc08_hhi_by_material", "uc08_hhi_by_legal_entity", "uc08_geographic_hhi",
                                            "uc08_hhi_by_category"),
    "u802_concentration_tier": lambda t: vendors.concentration_tier(vendors.uc08_features(t)),
    "u803_what_if_loss": lambda t: vendors.what_if_loss(t, countries=["CN", "JP", "VN", "TW", "MY"]),
    "u804_alternative_vendors": vendors.alternative_vendors,
    "u901_uc09_features": vendors.uc09_features,
    "u902_trend_rejection": trend("rejection_rate"),
    "u902_trend_rejection_by_reason": trend("rejection_rate", True),
    "u902_trend_late_share": trend("late_share"),
    "u902_trend_price_variance": trend("price_variance"),
    "u1001_uc10_features": sourcing.uc10_features,
    "u1002_pr_priority": lambda t: sourcing.pr_priority(sourcing.uc10_features(t)),
    "u1002_priority_queue": lambda t: sourcing.priority_queue(sourcing.uc10_features(t)),
    "u1101_duplicate_links": lambda t: finance.duplicate_links(t["invoice_header"]),
    "u1102_duplicate_counts": lambda t: finance.duplicate_counts(t["invoice_header"]),
    "u1103_fuzzy_pairs": lambda t: finance.fuzzy_pairs(t["invoice_header"], t["invoice_line_item"]),
    "u1201_uc12_features": masterdata.uc12_features,
    "u1203_category_profile": masterdata.category_profile,
    "u1301_uc13_features": masterdata.uc13_features,
    "u1302_tier_discrepancies": masterdata.tier_discrepancies,
}
