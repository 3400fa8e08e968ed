"""Report and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from buylens.functions.columns import CRITICALITY
from buylens.operators import analytics as a
from buylens.operators import confidentiality as conf
from buylens.operators import statistics as s

AS_OF = "2001-06-30"
STATUSES = ["FULL_MATCH", "PRICE_VARIANCE", "QUANTITY_VARIANCE", "BOTH_VARIANCE"]


def invoices(t):
    """Invoices with vendor scores, the frame the exploration works on."""
    return t["invoice_header"].join(t["vendor_master"].select(
        "vendor_id", "quality_score", "risk_score", "on_time_delivery_rate", "vendor_type", "esg_score"), "vendor_id")


def full(t=None):
    return F.col("match_status") == "FULL_MATCH"


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


QUERIES = {
    "rq01_spend_by_vendor": a.spend_by_vendor,
    "rq01_spend_by_vendor_all": lambda t: a.spend_by_vendor(t, None),
    "rq02_spend_by_category": a.spend_by_category,
    "rq02_spend_by_top_category": lambda t: a.spend_by_category(t, None, 1),
    "rq02_spend_rollup": a.spend_rollup,
    "rq03_po_filter": lambda t: a.po_filter(t, "SENT", True, 1000, None),
    "rq04_invoice_aging": a.invoice_aging,
    "rq05_overdue_invoices": lambda t: a.overdue_invoices(t, AS_OF),
    "rq05_overdue_invoices_all": lambda t: a.overdue_invoices(t, AS_OF, None),
    "rq06_vendor_risk": a.vendor_risk,
    "rq07_critical_single_source": lambda t: a.critical_single_source(t, risk=40),
    "rq08_maverick_vs_contract": a.maverick_vs_contract,
    "rq09_aging_buckets": lambda t: a.aging_buckets(t, AS_OF),
    "rq10_contract_coverage_by_category": a.contract_coverage_by_category,
    "rq11_blocked_by_vendor": a.blocked_by_vendor,
    "e01_value_counts": lambda t: s.value_counts(t["invoice_header"], "match_status", STATUSES + ["NOT_CHECKED"]),
    "e02_monthly_volume": lambda t: s.monthly_volume(t["invoice_header"], "invoice_date"),
    "e03_crosstab": lambda t: s.crosstab(t["invoice_header"], F.concat(F.year("invoice_date"), F.lit("Q"), F.quarter("invoice_date")),
                                         "match_status", STATUSES),
    "e04_crosstab_pct": lambda t: s.crosstab_pct(invoices(t), "vendor_type", "match_status", STATUSES),
    "e05_crosstab_margins": lambda t: s.crosstab_margins(invoices(t), "vendor_type", "match_status"),
    "e06_match_rate_by_vendor": lambda t: s.rate_by(t["invoice_header"], "vendor_id", full(), 3, t["vendor_master"].select(
        "vendor_id", "quality_score", "risk_score")),
    "e07_five_number": lambda t: s.five_number(invoices(t), "match_status", "quality_score"),
    "e07_five_number_amounts": lambda t: s.five_number(t["invoice_header"], "match_status", "total_net_amount"),
    "e08_pearson": lambda t: rounded(s.pearson(t["vendor_master"], "quality_score", "risk_score"), "r", "t_statistic", "p_value"),
    "e08_pearson_small": lambda t: rounded(s.pearson(t["vendor_master"].filter("quality_score > 75"), "quality_score", "on_time_delivery_rate"), "r", "t_statistic", "p_value"),
    "e09_chi_square": lambda t: rounded(s.chi_square(invoices(t), "vendor_type", "match_status"), "chi2", "p_value"),
    "e09_chi_square_contract": lambda t: rounded(s.chi_square(t["invoice_header"].join(t["po_line_item"].groupBy("po_id").agg(
        F.max(F.col("contract_id").isNotNull()).alias("has_contract")), "po_id"), "has_contract", "match_status"), "chi2", "p_value"),
    "e10_corr_matrix": lambda t: rounded(s.corr_matrix(
        invoices(t), ["quality_score", "risk_score", "on_time_delivery_rate", "esg_score", "total_net_amount"]), "r"),
    "e11_histogram": lambda t: s.histogram(t["invoice_header"], "total_net_amount", 20, "match_status"),
    "e12_rejection_rate_by_status": lambda t: s.rate_by(
        t["invoice_line_item"].join(t["gr_line_item"].select("gr_id", "gr_line_number", "quantity_rejected"), ["gr_id", "gr_line_number"])
        .join(t["invoice_header"].select("invoice_id", "match_status"), "invoice_id"), "match_status", F.col("quantity_rejected") > 0),
    "e13_null_report": lambda t: s.null_report(t["po_line_item"]),
    "e14_describe": lambda t: rounded(s.describe(t["vendor_master"], ["quality_score", "risk_score", "esg_score", "on_time_delivery_rate"]),
                                      "mean", "std"),
    "e15_rate_by_band": lambda t: s.rate_by_band(invoices(t), "quality_score", [65, 75, 85], full()),
    "e16_risk_curve": lambda t: s.risk_curve(t["invoice_line_item"].select(
        F.concat_ws("/", "invoice_id", F.col("invoice_line_number").cast("string")).alias("line_id"), F.abs("price_variance").alias("score")), "score", "line_id"),
    "e17_stratified_sample": lambda t: s.stratified_sample(t["invoice_header"], "match_status", "invoice_id", 25).select("invoice_id", "match_status"),
    "pr01_mask_ids": lambda t: conf.mask_ids(
        t.raw("conversations").select("conv_id", "turn", "text").unionByName(
            t["pr_header"].select(F.regexp_extract("pr_id", r"\d+", 0).cast("bigint").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"),
                                  F.concat(F.lit("requested by S"), F.substring("pr_id", 5, 7), F.lit("D and T"), F.substring("pr_id", 5, 7),
                                           F.lit("Z, not X"), F.substring("pr_id", 5, 7)).alias("text"))), ["text"]),
    "pr02_redact": lambda t: conf.redact(t["vendor_master"].select("vendor_id", "vendor_name", "bank_account"), "INTERNAL").unionByName(
        conf.redact(t["vendor_master"].select("vendor_id", "vendor_name", "bank_account"), "RESTRICTED")),
}
