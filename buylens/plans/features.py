"""Feature-group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from buylens.features import groups, invoice, price, vendor

AS_OF = "2001-06-30"


def rounded(df, *columns, places=6):
    """Results of floating-point sums, cut where the order of additions cannot show."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def performance(t, **kw):
    return vendor.vendor_performance(t["po_header"], t["po_line_item"], t["gr_line_item"], **kw)


def behavior(t, **kw):
    return invoice.invoice_behavior(t["invoice_header"], t["invoice_line_item"], **kw)


def loo(t):
    return invoice.invoice_behavior_loo(t["invoice_header"], t["invoice_line_item"])


def benchmarks(t):
    return price.price_benchmarks(t["po_line_item"], t["material_master"], t["contract_item"])


QUERIES = {
    "f01_vendor_profile": lambda t: vendor.vendor_profile(t["vendor_master"], t["vendor_category"]),
    "f02_vendor_performance": performance,
    "f02_vendor_performance_late": lambda t: performance(t, late_only=True),
    "f02b_vendor_po_frequency": lambda t: rounded(vendor.vendor_po_frequency(t["po_header"]), "v_po_frequency_monthly"),
    "f03_invoice_behavior": lambda t: rounded(behavior(t), "v_avg_price_variance_pct"),
    "f03_invoice_behavior_by_line": lambda t: rounded(behavior(t, grain="line"), "v_avg_price_variance_pct"),
    "f03b_invoice_to_payment_days": lambda t: vendor.invoice_to_payment_days(t["invoice_header"], t["payment_invoice_link"], t["payment"]),
    "f04_invoice_behavior_loo": lambda t: rounded(loo(t), *[f"{r}_loo" for r in invoice.RATES]),
    "f05_price_benchmarks": lambda t: rounded(benchmarks(t), "p_std_unit_price", places=4),
    "f05b_price_trend": lambda t: rounded(price.price_trend(
        t["po_line_item"], t["po_header"], t["material_master"], t["contract_header"], t["contract_item"], AS_OF),
        "p_std_unit_price", places=4),
    "f06_material_risk": lambda t: rounded(groups.material_risk(
        t["material_master"], t["source_list"], t["contract_header"], t["contract_item"]), "m_standard_cost_log"),
    "f07_contract_status": lambda t: rounded(groups.contract_status(t["contract_header"], t["contract_item"], AS_OF),
                                             "c_consumption_rate_monthly", "c_months_active", places=7),
    "f08_category_spend": lambda t: groups.category_spend(t["category_hierarchy"], t["material_master"], t["po_header"], t["po_line_item"]),
    "f09_pair_performance": lambda t: rounded(groups.pair_performance(t["po_header"], t["po_line_item"], t["gr_line_item"]), "vm_price_stability"),
    "f10_vendor_geo": lambda t: vendor.vendor_geo(t["vendor_master"], t["vendor_address"], t["legal_entity"]),
    "f11_vendor_scores": lambda t: vendor.vendor_scores(t["vendor_master"]),
}
