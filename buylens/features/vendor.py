"""Vendor feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import (CONFIDENTIALITY, COUNTRY_RISK, REGION, VENDOR_STATUS, flag, has_discount, lookup,
                                       mean, one_hot, ordinal, ratio, share, terms_days)

# The vendor types that get an indicator each.
VENDOR_TYPES = ["OEM", "DISTRIBUTOR", "CONTRACT_MFG", "LOGISTICS", "SERVICE"]


def vendor_profile(vendors: DataFrame, vendor_categories: DataFrame) -> DataFrame:
    counts = vendor_categories.groupBy("vendor_id").agg(F.countDistinct("category_id").alias("v_category_count"))
    return vendors.join(counts, "vendor_id", "left").select(
        "vendor_id", *one_hot("vendor_type", VENDOR_TYPES, "v_type"), flag(F.col("preferred_flag")).alias("v_preferred"),
        ordinal("status", VENDOR_STATUS).alias("v_status_encoded"), ordinal("country", COUNTRY_RISK).alias("v_country_risk"),
        terms_days("payment_terms").alias("v_payment_terms_days"), flag(has_discount("payment_terms")).alias("v_has_early_discount"),
        ordinal("confidentiality_tier", CONFIDENTIALITY).alias("v_confidentiality_ordinal"),
        F.coalesce("v_category_count", F.lit(0)).alias("v_category_count"))


def _delivered(po_headers: DataFrame, po_lines: DataFrame, keys: list[str], late_only: bool) -> DataFrame:
    delay = F.datediff("actual_delivery_date", "requested_delivery_date")
    counted = delay > 0 if late_only else delay.isNotNull()
    return po_lines.join(po_headers.select("po_id", "vendor_id"), "po_id").groupBy(*keys).agg(
        F.count(delay).alias("deliveries"), F.sum(flag(delay <= 0)).alias("on_time"),
        F.sum(flag(counted)).alias("delay_count"), F.sum(F.when(counted, delay)).alias("delay_days"))


def performance_parts(po_headers: DataFrame, po_lines: DataFrame, gr_lines: DataFrame, late_only: bool = False, delivered: DataFrame | None = None) -> DataFrame:
    """Additive parts of the vendor performance, one row per vendor; parts of disjoint
    batches of orders can be added up."""
    owner = po_headers.select("po_id", "vendor_id")
    orders = po_headers.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("po_count"), F.sum("total_net_value").alias("po_value"))
    if delivered is None:
        delivered = _delivered(po_headers, po_lines, ["vendor_id"], late_only)
    received = gr_lines.join(owner, "po_id").groupBy("vendor_id").agg(
        F.sum("quantity_received").alias("received"), F.sum("quantity_rejected").alias("rejected"))
    return orders.join(delivered, "vendor_id", "left").join(received, "vendor_id", "left")


def performance_from_parts(parts: DataFrame, *more: str) -> DataFrame:
    # No received quantity means no rejections.
    rejection = F.when(F.col("received") > 0, ratio(F.col("rejected"), F.col("received"))).otherwise(0.0)
    return parts.select(
        "vendor_id", F.col("po_count").alias("v_total_po_count"), F.col("po_value").cast("decimal(18,2)").alias("v_total_po_value"),
        ratio(F.col("po_value"), F.col("po_count")).alias("v_avg_po_value"),
        F.coalesce(ratio(F.col("on_time"), F.col("deliveries")), F.lit(0.5)).alias("v_on_time_delivery_actual"),
        F.coalesce(ratio(F.col("delay_days"), F.col("delay_count")), F.lit(0.0)).alias("v_avg_delivery_delay_days"),
        rejection.alias("v_rejection_rate"), *more)


def vendor_performance(po_headers: DataFrame, po_lines: DataFrame, gr_lines: DataFrame, late_only: bool = False) -> DataFrame:
    """Order, delivery and rejection history; vendors without deliveries get 0.5 on time."""
    # Deliveries by vendor and material give the distinct materials, too: the order lines are joined once for both.
    delivered = _delivered(po_headers, po_lines, ["vendor_id", "material_id"], late_only).groupBy("vendor_id").agg(
        F.count("material_id").alias("v_distinct_materials"), *[F.sum(c).alias(c) for c in ("deliveries", "on_time", "delay_count", "delay_days")])
    parts = performance_parts(po_headers, po_lines, gr_lines, late_only, delivered)
    return performance_from_parts(parts, "v_distinct_materials").na.fill(0, ["v_distinct_materials"])


def vendor_po_frequency(po_headers: DataFrame) -> DataFrame:
    """Orders per active month; shorter histories count as one month."""
    span = po_headers.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.min("po_date").alias("lo"), F.max("po_date").alias("hi"))
    months = F.greatest(F.months_between("hi", "lo"), F.lit(1.0))
    return span.select("vendor_id", (F.col("n") / months).alias("v_po_frequency_monthly"))


def invoice_to_payment_days(invoices: DataFrame, links: DataFrame, payments: DataFrame) -> DataFrame:
    days = F.datediff("payment_date", "invoice_date")
    return (links.select("invoice_id", "payment_id").join(payments.select("payment_id", "payment_date"), "payment_id")
            .join(invoices.select("invoice_id", "invoice_date", "vendor_id"), "invoice_id")
            .groupBy("vendor_id").agg(mean(days).alias("v_avg_invoice_to_payment_days")))


def vendor_geo(vendors: DataFrame, addresses: DataFrame, entities: DataFrame) -> DataFrame:
    places = addresses.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("country").alias("countries"))
    return (vendors.select("vendor_id", "country", "legal_entity_id", "alias_group")
            .join(entities.select("legal_entity_id", "country_of_incorporation"), "legal_entity_id", "left")
            .join(places, "vendor_id", "left").select(
        "vendor_id", F.col("country").alias("vg_country_code"), lookup("country", REGION, "OTHER").alias("vg_region"),
        F.col("country_of_incorporation").alias("vg_incorporation_country"),
        flag(F.col("country") != F.col("country_of_incorporation")).alias("vg_cross_border"),
        F.coalesce("n", F.lit(0)).alias("vg_address_count"), flag(F.col("countries") > 1).alias("vg_multi_country"),
        F.col("alias_group").alias("vg_alias_group")))


def vendor_scores(vendors: DataFrame) -> DataFrame:
    return vendors.select("vendor_id", *[F.col(c).alias(f"uc02_vendor_{n}") for c, n in (
        ("quality_score", "quality_score"), ("risk_score", "risk_score"), ("on_time_delivery_rate", "otd_rate"), ("esg_score", "esg_score"))])
