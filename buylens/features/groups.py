"""Material, contract, category and vendor-material feature groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import CONFIDENTIALITY, CRITICALITY, flag, mean, one_hot, ordinal, ratio
from buylens.operators.contracts import active_items

# The material types that get an indicator each.
MATERIAL_TYPES = ["COMPONENT", "RAW", "ASSEMBLY", "MRO", "SERVICE"]


def material_risk(materials: DataFrame, source_list: DataFrame, contract_headers: DataFrame, items: DataFrame) -> DataFrame:
    at_plant = source_list.groupBy("material_id", "plant_id").agg(F.countDistinct("vendor_id").alias("n"))
    sources = at_plant.groupBy("material_id").agg(F.max("n").alias("m_source_count"), F.min("n").alias("m_min_source_count"))
    covered = active_items(contract_headers, items).select("material_id").distinct().withColumn("hit", F.lit(1))
    return materials.join(sources, "material_id", "left").join(covered, "material_id", "left").select(
        "material_id", ordinal("criticality", CRITICALITY).alias("m_criticality_ordinal"),
        *one_hot("material_type", MATERIAL_TYPES, "m_type"), F.col("standard_cost").alias("m_standard_cost"),
        F.log1p(F.col("standard_cost").cast("double")).alias("m_standard_cost_log"),
        F.coalesce("m_source_count", F.lit(0)).alias("m_source_count"), F.coalesce("m_min_source_count", F.lit(0)).alias("m_min_source_count"),
        F.coalesce("hit", F.lit(0)).alias("m_contract_covered"), flag(F.col("hazmat_flag")).alias("m_hazmat"),
        F.col("default_lead_time_days").alias("m_lead_time_days"),
        ordinal("confidentiality_tier", CONFIDENTIALITY).alias("m_confidentiality_ordinal"),
        flag(F.col("make_or_buy") == "BUY").alias("m_make_or_buy"))


def consumption_pct() -> Column:
    return F.when(F.col("contract_type") == "QUANTITY", ratio(F.col("consumed_quantity"), F.col("max_quantity"))).otherwise(
        ratio(F.col("consumed_value"), F.col("target_value")))


def contract_status(headers: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Expiry and consumption of every contract item on a day."""
    day = F.lit(as_of).cast("date")
    months = F.months_between(F.least(day, F.col("valid_to")), F.col("valid_from"))
    return items.join(headers.select("contract_id", "contract_type", "status", "valid_from", "valid_to"), "contract_id").select(
        "contract_id", "item_number", F.datediff("valid_to", day).alias("c_days_to_expiry"),
        flag(F.col("status") == "ACTIVE").alias("c_is_active"), consumption_pct().alias("c_consumption_pct"),
        (F.col("max_quantity") - F.col("consumed_quantity")).alias("c_remaining_quantity"),
        (F.col("target_value") - F.col("consumed_value")).cast("decimal(14,2)").alias("c_remaining_value"),
        months.alias("c_months_active"), F.try_divide(consumption_pct(), months).alias("c_consumption_rate_monthly"))


def category_spend(categories: DataFrame, materials: DataFrame, po_headers: DataFrame, po_lines: DataFrame) -> DataFrame:
    """Spend, partners and maverick share of every category with orders."""
    lines = po_lines.select("po_id", "material_id", "net_value").join(
        materials.select("material_id", "category_id"), "material_id").join(
        po_headers.select("po_id", "vendor_id", "maverick_flag"), "po_id")
    # Distinct partners and orders are counted over pre-aggregated pairs, not over the lines.
    pairs = lines.groupBy("category_id", "vendor_id", "material_id").agg(F.sum("net_value").alias("v"), F.count(F.lit(1)).alias("n"))
    spend = pairs.groupBy("category_id").agg(
        F.sum("v").cast("decimal(18,2)").alias("cat_total_spend"), ratio(F.sum("v"), F.sum("n")).alias("cat_avg_po_value"),
        F.countDistinct("vendor_id").alias("cat_vendor_count"), F.countDistinct("material_id").alias("cat_material_count"))
    orders = lines.groupBy("category_id", "po_id").agg(F.bool_or("maverick_flag").alias("m"))
    maverick = orders.groupBy("category_id").agg(ratio(F.sum(flag(F.col("m"))), F.count(F.lit(1))).alias("cat_maverick_rate"))
    return spend.join(maverick, "category_id").join(categories.select(
        "category_id", F.col("level").alias("cat_hierarchy_level"), F.col("parent_category_id").alias("cat_parent_id")), "category_id", "left")


def pair_performance(po_headers: DataFrame, po_lines: DataFrame, gr_lines: DataFrame) -> DataFrame:
    """History of each vendor with each material."""
    owner = po_headers.select("po_id", "vendor_id", "po_date")
    price = F.col("unit_price").cast("double")
    ordered = po_lines.join(owner, "po_id").groupBy("vendor_id", "material_id").agg(
        F.count(F.lit(1)).alias("vm_order_count"), mean("quantity").alias("vm_avg_qty_per_order"),
        mean(F.datediff("actual_delivery_date", "requested_delivery_date")).alias("vm_avg_delivery_delay"),
        F.try_divide(F.stddev_samp(price), F.avg(price)).alias("vm_price_stability"), F.max("po_date").alias("vm_last_order_date"))
    received = gr_lines.join(owner, "po_id").groupBy("vendor_id", "material_id").agg(
        ratio(F.sum("quantity_rejected"), F.sum("quantity_received")).alias("vm_rejection_rate"))
    return ordered.join(received, ["vendor_id", "material_id"], "left")
