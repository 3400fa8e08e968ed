"""Contract coverage, consumption and order totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(as_of: str | None) -> Column:
    """Stored ACTIVE status; with ``as_of`` the validity dates must agree as well."""
    active = F.col("status") == "ACTIVE"
    if as_of is None:
        return active
    day = F.lit(as_of).cast("date")
    return active & day.between(F.col("valid_from"), F.col("valid_to"))


def active_items(headers: DataFrame, items: DataFrame, as_of: str | None = None) -> DataFrame:
    live = headers.filter(in_force(as_of)).select("contract_id", "vendor_id", "confidentiality_tier")
    return items.join(live, "contract_id")


def contract_coverage(headers: DataFrame, items: DataFrame, as_of: str | None = None) -> DataFrame:
    """(vendor, material) pairs under an active contract."""
    return active_items(headers, items, as_of).select("vendor_id", "material_id").distinct()


def po_totals(po_lines: DataFrame) -> DataFrame:
    return po_lines.groupBy("po_id").agg(
        F.sum(F.round(F.col("unit_price") * F.col("quantity"), 2)).cast("decimal(14,2)").alias("total_net_value"))


def reconcile_contracts(headers: DataFrame, items: DataFrame, po_lines: DataFrame) -> DataFrame:
    """Consumption of every contract item from its order lines; the other measure is kept."""
    used = po_lines.filter(F.col("contract_id").isNotNull()).groupBy(
        "contract_id", F.col("contract_item_number").alias("item_number")
    ).agg(F.sum(F.floor("quantity").cast("bigint")).alias("used_quantity"), F.sum("net_value").alias("used_value"))
    kinds = headers.select("contract_id", "contract_type")
    by_quantity = F.col("contract_type") == "QUANTITY"
    return items.join(kinds, "contract_id").join(used, ["contract_id", "item_number"], "left").select(
        "contract_id", "item_number", "contract_type",
        F.when(by_quantity, F.coalesce("used_quantity", F.lit(0))).otherwise(F.col("consumed_quantity"))
        .cast("bigint").alias("consumed_quantity"),
        F.when(by_quantity, F.col("consumed_value")).otherwise(F.coalesce("used_value", F.lit(0)))
        .cast("decimal(18,2)").alias("consumed_value"))
