"""Price benchmarks per material and per vendor-material pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import mean, ratio, slope
from buylens.session import splittable


def _contract_price(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.min("agreed_price").alias("p_contract_price"))


def price_stats(po_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation (0 for a single price), minimum and maximum unit price."""
    return po_lines.groupBy(*keys).agg(
        mean("unit_price").alias("p_avg_unit_price"),
        F.coalesce(F.stddev_samp(F.col("unit_price").cast("double")), F.lit(0.0)).alias("p_std_unit_price"),
        F.min("unit_price").alias("p_min_unit_price"), F.max("unit_price").alias("p_max_unit_price"))


def price_benchmarks(po_lines: DataFrame, materials: DataFrame, items: DataFrame) -> DataFrame:
    """Every order line beside the prices of its material."""
    # Material attributes are gathered first: the order lines are joined once.
    per_material = (price_stats(po_lines, ["material_id"])
                    .join(materials.select("material_id", "standard_cost"), "material_id", "left")
                    .join(_contract_price(items, ["material_id"]), "material_id", "left"))
    return po_lines.select("po_id", "po_line_number", "material_id", "unit_price").join(splittable(per_material), "material_id").select(
        "po_id", "po_line_number", "material_id", "unit_price", "p_avg_unit_price", "p_std_unit_price", "p_min_unit_price",
        "p_max_unit_price", F.when(F.col("standard_cost") > 0, ratio(F.col("unit_price"), F.col("standard_cost"))).alias("p_price_to_standard_ratio"),
        "p_contract_price")


def price_trend(po_lines: DataFrame, po_headers: DataFrame, materials: DataFrame, contract_headers: DataFrame,
                items: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Prices of a vendor-material pair, their slope per day and the latest window's extremes."""
    lines = po_lines.select("po_id", "material_id", "unit_price").join(po_headers.select("po_id", "vendor_id", "po_date"), "po_id")
    day = F.lit(as_of).cast("date")
    recent = F.col("po_date").between(F.date_sub(day, days), day)
    price = F.col("unit_price").cast("double")
    pairs = lines.groupBy("material_id", "vendor_id").agg(
        mean("unit_price").alias("p_avg_unit_price"), F.coalesce(F.stddev_samp(price), F.lit(0.0)).alias("p_std_unit_price"),
        (slope((F.col("unit_price") * 100).cast("bigint"), F.datediff("po_date", day)) / 100).alias("p_price_trend_slope"),
        F.min(F.when(recent, F.col("unit_price"))).alias("p_min_price_30d"), F.max(F.when(recent, F.col("unit_price"))).alias("p_max_price_30d"))
    agreed = _contract_price(items.join(contract_headers.select("contract_id", "vendor_id"), "contract_id"), ["material_id", "vendor_id"])
    return pairs.join(materials.select("material_id", "standard_cost"), "material_id").join(agreed, ["material_id", "vendor_id"], "left").select(
        "material_id", "vendor_id", "p_avg_unit_price", "p_std_unit_price",
        ratio(F.col("p_avg_unit_price"), F.col("standard_cost")).alias("p_price_to_standard_ratio"), "p_contract_price",
        ratio(F.col("p_avg_unit_price"), F.col("p_contract_price")).alias("p_price_vs_contract"), "p_price_trend_slope",
        "p_min_price_30d", "p_max_price_30d")
