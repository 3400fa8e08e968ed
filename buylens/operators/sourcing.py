"""Who may supply what, and from whom a requisition is bought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import col
from buylens.operators.contracts import active_items
from buylens.operators.hierarchy import category_root


def candidate_vendors(mpe: DataFrame, materials: DataFrame, categories: DataFrame, vendors: DataFrame,
                      vendor_categories: DataFrame) -> DataFrame:
    """Unblocked vendors per category that a stocked material can be sourced through.

    A material's candidates are the vendors of its parent category together with those
    of its top category. Kept per category, the relation grows with the vendors and not
    with materials times vendors.
    """
    open_vendors = vendors.filter(F.col("status") != "BLOCKED")
    stocked = mpe.select("material_id").distinct().join(materials.select("material_id", "category_id"), "material_id")
    nodes = stocked.select("category_id").distinct().join(
        categories.select("category_id", "parent_category_id"), "category_id").join(
        category_root(categories), "category_id")
    by_sub = vendor_categories.join(open_vendors.select("vendor_id"), "vendor_id", "left_semi").join(
        nodes.select(F.col("parent_category_id").alias("category_id")).distinct(), "category_id", "left_semi")
    by_top = open_vendors.select("vendor_id", F.explode(F.split("supported_categories", ",")).alias("c")).select(
        F.trim("c").alias("category_id"), "vendor_id").distinct().join(
        nodes.select(F.col("root_category_id").alias("category_id")).distinct(), "category_id", "left_semi")
    return by_sub.select("category_id", "vendor_id", F.lit("SUBCATEGORY").alias("via")).unionByName(
        by_top.select("category_id", "vendor_id", F.lit("TOP").alias("via")))


def candidate_counts(mpe: DataFrame, materials: DataFrame, categories: DataFrame, vendors: DataFrame,
                     vendor_categories: DataFrame) -> DataFrame:
    """Number of distinct candidate vendors of each material at each plant."""
    links = candidate_vendors(mpe, materials, categories, vendors, vendor_categories).select("category_id", "vendor_id", "via")
    roots = category_root(categories)
    sub, top = links.filter("via = 'SUBCATEGORY'"), links.filter("via = 'TOP'")
    # |A or B| = |A| + |B| - |A and B|; the overlap is found along the vendor-category rows.
    both = sub.join(roots, "category_id").join(
        top.select(F.col("category_id").alias("root_category_id"), "vendor_id"), ["root_category_id", "vendor_id"])
    n_sub = sub.groupBy(F.col("category_id").alias("parent_category_id")).agg(F.count(F.lit(1)).alias("n_sub"))
    n_both = both.groupBy(F.col("category_id").alias("parent_category_id")).agg(F.count(F.lit(1)).alias("n_both"))
    n_top = top.groupBy(F.col("category_id").alias("root_category_id")).agg(F.count(F.lit(1)).alias("n_top"))
    per_leaf = (categories.select("category_id", "parent_category_id").join(roots, "category_id")
                .join(n_sub, "parent_category_id", "left").join(n_both, "parent_category_id", "left")
                .join(n_top, "root_category_id", "left").na.fill(0, ["n_sub", "n_both", "n_top"])
                .select("category_id", (F.col("n_sub") + F.col("n_top") - F.col("n_both")).alias("candidate_vendors")))
    return mpe.select("material_id", "plant_id").join(materials.select("material_id", "category_id"), "material_id").join(
        per_leaf, "category_id").select("material_id", "plant_id", "candidate_vendors")


def enrich_source_list(source_list: DataFrame, vendors: DataFrame, coverage: DataFrame) -> DataFrame:
    hit = coverage.withColumn("hit", F.lit(True))
    return (source_list.select("material_id", "plant_id", "vendor_id")
            .join(vendors.select("vendor_id", "status"), "vendor_id").join(hit, ["vendor_id", "material_id"], "left")
            .select("material_id", "plant_id", "vendor_id", F.coalesce("hit", F.lit(False)).alias("contract_covered_flag"),
                    F.when(F.col("status") == "CONDITIONAL", "CONDITIONAL").otherwise("APPROVED").alias("approval_status")))


def best_source(source_list: DataFrame, vendors: DataFrame, headers: DataFrame, items: DataFrame) -> DataFrame:
    """One source per material and plant: best-ranked contracted vendor, else rank one."""
    contracts = active_items(headers, items).groupBy("vendor_id", "material_id").agg(
        F.min(F.struct("contract_id", "item_number")).alias("contract"))
    usable = F.col("contract").isNotNull() & (F.col("status") != "BLOCKED")
    key = F.struct(F.when(usable, 0).otherwise(1).alias("fallback"), F.col("preferred_rank"), F.col("vendor_id"))
    value = F.struct("vendor_id", "preferred_rank", "lane_lead_time_days", F.when(usable, F.col("contract")).alias("contract"))
    return (
        source_list.join(vendors.select("vendor_id", "status"), "vendor_id")
        .join(contracts, ["vendor_id", "material_id"], "left")
        .groupBy("material_id", "plant_id").agg(F.min_by(value, key).alias("s"))
        .select("material_id", "plant_id", "s.vendor_id", "s.preferred_rank", "s.lane_lead_time_days",
                F.col("s.contract.contract_id").alias("contract_id"),
                F.col("s.contract.item_number").alias("contract_item_number")))


def resolve_source(pr_lines: DataFrame, pr_headers: DataFrame, source_list: DataFrame, vendors: DataFrame,
                   headers: DataFrame, items: DataFrame) -> DataFrame:
    """Source of every requisition line, null where its material has none at the plant; the choice is made once per material and plant."""
    lines = pr_lines.select("pr_id", "pr_line_number", "material_id").join(
        pr_headers.select("pr_id", "plant_id"), "pr_id")
    return lines.join(best_source(source_list, vendors, headers, items), ["material_id", "plant_id"], "left")


def buying_price(resolved: DataFrame, items: DataFrame, materials: DataFrame, factor: str = "1.10") -> DataFrame:
    """Contract price where contracted, else standard cost times a factor."""
    agreed = items.select("contract_id", F.col("item_number").alias("contract_item_number"), "agreed_price")
    fallback = F.round(F.col("standard_cost") * F.lit(factor).cast("decimal(6,4)"), 2)
    return (resolved.join(agreed, ["contract_id", "contract_item_number"], "left")
            .join(materials.select("material_id", "standard_cost"), "material_id")
            .withColumn("buying_price", F.coalesce("agreed_price", fallback).cast("decimal(12,2)"))
            .drop("agreed_price", "standard_cost"))


def unordered_pr_lines(pr_lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    used = po_lines.filter(F.col("pr_id").isNotNull()).select("pr_id", "pr_line_number")
    return pr_lines.filter(F.col("status") == "PO_CREATED").join(used, ["pr_id", "pr_line_number"], "left_anti")


def pr_line_status(header_status: str | Column) -> Column:
    status = col(header_status)
    return (F.when(status == "CONVERTED", "PO_CREATED").when(status.isin("CANCELLED", "REJECTED"), "CANCELLED")
            .when(status == "APPROVED", "ASSIGNED").otherwise("OPEN"))


def lane_lead_time(po_lines: DataFrame, po_headers: DataFrame, source_list: DataFrame, default: int = 14) -> DataFrame:
    lanes = source_list.select("material_id", "plant_id", "vendor_id", "lane_lead_time_days")
    return (po_lines.select("po_id", "po_line_number", "material_id")
            .join(po_headers.select("po_id", "plant_id", "vendor_id"), "po_id")
            .join(lanes, ["material_id", "plant_id", "vendor_id"], "left")
            .select("po_id", "po_line_number", F.coalesce("lane_lead_time_days", F.lit(default)).alias("lead_time_days")))
