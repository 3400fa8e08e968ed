"""Vendor-side use cases: risk, concentration, receipt quality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.features import invoice, vendor
from buylens.functions.columns import CRITICALITY, flag, lookup, ordinal, ratio, share
from buylens.operators.contracts import in_force
from buylens.operators.ranking import ranks_within
from buylens.operators.statistics import group_quantiles
from buylens.operators.windows import last_date_before, sequence
from buylens.session import splittable

Tables = Mapping[str, DataFrame]


def uc03_features(t: Tables, as_of: str | None = None) -> DataFrame:
    """Risk signals of vendors; a missing ESG score takes the median."""
    v = t["vendor_master"]
    contracts = t["contract_header"].filter(in_force(as_of)).groupBy("vendor_id").agg(F.count(F.lit(1)).alias("contracts"))
    crit = t["source_list"].select("vendor_id", "material_id").distinct().join(
        t["material_master"].select("material_id", ordinal("criticality", CRITICALITY).alias("c")), "material_id").groupBy("vendor_id").agg(
        F.max("c").alias("crit"))
    aliases = v.filter(F.col("alias_group").isNotNull()).groupBy("alias_group").agg(F.count(F.lit(1)).alias("aliases"))
    median = group_quantiles(v.select(F.lit(1).alias("g"), "esg_score"), ["g"], "esg_score", {"m": 0.5}).agg(F.max("m")).scalar()
    return (v.join(contracts, "vendor_id", "left").join(crit, "vendor_id", "left").join(aliases, "alias_group", "left").select(
        "vendor_id", F.col("quality_score").alias("uc03_quality_score_raw"), F.col("on_time_delivery_rate").alias("uc03_otd_rate_raw"),
        F.coalesce(F.col("esg_score").cast("double"), median).alias("uc03_esg_score"), flag(F.col("esg_score").isNull()).alias("uc03_esg_missing"),
        F.coalesce("contracts", F.lit(0)).alias("uc03_active_contract_count"), F.coalesce("crit", F.lit(-1)).alias("uc03_material_criticality_max"),
        F.coalesce("aliases", F.lit(1)).alias("uc03_alias_vendor_count")))


def derived_risk(t: Tables, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), cuts: tuple[float, float] = (20, 35)) -> DataFrame:
    """Risk from observed lateness, quality, rejections and mismatches, and its tier."""
    perf = vendor.performance_from_parts(vendor.performance_parts(t["po_header"], t["po_line_item"], t["gr_line_item"]))
    behavior = t["invoice_header"].groupBy("vendor_id").agg(share(F.col("match_status") != "FULL_MATCH").alias("mismatch"))
    joined = t["vendor_master"].select("vendor_id", "quality_score").join(perf, "vendor_id", "left").join(behavior, "vendor_id", "left")
    w1, w2, w3, w4 = weights
    score = (w1 * (100 - F.coalesce("v_on_time_delivery_actual", F.lit(0.5)) * 100) + w2 * (100 - F.col("quality_score"))
             + w3 * F.coalesce("v_rejection_rate", F.lit(0.0)) * 100 + w4 * F.coalesce("mismatch", F.lit(0.0)) * 100)
    return joined.select("vendor_id", score.alias("risk_derived")).withColumn(
        "risk_tier", F.when(F.col("risk_derived") < cuts[0], "LOW").when(F.col("risk_derived") < cuts[1], "MEDIUM").otherwise("HIGH"))


def _spend(t: Tables) -> DataFrame:
    """Spend per material and vendor, pre-aggregated from the lines."""
    return t["po_line_item"].select("po_id", "material_id", "net_value").join(
        t["po_header"].select("po_id", "vendor_id"), "po_id").groupBy("material_id", "vendor_id").agg(F.sum("net_value").alias("spend"))


def concentration(t: Tables, per: str = "material_id", holder: str = "vendor_id") -> DataFrame:
    """Herfindahl index and largest share of the holders of a material's or category's spend."""
    spend = _spend(t)
    if per == "category_id":
        spend = spend.join(t["material_master"].select("material_id", "category_id"), "material_id")
    if holder != "vendor_id":
        spend = spend.join(t["vendor_master"].select("vendor_id", holder), "vendor_id")
    held = spend.groupBy(per, holder).agg(F.sum("spend").alias("s"))
    s = F.col("s").cast("double")
    return held.groupBy(per).agg(
        F.sum("s").cast("decimal(18,2)").alias("total_spend"), F.count(F.lit(1)).alias("holders"),
        F.try_divide(F.sum(s * s), F.pow(F.sum("s").cast("double"), 2)).alias("hhi"), ratio(F.max("s"), F.sum("s")).alias("top1_share"))


def uc08_features(t: Tables) -> DataFrame:
    """All concentration measures of a material."""
    by_vendor = concentration(t).select("material_id", F.col("hhi").alias("uc08_hhi_by_material"), F.col("top1_share").alias("uc08_top1_vendor_share"))
    by_entity = concentration(t, holder="legal_entity_id").select("material_id", F.col("hhi").alias("uc08_hhi_by_legal_entity"))
    by_country = concentration(t, holder="country").select("material_id", F.col("hhi").alias("uc08_geographic_hhi"))
    by_category = concentration(t, per="category_id").select("category_id", F.col("hhi").alias("uc08_hhi_by_category"))
    depth = t["source_list"].groupBy("material_id", "plant_id").agg(F.count(F.lit(1)).alias("n")).groupBy("material_id").agg(
        F.min("n").alias("uc08_source_list_depth"))
    return (by_vendor.join(by_entity, "material_id").join(by_country, "material_id")
            .join(t["material_master"].select("material_id", "category_id", F.col("criticality").alias("uc08_material_criticality")), "material_id")
            .join(by_category, "category_id", "left").join(depth, "material_id", "left"))


def concentration_tier(df: DataFrame, limit: float = 0.25) -> DataFrame:
    high = F.col("uc08_hhi_by_material") > limit
    return df.select("material_id", F.when(high & (F.col("uc08_material_criticality") == "HIGH"), "CRITICAL").when(high, "HIGH")
                     .when(F.col("uc08_material_criticality") == "HIGH", "MEDIUM").otherwise("LOW").alias("concentration_tier"))


def what_if_loss(t: Tables, vendors: list[str] | None = None, entities: list[str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """Spend and materials that depend on lost vendors; a material is stranded without another source."""
    gone = F.lit(False)
    for column, values in (("vendor_id", vendors), ("legal_entity_id", entities), ("country", countries)):
        if values:
            gone = gone | F.col(column).isin(values)
    lost = t["vendor_master"].filter(gone).select("vendor_id")
    left = t["source_list"].join(lost, "vendor_id", "left_anti").select("material_id").distinct().withColumn("still", F.lit(True))
    hit = t["source_list"].join(lost, "vendor_id", "left_semi").select("material_id").distinct()
    spend = _spend(t).join(lost, "vendor_id", "left_semi").groupBy("material_id").agg(F.sum("spend").alias("s"))
    return hit.join(left, "material_id", "left").join(spend, "material_id", "left").select(
        "material_id", F.coalesce("s", F.lit(0)).cast("decimal(18,2)").alias("lost_spend"), F.col("still").isNull().alias("left_without_source"))


def alternative_vendors(t: Tables, category: str | None = None, exclude_entity: str | None = None, top: int | None = None) -> DataFrame:
    """Active vendors of each category by quality and delivery, one per legal entity; all of them or the first ``top``."""
    v = t["vendor_master"].filter("status = 'ACTIVE'")
    if exclude_entity is not None:
        v = v.filter(F.col("legal_entity_id") != exclude_entity)
    links = t["vendor_category"] if category is None else t["vendor_category"].filter(F.col("category_id") == category)
    value = F.struct((-F.col("quality_score")).alias("q"), (-F.col("on_time_delivery_rate")).alias("o"), "vendor_id")
    best = links.join(v.select("vendor_id", "legal_entity_id", "quality_score", "on_time_delivery_rate"), "vendor_id").groupBy(
        "category_id", "legal_entity_id").agg(F.min(value).alias("b"))
    ranked = ranks_within(best, "category_id", ["b.q", "b.o", "b.vendor_id"], "rank")
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select(
        "category_id", "rank", "b.vendor_id", "legal_entity_id", (-F.col("b.q")).alias("quality_score"), (-F.col("b.o")).alias("on_time_delivery_rate"))


def uc09_features(t: Tables) -> DataFrame:
    """Quality signals of receipt lines, with the vendor's sequence and last rejection."""
    lots = t["material_plant_extension"].select("material_id", "plant_id", "lot_size")
    lines = (t["gr_line_item"].select("gr_id", "gr_line_number", "po_id", "po_line_number", "material_id", "quantity_rejected")
             .join(t["gr_header"].select("gr_id", "gr_date", "plant_id"), "gr_id")
             .join(t["po_line_item"].select("po_id", "po_line_number", "quantity"), ["po_id", "po_line_number"])
             .join(t["po_header"].select("po_id", "vendor_id"), "po_id")
             .select("gr_id", "gr_line_number", "gr_date", "vendor_id", "material_id", "plant_id", "quantity", "quantity_rejected"))
    # The sequence and the last rejection read the joined lines three times, each time other columns: written out, they are joined once.
    lines = sequence(splittable(lines), ["vendor_id"], "gr_date", ["gr_id", "gr_line_number"], "uc09_gr_sequence_for_vendor")
    lines = last_date_before(lines, ["vendor_id"], "gr_date", F.col("quantity_rejected") > 0, "last_rejection")
    quality = F.col("quality_score")
    return (lines.join(t["vendor_master"].select("vendor_id", "quality_score"), "vendor_id")
            .join(t["material_master"].select("material_id", "hazmat_flag"), "material_id").join(lots, ["material_id", "plant_id"], "left")
            .select("gr_id", "gr_line_number", quality.alias("uc09_vendor_quality_score"),
                    F.when(quality > 85, "HIGH").when(quality >= 70, "MEDIUM").otherwise("LOW").alias("uc09_vendor_quality_tier"),
                    flag(F.col("hazmat_flag")).alias("uc09_is_hazmat"), ratio(F.col("quantity"), F.col("lot_size")).alias("uc09_order_qty_vs_lot_size"),
                    "uc09_gr_sequence_for_vendor", F.datediff("gr_date", "last_rejection").alias("uc09_days_since_last_rejection"),
                    flag(F.col("quantity_rejected") > 0).alias("label")))


def vendor_trend(t: Tables, metric: str = "rejection_rate", by_reason: bool = False) -> DataFrame:
    """A metric per vendor and quarter with the change from the quarter before."""
    owner = t["po_header"].select("po_id", "vendor_id", "po_date")
    keys = ["vendor_id", "quarter"]
    if metric == "rejection_rate":
        rows = t["gr_line_item"].join(t["gr_header"].select("gr_id", "gr_date"), "gr_id").join(owner, "po_id").withColumn(
            "quarter", F.trunc("gr_date", "quarter"))
        total = rows.groupBy(*keys).agg(F.sum("quantity_received").alias("received"), F.sum("quantity_rejected").alias("rejected"))
        values = total.select(*keys, ratio(F.col("rejected"), F.col("received")).alias("value"))
        if by_reason:
            # The denominator is all that was received in the quarter.
            split = rows.filter(F.col("rejection_reason").isNotNull()).groupBy(*keys, "rejection_reason").agg(F.sum("quantity_rejected").alias("r"))
            values = split.join(total, keys).select(*keys, "rejection_reason", ratio(F.col("r"), F.col("received")).alias("value"))
    elif metric == "late_share":
        rows = t["po_line_item"].filter(F.col("actual_delivery_date").isNotNull()).join(owner, "po_id").withColumn(
            "quarter", F.trunc("actual_delivery_date", "quarter"))
        values = rows.groupBy(*keys).agg(share(F.col("actual_delivery_date") > F.col("requested_delivery_date")).alias("value"))
    elif metric == "price_variance":
        rows = t["invoice_header"].withColumn("quarter", F.trunc("invoice_date", "quarter"))
        values = rows.groupBy(*keys).agg(share(invoice.price_varies()).alias("value"))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    keep = ["vendor_id"] + (["rejection_reason"] if by_reason and metric == "rejection_rate" else [])
    # One row per quarter: the window holds as many rows as the history has quarters.
    before = F.lag("value").over(W.partitionBy(*keep).orderBy("quarter"))
    return values.withColumn("previous_value", before).withColumn("change", F.col("value") - F.col("previous_value"))
