"""Spend, risk, aging and compliance reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.functions.columns import flag, ratio, share
from buylens.operators.contracts import in_force
from buylens.operators.hierarchy import category_closure
from buylens.session import splittable

Tables = Mapping[str, DataFrame]


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def spend_by_vendor(t: Tables, top_n: int | None = 10) -> DataFrame:
    spend = t["po_header"].groupBy("vendor_id").agg(
        _money(F.sum("total_net_value")).alias("total_spend"), F.count(F.lit(1)).alias("po_count"))
    if top_n is not None:
        # The rank runs over the report's own rows only.
        spend = spend.orderBy(F.desc("total_spend"), "vendor_id").limit(top_n).withColumn(
            "spend_rank", F.row_number().over(W.orderBy(F.desc("total_spend"), "vendor_id")))
    return spend.join(t["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id")


def spend_by_category(t: Tables, top_n: int | None = 10, level: int | None = None) -> DataFrame:
    """Line value per category; with ``level`` rolled up to that level of the tree."""
    per_leaf = t["po_line_item"].select("material_id", "net_value").join(
        t["material_master"].select("material_id", "category_id"), "material_id").groupBy("category_id").agg(
        F.sum("net_value").alias("spend"), F.count(F.lit(1)).alias("items"))
    if level is not None:
        tops = t["category_hierarchy"].filter(F.col("level") == level).select(F.col("category_id").alias("ancestor"))
        up = category_closure(t["category_hierarchy"]).join(tops, "ancestor", "left_semi")
        per_leaf = per_leaf.join(up.select("ancestor", F.col("descendant").alias("category_id")), "category_id").groupBy(
            F.col("ancestor").alias("category_id")).agg(F.sum("spend").alias("spend"), F.sum("items").alias("items"))
    named = per_leaf.join(t["category_hierarchy"].select("category_id", "category_name"), "category_id").select(
        "category_id", "category_name", _money(F.col("spend")).alias("total_spend"), F.col("items").alias("item_count"))
    return named if top_n is None else named.orderBy(F.desc("total_spend"), "category_id").limit(top_n)


def spend_rollup(t: Tables) -> DataFrame:
    """Spend by the upper three category levels with subtotals and a grand total.

    Spend on a node of level 1 or 2 stands under that node's own name on the levels below; deeper nodes count
    with their ancestor of level 3.
    """
    up = category_closure(t["category_hierarchy"]).withColumn("from_top", F.max("depth").over(W.partitionBy("descendant")) - F.col("depth") + 1)
    at = lambda k: F.max(F.when(F.col("from_top") == k, F.col("ancestor")))
    path = up.groupBy(F.col("descendant").alias("category_id")).agg(*[at(k).alias(f"_{k}") for k in (1, 2, 3)]).select(
        "category_id", F.col("_1").alias("level_1"), F.coalesce("_2", "_1").alias("level_2"), F.coalesce("_3", "_2", "_1").alias("level_3"))
    spend = t["po_line_item"].select("material_id", "net_value").join(
        t["material_master"].select("material_id", "category_id"), "material_id").groupBy("category_id").agg(F.sum("net_value").alias("v"))
    return spend.join(path, "category_id").rollup("level_1", "level_2", "level_3").agg(F.sum("v").cast("decimal(20,2)").alias("total_spend"))


def po_filter(t: Tables, status: str | None = None, maverick: bool | None = None, low=None, high=None,
              limit: int | None = 20) -> DataFrame:
    """Orders by status, maverick flag and value; a parameter left out does not filter."""
    po = t["po_header"]
    if status is not None:
        po = po.filter(F.col("status") == status)
    if maverick is not None:
        po = po.filter(F.col("maverick_flag") == maverick)
    if low is not None:
        po = po.filter(F.col("total_net_value") >= low)
    if high is not None:
        po = po.filter(F.col("total_net_value") <= high)
    po = po.select("po_id", "po_date", "vendor_id", "status", "total_net_value", "maverick_flag")
    if limit is not None:
        po = po.orderBy(F.desc("total_net_value"), "po_id").limit(limit)
    return po.join(t["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id")


def invoice_aging(t: Tables) -> DataFrame:
    return t["invoice_header"].groupBy("match_status", "status").agg(
        F.count(F.lit(1)).alias("invoices"), _money(F.sum("total_net_amount")).alias("total_amount"))


def overdue_invoices(t: Tables, as_of: str, limit: int | None = 20) -> DataFrame:
    day = F.lit(as_of).cast("date")
    late = t["invoice_header"].filter((F.col("payment_due_date") < day) & (F.col("status") != "PAID")).select(
        "invoice_id", "vendor_id", "payment_due_date", "total_net_amount", "match_status",
        F.datediff(day, "payment_due_date").alias("days_overdue"))
    if limit is not None:
        late = late.orderBy("payment_due_date", "invoice_id").limit(limit)
    return late.join(t["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id")


def aging_buckets(t: Tables, as_of: str) -> DataFrame:
    """Unpaid invoices by how long they are overdue."""
    days = F.datediff(F.lit(as_of).cast("date"), "payment_due_date")
    bucket = (F.when(days <= 0, "0").when(days <= 30, "1-30").when(days <= 60, "31-60").when(days <= 90, "61-90")
              .otherwise("90+"))
    return t["invoice_header"].filter(F.col("status") != "PAID").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("invoices"), _money(F.sum("total_net_amount")).alias("total_amount"))


def vendor_risk(t: Tables, threshold: int = 70) -> DataFrame:
    return t["vendor_master"].filter(F.col("risk_score") > threshold).select(
        "vendor_id", "vendor_name", "risk_score", "quality_score", "on_time_delivery_rate", "esg_score")


def critical_single_source(t: Tables, plant: str | None = None, risk: int = 70) -> DataFrame:
    """HIGH materials with a single vendor at a plant, and that one risky."""
    lanes = t["source_list"] if plant is None else t["source_list"].filter(F.col("plant_id") == plant)
    single = lanes.join(t["material_master"].filter("criticality = 'HIGH'").select("material_id", "description"), "material_id").groupBy(
        "material_id", "plant_id", "description").agg(F.min("vendor_id").alias("vendor_id"), F.max("vendor_id").alias("hi"))
    return single.filter("vendor_id = hi").drop("hi").join(
        t["vendor_master"].filter(F.col("risk_score") > risk).select("vendor_id", "risk_score"), "vendor_id")


def maverick_vs_contract(t: Tables, as_of: str | None = None) -> DataFrame:
    """Maverick orders of vendors that do hold an active contract."""
    live = t["contract_header"].filter(in_force(as_of)).select("vendor_id").distinct()
    return t["po_header"].join(live, "vendor_id", "left_semi").groupBy("vendor_id").agg(
        F.sum(flag(F.col("maverick_flag"))).alias("maverick_pos"), F.count(F.lit(1)).alias("pos"),
        share(F.col("maverick_flag")).alias("maverick_share")).filter("maverick_pos > 0")


def contract_coverage_by_category(t: Tables, level: int = 1) -> DataFrame:
    tops = t["category_hierarchy"].filter(F.col("level") == level).select(F.col("category_id").alias("ancestor"))
    up = category_closure(t["category_hierarchy"]).join(tops, "ancestor", "left_semi").select(
        "ancestor", F.col("descendant").alias("category_id"))
    leaf = t["po_line_item"].join(t["material_master"].select("material_id", "category_id"), "material_id").groupBy("category_id").agg(
        F.sum("net_value").alias("spend"), F.sum(F.when(F.col("contract_id").isNotNull(), F.col("net_value"))).alias("covered"))
    return leaf.join(up, "category_id").groupBy(F.col("ancestor").alias("category_id")).agg(
        _money(F.sum("spend")).alias("total_spend"), _money(F.coalesce(F.sum("covered"), F.lit(0))).alias("contract_spend")
    ).withColumn("contract_share", ratio(F.col("contract_spend"), F.col("total_spend")))


def blocked_by_vendor(t: Tables, vendor: str | None = None) -> DataFrame:
    """Blocked invoices with the vendor's quality and match history."""
    inv = t["invoice_header"] if vendor is None else t["invoice_header"].filter(F.col("vendor_id") == vendor)
    history = inv.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("invoice_count"),
                                           share(F.col("match_status") == "FULL_MATCH").alias("match_rate"))
    return (inv.filter("payment_block").select("invoice_id", "vendor_id", "block_reason", "total_net_amount")
            .join(splittable(history), "vendor_id").join(t["vendor_master"].select("vendor_id", "quality_score"), "vendor_id"))
