"""Goods receipts against orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_receipt(gr_headers: DataFrame, gr_lines: DataFrame) -> DataFrame:
    """Earliest-numbered receipt of every order with its first line."""
    lines = gr_lines.groupBy("gr_id").agg(F.min("gr_line_number").alias("gr_line_number"))
    return gr_headers.groupBy("po_id").agg(F.min(F.struct("gr_id", "gr_date")).alias("g")).select(
        "po_id", "g.gr_id", "g.gr_date").join(lines, "gr_id", "left")


def apply_receipts(po_headers: DataFrame, po_lines: DataFrame, gr_headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and lines after the first receipt: status, line status and delivery date."""
    first = gr_headers.groupBy("po_id").agg(F.min_by("gr_date", "gr_id").alias("gr_date"))
    got = F.col("gr_date").isNotNull()
    headers = po_headers.join(first, "po_id", "left").withColumn(
        "status", F.when(got, "FULLY_RECEIVED").otherwise(F.col("status"))).drop("gr_date")
    lines = (po_lines.join(first, "po_id", "left")
             .withColumn("gr_status", F.when(got, "COMPLETE").otherwise(F.col("gr_status")))
             .withColumn("actual_delivery_date", F.coalesce("gr_date", "actual_delivery_date")).drop("gr_date"))
    return headers, lines


def delivery_class(po_lines: DataFrame) -> DataFrame:
    """Delivered lines by their distance from the requested date."""
    delay = F.datediff("actual_delivery_date", "requested_delivery_date")
    return po_lines.filter(F.col("actual_delivery_date").isNotNull()).select(
        "po_id", "po_line_number", delay.alias("delay_days"),
        F.when(delay <= -4, "EARLY").when(delay <= 0, "ON_TIME").when(delay <= 7, "MINOR_LATE").otherwise("LATE")
        .alias("delivery_class"))


def receipt_class(gr_lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """Accepted quantity and delivered share, judged by the line's own tolerances."""
    po = po_lines.select("po_id", "po_line_number", "quantity", "over_delivery_tolerance", "under_delivery_tolerance")
    received, ordered = F.col("quantity_received") * 100, F.col("quantity")
    return gr_lines.join(po, ["po_id", "po_line_number"]).select(
        "gr_id", "gr_line_number",
        (F.col("quantity_received") - F.col("quantity_rejected")).cast("decimal(12,2)").alias("accepted"),
        F.when(F.col("quantity_received") == ordered, "FULL")
        .when(received > ordered * (100 + F.col("over_delivery_tolerance")), "OVER_TOLERANCE")
        .when(F.col("quantity_received") > ordered, "OVER")
        .when(received < ordered * (100 - F.col("under_delivery_tolerance")), "PARTIAL")
        .otherwise("UNDER").alias("receipt_class"))
