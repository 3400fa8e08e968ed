"""Streams run over the tables to their end; the results equal the batch operators'."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from buylens.plans.features import rounded
from buylens.schemas import SCHEMAS
from buylens.streaming import checks, partials, runs


def fresh(t, name):
    """A folder of its own for each run of a stream."""
    return f"{t.folder}/streams/{name}-{uuid.uuid4().hex[:8]}"


#: A table comes in so many batches at most: a batch that joins another table reads all of it, so the number of batches must not grow with the tables.
BATCHES = 8


def stream(t, table, files=None):
    """The table's files as a stream, ``files`` a batch or more."""
    there = len(t.written(table).inputFiles())
    files = files and max(files, -(-there // BATCHES))
    return runs.table_stream(t.spark, t.folder, table, SCHEMAS[table], files)


def to_end(t, df, name):
    path = fresh(t, name)
    return runs.run_to_folder(df, f"{path}/rows", f"{path}/state")


def owner(t):
    return t["po_header"].select("po_id", "vendor_id")


def refreshed_performance(t):
    path = fresh(t, "performance")
    steps = {"orders": ("po_header", partials.order_parts), "deliveries": ("po_line_item", partials.delivery_parts), "receipts": ("gr_line_item", partials.receipt_parts)}
    stores = []
    for name, (table, parts) in steps.items():
        partials.refresh_partials(stream(t, table, 2), parts, f"{path}/{name}", f"{path}/{name}-state")
        stores.append(partials.merged(t.spark, f"{path}/{name}", "vendor_id", owner=None if name == "orders" else owner(t)))
    return partials.performance_from_stores(*stores)


def refreshed_prices(t):
    path = fresh(t, "prices")
    partials.refresh_partials(stream(t, "po_line_item", 2), partials.price_parts, f"{path}/parts", f"{path}/state")
    return partials.price_stats_from_parts(partials.merged(t.spark, f"{path}/parts", "material_id", ("lo",), ("hi",)))


def refreshed_behavior(t):
    path = fresh(t, "behavior")
    partials.refresh_partials(stream(t, "invoice_header", 2), partials.behavior_parts, f"{path}/parts", f"{path}/state")
    return partials.behavior_from_parts(partials.merged(t.spark, f"{path}/parts", "vendor_id"))


def counted(t, size, slide=None):
    events = runs.file_stream(t.spark, t.source_dir, "events.parquet")
    return to_end(t, checks.stream_counts(events, "ts", size, slide, "1 hour", "event_type"), "counts")


def linked(t):
    path = fresh(t, "duplicates")
    checks.stream_duplicates(stream(t, "invoice_header", 2), t.spark, path, f"{path}-state")
    return checks.read_links(t.spark, path)


def overdue(t):
    path = fresh(t, "overdue")
    due = stream(t, "po_line_item").select("po_id", F.col("requested_delivery_date").cast("timestamp").alias("due_ts"))
    got = stream(t, "gr_header").select("po_id", F.col("gr_date").cast("timestamp").alias("gr_ts"))
    checks.stream_overdue_receipts(due, got, t.spark, path, f"{path}-state", 20)
    return checks.read_overdue(t.spark, path)


def refreshed_materials(t):
    path = fresh(t, "materials")
    partials.refresh_partials(stream(t, "po_line_item", 2), partials.material_pairs, f"{path}/parts", f"{path}/state")
    return partials.distinct_from_pairs(t.spark, f"{path}/parts", "vendor_id", "v_distinct_materials", owner(t))


def refreshed_medians(t):
    path = fresh(t, "medians")
    partials.refresh_partials(stream(t, "po_line_item", 2), partials.price_values, f"{path}/parts", f"{path}/state")
    return partials.quantiles_from_values(t.spark, f"{path}/parts", "material_id", "unit_price", {"p_median_unit_price": 0.5, "p_q1_unit_price": 0.25, "p_q3_unit_price": 0.75})


def refreshed_sketches(t):
    path = fresh(t, "sketches")
    partials.refresh_partials(stream(t, "po_line_item", 2), lambda b: partials.price_sketches(b.join(owner(t), "po_id")), f"{path}/parts", f"{path}/state")
    found = partials.from_sketches(t.spark, f"{path}/parts")
    lines = t["po_line_item"].join(owner(t), "po_id")
    exact = lines.groupBy("vendor_id").agg(F.countDistinct("material_id").alias("materials"), F.count(F.lit(1)).alias("n"))
    below = lines.join(found, "vendor_id").groupBy("vendor_id").agg(F.avg((F.col("unit_price").cast("double") <= F.col("median")).cast("double")).alias("share"),
                                                                     F.avg((F.col("unit_price").cast("double") < F.col("median")).cast("double")).alias("under"))
    return found.join(exact, "vendor_id").join(below, "vendor_id").select(
        "vendor_id", (F.abs(F.col("distinct_materials") - F.col("materials")) <= F.greatest(0.07 * F.col("materials"), F.lit(1))).alias("distinct_within_bound"),
        ((F.col("under") <= 0.53) & (F.col("share") >= 0.47)).alias("median_within_bound"))


QUERIES = {
    "st01_stream_match": lambda t: to_end(t, checks.stream_match(stream(t, "invoice_line_item"), t), "match"),
    "st02_stream_po_check": lambda t: to_end(t, checks.stream_po_check(stream(t, "po_line_item"), t), "po_check"),
    "st03_refresh_performance": refreshed_performance,
    "st03_refresh_prices": lambda t: rounded(refreshed_prices(t), "p_std_unit_price", places=4),
    "st03_refresh_behavior": refreshed_behavior,
    "st03_refresh_distinct_materials": refreshed_materials,
    "st03_refresh_price_quantiles": refreshed_medians,
    "st03_refresh_sketches": refreshed_sketches,
    "st04_stream_counts_day": lambda t: counted(t, "1 day"),
    "st04_stream_counts_sliding": lambda t: counted(t, "1 day", "12 hours"),
    "st05_stream_duplicates": linked,
    "st06_stream_overdue_receipts": overdue,
    "st07_sessions": lambda t: checks.sessions(t.raw("events"), "user_id", "ts", "6 hours"),
    "st07_sessions_by_day": lambda t: checks.sessions_by_day(t["po_header"], "vendor_id", "po_date", 20),
}
