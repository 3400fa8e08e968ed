"""Incremental refresh of feature groups from additive parts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buylens.features.vendor import performance_from_parts
from buylens.functions.columns import flag, ratio
from buylens.operators.statistics import group_quantiles
from buylens.streaming.runs import run_batches

Tables = Mapping[str, DataFrame]


def _owned(rows: DataFrame, owner: DataFrame | None) -> tuple[DataFrame, str]:
    """Rows with the vendor of their order and its name, or without ``owner`` as they are, to be keyed by the order."""
    return (rows, "po_id") if owner is None else (rows.join(owner, "po_id"), "vendor_id")


def delivery_parts(po_lines: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """Per vendor, or without ``owner`` per order: a batch then reads no order but its own, and ``merged`` finds the vendors once for all batches."""
    delay = F.datediff("actual_delivery_date", "requested_delivery_date")
    rows, key = _owned(po_lines, owner)
    return rows.groupBy(key).agg(
        F.count(delay).alias("deliveries"), F.sum(flag(delay <= 0)).alias("on_time"), F.count(delay).alias("delay_count"),
        F.coalesce(F.sum(delay), F.lit(0)).alias("delay_days"))


def price_parts(po_lines: DataFrame) -> DataFrame:
    """Count, sum and sum of squares in cents per material, with the extremes."""
    cents = (F.col("unit_price") * 100).cast("bigint")
    return po_lines.groupBy("material_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("s"), F.sum((cents * cents).cast("decimal(38,0)")).alias("ss"),
        F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"))


def behavior_parts(invoices: DataFrame) -> DataFrame:
    status = F.col("match_status")
    return invoices.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(status == "FULL_MATCH")).alias("full"),
        F.sum(flag(status.isin("PRICE_VARIANCE", "BOTH_VARIANCE"))).alias("price"),
        F.sum(flag(status.isin("QUANTITY_VARIANCE", "BOTH_VARIANCE"))).alias("quantity"), F.sum(flag(F.col("payment_block"))).alias("blocked"))


def refresh_partials(stream: DataFrame, parts, store: str, checkpoint: str) -> None:
    """Write the parts of each batch into a folder of its own.

    A batch that is repeated after a failure overwrites its folder, so nothing counts twice.
    """
    def handle(batch: DataFrame, number: int) -> None:
        parts(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")
    run_batches(stream, handle, checkpoint)


def merged(spark: SparkSession, store: str, key: str, smallest: tuple[str, ...] = (), largest: tuple[str, ...] = (), owner: DataFrame | None = None) -> DataFrame:
    """Parts of all batches added up; parts by order are given to the vendor in ``owner``."""
    logs = spark.read.parquet(store).drop("batch")
    if owner is not None:
        logs = logs.join(owner, "po_id").drop("po_id")
    sums = [c for c in logs.columns if c not in (key, *smallest, *largest)]
    return logs.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in smallest], *[F.max(c).alias(c) for c in largest])


def price_stats_from_parts(parts: DataFrame) -> DataFrame:
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    # n * sum of squares - square of the sum, exact in decimals before the division.
    spread = (n.cast("decimal(20,0)") * ss - s.cast("decimal(19,0)") * s.cast("decimal(19,0)")).cast("double")
    std = F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1))) / 100)
    return parts.select("material_id", (ratio(s, n) / 100).alias("p_avg_unit_price"), F.coalesce(std, F.lit(0.0)).alias("p_std_unit_price"),
                        F.col("lo").alias("p_min_unit_price"), F.col("hi").alias("p_max_unit_price"))


def behavior_from_parts(parts: DataFrame) -> DataFrame:
    n = F.col("n")
    return parts.select("vendor_id", n.alias("v_invoice_count"), ratio(F.col("full"), n).alias("v_invoice_match_rate"),
                        ratio(F.col("price"), n).alias("v_price_variance_rate"), ratio(F.col("quantity"), n).alias("v_qty_variance_rate"),
                        ratio(F.col("blocked"), n).alias("v_payment_block_rate"))


def order_parts(po_headers: DataFrame) -> DataFrame:
    return po_headers.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("po_count"), F.sum("total_net_value").cast("decimal(38,2)").alias("po_value"))


def receipt_parts(gr_lines: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    rows, key = _owned(gr_lines, owner)
    return rows.groupBy(key).agg(
        F.sum("quantity_received").cast("decimal(38,2)").alias("received"), F.sum("quantity_rejected").cast("decimal(38,2)").alias("rejected"))


def performance_from_stores(orders: DataFrame, deliveries: DataFrame, receipts: DataFrame) -> DataFrame:
    return performance_from_parts(orders.join(deliveries, "vendor_id", "left").join(receipts, "vendor_id", "left"))


def material_pairs(po_lines: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """Different (vendor, material) pairs of a batch, or without ``owner`` (order, material): parts of a distinct count that stay exact when batches overlap."""
    rows, key = _owned(po_lines.select("po_id", "material_id"), owner)
    return rows.select(key, "material_id").distinct()


def distinct_from_pairs(spark: SparkSession, store: str, key: str, name: str, owner: DataFrame | None = None) -> DataFrame:
    pairs = spark.read.parquet(store).drop("batch")
    if owner is not None:
        pairs = pairs.join(owner, "po_id").drop("po_id")
    return pairs.distinct().groupBy(key).agg(F.count(F.lit(1)).alias(name))


def price_values(po_lines: DataFrame) -> DataFrame:
    """How often a material was bought at a price: parts of exact quantiles."""
    return po_lines.groupBy("material_id", "unit_price").agg(F.count(F.lit(1)).alias("n"))


def quantiles_from_values(spark: SparkSession, store: str, key: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per key from counted values of all batches."""
    return group_quantiles(spark.read.parquet(store), [key], value, probabilities, "n")


#: 2**12 registers: a standard error of 1.6 %; a KLL sketch of size 200: ranks within 1.7 % at 99 %.
LG_K, KLL_SIZE = 12, 200


def price_sketches(po_lines: DataFrame) -> DataFrame:
    """Per vendor a sketch of its materials and one of its prices, where exact pairs and values would be too many to keep."""
    return po_lines.groupBy("vendor_id").agg(F.hll_sketch_agg("material_id", LG_K).alias("materials"),
                                             F.kll_sketch_agg_double(F.col("unit_price").cast("double"), KLL_SIZE).alias("prices"))


def from_sketches(spark: SparkSession, store: str) -> DataFrame:
    merged = spark.read.parquet(store).groupBy("vendor_id").agg(F.hll_union_agg("materials").alias("materials"), F.kll_merge_agg_double("prices", KLL_SIZE).alias("prices"))
    return merged.select("vendor_id", F.hll_sketch_estimate("materials").alias("distinct_materials"),
                         F.kll_sketch_get_quantile_double("prices", F.lit(0.5)).alias("median"))
