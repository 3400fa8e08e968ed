"""Checks on documents as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.features.price import price_stats
from buylens.functions.columns import flag, ratio
from buylens.operators.matching import three_way_match_lines
from buylens.session import discard, splittable
from buylens.streaming.runs import run_batches
from buylens.usecases.finance import duplicate_links

Tables = Mapping[str, DataFrame]


def stream_match(lines: DataFrame, t: Tables) -> DataFrame:
    """Match invoice lines on arrival against the stored orders and receipts."""
    matched = three_way_match_lines(lines, t["po_line_item"], t["gr_line_item"])
    status = (F.when(F.col("price_breach") & F.col("quantity_breach"), "BOTH_VARIANCE").when(F.col("price_breach"), "PRICE_VARIANCE")
              .when(F.col("quantity_breach"), "QUANTITY_VARIANCE").otherwise("FULL_MATCH"))
    return matched.withColumn("match_status", status).withColumn(
        "block_reason", F.when(F.col("price_breach"), "PRICE_MISMATCH").when(F.col("quantity_breach"), "QTY_MISMATCH")).select(
        "invoice_id", "invoice_line_number", "price_variance", "quantity_variance", "match_status", "block_reason")


def stream_po_check(lines: DataFrame, t: Tables, ratio_limit: float = 1.15, z_limit: float = 2.0) -> DataFrame:
    """Maverick and price check of new order lines against a snapshot of prices and sources."""
    # Written once before the stream starts, or every batch would read the whole history.
    prices = splittable(price_stats(t["po_line_item"], ["material_id"]).select("material_id", "p_avg_unit_price", "p_std_unit_price"))
    heads = t["po_header"].select("po_id", "vendor_id", "plant_id")
    lanes = t["source_list"].select("material_id", "plant_id", "vendor_id", "approval_status")
    price = F.col("unit_price").cast("double")
    z = F.try_divide(price - F.col("p_avg_unit_price"), F.when(F.col("p_std_unit_price") > 1e-9, F.col("p_std_unit_price")))
    score = (flag(ratio(F.col("unit_price"), F.col("standard_cost")) > ratio_limit) + flag(F.col("contract_id").isNull())
             + flag(F.coalesce("approval_status", F.lit("")) != "APPROVED"))
    return (lines.select("po_id", "po_line_number", "material_id", "unit_price", "contract_id").join(heads, "po_id")
            .join(t["material_master"].select("material_id", "standard_cost"), "material_id").join(prices, "material_id", "left")
            .join(lanes, ["material_id", "plant_id", "vendor_id"], "left")
            .select("po_id", "po_line_number", score.alias("maverick_score"), F.coalesce(F.abs(z) > z_limit, F.lit(False)).alias("price_anomaly")))


def stream_counts(df: DataFrame, ts: str, size: str, slide: str | None, delay: str, by: str) -> DataFrame:
    """Rows per window and value; a window is final once the watermark has passed its end."""
    stamped = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stamped.groupBy(span.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def drop_replays(invoices: DataFrame, ts: str, delay: str) -> DataFrame:
    """Drop exact repetitions of an invoice inside the watermark."""
    return invoices.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["vendor_id", "vendor_invoice_number", "total_gross_amount"])


def stream_duplicates(invoices: DataFrame, spark: SparkSession, store: str, checkpoint: str, days: int = 7) -> None:
    """Link arriving invoices to the closest earlier one of the same vendor and amount.

    The seen invoices lie in folders by month, then by batch. A batch opens only the folders of the months it can touch, however many
    batches there were before, links as the batch operator does, and writes the links that involve a new invoice. A repeated batch
    writes the same folders again and reads none of a later number.
    """
    columns = ["invoice_id", "invoice_date", "vendor_id", "total_gross_amount"]

    def handle(batch: DataFrame, number: int) -> None:
        new = batch.select(*columns).withColumns({"month": F.date_format("invoice_date", "yyyy-MM"), "batch": F.lit(number)})
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{store}/seen")
        near_months = F.sequence(F.trunc(F.date_sub("invoice_date", days), "month"), F.trunc(F.date_add("invoice_date", days), "month"), F.expr("interval 1 month"))
        # One row per calendar month.
        months = sorted(r["m"] for r in batch.filter("invoice_date is not null").select(F.explode(near_months).alias("m")).distinct().select(
            F.date_format("m", "yyyy-MM").alias("m")).collect())
        if not months:
            return
        seen = spark.read.option("basePath", f"{store}/seen").schema(new.schema).parquet(f"{store}/seen/month={{{','.join(months)}}}").filter(F.col("batch") <= number)
        fresh = seen.filter(F.col("batch") == number)
        reach = fresh.agg(F.date_sub(F.min("invoice_date"), days).alias("lo"), F.date_add(F.max("invoice_date"), days).alias("hi")).first()
        near = seen.filter(F.col("invoice_date").between(reach["lo"], reach["hi"]))
        ids = fresh.select("invoice_id")
        links = duplicate_links(near, days)
        touched = links.join(ids, "invoice_id", "left_semi").unionByName(
            links.join(ids.withColumnRenamed("invoice_id", "first_invoice_id"), "first_invoice_id", "left_semi").select(links.columns)).distinct()
        touched.write.mode("overwrite").parquet(f"{store}/links/batch={number}")

    run_batches(invoices, handle, checkpoint)


def read_links(spark: SparkSession, store: str) -> DataFrame:
    """All links found so far; a later batch may put an invoice between two linked ones,
    so per invoice the closest predecessor counts."""
    links = spark.read.parquet(f"{store}/links")
    best = links.groupBy("invoice_id").agg(F.min(F.struct("date_gap_days", (-F.col("batch")).alias("b"), "first_invoice_id")).alias("x"))
    return best.select("x.first_invoice_id", "invoice_id", "x.date_gap_days")


_STATE = "po_id string, kind string, at timestamp"


def stream_overdue_receipts(orders: DataFrame, receipts: DataFrame, spark: SparkSession, store: str, checkpoint: str, tolerance_days: int = 3,
                            delay_days: int = 1, orphan_days: int = 400) -> None:
    """Order lines without a receipt by their requested date plus the tolerance.

    ``orders`` has po_id and due_ts, ``receipts`` po_id and gr_ts. A line is reported once both streams have passed its deadline by ``delay_days``; a receipt counts
    however long before the requested date it comes. The state is a table, written anew by each batch from the one before: open lines, and per order that
    has lines before their deadline the last deadline and the first receipt. A line with its receipt leaves at once, an order after its
    last deadline; a receipt that no order line has claimed leaves after ``orphan_days``. So the state grows with open orders, not with the length of the streams.
    """
    both = orders.select("po_id", F.lit("due").alias("kind"), F.col("due_ts").alias("at")).unionByName(
        receipts.select("po_id", F.lit("got").alias("kind"), F.col("gr_ts").alias("at"))).filter("at is not null and po_id is not null")
    tolerance = F.expr(f"interval {tolerance_days} days")

    def version(number: int) -> str:
        return f"{store}/state/version={number}"

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.select("po_id", "kind", "at")
        if number:
            rows = rows.unionByName(spark.read.schema(_STATE).parquet(version(number - 1)))
        rows = splittable(rows)
        of = lambda *kinds: rows.filter(F.col("kind").isin(*kinds))
        clocks = rows.agg(*[F.max(F.when(F.col("kind").isin(k, f"clock_{k}"), F.col("at"))).alias(k) for k in ("due", "got")])
        passed = F.least(*[F.coalesce(k, F.lit("0001-01-01").cast("timestamp")) for k in ("due", "got")]) - F.expr(f"interval {delay_days} days")
        mark = F.lit(clocks.select(passed.alias("mark")).first()["mark"])
        first = of("got").groupBy("po_id").agg(F.min("at").alias("got"))
        last = of("due", "last").groupBy("po_id").agg(F.max("at").alias("last"))
        lines = of("due").join(splittable(first), "po_id", "left")
        waiting = lines.filter(F.col("got").isNull() | (F.col("got") > F.col("at") + tolerance))
        late = F.col("at") + tolerance < mark
        waiting.filter(late).select("po_id", F.col("at").alias("due_ts")).write.mode("overwrite").parquet(f"{store}/overdue/batch={number}")
        order = first.join(last, "po_id", "full")
        alive = F.when(F.col("last").isNull(), F.col("got") + F.expr(f"interval {orphan_days} days") >= mark).otherwise(F.col("last") + tolerance >= mark)
        kept = order.filter(alive).select("po_id", F.inline(F.array(
            F.struct(F.lit("last").alias("kind"), F.col("last").alias("at")), F.struct(F.lit("got").alias("kind"), F.col("got").alias("at"))))).filter("at is not null")
        clock = clocks.select(F.lit(None).cast("string").alias("po_id"), F.inline(F.array(*[
            F.struct(F.lit(f"clock_{k}").alias("kind"), F.col(k).alias("at")) for k in ("due", "got")]))).filter("at is not null")
        state = waiting.filter(~late).select("po_id", "kind", "at").unionByName(kept).unionByName(clock)
        state.write.mode("overwrite").parquet(version(number))
        if number > 1:  # the one before this stays, a repeated batch starts from it
            discard(spark, version(number - 2))

    run_batches(both, handle, checkpoint)


def read_overdue(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/overdue").select("po_id", "due_ts")


def sessions(df: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Activity sessions per key, batch or stream; a pause of ``gap`` or more ends one."""
    stamped = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        stamped = stamped.withWatermark(ts, watermark)
    return stamped.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def sessions_by_day(df: DataFrame, key: str, date: str, gap_days: int) -> DataFrame:
    """Sessions of dated rows. The days of a key are merged first, so a busy key is short."""
    days = df.groupBy(key, date).agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(key).orderBy(date)
    starts = F.coalesce(F.datediff(F.col(date), F.lag(date).over(order)) >= gap_days, F.lit(True))
    numbered = days.withColumn("_new", flag(starts)).withColumn("_s", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_s").agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.sum("c").alias("n")).drop("_s")
