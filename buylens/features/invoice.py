"""Invoice behaviour of vendors, plain and leave-one-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import flag, ratio, share
from buylens.session import splittable

RATES = ["v_invoice_match_rate", "v_price_variance_rate", "v_qty_variance_rate", "v_avg_price_variance_pct"]


def full_match() -> Column:
    return F.col("match_status") == "FULL_MATCH"


def price_varies() -> Column:
    return F.col("match_status").isin("PRICE_VARIANCE", "BOTH_VARIANCE")


def quantity_varies() -> Column:
    return F.col("match_status").isin("QUANTITY_VARIANCE", "BOTH_VARIANCE")


def _variance_pct() -> Column:
    return F.when(F.col("unit_price_invoiced") > 0, ratio(F.abs("price_variance"), F.col("unit_price_invoiced"))).otherwise(0.0)


def invoice_behavior(invoices: DataFrame, lines: DataFrame, grain: str = "header") -> DataFrame:
    """Match, variance and block rates of every vendor.

    ``header`` counts each invoice once; ``line`` weights it by its number of lines.
    """
    rates = [share(full_match()).alias(RATES[0]), share(price_varies()).alias(RATES[1]), share(quantity_varies()).alias(RATES[2]),
             share(F.col("payment_block")).alias("v_payment_block_rate")]
    pct = lines.select("invoice_id", _variance_pct().alias("pct"))
    if grain == "line":
        return invoices.select("invoice_id", "vendor_id", "match_status", "payment_block").join(pct, "invoice_id").groupBy("vendor_id").agg(
            F.count(F.lit(1)).alias("v_invoice_count"), *rates, F.avg("pct").alias(RATES[3]))
    if grain != "header":
        raise ValueError(f"grain must be header or line, not {grain!r}")
    heads = invoices.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("v_invoice_count"), *rates)
    by_line = pct.join(invoices.select("invoice_id", "vendor_id"), "invoice_id").groupBy("vendor_id").agg(F.avg("pct").alias(RATES[3]))
    return heads.join(by_line, "vendor_id", "left").na.fill(0.0, [RATES[3]])


def invoice_behavior_loo(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Rates of the vendor without the invoice itself.

    (vendor total - own) / (n - 1), so one pass over the vendors replaces a pass per
    invoice. An only invoice gets the mean of all vendors' rates.
    """
    own_lines = lines.groupBy("invoice_id").agg(F.sum(_variance_pct()).alias("pct"), F.count(F.lit(1)).alias("lines"))
    # Both are read more than once and written out for it.
    own = splittable(invoices.select("invoice_id", "vendor_id", flag(full_match()).alias("full"), flag(price_varies()).alias("price"),
                                     flag(quantity_varies()).alias("quantity")).join(own_lines, "invoice_id", "left").na.fill(0, ["lines"]).na.fill(0.0, ["pct"]))
    parts = ["full", "price", "quantity", "pct", "lines"]
    totals = splittable(own.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t_{c}") for c in parts]))
    pct_all = F.coalesce(ratio(F.col("t_pct"), F.col("t_lines")), F.lit(0.0))
    cold = totals.agg(F.struct(*[F.avg(ratio(F.col(f"t_{c}"), F.col("n"))).alias(c) for c in parts[:3]],
                               F.avg(pct_all).alias("pct")).alias("c")).scalar()
    rest = F.col("t_pct") - F.col("pct")
    # The subtraction may leave a residue where nothing is left.
    pct_loo = F.when(F.abs(rest) < 1e-12, 0.0).otherwise(F.coalesce(ratio(rest, F.col("t_lines") - F.col("lines")), F.lit(0.0)))
    lonely = F.col("n") <= 1
    outs = [F.when(lonely, cold[c]).otherwise(ratio(F.col(f"t_{c}") - F.col(c), F.col("n") - 1)).alias(f"{r}_loo")
            for c, r in zip(parts[:3], RATES)]
    return own.join(totals, "vendor_id").select("invoice_id", *outs, F.when(lonely, cold["pct"]).otherwise(pct_loo).alias(f"{RATES[3]}_loo"))
