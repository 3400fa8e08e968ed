"""Payment terms, due dates, discounts and payment application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import discount_days, discount_pct, has_discount, terms_days


def due_date(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    terms = vendors.select("vendor_id", "payment_terms")
    return invoices.join(terms, "vendor_id").select(
        "invoice_id", "invoice_date", terms_days("payment_terms").alias("terms_days"),
        F.date_add("invoice_date", terms_days("payment_terms")).alias("due_date"))


def early_discount(payments: DataFrame, links: DataFrame, invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Discount earned by each payment: terms allow it and it came inside the window."""
    inv = invoices.select("invoice_id", "invoice_date", "vendor_id", "total_net_amount")
    earned = has_discount("payment_terms") & (
        F.datediff("payment_date", "invoice_date") <= discount_days("payment_terms"))
    cut = F.round(F.col("total_net_amount") * discount_pct("payment_terms") / F.lit(100), 2)
    return (
        payments.select("payment_id", "payment_date").join(links.select("payment_id", "invoice_id"), "payment_id")
        .join(inv, "invoice_id").join(vendors.select("vendor_id", "payment_terms"), "vendor_id")
        .withColumn("discount", F.when(earned, cut).otherwise(0).cast("decimal(12,2)"))
        .select("payment_id", "invoice_id", "discount",
                (F.col("total_net_amount") - F.col("discount")).cast("decimal(14,2)").alias("pay_amount")))


def payable_invoices(invoices: DataFrame) -> DataFrame:
    return invoices.filter(~F.col("payment_block") & F.col("status").isin("MATCHED", "APPROVED"))


def apply_payments(invoices: DataFrame, payments: DataFrame, links: DataFrame) -> DataFrame:
    """Invoices with an executed payment become PAID."""
    executed = links.join(payments.filter(F.col("status") == "EXECUTED").select("payment_id"), "payment_id", "left_semi")
    paid = executed.select("invoice_id").distinct().withColumn("paid", F.lit(True))
    return invoices.join(paid, "invoice_id", "left").withColumn(
        "status", F.when(F.col("paid"), "PAID").otherwise(F.col("status"))).drop("paid")
