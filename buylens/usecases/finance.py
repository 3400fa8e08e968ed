"""Money-side use cases: contract renewal, payment timing, duplicate invoices."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buylens.features import groups, invoice, vendor
from buylens.functions.columns import CRITICALITY, discount_days, discount_pct, flag, has_discount, ordinal, ratio, share
from buylens.operators.contracts import in_force
from buylens.operators.windows import nearby_count, previous
from buylens.session import splittable

Tables = Mapping[str, DataFrame]


def uc06_features(t: Tables, as_of: str) -> DataFrame:
    """Renewal signals of every contract, from its items, materials and vendor; those of the items are null for a contract without any."""
    items = groups.contract_status(t["contract_header"], t["contract_item"], as_of)
    listed = t["contract_item"].select("contract_id", "item_number", "material_id").join(
        t["contract_header"].select("contract_id", "vendor_id"), "contract_id")
    sources = t["source_list"].groupBy("material_id").agg(F.countDistinct("vendor_id").alias("vendors"))
    per_material = listed.join(t["material_master"].select("material_id", ordinal("criticality", CRITICALITY).alias("crit")), "material_id").join(
        sources, "material_id", "left").groupBy("contract_id").agg(
        F.max("crit").alias("uc06_material_criticality_max"),
        # Sources of the most exposed material, the contract's own vendor not counted.
        F.greatest(F.min(F.coalesce("vendors", F.lit(0))) - 1, F.lit(0)).alias("uc06_alternative_vendor_count"))
    used = items.groupBy("contract_id").agg(
        F.avg("c_consumption_pct").alias("c_consumption_pct"), F.max("c_months_active").alias("c_months_active"))
    perf = vendor.performance_from_parts(vendor.performance_parts(t["po_header"], t["po_line_item"], t["gr_line_item"]))
    matched = t["invoice_header"].groupBy("vendor_id").agg(share(invoice.full_match()).alias("match_rate"))
    score = (F.coalesce("v_on_time_delivery_actual", F.lit(0.5)) * 100 + F.col("quality_score") + F.coalesce("match_rate", F.lit(0.0)) * 100) / 3
    scores = t["vendor_master"].select("vendor_id", "quality_score").join(perf, "vendor_id", "left").join(matched, "vendor_id", "left").select(
        "vendor_id", score.alias("uc06_vendor_performance_score"))
    length = F.datediff(F.least(F.lit(as_of).cast("date"), F.col("valid_to")), "valid_from")
    # At the pace so far the contract is used up after elapsed / consumed share days.
    exhaust = F.when(F.col("c_consumption_pct") > 0, F.date_add("valid_from", F.floor(length / F.col("c_consumption_pct")).cast("int")))
    due = F.datediff("valid_to", F.lit(as_of).cast("date")).alias("uc06_days_to_expiry")
    headers = t["contract_header"].select("contract_id", "vendor_id", "valid_from", "valid_to", due, flag(F.col("status") == "ACTIVE").alias("c_is_active"))
    return (headers.join(used, "contract_id", "left").join(per_material, "contract_id", "left")
            .join(scores, "vendor_id", "left").select(
        "contract_id", "vendor_id", "uc06_days_to_expiry", "c_is_active", "c_consumption_pct",
        F.try_divide(F.col("c_consumption_pct"), F.col("c_months_active")).alias("uc06_consumption_velocity"),
        exhaust.alias("uc06_estimated_exhaust_date"), "uc06_material_criticality_max", "uc06_alternative_vendor_count", "uc06_vendor_performance_score"))


def renewal_rule(df: DataFrame, days: int = 90, pct: float = 0.7, urgent_days: int = 60) -> DataFrame:
    """Contracts about to end while mostly used up."""
    due, used = F.col("uc06_days_to_expiry"), F.col("c_consumption_pct") > pct
    return df.select("contract_id", ((due <= days) & used).alias("needs_renewal"), ((due <= urgent_days) & used).alias("urgent"))


def uc07_features(t: Tables, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    contracts = t["contract_header"].filter(in_force(None)).groupBy("vendor_id").agg(F.count(F.lit(1)).alias("contracts"))
    strategic = flag(F.col("preferred_flag")) * 40 + F.least(F.coalesce("contracts", F.lit(0)), F.lit(3)) * 10 + F.col("quality_score") * 0.3
    vendors = t["vendor_master"].join(contracts, "vendor_id", "left").select("vendor_id", "payment_terms", strategic.alias("strategic"))
    return t["invoice_header"].join(vendors, "vendor_id").select(
        "invoice_id", flag(has_discount("payment_terms")).alias("uc07_has_early_discount"), discount_pct("payment_terms").alias("uc07_discount_pct"),
        (discount_days("payment_terms") - F.datediff(day, "invoice_date")).alias("uc07_discount_window_remaining"),
        F.col("total_net_amount").alias("uc07_invoice_amount"), F.col("strategic").alias("uc07_vendor_strategic_score"),
        flag(F.col("payment_block")).alias("uc07_payment_block"))


def payment_plan(t: Tables) -> DataFrame:
    """When to pay each unblocked invoice, what it earns, and how it was paid."""
    terms = F.col("payment_terms")
    takes = has_discount(terms)
    paid = t["payment_invoice_link"].select("invoice_id", "payment_id").join(
        t["payment"].filter("status = 'EXECUTED'").select("payment_id", "payment_date"), "payment_id").groupBy("invoice_id").agg(
        F.min("payment_date").alias("payment_date"))
    offset = F.datediff("payment_date", "payment_due_date")
    return (t["invoice_header"].filter("not payment_block").join(t["vendor_master"].select("vendor_id", "payment_terms"), "vendor_id")
            .join(paid, "invoice_id", "left").select(
        "invoice_id", "vendor_id", "total_net_amount",
        F.when(takes, F.date_add("invoice_date", discount_days(terms))).otherwise(F.col("payment_due_date")).alias("plan_date"),
        F.when(takes, F.round(F.col("total_net_amount") * discount_pct(terms) / 100, 2)).otherwise(0).cast("decimal(12,2)").alias("discount"),
        F.when(takes, F.datediff("payment_due_date", F.date_add("invoice_date", discount_days(terms)))).otherwise(0).alias("days_advanced"),
        F.when(offset < -3, "EARLY").when(offset <= 3, "ON_TIME").when(offset > 3, "LATE").alias("paid_class")))


def discount_portfolio(plan: DataFrame) -> DataFrame:
    """Discounts on offer against the cash advanced, with the yearly return."""
    eligible = plan.filter("discount > 0")
    cash = F.col("total_net_amount") - F.col("discount")
    sums = eligible.agg(F.count(F.lit(1)).alias("eligible_invoices"), F.sum("discount").cast("decimal(18,2)").alias("discount_captured"),
                        F.sum(cash).cast("decimal(18,2)").alias("cash_advanced"), F.sum(cash * F.col("days_advanced")).alias("cash_days"))
    return sums.select("eligible_invoices", "discount_captured", "cash_advanced",
                       F.try_divide(F.col("discount_captured").cast("double") * 365, F.col("cash_days").cast("double")).alias("annual_return"))


def duplicate_links(invoices: DataFrame, days: int = 7, keys: tuple[str, ...] = ("vendor_id", "total_gross_amount"),
                    columns: tuple[str, ...] = ()) -> DataFrame:
    """Each invoice with the closest earlier one of the same vendor and amount.

    An invoice has an earlier duplicate within ``days`` exactly when its direct
    predecessor is one, so the links find every duplicate and tie each cluster together
    without listing all of its pairs.
    """
    rows = invoices.select(*dict.fromkeys(["invoice_id", "invoice_date", *keys, *columns]))
    last = F.struct(F.col("invoice_id").alias("id"), F.col("invoice_date").alias("day"))
    linked = previous(rows, list(keys), "invoice_date", ["invoice_id"], last, "p")
    gap = F.datediff("invoice_date", F.col("p.day"))
    return linked.filter(gap <= days).select(F.col("p.id").alias("first_invoice_id"), "invoice_id", gap.alias("date_gap_days"))


def duplicate_counts(invoices: DataFrame, days: int = 30) -> DataFrame:
    """Other invoices within the window with the same vendor and amount, or the same order."""
    rows = invoices.select("invoice_id", "vendor_id", "po_id", "total_gross_amount", "invoice_date")
    rows = nearby_count(rows, ["vendor_id", "total_gross_amount"], "invoice_date", days, "uc11_same_vendor_same_amount")
    rows = nearby_count(rows, ["po_id"], "invoice_date", days, "uc11_same_po_reference")
    return rows.select("invoice_id", "uc11_same_vendor_same_amount", "uc11_same_po_reference")


def number_variants(invoices: DataFrame) -> DataFrame:
    """Vendor invoice numbers as they are, with one character left out, and with one character masked.

    Numbers one replaced character apart share a masked variant; one with a character more than the other
    shares its shortened variant with the other number itself.
    """
    number = F.col("vendor_invoice_number")
    places = F.sequence(F.lit(1), F.length(number))
    cut = lambda mark: F.transform(places, lambda i: F.concat(F.substring(number, F.lit(1), i - 1), F.lit(mark), F.substring(number, i + 1, F.length(number))))
    variants = F.array_distinct(F.concat(F.array(number), cut("_"), cut("")))
    return invoices.select("invoice_id", "invoice_date", "vendor_id", F.explode(variants).alias("variant"))


#: Bits of the sieve of hashes: at most 2 million rows of 64 bits, whatever the input.
SIEVE_BITS = 27


def number_links(invoices: DataFrame, days: int = 30) -> DataFrame:
    """Links between invoices of a vendor whose numbers are equal or one replaced, added or dropped character apart.

    Almost every variant occurs once. A count per hash tells which hashes repeat, and those are bits of a sieve of bounded size that goes to the variants:
    only hashes move, and variants that pass. The links are made on the variants themselves, so a chance pass does no harm.
    """
    variants = number_variants(invoices).withColumn("h", F.shiftrightunsigned(F.xxhash64("vendor_id", "variant"), 24))
    # Dealt out first: a count before the shuffle finds next to no equal hashes.
    repeated = variants.select("h").repartition("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    word = F.expr(f"(h & {(1 << SIEVE_BITS) - 1}L) >> 6")
    sieve = splittable(repeated.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")))
    passed = variants.withColumn("word", word).join(F.broadcast(sieve), "word").filter("shiftright(bits, cast(h & 63 as int)) & 1 = 1")
    return duplicate_links(splittable(passed.select("invoice_id", "invoice_date", "vendor_id", "variant")), days, ("vendor_id", "variant"))


def amount_links(invoices: DataFrame, lines: DataFrame | None = None, days: int = 30, percent: int = 5) -> DataFrame:
    """Links between invoices of a vendor that share an ordered good and quantity (any, without ``lines``), whose amounts differ by ``percent`` of the first one's at most.

    Nearness is not transitive, so every pair in the window is made. Amounts fall into cells by their logarithm, so that near ones are in the same or in
    adjacent cells however large they are; days fall into blocks of the window's length. A pair meets once, on vendor, good, quantity, cell and block.
    Invoices of one day with the same amount and good are one class, its least id stands for it; equal amounts are ``duplicate_links``'.
    """
    amount = F.col("total_gross_amount")
    width = -math.log(1 - percent / 100)
    rows, keys = invoices.filter(amount != 0).select("invoice_id", "vendor_id", "invoice_date", "total_gross_amount"), ["vendor_id"]
    if lines is not None:
        keys += ["material_id", "quantity_invoiced"]
        rows = rows.join(lines.select("invoice_id", "material_id", "quantity_invoiced").distinct(), "invoice_id")
    classes = rows.groupBy(*keys, "invoice_date", "total_gross_amount").agg(F.min("invoice_id").alias("invoice_id"))
    placed = splittable(classes.withColumns({
        "above": amount > 0, "cell": F.floor(F.log(F.abs(amount.cast("double"))) / width), "block": F.floor(F.unix_date("invoice_date") / (days + 1))}))
    first = placed.select(*keys, "above", F.col("invoice_id").alias("first_invoice_id"), F.col("invoice_date").alias("first_date"), F.col("total_gross_amount").alias("first_amount"),
                          F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"), "block")
    first = first.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    gap = F.datediff("invoice_date", "first_date")
    after = (gap > 0) | ((gap == 0) & (F.col("invoice_id") > F.col("first_invoice_id")))
    off = F.abs(F.col("first_amount") - amount)
    near = (off > 0) & (off * 100 <= F.abs("first_amount") * percent)
    return first.join(placed, [*keys, "above", "cell", "block"]).filter(after & (gap <= days) & near).select("first_invoice_id", "invoice_id").distinct()


def candidate_links(invoices: DataFrame, lines: DataFrame | None = None, days: int = 30) -> DataFrame:
    """Invoices linked by equal amount, order, or a number one character apart, each to its predecessor, and by near amounts, each to all in the window."""
    links = [duplicate_links(invoices, days), duplicate_links(invoices, days, ("vendor_id", "po_id")), number_links(invoices, days),
             amount_links(invoices, lines, days)]
    return reduce(DataFrame.unionByName, [x.select("first_invoice_id", "invoice_id") for x in links]).distinct()


def fuzzy_pairs(invoices: DataFrame, lines: DataFrame, days: int = 30) -> DataFrame:
    """Similarity of linked invoices: number, amount, date and ordered goods."""
    pairs = splittable(candidate_links(invoices, lines, days))
    info = invoices.select("invoice_id", "invoice_date", "vendor_invoice_number", "total_gross_amount")
    first = info.select(F.col("invoice_id").alias("first_invoice_id"), F.col("invoice_date").alias("first_date"),
                        F.col("vendor_invoice_number").alias("first_number"), F.col("total_gross_amount").alias("first_amount"))
    goods = lines.select("invoice_id", "material_id", "quantity_invoiced").distinct()
    sizes = goods.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("size"))
    # Common lines are found by joining lines on the pair and the good, never as one list per invoice.
    common = pairs.join(goods.withColumnRenamed("invoice_id", "first_invoice_id"), "first_invoice_id").join(
        goods, ["invoice_id", "material_id", "quantity_invoiced"]).groupBy("first_invoice_id", "invoice_id").agg(F.count(F.lit(1)).alias("common"))
    n = F.coalesce("common", F.lit(0))
    both = F.coalesce("size", F.lit(0)) + F.coalesce("first_size", F.lit(0))
    return (pairs.join(info, "invoice_id").join(first, "first_invoice_id").join(sizes, "invoice_id", "left")
            .join(sizes.select(F.col("invoice_id").alias("first_invoice_id"), F.col("size").alias("first_size")), "first_invoice_id", "left")
            .join(common, ["first_invoice_id", "invoice_id"], "left").select(
        "first_invoice_id", "invoice_id", F.levenshtein("first_number", "vendor_invoice_number").alias("uc11_invoice_number_distance"),
        ratio(F.abs(F.col("first_amount") - F.col("total_gross_amount")), F.col("first_amount")).alias("uc11_amount_deviation"),
        F.abs(F.datediff("invoice_date", "first_date")).alias("uc11_date_gap_days"), ratio(n, both - n).alias("uc11_line_item_overlap")))
