"""Queries over sources, sinks and the business rules."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from buylens.functions import columns as C
from buylens.operators import confidentiality as conf
from buylens.operators import contracts, hierarchy, matching, payments, receipts, reference, sourcing
from buylens.sources import tables as io

COUNTED = ["vendor_master", "material_master", "po_header", "po_line_item", "gr_header", "invoice_header", "payment"]


def matched_lines(t):
    return matching.three_way_match_lines(t["invoice_line_item"], t["po_line_item"], t["gr_line_item"])


def matched(t):
    return matching.match_status(matched_lines(t))


def coverage(t):
    return contracts.contract_coverage(t["contract_header"], t["contract_item"])


def csv_round_trip(t, name):
    folder = f"{t.folder}/csv"
    io.write_tables_csv(t, folder, [name])
    return io.read_table_csv(t.spark, folder, name)


def loaded_spend(t):
    """Orders and vendors through the loader, joined again."""
    t.written("po_header"), t.written("vendor_master")
    got = io.load_tables(t.spark, "parquet", ["po_header", "vendor_master"], folder=t.folder)
    return got["po_header"].join(got["vendor_master"].select("vendor_id", "country"), "vendor_id").groupBy("country").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_net_value").cast("decimal(18,2)").alias("value"))


def fact_layout(t):
    path = f"{t.folder}/fact_po_header"
    io.write_fact(t["po_header"], "po_date", path)
    return io.read_fact(t.spark, path, "po_date", "1996-11-15", "1997-02-10").select(
        "po_id", "po_date", "total_net_value")


def saved_and_read(t):
    """Vendors and orders written as Parquet folders by the full refresh, and read back."""
    to = f"{t.folder}/saved"
    io.save_tables(t, folder=to, names=["vendor_master", "po_header"])
    got = io.load_tables(t.spark, "parquet", ["po_header", "vendor_master"], folder=to)
    return got["po_header"].join(got["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id").select(
        "po_id", "po_date", "vendor_name", "total_net_value")


def features_and_back(t):
    """A feature table in folders per label month, and read back."""
    to = f"{t.folder}/features"
    io.write_features(t["invoice_header"].select("invoice_id", "invoice_date", "total_net_amount"), to, "invoice_date")
    return t.spark.read.parquet(to).withColumn("label_month", F.col("label_month").cast("string"))


def bucketed_match(t):
    """The three-way match by order line, on tables bucketed by the order line."""
    got = {n: io.save_bucketed(t[n], f"bucketed_{n}_{zlib.crc32(t.folder.encode()):08x}", f"{t.folder}/bucketed/{n}", matching.PO_KEY, 8)
           for n in ("invoice_line_item", "po_line_item", "gr_line_item")}
    return matching.three_way_match_lines(got["invoice_line_item"], got["po_line_item"], got["gr_line_item"], receipts="sum").select(
        "invoice_id", "invoice_line_number", "quantity_variance", "quantity_breach")


def resolved(t):
    return sourcing.resolve_source(t["pr_line_item"], t["pr_header"], t["source_list"], t["vendor_master"],
                                   t["contract_header"], t["contract_item"])


QUERIES = {
    "s01_read_table_csv": lambda t: csv_round_trip(t, "vendor_master"),
    "s03_load_tables": loaded_spend,
    "s04_write_tables_csv": lambda t: csv_round_trip(t, "po_line_item"),
    "s05_schema_report": io.schema_report,
    "s06_save_tables": saved_and_read,
    "s07_verify_counts": lambda t: io.verify_counts(t, COUNTED),
    "s08_write_features": features_and_back,
    "s09_write_fact": fact_layout,
    "s09_bucketed_match": bucketed_match,
    "b01_three_way_match_lines": lambda t: matched_lines(t).select(
        "invoice_id", "invoice_line_number", "price_variance", "quantity_variance", "price_breach", "quantity_breach"),
    "b01_match_sum_of_receipts": lambda t: matching.three_way_match_lines(
        t["invoice_line_item"], t["po_line_item"], t["gr_line_item"], receipts="sum").select(
        "invoice_id", "invoice_line_number", "quantity_variance", "quantity_breach"),
    "b02_match_status": lambda t: matched(t).select("invoice_id", "match_status"),
    "b03_block_reason": lambda t: matching.block_reason(matched(t)),
    "b04_invoice_totals": lambda t: matching.invoice_totals(t["invoice_line_item"]),
    "b05_terms_days": lambda t: t["vendor_master"].select(
        "vendor_id", "payment_terms", C.terms_days("payment_terms").alias("terms_days")),
    "b06_due_date": lambda t: payments.due_date(t["invoice_header"], t["vendor_master"]),
    "b07_early_discount": lambda t: payments.early_discount(
        t["payment"], t["payment_invoice_link"], t["invoice_header"], t["vendor_master"]),
    "b08_payable_invoices": lambda t: payments.payable_invoices(t["invoice_header"]).select(
        "invoice_id", "vendor_id", "total_net_amount", "payment_due_date"),
    "b09_apply_payments": lambda t: payments.apply_payments(
        matching.block_reason(matched(t)), t["payment"], t["payment_invoice_link"]).select("invoice_id", "status"),
    "b10_apply_receipts": lambda t: receipts.apply_receipts(
        t["po_header"], t["po_line_item"], t["gr_header"])[1].select(
        "po_id", "po_line_number", "gr_status", "actual_delivery_date"),
    "b10_apply_receipts_headers": lambda t: receipts.apply_receipts(
        t["po_header"], t["po_line_item"], t["gr_header"])[0].select("po_id", "status"),
    "b11_apply_invoices": lambda t: matching.apply_invoices(
        t["po_line_item"], t["invoice_line_item"]).select("po_id", "po_line_number", "invoice_status"),
    "b12_first_receipt": lambda t: receipts.first_receipt(t["gr_header"], t["gr_line_item"]),
    "b13_delivery_class": lambda t: receipts.delivery_class(t["po_line_item"]),
    "b14_receipt_class": lambda t: receipts.receipt_class(t["gr_line_item"], t["po_line_item"]),
    "b15_po_totals": lambda t: contracts.po_totals(t["po_line_item"]),
    "b16_reconcile_contracts": lambda t: contracts.reconcile_contracts(
        t["contract_header"], t["contract_item"], t["po_line_item"]),
    "b17_max_tier": lambda t: t["source_list"].select("vendor_id", "material_id").distinct().join(
        t["vendor_master"].selectExpr("vendor_id", "confidentiality_tier as vt"), "vendor_id").join(
        t["material_master"].selectExpr("material_id", "confidentiality_tier as mt"), "material_id").groupBy(
        C.max_tier("vt", "mt").alias("tier")).agg(F.count(F.lit(1)).alias("pairs")),
    "b18_propagate_confidentiality": lambda t: conf.propagate_confidentiality(
        t["source_list"], t["vendor_master"], t["material_master"], t["contract_header"], t["contract_item"]),
    "b19_material_tier": lambda t: conf.material_tier(t["material_master"]),
    "b20_candidate_vendors": lambda t: sourcing.candidate_vendors(
        t["material_plant_extension"], t["material_master"], t["category_hierarchy"], t["vendor_master"],
        t["vendor_category"]),
    "b20_candidate_counts": lambda t: sourcing.candidate_counts(
        t["material_plant_extension"], t["material_master"], t["category_hierarchy"], t["vendor_master"],
        t["vendor_category"]),
    "b21_contract_coverage": coverage,
    "b22_enrich_source_list": lambda t: sourcing.enrich_source_list(t["source_list"], t["vendor_master"], coverage(t)),
    "b23_resolve_source": resolved,
    "b24_buying_price": lambda t: sourcing.buying_price(resolved(t), t["contract_item"], t["material_master"]).select(
        "pr_id", "pr_line_number", "vendor_id", "buying_price"),
    "b25_unordered_pr_lines": lambda t: sourcing.unordered_pr_lines(t["pr_line_item"], t["po_line_item"]).select(
        "pr_id", "pr_line_number", "material_id"),
    "b26_pr_line_status": lambda t: t["pr_line_item"].select("pr_id", "pr_line_number").join(
        t["pr_header"].select("pr_id", sourcing.pr_line_status("status").alias("line_status")), "pr_id"),
    "b27_lane_lead_time": lambda t: sourcing.lane_lead_time(t["po_line_item"], t["po_header"], t["source_list"]),
    "b28_category_root": lambda t: hierarchy.category_root(t["category_hierarchy"]),
    "b29_purch_group_for": lambda t: hierarchy.purch_group_for(t["category_hierarchy"]),
    "b30_category_closure": lambda t: hierarchy.category_closure(t["category_hierarchy"]),
    "b31_convert_uom": lambda t: reference.convert_uom(
        t["po_line_item"].select("po_id", "po_line_number", "material_id", "quantity", "uom"), t["uom_conversion"],
        "quantity", "uom", "BOX").select("po_id", "po_line_number", "converted_quantity", "converted_uom"),
    "b32_to_usd": lambda t: t["po_header"].select("po_id", C.to_usd("total_net_value", "currency").alias("value_usd")),
    "b33_add_business_days": lambda t: t["invoice_header"].select("received_date").distinct().select(
        "received_date", C.add_business_days("received_date", 5).alias("plus_5"),
        C.add_business_days("received_date", 13).alias("plus_13"),
        C.add_business_days("received_date", -3).alias("minus_3")),
    "b34_alias_groups": lambda t: reference.alias_groups(t["vendor_master"]),
    "b35_lookup": lambda t: reference.lookup_rows(t, "source_list", plant_id="PL01", preferred_rank=1).select(
        "material_id", "vendor_id", "lane_lead_time_days"),
    "b36_id_set": lambda t: reference.id_set(t, "category_hierarchy", "level = 3"),
}
