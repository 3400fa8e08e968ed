"""Invoice-match dataset: joins, features, labels, matrix and leakage guard (UC-02)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buylens.features import invoice, price, vendor
from buylens.functions.columns import CONFIDENTIALITY, CRITICALITY, MATCH_CLASS, flag, lookup, ordinal, ratio, to_usd
from buylens.operators.windows import sequence
from buylens.session import splittable

Tables = Mapping[str, DataFrame]

# Columns known only once the match is decided.
LEAKAGE = ["price_variance", "quantity_variance", "payment_block", "block_reason", "status", "unit_price_invoiced",
           "quantity_invoiced", "total_gross_amount", "tax_amount", "total_net_amount", "net_amount"]

TEMPORAL = ["invoice_month", "invoice_quarter", "days_po_to_invoice", "days_gr_to_invoice"]
SPECIFIC = ["uc02_is_contract_po", "uc02_gr_qty_vs_po_qty", "uc02_gr_has_rejection", "uc02_days_gr_to_invoice", "uc02_is_maverick_po",
            "uc02_po_type_rush", "uc02_price_vs_standard", "uc02_delivery_delay_days", "uc02_material_criticality",
            "uc02_gr_status_quality_hold", "uc02_amount_usd", "uc02_hazmat_flag", "uc02_confidentiality"]
SCORES = ["uc02_vendor_quality_score", "uc02_vendor_risk_score", "uc02_vendor_otd_rate", "uc02_vendor_esg_score"]
PROFILE = [f"v_type_{k.lower()}" for k in vendor.VENDOR_TYPES] + [
    "v_preferred", "v_status_encoded", "v_country_risk", "v_payment_terms_days", "v_has_early_discount", "v_confidentiality_ordinal",
    "v_category_count"]
PERFORMANCE = ["v_total_po_count", "v_total_po_value", "v_avg_po_value", "v_on_time_delivery_actual", "v_avg_delivery_delay_days",
               "v_rejection_rate", "v_distinct_materials"]
BEHAVIOR = [f"{r}_loo" for r in invoice.RATES]
PRICES = ["p_avg_unit_price", "p_std_unit_price", "p_min_unit_price", "p_max_unit_price", "p_price_to_standard_ratio", "p_contract_price"]
BASE_NUMBERS = ["po_total_net_value", "po_quantity", "po_unit_price", "quantity_received", "quantity_accepted", "quantity_rejected",
                "standard_cost", "default_lead_time_days", "contract_agreed_price"]
FEATURES = (BASE_NUMBERS + TEMPORAL + PROFILE + PERFORMANCE + BEHAVIOR + PRICES + SPECIFIC + SCORES + ["uc02_vendor_invoice_seq"])


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*LEAKAGE)


def uc02_base(t: Tables, invoice_ids: DataFrame | None = None, per_material: DataFrame | None = None, encoded: bool = False) -> DataFrame:
    """One row per invoice line with its documents; nothing that gives the outcome away.

    ``per_material`` adds its columns along with the material's own. ``encoded`` adds the features and labels that are narrower than what they are made
    of as soon as that is there, so that the wide rows need not carry it.
    """
    def early(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumns({n: _specific()[n] for n in names}) if encoded else df

    heads, lines = t["invoice_header"], t["invoice_line_item"]
    if invoice_ids is not None:
        heads = heads.join(invoice_ids, "invoice_id", "left_semi")
        lines = lines.join(invoice_ids, "invoice_id", "left_semi")
    heads = heads.select("invoice_id", "invoice_date", "received_date", "vendor_id", "currency", "payment_due_date", "match_status")
    lines = lines.select("invoice_id", "invoice_line_number", "po_id", "po_line_number", "material_id", "gr_id", "gr_line_number")
    orders = t["po_line_item"].select(
        "po_id", "po_line_number", F.col("quantity").alias("po_quantity"), F.col("unit_price").alias("po_unit_price"),
        "requested_delivery_date", "actual_delivery_date", "contract_id", "contract_item_number",
    ).join(t["po_header"].select("po_id", "po_date", "po_type", "incoterms", "payment_terms",
                                 F.col("total_net_value").alias("po_total_net_value"), "maverick_flag"), "po_id")
    received = t["gr_line_item"].select("gr_id", "gr_line_number", "quantity_received", "quantity_accepted", "quantity_rejected",
                                        "rejection_reason").join(
        t["gr_header"].select("gr_id", "gr_date", F.col("status").alias("gr_status")), "gr_id")
    materials = t["material_master"].select(
        "material_id", "material_type", "category_id", "standard_cost", "criticality", "hazmat_flag", "default_lead_time_days",
        "make_or_buy", F.col("confidentiality_tier").alias("material_confidentiality"))
    if per_material is not None:
        materials = materials.join(per_material, "material_id", "left")
    agreed = t["contract_item"].select(
        "contract_id", F.col("item_number").alias("contract_item_number"), F.col("agreed_price").alias("contract_agreed_price"))
    contracts = t["contract_header"].select("contract_id", "contract_type", F.col("valid_from").alias("contract_valid_from"),
                                            F.col("valid_to").alias("contract_valid_to"))
    # Every join moves all columns gathered before it: those that bring few come first, the material's many last.
    taken = early(lines.join(received, ["gr_id", "gr_line_number"], "left"), "uc02_gr_status_quality_hold")
    ordered = (taken.join(match_labels(heads) if encoded else heads, "invoice_id")
               .join(early(orders, "uc02_po_type_rush", "uc02_is_maverick_po", "uc02_delivery_delay_days"), ["po_id", "po_line_number"]))
    priced = early(ordered.join(contracts, "contract_id", "left").join(agreed, ["contract_id", "contract_item_number"], "left"), "uc02_is_contract_po")
    joined = priced.join(materials, "material_id", "left")
    first = ["contract_id", "contract_item_number", "material_id", "gr_id", "gr_line_number", "po_id", "po_line_number", "invoice_id"]
    tables = [x.columns for x in (lines, heads, orders, received, materials, contracts, agreed, joined)]
    return joined.select(*dict.fromkeys(sum(tables, first)))


def temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "invoice_month": F.month("invoice_date"), "invoice_quarter": F.quarter("invoice_date"),
        "days_po_to_invoice": F.datediff("invoice_date", "po_date"), "days_gr_to_invoice": F.datediff("invoice_date", "gr_date")})


def _specific() -> dict[str, Column]:
    return {
        "uc02_is_contract_po": flag(F.col("contract_id").isNotNull()),
        "uc02_gr_qty_vs_po_qty": ratio(F.col("quantity_received"), F.col("po_quantity")),
        "uc02_gr_has_rejection": flag(F.col("quantity_rejected") > 0),
        "uc02_days_gr_to_invoice": F.datediff("invoice_date", "gr_date"),
        "uc02_is_maverick_po": flag(F.col("maverick_flag")), "uc02_po_type_rush": flag(F.col("po_type") == "RUSH"),
        "uc02_price_vs_standard": ratio(F.col("po_unit_price"), F.col("standard_cost")),
        "uc02_delivery_delay_days": F.datediff("actual_delivery_date", "requested_delivery_date"),
        "uc02_material_criticality": ordinal("criticality", CRITICALITY),
        "uc02_gr_status_quality_hold": flag(F.col("gr_status") == "QUALITY_HOLD"),
        "uc02_amount_usd": to_usd("po_total_net_value", "currency"), "uc02_hazmat_flag": flag(F.col("hazmat_flag")),
        "uc02_confidentiality": ordinal("material_confidentiality", CONFIDENTIALITY)}


def uc02_features(df: DataFrame) -> DataFrame:
    """All specific features; those the base has already stay."""
    return df.withColumns({name: column for name, column in _specific().items() if name not in df.columns})


def vendor_invoice_seq(df: DataFrame) -> DataFrame:
    """Number of the line among the vendor's lines by date; ties by invoice and line."""
    return sequence(df, ["vendor_id"], "invoice_date", ["invoice_id", "invoice_line_number"], "uc02_vendor_invoice_seq")


def invoice_amount_ratio(t: Tables) -> DataFrame:
    """Invoice amount over order value; tells the outcome, so it is not in the matrix."""
    return t["invoice_header"].select("invoice_id", "po_id", "total_gross_amount").join(
        t["po_header"].select("po_id", "total_net_value"), "po_id").select(
        "invoice_id", ratio(F.col("total_gross_amount"), F.col("total_net_value")).alias("uc02_invoice_amount_vs_po"))


def match_labels(df: DataFrame) -> DataFrame:
    classes = lookup("match_status", MATCH_CLASS, -1)
    return df.withColumns({"target_binary": flag(F.col("match_status") != "FULL_MATCH"),
                           "target_multiclass": F.when(classes >= 0, classes)})


def missing_flag(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"has_{column}", flag(F.col(column).isNotNull()))


def uc02_table(t: Tables, leave_one_out: bool = True, invoice_ids: DataFrame | None = None) -> DataFrame:
    """All features and labels. Training leaves the own invoice out of the vendor's rates,
    serving does not; both give the same columns. The vendor and material history always
    covers all rows, also when only some invoices are asked for."""
    prices = price.price_stats(t["po_line_item"], ["material_id"]).join(
        t["contract_item"].groupBy("material_id").agg(F.min("agreed_price").alias("p_contract_price")), "material_id", "left")
    df = uc02_features(temporal_features(uc02_base(t, invoice_ids, prices, encoded=True))).withColumn(
        "p_price_to_standard_ratio", ratio(F.col("po_unit_price"), F.col("standard_cost")))
    per_vendor = (vendor.vendor_profile(t["vendor_master"], t["vendor_category"])
                  .join(vendor.vendor_scores(t["vendor_master"]), "vendor_id")
                  .join(vendor.vendor_performance(t["po_header"], t["po_line_item"], t["gr_line_item"]), "vendor_id", "left"))
    # What belongs to the invoice line is put together on narrow rows; the wide rows move once for it.
    per_line = vendor_invoice_seq(splittable(t["invoice_header"].select("invoice_id", "vendor_id", "invoice_date").join(
        t["invoice_line_item"].select("invoice_id", "invoice_line_number"), "invoice_id"))).drop("vendor_id", "invoice_date")
    if leave_one_out:
        per_line = per_line.join(invoice.invoice_behavior_loo(t["invoice_header"], t["invoice_line_item"]), "invoice_id", "left")
    else:
        behavior = invoice.invoice_behavior(t["invoice_header"], t["invoice_line_item"]).select(
            "vendor_id", *[F.col(r).alias(f"{r}_loo") for r in invoice.RATES])
        per_vendor = per_vendor.join(behavior, "vendor_id", "left")
    return df.join(per_line, ["invoice_id", "invoice_line_number"]).join(splittable(per_vendor), "vendor_id", "left")


def feature_columns(df: DataFrame, target: str = "target_binary", features: list[str] = FEATURES) -> DataFrame:
    """Keys, the fixed feature list as doubles with NULL as 0, and the label."""
    keys = [c for c in ("invoice_id", "invoice_line_number", "invoice_date") if c in df.columns]
    return df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
                     F.col(target).cast("double").alias("label"))


def feature_matrix(df: DataFrame, target: str = "target_binary", features: list[str] = FEATURES) -> DataFrame:
    plain = feature_columns(df, target, features)
    return VectorAssembler(inputCols=features, outputCol="features").transform(plain)


def leakage_report(df: DataFrame, features: list[str], label: str = "label", limit: float = 0.9) -> DataFrame:
    """Absolute correlation of each feature with the label, in one pass."""
    y = F.col(label).cast("double")
    one = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(c)).alias("abs_corr")) for c in features])
    return one.select(F.explode(rows).alias("r")).select(
        "r.feature", "r.abs_corr", F.coalesce(F.col("r.abs_corr") > limit, F.lit(False)).alias("leaks"))
