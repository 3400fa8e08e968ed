"""The purchasing tables seen as typed vertices and edges."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.session import cut_lineage

# type: (table, id, label, attributes)
VERTICES = {
    "VENDOR": ("vendor_master", "vendor_id", "vendor_name",
               ["vendor_type", "country", "status", "quality_score", "risk_score", "on_time_delivery_rate"]),
    "MATERIAL": ("material_master", "material_id", "description",
                 ["material_type", "category_id", "criticality", "standard_cost", "base_uom"]),
    "PLANT": ("plant", "plant_id", "plant_name", ["country", "city", "function"]),
    "CATEGORY": ("category_hierarchy", "category_id", "category_name", ["level", "parent_category_id"]),
    "PURCHASE_ORDER": ("po_header", "po_id", "po_id",
                       ["po_date", "vendor_id", "status", "total_net_value", "maverick_flag", "po_type"]),
    "CONTRACT": ("contract_header", "contract_id", "contract_id",
                 ["vendor_id", "valid_from", "valid_to", "status", "contract_type"]),
    "INVOICE": ("invoice_header", "invoice_id", "invoice_id",
                ["invoice_date", "vendor_id", "total_net_amount", "match_status", "status"]),
    "GOODS_RECEIPT": ("gr_header", "gr_id", "gr_id", ["gr_date", "po_id", "status"]),
    "PAYMENT": ("payment", "payment_id", "payment_id",
                ["payment_date", "vendor_id", "total_amount", "payment_method", "status"]),
    "PURCHASE_REQ": ("pr_header", "pr_id", "pr_id", ["pr_date", "status", "priority", "pr_type"]),
}

# type: (table, source, target, columns that order and identify the edge, attributes)
EDGES = {
    "SUPPLIES": ("source_list", "vendor_id", "material_id", ["vendor_id", "material_id", "plant_id"],
                 ["plant_id", "preferred_rank", "approval_status", "lane_lead_time_days as lead_time"]),
    "ORDERED_FROM": ("po_header", "po_id", "vendor_id", ["po_id"], ["po_date", "total_net_value", "maverick_flag"]),
    "CONTAINS_MATERIAL": ("po_line_item", "po_id", "material_id", ["po_id", "po_line_number"],
                          ["quantity", "unit_price", "net_value"]),
    "UNDER_CONTRACT": ("po_line_item", "po_id", "contract_id", ["po_id", "po_line_number"],
                       ["unit_price"]),
    "INVOICED_FOR": ("invoice_header", "invoice_id", "po_id", ["invoice_id"], ["total_net_amount", "match_status"]),
    "RECEIVED_FOR": ("gr_header", "gr_id", "po_id", ["gr_id"], ["gr_date", "status"]),
    "PAYS": ("payment_invoice_link", "payment_id", "invoice_id", ["payment_id", "invoice_id"], ["amount_applied"]),
    "BELONGS_TO_CATEGORY": ("material_master", "material_id", "category_id", ["material_id"], []),
    "CATEGORY_PARENT": ("category_hierarchy", "category_id", "parent_category_id", ["category_id"], []),
    "LOCATED_AT": ("po_header", "po_id", "plant_id", ["po_id"], []),
    "HAS_CONTRACT": ("contract_header", "vendor_id", "contract_id", ["contract_id"], ["valid_from", "valid_to", "status"]),
    "REQUESTED_MATERIAL": ("pr_line_item", "pr_id", "material_id", ["pr_id", "pr_line_number"],
                           ["quantity", "requested_delivery_date"]),
    "INVOICED_BY_VENDOR": ("invoice_header", "invoice_id", "vendor_id", ["invoice_id"], ["total_net_amount"]),
    "PAID_TO_VENDOR": ("payment", "payment_id", "vendor_id", ["payment_id"], ["total_amount", "payment_date"]),
}
EDGE_NUMBER = {kind: n for n, kind in enumerate(EDGES)}
OPTIONAL_TARGET = {"UNDER_CONTRACT", "CATEGORY_PARENT"}


def vertices_of(t: Mapping[str, DataFrame], kind: str) -> DataFrame:
    table, key, label, attributes = VERTICES[kind]
    return t[table].select(F.col(key).alias("vertex_id"), F.lit(kind).alias("vertex_type"), F.col(label).alias("label"),
                           *attributes)


def all_vertices(t: Mapping[str, DataFrame], kinds=None) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [vertices_of(t, k).select("vertex_id", "vertex_type", "label") for k in (kinds or VERTICES)])


def vertex_attributes(t: Mapping[str, DataFrame], kinds=None) -> DataFrame:
    """Long form of all typed attributes: one row per vertex and attribute."""
    parts = []
    for kind in kinds or VERTICES:
        attributes = VERTICES[kind][3]
        pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
        parts.append(vertices_of(t, kind).select("vertex_id", "vertex_type", "label", F.explode(pairs).alias("p"))
                     .select("vertex_id", "vertex_type", "label", "p.attribute", "p.value"))
    return reduce(DataFrame.unionByName, parts)


def _edge_rows(t: Mapping[str, DataFrame], kind: str) -> DataFrame:
    table, _, target, _, _ = EDGES[kind]
    rows = t[table]
    return rows.filter(F.col(target).isNotNull()) if kind in OPTIONAL_TARGET else rows


def edges_of(t: Mapping[str, DataFrame], kind: str) -> DataFrame:
    """Edges of one type; the id is made of the type, both ends and the line key."""
    _, source, target, key, attributes = EDGES[kind]
    extra = [F.col(k).cast("string") for k in key if k not in (source, target)]
    edge_id = F.concat_ws(":", F.lit(kind), F.col(source), F.col(target), *extra)
    return _edge_rows(t, kind).select(edge_id.alias("edge_id"), F.col(source).alias("source_vertex"),
                                      F.col(target).alias("target_vertex"), F.lit(kind).alias("edge_type"),
                                      *[F.expr(a) for a in attributes])


def sequential_ids(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """1, 2, 3 ... in the given order, without moving all rows to one task.

    The sorted partitions are written with their numbering, so it cannot change when a task
    is repeated; only one count per partition is summed up.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mono")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    row = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + row + 1).drop("_part", "_mono", "_offset")


def all_edges(t: Mapping[str, DataFrame], kinds=None, parity: bool = False) -> DataFrame:
    """All edges. ``parity`` numbers each type from one and adds 100000 per type, which
    repeats ids once a type passes 100000 edges; the default id never does."""
    parts = []
    for kind in kinds or EDGES:
        if parity:
            _, source, target, key, _ = EDGES[kind]
            rows = _edge_rows(t, kind).select(F.col(source).alias("source_vertex"), F.col(target).alias("target_vertex"),
                                              *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
            rows = sequential_ids(rows, [f"_k{i}" for i in range(len(key))])
            parts.append(rows.select((F.lit(EDGE_NUMBER[kind] * 100000) + F.col("n")).alias("edge_id"), "source_vertex",
                                     "target_vertex", F.lit(kind).alias("edge_type")))
        else:
            parts.append(edges_of(t, kind).select("edge_id", "source_vertex", "target_vertex", "edge_type"))
    return reduce(DataFrame.unionByName, parts)


def extra_edges(t: Mapping[str, DataFrame]) -> DataFrame:
    """Requisition to order, material to plant and vendor to plant."""
    def ends(df, source, target, kind):
        return df.filter(F.col(source).isNotNull()).select(
            F.col(source).alias("source_vertex"), F.col(target).alias("target_vertex"), F.lit(kind).alias("edge_type")).distinct()
    return (ends(t["po_line_item"], "pr_id", "po_id", "CONVERTED_TO")
            .unionByName(ends(t["material_plant_extension"], "material_id", "plant_id", "STOCKED_AT"))
            .unionByName(ends(t["source_list"], "vendor_id", "plant_id", "DELIVERS_TO")))
