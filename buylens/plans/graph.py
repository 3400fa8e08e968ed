"""Queries over the graph views and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from buylens.graph import queries as g
from buylens.graph import views


def blocked(t):
    return t["vendor_master"].filter("status = 'BLOCKED'").select(F.col("vendor_id").alias("vertex_id"))


def first_vendor(t):
    return t["vendor_master"].agg(F.min("vendor_id").alias("vertex_id"))


CONTRACT_EDGES = ["HAS_CONTRACT", "UNDER_CONTRACT"]
PAY_EDGES = ["PAYS", "INVOICED_FOR", "UNDER_CONTRACT"]


def path_checked(t):
    """The length of a shortest path between the first and the last vendor, and whether it is a path: its steps are edges from one end to the other."""
    edges = views.all_edges(t, CONTRACT_EDGES + ["SUPPLIES"])
    ends = t["vendor_master"].agg(F.min("vendor_id").alias("a"), F.max("vendor_id").alias("b")).first()
    path = g.shortest_path(edges, ends["a"], ends["b"])
    steps = path.select("step", "vertex_id")
    follows = steps.join(steps.select((F.col("step") - 1).alias("step"), F.col("vertex_id").alias("next")), "step")
    linked = follows.join(g.undirected(edges), (F.col("vertex_id") == F.col("u")) & (F.col("next") == F.col("v")), "left_semi").agg(F.count(F.lit(1)).alias("linked"))
    whole = steps.agg(F.max("step").cast("int").alias("hops"), F.min_by("vertex_id", "step").alias("first"), F.max_by("vertex_id", "step").alias("last"), F.count(F.lit(1)).alias("n"))
    return whole.select("hops", ((F.col("first") == ends["a"]) & (F.col("last") == ends["b"]) & (F.col("n") == F.col("hops") + 1)
                                              & (linked.scalar() == F.col("hops"))).alias("is_path"))


QUERIES = {f"gv{n:02d}_{kind.lower()}": (lambda t, kind=kind: views.vertices_of(t, kind))
           for n, kind in enumerate(views.VERTICES, 1)}
QUERIES["gv11_all_vertices"] = views.all_vertices
QUERIES |= {f"ge{n:02d}_{kind.lower()}": (lambda t, kind=kind: views.edges_of(t, kind))
            for n, kind in enumerate(views.EDGES, 1)}
QUERIES |= {
    "ge15_all_edges": views.all_edges,
    "ge15_all_edges_numbered": lambda t: views.all_edges(t, parity=True),
    "ge16_extra_edges": views.extra_edges,
    "gq01_entity_lookup": g.entity_lookup,
    "gq02_vendor_profile": g.vendor_profile,
    "gq03_vendor_materials": g.vendor_materials,
    "gq04_material_vendors": g.material_vendors,
    "gq05_po_details": g.po_details,
    "gq06_p2p_chain": g.p2p_chain,
    "gq07_contract_pos": g.contract_pos,
    "gq08_vendor_contracts": g.vendor_contracts,
    "gq09_invoice_issues": g.invoice_issues,
    "gq10_invoice_context": g.invoice_context,
    "gq10_invoice_context_by_order": g.invoice_context_by_order,
    "gq11_plant_materials": g.plant_materials,
    "gq12_vendor_pos": g.vendor_pos,
    "gq13_category_tree": g.category_tree,
    "gq14_vendor_plant_contracts": g.vendor_plant_contracts,
    "gq15_search": lambda t: g.search(t, "Ring"),
    "gq15_search_all": lambda t: g.search(t, "Ring", limit=None),
    "gq16_summary": g.summary,
    "gq17_neighbors": g.neighbors,
    "gq18_ego_vertices": lambda t: g.ego_vertices(views.all_edges(t), blocked(t), 2),
    "gq18_ego_edges": lambda t: g.ego_edges(
        views.all_edges(t), g.ego_vertices(views.all_edges(t), blocked(t), 1)).select(
        "source_vertex", "target_vertex", "edge_type"),
    "gq19_bfs_levels": lambda t: g.bfs_levels(views.all_edges(t, CONTRACT_EDGES + ["SUPPLIES"]), first_vendor(t), 3),
    "gq19_shortest_path": path_checked,
    "gq20_nodes_by_type": lambda t: g.nodes_by_type(t, "CONTRACT"),
    "gq21_typed_hop": lambda t: g.typed_hop(t, "SUPPLIES"),
    "gq22_two_hop": g.two_hop,
    "gq23_components": lambda t: g.components(views.all_edges(t, PAY_EDGES)),
    "gq23_degree": lambda t: g.degree(views.all_edges(t)),
}
