"""Graph query patterns. With ``key=None`` a pattern returns its rows for every key.

Results are flat rows and never one list per vertex, so a vendor or plant with a third of
all documents does not have to fit into one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buylens.graph.views import all_edges, all_vertices, vertex_attributes
from buylens.operators.hierarchy import category_closure
from buylens.session import cut_lineage, splittable

Tables = Mapping[str, DataFrame]


def _only(df: DataFrame, column: str, key: str | None) -> DataFrame:
    return df if key is None else df.filter(F.col(column) == key)


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def entity_lookup(t: Tables, key: str | None = None) -> DataFrame:
    return _only(vertex_attributes(t), "vertex_id", key)


def _section(df: DataFrame, key: str, section: str, item: Column, detail: Column) -> DataFrame:
    return df.select(key, F.lit(section).alias("section"), item.alias("item_id"), detail.alias("detail"))


def vendor_profile(t: Tables, key: str | None = None) -> DataFrame:
    """Attributes, materials with plant and rank, contracts and order count of a vendor."""
    vendors = vertex_attributes(t, ["VENDOR"]).withColumnRenamed("vertex_id", "vendor_id")
    orders = _only(t["po_header"], "vendor_id", key).groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"))
    return _union(
        _section(_only(vendors, "vendor_id", key), "vendor_id", "ATTRIBUTE", F.col("attribute"), F.col("value")),
        _section(_only(t["source_list"], "vendor_id", key), "vendor_id", "MATERIAL", F.col("material_id"),
                 F.concat_ws(":", "plant_id", F.col("preferred_rank").cast("string"))),
        _section(_only(t["contract_header"], "vendor_id", key), "vendor_id", "CONTRACT", F.col("contract_id"), F.col("status")),
        _section(orders, "vendor_id", "ORDERS", F.lit("count"), F.col("n").cast("string")))


def vendor_materials(t: Tables, key: str | None = None) -> DataFrame:
    return _only(t["source_list"], "vendor_id", key).join(
        t["material_master"].select("material_id", "description", "criticality"), "material_id").select(
        "vendor_id", "material_id", "description", "criticality", "plant_id", "preferred_rank")


def material_vendors(t: Tables, key: str | None = None) -> DataFrame:
    return _only(t["source_list"], "material_id", key).join(
        t["vendor_master"].select("vendor_id", "vendor_name", "quality_score"), "vendor_id").select(
        "material_id", "vendor_id", "vendor_name", "quality_score", "plant_id", "preferred_rank")


def po_details(t: Tables, key: str | None = None) -> DataFrame:
    lines = _only(t["po_line_item"], "po_id", key).select(
        "po_id", "po_line_number", "material_id", "quantity", "unit_price", "net_value", "contract_id")
    head = _only(t["po_header"], "po_id", key).select("po_id", "po_date", "status", "vendor_id")
    return (lines.join(head, "po_id").join(t["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id")
            .join(t["contract_header"].select("contract_id", "contract_type", "valid_to"), "contract_id", "left"))


def p2p_chain(t: Tables, key: str | None = None) -> DataFrame:
    """Order, receipts, invoices and payments as steps; ``key`` may be any of the first three."""
    po, gr, inv = t["po_header"], t["gr_header"], t["invoice_header"]
    if key is not None:
        start = _union(po.filter(F.col("po_id") == key).select("po_id"), gr.filter(F.col("gr_id") == key).select("po_id"),
                       inv.filter(F.col("invoice_id") == key).select("po_id")).distinct()
        po, gr, inv = (df.join(start, "po_id", "left_semi") for df in (po, gr, inv))
    paid = inv.select("po_id", "invoice_id").join(t["payment_invoice_link"].select("invoice_id", "payment_id"), "invoice_id").join(
        t["payment"].select("payment_id", "payment_date", "total_amount", "status"), "payment_id")

    def step(df, n, kind, item, day, amount):
        return df.select("po_id", F.lit(n).alias("step"), F.lit(kind).alias("document_type"), F.col(item).alias("document_id"),
                         F.col(day).alias("document_date"), amount.cast("decimal(14,2)").alias("amount"), "status")
    return _union(
        step(po, 1, "PURCHASE_ORDER", "po_id", "po_date", F.col("total_net_value")),
        step(gr, 2, "GOODS_RECEIPT", "gr_id", "gr_date", F.lit(None)),
        step(inv, 3, "INVOICE", "invoice_id", "invoice_date", F.col("total_net_amount")),
        step(paid, 4, "PAYMENT", "payment_id", "payment_date", F.col("total_amount")))


def contract_pos(t: Tables, key: str | None = None) -> DataFrame:
    pairs = _only(t["po_line_item"].filter(F.col("contract_id").isNotNull()), "contract_id", key).select(
        "contract_id", "po_id").distinct()
    return pairs.join(t["po_header"].select("po_id", "po_date", "total_net_value", "status"), "po_id")


def vendor_contracts(t: Tables, key: str | None = None) -> DataFrame:
    return _only(t["contract_header"], "vendor_id", key).select(
        "vendor_id", "contract_id", "contract_type", "status", "valid_from", "valid_to")


def invoice_issues(t: Tables) -> DataFrame:
    return t["invoice_header"].filter(F.col("match_status") != "FULL_MATCH").select(
        "invoice_id", "vendor_id", "po_id", "match_status", "total_net_amount", "payment_block", "block_reason")


def invoice_context(t: Tables, key: str | None = None) -> DataFrame:
    """Order lines, receipts, vendor and payments around an invoice."""
    inv = _only(t["invoice_header"], "invoice_id", key).select("invoice_id", "po_id", "vendor_id")
    lines = inv.join(t["po_line_item"].select("po_id", "po_line_number", "material_id"), "po_id")
    received = inv.join(t["gr_header"].select("po_id", "gr_id", "status"), "po_id")
    vendor = inv.join(t["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id")
    paid = inv.join(t["payment_invoice_link"], "invoice_id")
    return _union(
        _section(lines, "invoice_id", "PO_LINE", F.concat_ws(":", "po_id", F.col("po_line_number").cast("string")), F.col("material_id")),
        _section(received, "invoice_id", "RECEIPT", F.col("gr_id"), F.col("status")),
        _section(vendor, "invoice_id", "VENDOR", F.col("vendor_id"), F.col("vendor_name")),
        _section(paid, "invoice_id", "PAYMENT", F.col("payment_id"), F.col("amount_applied").cast("string")))


def plant_materials(t: Tables, key: str | None = None) -> DataFrame:
    return (_only(t["source_list"], "plant_id", key).select("plant_id", "material_id", "vendor_id", "preferred_rank")
            .join(t["material_master"].select("material_id", "description"), "material_id")
            .join(t["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id"))


def vendor_pos(t: Tables, key: str | None = None) -> DataFrame:
    return _only(t["po_header"], "vendor_id", key).select(
        "vendor_id", "po_id", "po_date", "total_net_value", "status", "maverick_flag")


def category_tree(t: Tables, key: str | None = None) -> DataFrame:
    """Parent, children and all materials below a category."""
    cat = t["category_hierarchy"]
    linked = cat.filter(F.col("parent_category_id").isNotNull())
    below = category_closure(cat).select(F.col("ancestor").alias("node"), F.col("descendant").alias("category_id")).join(
        t["material_master"].select("material_id", "category_id"), "category_id")
    return _union(
        *[_only(df.select(F.col(node).alias("category_id"), F.lit(kind).alias("relation"), F.col(item).alias("item_id")),
                "category_id", key)
          for df, node, kind, item in ((linked, "category_id", "PARENT", "parent_category_id"),
                                       (linked, "parent_category_id", "CHILD", "category_id"),
                                       (below, "node", "MATERIAL", "material_id"))])


def vendor_plant_contracts(t: Tables, key: str | None = None) -> DataFrame:
    at_plant = _only(t["source_list"], "plant_id", key).select("plant_id", "vendor_id").distinct()
    return at_plant.join(t["contract_header"].select("vendor_id", "contract_id", "status", "valid_to"), "vendor_id", "left")


def search(t: Tables, q: str, kind: str | None = None, limit: int | None = 20) -> DataFrame:
    """Vertices whose id or label contains the text, whatever its case: the first by id, or with ``limit=None`` all."""
    q = q.lower()
    hits = all_vertices(t, [kind] if kind else None).filter(F.lower("vertex_id").contains(q) | F.lower("label").contains(q))
    return hits if limit is None else hits.orderBy("vertex_id").limit(limit)


def summary(t: Tables) -> DataFrame:
    nodes = all_vertices(t).groupBy(F.col("vertex_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    links = all_edges(t).groupBy(F.col("edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.withColumn("element", F.lit("VERTEX")).unionByName(links.withColumn("element", F.lit("EDGE")))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every distinct pair of ends."""
    out = edges.select(F.col("source_vertex").alias("u"), F.col("target_vertex").alias("v"))
    return out.unionByName(out.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()


def neighbors(t: Tables, key: str | None = None, edge_type: str | None = None, direction: str = "both") -> DataFrame:
    """Neighbours with the number of parallel edges."""
    rows = all_edges(t, [edge_type] if edge_type else None).select("source_vertex", "target_vertex", "edge_type")
    if key is not None:
        ends = {"out": ["source_vertex"], "in": ["target_vertex"], "both": ["source_vertex", "target_vertex"]}[direction]
        rows = rows.filter(reduce(Column.__or__, [F.col(c) == key for c in ends]))

    # Parallel edges are counted once; a pair seen from its other end has the same count.
    pairs = rows.groupBy("source_vertex", "target_vertex", "edge_type").agg(F.count(F.lit(1)).alias("edges"))

    def seen(here: str, there: str, name: str) -> Column:
        return F.struct(F.col(here).alias("vertex_id"), F.col(there).alias("neighbor_id"), "edge_type", F.lit(name).alias("direction"), "edges")

    out, back = seen("source_vertex", "target_vertex", "OUT"), seen("target_vertex", "source_vertex", "IN")
    sides = {"out": [out], "in": [back], "both": [out, back]}[direction]
    return _only(pairs.select(F.inline(F.array(*sides))), "vertex_id", key)


def bfs_levels(edges: DataFrame, sources: DataFrame, max_hops: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Vertices within ``max_hops`` of the sources, or all that they reach, with their level and smallest parent.

    Each hop joins the frontier to the edges and drops what was seen. Stops early when a
    hop reaches nothing new, or a target.
    """
    links = cut_lineage(undirected(edges)) if max_hops is None or max_hops > 1 else undirected(edges)
    level = sources.select("vertex_id").distinct().withColumn("level", F.lit(0)).withColumn(
        "parent_id", F.lit(None).cast("string"))
    seen = level
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        frontier = level.select(F.col("vertex_id").alias("u"))
        reached = links.join(frontier, "u").groupBy(F.col("v").alias("vertex_id")).agg(F.min("u").alias("parent_id"))
        level = cut_lineage(reached.join(seen.select("vertex_id"), "vertex_id", "left_anti").select(
            "vertex_id", F.lit(hop).alias("level"), "parent_id"))
        seen = seen.unionByName(level)
        if hop == max_hops or level.isEmpty():
            break
        if targets is not None and not level.join(targets, "vertex_id", "left_semi").isEmpty():
            break
    return seen


def ego_vertices(edges: DataFrame, ids: DataFrame, hops: int = 1) -> DataFrame:
    return bfs_levels(edges, ids, hops).select("vertex_id", F.col("level").alias("hop"))


def ego_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    ids = vertices.select("vertex_id")
    return edges.join(ids.withColumnRenamed("vertex_id", "source_vertex"), "source_vertex", "left_semi").join(
        ids.withColumnRenamed("vertex_id", "target_vertex"), "target_vertex", "left_semi")


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """Vertices of one shortest undirected path, numbered from the source; empty if none.

    The search goes out from both ends. Each round grows the smaller frontier by one hop, so a hub next to one end is not opened while the other
    end's side is small, and stops when the frontiers meet. Among shortest paths the smallest meeting vertex and the smallest parents decide.
    """
    spark = edges.sparkSession
    links = cut_lineage(undirected(edges))
    start = lambda v: cut_lineage(spark.createDataFrame([(v, 0, None)], "vertex_id string, level int, parent_id string").join(
        links.select(F.col("u").alias("vertex_id")).distinct(), "vertex_id", "left_semi"))
    sides = [start(source), start(target)]
    fronts, levels, sizes = list(sides), [0, 0], [side.count() for side in sides]
    met = cut_lineage(fronts[0].join(fronts[1].select("vertex_id"), "vertex_id", "left_semi").select("vertex_id"))
    while all(sizes) and met.isEmpty() and (max_hops is None or sum(levels) < max_hops):
        k = 0 if sizes[0] <= sizes[1] else 1
        levels[k] += 1
        reached = links.join(fronts[k].select(F.col("vertex_id").alias("u")), "u").groupBy(F.col("v").alias("vertex_id")).agg(F.min("u").alias("parent_id"))
        fronts[k] = cut_lineage(reached.join(sides[k].select("vertex_id"), "vertex_id", "left_anti").select(
            "vertex_id", F.lit(levels[k]).alias("level"), "parent_id"))
        sides[k], sizes[k] = sides[k].unionByName(fronts[k]), fronts[k].count()
        met = cut_lineage(fronts[k].join(sides[1 - k].select("vertex_id"), "vertex_id", "left_semi").select("vertex_id"))
    middle = met.agg(F.min("vertex_id").alias("vertex_id")).filter("vertex_id is not null")
    steps = []
    for k in (0, 1):
        here = sides[k].join(middle, "vertex_id", "left_semi")
        for hop in range(levels[k] + 1):
            if hop or not k:  # the middle belongs to the first side
                steps.append(here.select((F.col("level") if not k else F.lit(sum(levels)) - F.col("level")).alias("step"), "vertex_id"))
            here = cut_lineage(sides[k].join(here.select(F.col("parent_id").alias("vertex_id")), "vertex_id", "left_semi"))
    return _union(*steps)


def invoice_context_by_order(t: Tables, key: str | None = None) -> DataFrame:
    """Order lines and receipts once per order with an invoice, vendor and payments once per invoice: join on the order for the whole of an invoice's context."""
    inv = _only(t["invoice_header"], "invoice_id", key).select("invoice_id", "po_id", "vendor_id")
    orders = inv.select("po_id").distinct()
    lines = orders.join(t["po_line_item"].select("po_id", "po_line_number", "material_id"), "po_id")
    received = orders.join(t["gr_header"].select("po_id", "gr_id", "status"), "po_id")
    vendor = inv.join(t["vendor_master"].select("vendor_id", "vendor_name"), "vendor_id")
    paid = inv.join(t["payment_invoice_link"], "invoice_id")
    order, invoice = F.lit("ORDER").alias("level"), F.lit("INVOICE").alias("level")
    return _union(
        _section(lines, "po_id", "PO_LINE", F.concat_ws(":", "po_id", F.col("po_line_number").cast("string")), F.col("material_id")).withColumnRenamed("po_id", "key_id").select("*", order),
        _section(received, "po_id", "RECEIPT", F.col("gr_id"), F.col("status")).withColumnRenamed("po_id", "key_id").select("*", order),
        _section(vendor, "invoice_id", "VENDOR", F.col("vendor_id"), F.col("vendor_name")).withColumnRenamed("invoice_id", "key_id").select("*", invoice),
        _section(paid, "invoice_id", "PAYMENT", F.col("payment_id"), F.col("amount_applied").cast("string")).withColumnRenamed("invoice_id", "key_id").select("*", invoice),
        _section(inv, "invoice_id", "ORDER", F.col("po_id"), F.lit(None).cast("string")).withColumnRenamed("invoice_id", "key_id").select("*", invoice))


def nodes_by_type(t: Tables, kind: str) -> DataFrame:
    return all_vertices(t, [kind])


def typed_hop(t: Tables, edge_type: str, ids: DataFrame | None = None) -> DataFrame:
    """Source, edge and target with the types and labels of both ends."""
    edges = all_edges(t, [edge_type])
    if ids is not None:
        edges = edges.join(ids.select(F.col("vertex_id").alias("source_vertex")), "source_vertex", "left_semi")
    nodes = all_vertices(t)
    source = nodes.select(F.col("vertex_id").alias("source_vertex"), F.col("label").alias("source_label"))
    target = nodes.select(F.col("vertex_id").alias("target_vertex"), F.col("vertex_type").alias("target_type"),
                          F.col("label").alias("target_label"))
    return edges.join(source, "source_vertex").join(target, "target_vertex").select(
        "edge_id", "source_vertex", "source_label", "edge_type", "target_vertex", "target_type", "target_label")


def two_hop(t: Tables, first: str = "HAS_CONTRACT", second: str = "UNDER_CONTRACT") -> DataFrame:
    """Distinct (start, middle, end) where both edges point at the middle vertex."""
    a = all_edges(t, [first]).select(F.col("source_vertex").alias("start_id"), F.col("target_vertex").alias("middle_id")).distinct()
    b = all_edges(t, [second]).select(F.col("source_vertex").alias("end_id"), F.col("target_vertex").alias("middle_id")).distinct()
    return b.join(a, "middle_id").select("start_id", "middle_id", "end_id")


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_vertex").alias("vertex_id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("target_vertex").alias("vertex_id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("vertex_id").agg(F.sum("out").alias("out_degree"), F.sum("into").alias("in_degree"))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components, named by their smallest vertex id.

    Alternates large-star and small-star steps: every vertex points its neighbours at the
    smallest one it knows. The number of edges never grows and a few rounds suffice, also
    for long chains and for hubs.
    """
    pairs = undirected(edges)
    vertices = pairs.select(F.col("u").alias("vertex_id")).distinct()
    pairs = cut_lineage(pairs.filter("u > v"))

    def smallest(both: DataFrame) -> DataFrame:
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        return both.join(splittable(low), "u")  # a hub has many rows

    def fingerprint(edge_set: DataFrame) -> tuple:
        """Count and two hash sums; equal for equal edge sets. One row to the driver."""
        return tuple(edge_set.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("bigint"))).first())

    mark = fingerprint(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        marked = smallest(large)
        small = marked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            marked.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        small = cut_lineage(small)
        now = fingerprint(small)
        settled, mark = now == mark, now
        pairs = small
        if settled:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = pairs.select(F.col("u").alias("vertex_id"), F.col("v").alias("root"))
    return vertices.join(roots, "vertex_id", "left").select("vertex_id", F.coalesce("root", "vertex_id").alias("component_id"))
