"""DuckDB twins of the graph views and patterns."""

VERTEX = {
    "vendor": ("vendor_master", "vendor_id", "vendor_name", "vendor_type, country, status, quality_score, risk_score, on_time_delivery_rate"),
    "material": ("material_master", "material_id", "description", "material_type, category_id, criticality, standard_cost, base_uom"),
    "plant": ("plant", "plant_id", "plant_name", 'country, city, "function"'),
    "category": ("category_hierarchy", "category_id", "category_name", "level, parent_category_id"),
    "purchase_order": ("po_header", "po_id", "po_id", "po_date, vendor_id, status, total_net_value, maverick_flag, po_type"),
    "contract": ("contract_header", "contract_id", "contract_id", "vendor_id, valid_from, valid_to, status, contract_type"),
    "invoice": ("invoice_header", "invoice_id", "invoice_id", "invoice_date, vendor_id, total_net_amount, match_status, status"),
    "goods_receipt": ("gr_header", "gr_id", "gr_id", "gr_date, po_id, status"),
    "payment": ("payment", "payment_id", "payment_id", "payment_date, vendor_id, total_amount, payment_method, status"),
    "purchase_req": ("pr_header", "pr_id", "pr_id", "pr_date, status, priority, pr_type"),
}
# source, target, rest of the id, order, attributes, filter
EDGE = {
    "supplies": ("source_list", "vendor_id", "material_id", "plant_id", "vendor_id, material_id, plant_id",
                 ", plant_id, preferred_rank, approval_status, lane_lead_time_days AS lead_time", ""),
    "ordered_from": ("po_header", "po_id", "vendor_id", "", "po_id", ", po_date, total_net_value, maverick_flag", ""),
    "contains_material": ("po_line_item", "po_id", "material_id", "po_line_number", "po_id, po_line_number",
                          ", quantity, unit_price, net_value", ""),
    "under_contract": ("po_line_item", "po_id", "contract_id", "po_line_number", "po_id, po_line_number",
                       ", unit_price", "WHERE contract_id IS NOT NULL"),
    "invoiced_for": ("invoice_header", "invoice_id", "po_id", "", "invoice_id", ", total_net_amount, match_status", ""),
    "received_for": ("gr_header", "gr_id", "po_id", "", "gr_id", ", gr_date, status", ""),
    "pays": ("payment_invoice_link", "payment_id", "invoice_id", "", "payment_id, invoice_id", ", amount_applied", ""),
    "belongs_to_category": ("material_master", "material_id", "category_id", "", "material_id", "", ""),
    "category_parent": ("category_hierarchy", "category_id", "parent_category_id", "", "category_id", "",
                        "WHERE parent_category_id IS NOT NULL"),
    "located_at": ("po_header", "po_id", "plant_id", "", "po_id", "", ""),
    "has_contract": ("contract_header", "vendor_id", "contract_id", "", "contract_id", ", valid_from, valid_to, status", ""),
    "requested_material": ("pr_line_item", "pr_id", "material_id", "pr_line_number", "pr_id, pr_line_number",
                           ", quantity, requested_delivery_date", ""),
    "invoiced_by_vendor": ("invoice_header", "invoice_id", "vendor_id", "", "invoice_id", ", total_net_amount", ""),
    "paid_to_vendor": ("payment", "payment_id", "vendor_id", "", "payment_id", ", total_amount, payment_date", ""),
}

SQL = {}
for n, (kind, (table, key, label, attributes)) in enumerate(VERTEX.items(), 1):
    SQL[f"gv{n:02d}_{kind}"] = (f"SELECT {key} AS vertex_id, '{kind.upper()}' AS vertex_type, {label} AS label, {attributes} FROM {table}")
ALL_V = " UNION ALL ".join(f"SELECT {k} AS vertex_id, '{kind.upper()}' AS vertex_type, {label} AS label FROM {t}"
                           for kind, (t, k, label, _) in VERTEX.items())
SQL["gv11_all_vertices"] = ALL_V


def edge(kind, attributes=True):
    table, source, target, rest, _, extra, where = EDGE[kind]
    tail = f" || ':' || {rest}" if rest else ""
    return (f"SELECT '{kind.upper()}:' || {source} || ':' || {target}{tail} AS edge_id, {source} AS source_vertex, "
            f"{target} AS target_vertex, '{kind.upper()}' AS edge_type{extra if attributes else ''} FROM {table} {where}")


for n, kind in enumerate(EDGE, 1):
    SQL[f"ge{n:02d}_{kind}"] = edge(kind)


def edges(kinds=EDGE):
    return " UNION ALL ".join(edge(k, False) for k in kinds)


SQL["ge15_all_edges"] = edges()
SQL["ge15_all_edges_numbered"] = " UNION ALL ".join(
    f"SELECT {n} * 100000 + row_number() OVER (ORDER BY {order}) AS edge_id, {source} AS source_vertex, {target} AS target_vertex, "
    f"'{kind.upper()}' AS edge_type FROM {table} {where}"
    for n, (kind, (table, source, target, _, order, _, where)) in enumerate(EDGE.items()))
SQL["ge16_extra_edges"] = """SELECT DISTINCT pr_id AS source_vertex, po_id AS target_vertex, 'CONVERTED_TO' AS edge_type FROM po_line_item
WHERE pr_id IS NOT NULL
UNION ALL SELECT material_id, plant_id, 'STOCKED_AT' FROM material_plant_extension
UNION ALL SELECT DISTINCT vendor_id, plant_id, 'DELIVERS_TO' FROM source_list"""


def long_attributes(kinds):
    parts = []
    for kind in kinds:
        table, key, label, attributes = VERTEX[kind]
        for a in attributes.split(", "):
            parts.append(f"SELECT {key} AS vertex_id, '{kind.upper()}' AS vertex_type, {label} AS label, "
                         f"'{a.strip(chr(34))}' AS attribute, CAST({a} AS VARCHAR) AS value FROM {table}")
    return " UNION ALL ".join(parts)


SQL["gq01_entity_lookup"] = long_attributes(VERTEX)
SQL["gq02_vendor_profile"] = f"""
SELECT vertex_id AS vendor_id, 'ATTRIBUTE' AS section, attribute AS item_id, value AS detail FROM ({long_attributes(['vendor'])})
UNION ALL SELECT vendor_id, 'MATERIAL', material_id, plant_id || ':' || preferred_rank FROM source_list
UNION ALL SELECT vendor_id, 'CONTRACT', contract_id, status FROM contract_header
UNION ALL SELECT vendor_id, 'ORDERS', 'count', CAST(count(*) AS VARCHAR) FROM po_header GROUP BY vendor_id"""
SQL["gq03_vendor_materials"] = """SELECT vendor_id, material_id, description, criticality, plant_id, preferred_rank
FROM source_list JOIN material_master USING (material_id)"""
SQL["gq04_material_vendors"] = """SELECT material_id, vendor_id, vendor_name, quality_score, plant_id, preferred_rank
FROM source_list JOIN vendor_master USING (vendor_id)"""
SQL["gq05_po_details"] = """SELECT l.po_id, po_line_number, material_id, quantity, unit_price, net_value, l.contract_id, po_date,
  h.status, h.vendor_id, vendor_name, contract_type, valid_to
FROM po_line_item l JOIN po_header h ON l.po_id = h.po_id JOIN vendor_master v ON v.vendor_id = h.vendor_id
LEFT JOIN contract_header c ON c.contract_id = l.contract_id"""
SQL["gq06_p2p_chain"] = """
SELECT po_id, 1 AS step, 'PURCHASE_ORDER' AS document_type, po_id AS document_id, po_date AS document_date,
  CAST(total_net_value AS DECIMAL(14,2)) AS amount, status FROM po_header
UNION ALL SELECT po_id, 2, 'GOODS_RECEIPT', gr_id, gr_date, NULL, status FROM gr_header
UNION ALL SELECT po_id, 3, 'INVOICE', invoice_id, invoice_date, total_net_amount, status FROM invoice_header
UNION ALL SELECT i.po_id, 4, 'PAYMENT', p.payment_id, p.payment_date, p.total_amount, p.status FROM payment p
  JOIN payment_invoice_link k ON p.payment_id = k.payment_id JOIN invoice_header i ON i.invoice_id = k.invoice_id"""
SQL["gq07_contract_pos"] = """SELECT DISTINCT contract_id, po_id, po_date, total_net_value, status
FROM po_line_item JOIN po_header USING (po_id) WHERE contract_id IS NOT NULL"""
SQL["gq08_vendor_contracts"] = "SELECT vendor_id, contract_id, contract_type, status, valid_from, valid_to FROM contract_header"
SQL["gq09_invoice_issues"] = """SELECT invoice_id, vendor_id, po_id, match_status, total_net_amount, payment_block, block_reason
FROM invoice_header WHERE match_status IN ('PRICE_VARIANCE', 'QUANTITY_VARIANCE', 'BOTH_VARIANCE')"""
SQL["gq10_invoice_context"] = """
SELECT invoice_id, 'PO_LINE' AS section, po_id || ':' || po_line_number AS item_id, material_id AS detail
FROM invoice_header JOIN po_line_item USING (po_id)
UNION ALL SELECT invoice_id, 'RECEIPT', gr_id, g.status FROM invoice_header JOIN gr_header g USING (po_id)
UNION ALL SELECT invoice_id, 'VENDOR', vendor_id, vendor_name FROM invoice_header JOIN vendor_master USING (vendor_id)
UNION ALL SELECT invoice_id, 'PAYMENT', payment_id, CAST(amount_applied AS VARCHAR) FROM payment_invoice_link"""
SQL["gq10_invoice_context_by_order"] = """WITH o AS (SELECT DISTINCT po_id FROM invoice_header)
SELECT po_id AS key_id, 'PO_LINE' AS section, po_id || ':' || po_line_number AS item_id, material_id AS detail, 'ORDER' AS level FROM o JOIN po_line_item USING (po_id)
UNION ALL SELECT po_id, 'RECEIPT', gr_id, status, 'ORDER' FROM o JOIN gr_header USING (po_id)
UNION ALL SELECT invoice_id, 'VENDOR', vendor_id, vendor_name, 'INVOICE' FROM invoice_header JOIN vendor_master USING (vendor_id)
UNION ALL SELECT invoice_id, 'PAYMENT', payment_id, CAST(amount_applied AS VARCHAR), 'INVOICE' FROM payment_invoice_link
UNION ALL SELECT invoice_id, 'ORDER', po_id, NULL, 'INVOICE' FROM invoice_header"""
SQL["gq11_plant_materials"] = """SELECT plant_id, material_id, vendor_id, preferred_rank, description, vendor_name
FROM source_list JOIN material_master USING (material_id) JOIN vendor_master USING (vendor_id)"""
SQL["gq12_vendor_pos"] = "SELECT vendor_id, po_id, po_date, total_net_value, status, maverick_flag FROM po_header"
SQL["gq13_category_tree"] = """
SELECT category_id, 'PARENT' AS relation, parent_category_id AS item_id FROM category_hierarchy WHERE parent_category_id IS NOT NULL
UNION ALL SELECT parent_category_id, 'CHILD', category_id FROM category_hierarchy WHERE parent_category_id IS NOT NULL
UNION ALL SELECT c.category_id, 'MATERIAL', material_id FROM category_hierarchy c JOIN material_master m
  ON m.category_id = c.category_id OR starts_with(m.category_id, c.category_id || '-')"""
SQL["gq14_vendor_plant_contracts"] = """SELECT plant_id, vendor_id, contract_id, status, valid_to
FROM (SELECT DISTINCT plant_id, vendor_id FROM source_list) LEFT JOIN contract_header USING (vendor_id)"""
SQL["gq15_search"] = f"SELECT * FROM ({ALL_V}) WHERE vertex_id ILIKE '%ring%' OR label ILIKE '%ring%' ORDER BY vertex_id LIMIT 20"
SQL["gq15_search_all"] = f"SELECT * FROM ({ALL_V}) WHERE vertex_id ILIKE '%ring%' OR label ILIKE '%ring%'"
SQL["gq16_summary"] = f"""SELECT vertex_type AS kind, count(*) AS n, 'VERTEX' AS element FROM ({ALL_V}) GROUP BY 1
UNION ALL SELECT edge_type, count(*), 'EDGE' FROM ({edges()}) GROUP BY 1"""
SQL["gq17_neighbors"] = f"""WITH e AS ({edges()})
SELECT source_vertex AS vertex_id, target_vertex AS neighbor_id, edge_type, 'OUT' AS direction, count(*) AS edges FROM e GROUP BY ALL
UNION ALL SELECT target_vertex, source_vertex, edge_type, 'IN', count(*) FROM e GROUP BY ALL"""
BOTH = "b AS (SELECT DISTINCT source_vertex AS u, target_vertex AS w FROM e UNION SELECT DISTINCT target_vertex, source_vertex FROM e)"
BLOCKED = "z AS (SELECT vendor_id AS x FROM vendor_master WHERE status = 'BLOCKED')"
SQL["gq18_ego_vertices"] = f"""WITH e AS ({edges()}), {BOTH}, {BLOCKED},
h1 AS (SELECT DISTINCT w AS x FROM b JOIN z ON u = x WHERE w NOT IN (SELECT x FROM z)),
h2 AS (SELECT DISTINCT w AS x FROM b JOIN h1 ON u = x WHERE w NOT IN (SELECT x FROM z) AND w NOT IN (SELECT x FROM h1))
SELECT x AS vertex_id, 0 AS hop FROM z UNION ALL SELECT x, 1 FROM h1 UNION ALL SELECT x, 2 FROM h2"""
SQL["gq18_ego_edges"] = f"""WITH e AS ({edges()}), {BOTH}, {BLOCKED},
s AS (SELECT x FROM z UNION SELECT w FROM b JOIN z ON u = x)
SELECT source_vertex, target_vertex, edge_type FROM e WHERE source_vertex IN (SELECT x FROM s) AND target_vertex IN (SELECT x FROM s)"""
SQL["gq19_bfs_levels"] = f"""WITH e AS ({edges(['has_contract', 'under_contract', 'supplies'])}), {BOTH},
h0 AS (SELECT min(vendor_id) AS x FROM vendor_master),
h1 AS (SELECT w AS x, min(u) AS p FROM b JOIN h0 ON u = x WHERE w NOT IN (SELECT x FROM h0) GROUP BY w),
s1 AS (SELECT x FROM h0 UNION SELECT x FROM h1),
h2 AS (SELECT w AS x, min(u) AS p FROM b JOIN h1 ON u = x WHERE w NOT IN (SELECT x FROM s1) GROUP BY w),
s2 AS (SELECT x FROM s1 UNION SELECT x FROM h2),
h3 AS (SELECT w AS x, min(u) AS p FROM b JOIN h2 ON u = x WHERE w NOT IN (SELECT x FROM s2) GROUP BY w)
SELECT x AS vertex_id, 0 AS level, CAST(NULL AS VARCHAR) AS parent_id FROM h0 UNION ALL SELECT x, 1, p FROM h1
UNION ALL SELECT x, 2, p FROM h2 UNION ALL SELECT x, 3, p FROM h3"""
SQL["gq19_shortest_path"] = f"""WITH RECURSIVE e AS ({edges(['has_contract', 'under_contract', 'supplies'])}), {BOTH.replace("b AS (", "b AS MATERIALIZED (", 1)},
h(x, d) AS (SELECT min(vendor_id), 0 FROM vendor_master UNION SELECT w, d + 1 FROM h JOIN b ON u = x WHERE d < 6)
SELECT min(d) AS hops, true AS is_path FROM h WHERE x = (SELECT max(vendor_id) FROM vendor_master)"""
SQL["gq20_nodes_by_type"] = "SELECT contract_id AS vertex_id, 'CONTRACT' AS vertex_type, contract_id AS label FROM contract_header"
SQL["gq21_typed_hop"] = """SELECT 'SUPPLIES:' || vendor_id || ':' || material_id || ':' || plant_id AS edge_id, vendor_id AS source_vertex,
  vendor_name AS source_label, 'SUPPLIES' AS edge_type, material_id AS target_vertex, 'MATERIAL' AS target_type,
  description AS target_label
FROM source_list JOIN vendor_master USING (vendor_id) JOIN material_master USING (material_id)"""
SQL["gq22_two_hop"] = """SELECT DISTINCT h.vendor_id AS start_id, contract_id AS middle_id, po_id AS end_id
FROM contract_header h JOIN po_line_item USING (contract_id)"""
# Orders of one contract hang together, with their invoices and payments; other orders stand alone.
SQL["gq23_components"] = """WITH o AS (SELECT po_id, max(contract_id) AS c FROM po_line_item GROUP BY po_id),
m AS (SELECT po_id, c, po_id AS x FROM o
  UNION ALL SELECT DISTINCT NULL, c, c FROM o WHERE c IS NOT NULL
  UNION ALL SELECT po_id, c, invoice_id FROM invoice_header JOIN o USING (po_id)
  UNION ALL SELECT po_id, c, payment_id FROM payment_invoice_link JOIN invoice_header USING (invoice_id) JOIN o USING (po_id))
SELECT x AS vertex_id, coalesce(c, min(x) OVER (PARTITION BY po_id)) AS component_id FROM m
WHERE c IS NOT NULL OR po_id IN (SELECT po_id FROM invoice_header)"""
SQL["gq23_degree"] = f"""WITH e AS ({edges()})
SELECT x AS vertex_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree
FROM (SELECT source_vertex AS x, 1 AS o, 0 AS i FROM e UNION ALL SELECT target_vertex, 0, 1 FROM e) GROUP BY x"""
