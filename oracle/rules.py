"""DuckDB twins of the source and rule queries."""

from buylens.schemas import MAX_LENGTH, SCHEMAS, TABLE_ORDER, is_required, sql_type

DATE_WALK = """list_filter(list_transform(range(1, 40), lambda i: received_date {sign} CAST(i AS INTEGER)),
  lambda d: isodow(d) < 6)[{n}]"""

ACTIVE = """active AS (SELECT vendor_id, material_id, contract_id, item_number, agreed_price, confidentiality_tier
  FROM contract_item JOIN contract_header USING (contract_id) WHERE status = 'ACTIVE')"""

MATCH = """m AS (
  SELECT il.invoice_id, il.invoice_line_number,
    CAST(il.unit_price_invoiced - pl.unit_price AS DECIMAL(12,2)) AS price_variance,
    CAST(CASE WHEN gl.gr_id IS NULL THEN 0 ELSE il.quantity_invoiced - gl.quantity_accepted END AS DECIMAL(12,2))
      AS quantity_variance, pl.unit_price, pl.quantity
  FROM invoice_line_item il JOIN po_line_item pl ON il.po_id = pl.po_id AND il.po_line_number = pl.po_line_number
  LEFT JOIN gr_line_item gl ON il.gr_id = gl.gr_id AND il.gr_line_number = gl.gr_line_number),
f AS (SELECT *, (unit_price <> 0 AND abs(price_variance) * 50 > abs(unit_price)) OR abs(price_variance) > 0.50 AS price_breach,
    quantity <> 0 AND abs(quantity_variance) * 20 > abs(quantity) AS quantity_breach FROM m),
h AS (SELECT invoice_id, max(price_breach) AS p, max(quantity_breach) AS q FROM f GROUP BY ALL),
s AS (SELECT invoice_id, p, q, CASE WHEN p AND q THEN 'BOTH_VARIANCE' WHEN p THEN 'PRICE_VARIANCE'
    WHEN q THEN 'QUANTITY_VARIANCE' ELSE 'FULL_MATCH' END AS match_status FROM h)"""

MATCH_SUM = """
WITH g AS (SELECT po_id, po_line_number, sum(quantity_accepted) AS a FROM gr_line_item GROUP BY ALL),
m AS (SELECT invoice_id, invoice_line_number, quantity, CAST(coalesce(quantity_invoiced - a, 0) AS DECIMAL(12,2)) AS quantity_variance
  FROM invoice_line_item JOIN po_line_item USING (po_id, po_line_number) LEFT JOIN g USING (po_id, po_line_number))
SELECT invoice_id, invoice_line_number, quantity_variance, abs(quantity_variance) * 20 > quantity AS quantity_breach FROM m"""

RESOLVED = f"""{ACTIVE},
r AS (
  SELECT sl.material_id, plant_id, sl.vendor_id, preferred_rank, lane_lead_time_days, contract_id, item_number,
    row_number() OVER (PARTITION BY sl.material_id, plant_id ORDER BY (contract_id IS NULL)::INT, preferred_rank,
      contract_id, item_number) AS n
  FROM source_list sl JOIN vendor_master v ON v.vendor_id = sl.vendor_id
  LEFT JOIN active a ON a.vendor_id = sl.vendor_id AND a.material_id = sl.material_id AND v.status <> 'BLOCKED'),
x AS (SELECT pl.pr_id, pl.pr_line_number, pl.material_id, ph.plant_id, r.vendor_id, r.preferred_rank,
    r.lane_lead_time_days, r.contract_id, r.item_number AS contract_item_number
  FROM pr_line_item pl JOIN pr_header ph ON pl.pr_id = ph.pr_id
  LEFT JOIN r ON r.material_id = pl.material_id AND r.plant_id = ph.plant_id AND r.n = 1)"""

CANDIDATES = """ok AS (SELECT * FROM vendor_master WHERE status <> 'BLOCKED'),
stocked AS (SELECT DISTINCT c.parent_category_id AS parent_id, split_part(c.category_id, '-', 1) AS root_id
  FROM material_plant_extension JOIN material_master USING (material_id) JOIN category_hierarchy c USING (category_id)),
cand AS (
  SELECT category_id, vendor_id, 'SUBCATEGORY' AS via FROM vendor_category
  WHERE vendor_id IN (SELECT vendor_id FROM ok) AND category_id IN (SELECT parent_id FROM stocked)
  UNION ALL
  SELECT DISTINCT trim(c), vendor_id, 'TOP' FROM (SELECT vendor_id, unnest(string_split(supported_categories, ',')) AS c FROM ok)
  WHERE trim(c) IN (SELECT root_id FROM stocked))"""

CLOSURE = """WITH RECURSIVE cl(ancestor, descendant, depth) AS (
  SELECT category_id, category_id, 0 FROM category_hierarchy
  UNION ALL
  SELECT c.parent_category_id, cl.descendant, cl.depth + 1 FROM cl JOIN category_hierarchy c ON c.category_id = cl.ancestor
  WHERE c.parent_category_id IS NOT NULL)"""

SQL = {
    "s01_read_table_csv": "SELECT * FROM vendor_master",
    "s06_save_tables": "SELECT po_id, po_date, vendor_name, total_net_value FROM po_header JOIN vendor_master USING (vendor_id)",
    "s08_write_features": "SELECT invoice_id, invoice_date, total_net_amount, strftime(invoice_date, '%Y-%m') AS label_month FROM invoice_header",
    "s03_load_tables": """SELECT v.country, count(*) AS orders, CAST(sum(total_net_value) AS DECIMAL(18,2)) AS value
FROM po_header JOIN vendor_master v USING (vendor_id) GROUP BY v.country""",
    "s04_write_tables_csv": "SELECT * FROM po_line_item",
    "s07_verify_counts": """SELECT coalesce(n, 'TOTAL') AS table_name, CAST(sum(c) AS BIGINT) AS row_count FROM (
  SELECT 'vendor_master' AS n, count(*) AS c FROM vendor_master UNION ALL SELECT 'material_master', count(*) FROM material_master
  UNION ALL SELECT 'po_header', count(*) FROM po_header UNION ALL SELECT 'po_line_item', count(*) FROM po_line_item
  UNION ALL SELECT 'gr_header', count(*) FROM gr_header UNION ALL SELECT 'invoice_header', count(*) FROM invoice_header
  UNION ALL SELECT 'payment', count(*) FROM payment) GROUP BY ROLLUP (n)""",
    "s05_schema_report": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{f.name}' AS column_name, '{sql_type(f)}' AS sql_type, {is_required(f)} AS required, "
        + (f"CAST(max(length({f.name})) AS INTEGER) AS longest, coalesce(max(length({f.name})) <= {MAX_LENGTH[f.name]}, true)"
           if f.dataType.simpleString() == "string" else "CAST(max(NULL) AS INTEGER) AS longest, true")
        + f" AND (count(*) = count({f.name}) OR NOT {is_required(f)}) AS fits FROM {n}" for n in TABLE_ORDER for f in SCHEMAS[n]),
    "s09_bucketed_match": MATCH_SUM,
    "s09_write_fact": """SELECT po_id, po_date, total_net_value FROM po_header
WHERE po_date BETWEEN DATE '1996-11-15' AND DATE '1997-02-10'""",
    "b01_three_way_match_lines": f"""WITH {MATCH} SELECT invoice_id, invoice_line_number, price_variance, quantity_variance,
  price_breach, quantity_breach FROM f""",
    "b01_match_sum_of_receipts": MATCH_SUM,
    "b02_match_status": f"WITH {MATCH} SELECT invoice_id, match_status FROM s",
    "b03_block_reason": f"""WITH {MATCH} SELECT invoice_id, match_status, p OR q AS payment_block,
  CASE WHEN p THEN 'PRICE_MISMATCH' WHEN q THEN 'QTY_MISMATCH' END AS block_reason,
  CASE WHEN p OR q THEN 'EXCEPTION' ELSE 'MATCHED' END AS status FROM s""",
    "b04_invoice_totals": """SELECT invoice_id, CAST(g AS DECIMAL(14,2)) AS total_gross_amount,
  CAST(round(g * 0.07, 2) AS DECIMAL(12,2)) AS tax_amount, CAST(g + round(g * 0.07, 2) AS DECIMAL(14,2)) AS total_net_amount
FROM (SELECT invoice_id, CAST(sum(round(unit_price_invoiced * quantity_invoiced, 2)) AS DECIMAL(18,2)) AS g
  FROM invoice_line_item GROUP BY invoice_id)""",
    "b05_terms_days": """SELECT vendor_id, payment_terms, CASE payment_terms WHEN 'NET60' THEN 60 WHEN 'NET90' THEN 90
  WHEN 'IMMEDIATE' THEN 0 ELSE 30 END AS terms_days FROM vendor_master""",
    "b06_due_date": """SELECT invoice_id, invoice_date, d AS terms_days, invoice_date + d AS due_date
FROM (SELECT invoice_id, invoice_date, CASE payment_terms WHEN 'NET60' THEN 60 WHEN 'NET90' THEN 90 ELSE 30 END AS d
  FROM invoice_header JOIN vendor_master USING (vendor_id))""",
    "b07_early_discount": """SELECT payment_id, invoice_id, early_payment_discount AS discount,
  CAST(total_net_amount - early_payment_discount AS DECIMAL(14,2)) AS pay_amount
FROM payment JOIN payment_invoice_link USING (payment_id) JOIN invoice_header i USING (invoice_id)""",
    "b08_payable_invoices": """SELECT invoice_id, vendor_id, total_net_amount, payment_due_date FROM invoice_header
WHERE NOT payment_block AND status IN ('MATCHED', 'APPROVED')""",
    "b09_apply_payments": f"""WITH {MATCH} SELECT invoice_id, CASE WHEN invoice_id IN (SELECT invoice_id FROM payment_invoice_link
    JOIN payment USING (payment_id) WHERE payment.status = 'EXECUTED') THEN 'PAID' WHEN p OR q THEN 'EXCEPTION'
    ELSE 'MATCHED' END AS status FROM s""",
    "b10_apply_receipts": """
WITH g AS (SELECT po_id, gr_date FROM gr_header QUALIFY row_number() OVER (PARTITION BY po_id ORDER BY gr_id) = 1)
SELECT po_id, po_line_number, CASE WHEN gr_date IS NULL THEN gr_status ELSE 'COMPLETE' END AS gr_status,
  coalesce(gr_date, actual_delivery_date) AS actual_delivery_date FROM po_line_item LEFT JOIN g USING (po_id)""",
    "b10_apply_receipts_headers": """SELECT po_id, CASE WHEN po_id IN (SELECT po_id FROM gr_header) THEN 'FULLY_RECEIVED'
  ELSE status END AS status FROM po_header""",
    "b11_apply_invoices": """SELECT po_id, po_line_number, CASE WHEN (po_id, po_line_number) IN
  (SELECT (po_id, po_line_number) FROM invoice_line_item) THEN 'COMPLETE' ELSE 'OPEN' END AS invoice_status FROM po_line_item""",
    "b12_first_receipt": """SELECT po_id, gr_id, gr_date, gr_line_number FROM gr_header JOIN gr_line_item USING (gr_id, po_id)
QUALIFY row_number() OVER (PARTITION BY po_id ORDER BY gr_id, gr_line_number) = 1""",
    "b13_delivery_class": """SELECT po_id, po_line_number, CAST(d AS INTEGER) AS delay_days, CASE WHEN d < -3 THEN 'EARLY'
  WHEN d < 1 THEN 'ON_TIME' WHEN d < 8 THEN 'MINOR_LATE' ELSE 'LATE' END AS delivery_class
FROM (SELECT *, actual_delivery_date - requested_delivery_date AS d FROM po_line_item) WHERE d IS NOT NULL""",
    "b14_receipt_class": """SELECT gr_id, gr_line_number, quantity_accepted AS accepted,
  CASE WHEN quantity_received = quantity THEN 'FULL' WHEN quantity_received > quantity * 1.10 THEN 'OVER_TOLERANCE'
    WHEN quantity_received > quantity THEN 'OVER' WHEN quantity_received < quantity * 0.95 THEN 'PARTIAL' ELSE 'UNDER' END
    AS receipt_class
FROM gr_line_item JOIN po_line_item USING (po_id, po_line_number)""",
    "b15_po_totals": "SELECT po_id, CAST(sum(net_value) AS DECIMAL(14,2)) AS total_net_value FROM po_line_item GROUP BY po_id",
    "b16_reconcile_contracts": """
WITH u AS (SELECT contract_id, contract_item_number AS item_number, sum(trunc(quantity)) AS q, sum(net_value) AS w
  FROM po_line_item WHERE contract_id IS NOT NULL GROUP BY ALL)
SELECT contract_id, item_number, contract_type,
  CAST(CASE contract_type WHEN 'QUANTITY' THEN coalesce(q, 0) ELSE consumed_quantity END AS BIGINT) AS consumed_quantity,
  CAST(CASE contract_type WHEN 'VALUE' THEN coalesce(w, 0) ELSE consumed_value END AS DECIMAL(18,2)) AS consumed_value
FROM contract_item JOIN contract_header USING (contract_id) LEFT JOIN u USING (contract_id, item_number)""",
    "b17_max_tier": """
WITH r AS (SELECT * FROM (VALUES ('PUBLIC', 1), ('INTERNAL', 2), ('RESTRICTED', 3)) AS v(tier, n)),
p AS (SELECT DISTINCT vendor_id, material_id FROM source_list),
g AS (SELECT greatest(a.n, b.n) AS n FROM p JOIN vendor_master v USING (vendor_id) JOIN material_master m USING (material_id)
  JOIN r a ON a.tier = v.confidentiality_tier JOIN r b ON b.tier = m.confidentiality_tier)
SELECT tier, count(*) AS pairs FROM g JOIN r USING (n) GROUP BY tier""",
    "b18_propagate_confidentiality": f"""
WITH {ACTIVE},
r AS (SELECT * FROM (VALUES ('PUBLIC', 1), ('INTERNAL', 2), ('RESTRICTED', 3)) AS v(tier, n)),
f AS (SELECT vendor_id, material_id, confidentiality_tier AS ct FROM active
  QUALIFY row_number() OVER (PARTITION BY vendor_id, material_id ORDER BY contract_id, item_number) = 1),
n AS (SELECT sl.*, o.n AS own, greatest(a.n, b.n, coalesce(CASE WHEN contract_covered_flag THEN c.n END, 1)) AS need
  FROM source_list sl JOIN vendor_master v ON v.vendor_id = sl.vendor_id JOIN material_master m ON m.material_id = sl.material_id
  LEFT JOIN f ON f.vendor_id = sl.vendor_id AND f.material_id = sl.material_id
  JOIN r a ON a.tier = v.confidentiality_tier JOIN r b ON b.tier = m.confidentiality_tier LEFT JOIN r c ON c.tier = f.ct
  JOIN r o ON o.tier = sl.confidentiality_tier)
SELECT material_id, plant_id, vendor_id, r.tier AS confidentiality_tier, need > own AS updated
FROM n JOIN r ON r.n = greatest(own, need)""",
    "b19_material_tier": """SELECT material_id, CASE WHEN hazmat_flag THEN 'RESTRICTED'
  WHEN regexp_matches(category_id, '^(SRVC|PACK|MRO)-') THEN 'PUBLIC' ELSE 'INTERNAL' END AS assigned_tier FROM material_master""",
    "b20_candidate_vendors": f"WITH {CANDIDATES} SELECT category_id, vendor_id, via FROM cand",
    "b20_candidate_counts": f"""WITH {CANDIDATES},
cc AS (SELECT s.parent_id, count(DISTINCT c.vendor_id) AS n FROM stocked s
  JOIN cand c ON (c.via = 'SUBCATEGORY' AND c.category_id = s.parent_id) OR (c.via = 'TOP' AND c.category_id = s.root_id)
  GROUP BY 1)
SELECT material_id, plant_id, n AS candidate_vendors FROM material_plant_extension JOIN material_master USING (material_id)
JOIN category_hierarchy c USING (category_id) JOIN cc ON cc.parent_id = c.parent_category_id""",
    "b21_contract_coverage": f"WITH {ACTIVE} SELECT DISTINCT vendor_id, material_id FROM active",
    "b22_enrich_source_list": f"""WITH {ACTIVE}
SELECT material_id, plant_id, sl.vendor_id, (sl.vendor_id, material_id) IN (SELECT (vendor_id, material_id) FROM active)
  AS contract_covered_flag, CASE status WHEN 'CONDITIONAL' THEN 'CONDITIONAL' ELSE 'APPROVED' END AS approval_status
FROM source_list sl JOIN vendor_master v ON v.vendor_id = sl.vendor_id""",
    "b23_resolve_source": f"WITH {RESOLVED} SELECT * FROM x",
    "b24_buying_price": f"""WITH {RESOLVED} SELECT pr_id, pr_line_number, vendor_id,
  CAST(coalesce(agreed_price, round(standard_cost * 1.10, 2)) AS DECIMAL(12,2)) AS buying_price
FROM x JOIN material_master USING (material_id)
LEFT JOIN contract_item ci ON ci.contract_id = x.contract_id AND ci.item_number = x.contract_item_number""",
    "b25_unordered_pr_lines": """SELECT pr_id, pr_line_number, material_id FROM pr_line_item p WHERE status = 'PO_CREATED'
AND NOT EXISTS (SELECT 1 FROM po_line_item l WHERE l.pr_id = p.pr_id AND l.pr_line_number = p.pr_line_number)""",
    "b26_pr_line_status": "SELECT pr_id, pr_line_number, status AS line_status FROM pr_line_item",
    "b27_lane_lead_time": """SELECT po_id, po_line_number, coalesce(lane_lead_time_days, 14) AS lead_time_days
FROM po_line_item JOIN po_header h USING (po_id) LEFT JOIN source_list USING (material_id, plant_id, vendor_id)""",
    "b28_category_root": """SELECT category_id, split_part(category_id, '-', 1) AS root_category_id FROM category_hierarchy""",
    "b29_purch_group_for": """SELECT c.category_id, g.owner_purch_group_id AS purch_group_id FROM category_hierarchy c
JOIN category_hierarchy g ON g.category_id = split_part(c.category_id, '-', 1)""",
    "b30_category_closure": f"{CLOSURE} SELECT ancestor, descendant, depth FROM cl",
    "b31_convert_uom": """SELECT po_id, po_line_number,
  CAST(quantity * coalesce(conversion_factor, 1) AS DECIMAL(18,4)) AS converted_quantity,
  CASE WHEN conversion_factor IS NULL THEN uom ELSE 'BOX' END AS converted_uom
FROM po_line_item p LEFT JOIN uom_conversion u ON u.material_id = p.material_id AND u.from_uom = p.uom AND u.to_uom = 'BOX'""",
    "b32_to_usd": """
WITH fx AS (SELECT * FROM (VALUES ('USD', 1.0), ('EUR', 1.08), ('JPY', 0.0067), ('SGD', 0.74), ('KRW', 0.00075), ('THB', 0.028),
  ('CNY', 0.14), ('VND', 0.000041), ('GBP', 1.27), ('CHF', 1.13)) AS v(currency, rate))
SELECT po_id, CAST(total_net_value AS DOUBLE) * coalesce(CAST(rate AS DOUBLE), 1.0::DOUBLE) AS value_usd
FROM po_header LEFT JOIN fx USING (currency)""",
    "b33_add_business_days": f"""SELECT DISTINCT received_date, {DATE_WALK.format(sign='+', n=5)} AS plus_5,
  {DATE_WALK.format(sign='+', n=13)} AS plus_13, {DATE_WALK.format(sign='-', n=3)} AS minus_3 FROM invoice_header""",
    "b34_alias_groups": """SELECT vendor_id, legal_entity_id, alias_group, n AS group_size FROM vendor_master
JOIN (SELECT legal_entity_id, count(*) AS n FROM vendor_master GROUP BY 1) USING (legal_entity_id) WHERE n > 1""",
    "b35_lookup": """SELECT material_id, vendor_id, lane_lead_time_days FROM source_list
WHERE plant_id = 'PL01' AND preferred_rank = 1""",
    "b36_id_set": "SELECT category_id FROM category_hierarchy WHERE level = 3",
}
