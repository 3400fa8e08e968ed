"""DuckDB text that shapes the given tables into the purchasing tables.

``with_adapter(sql)`` puts in front of a query the CTEs it needs, directly or through others.
"""

from __future__ import annotations

import re

D2 = "CAST(({}) / 100.0 AS DECIMAL(14,2))"

CTES: dict[str, str] = {}

CTES["x_vendor"] = """
SELECT s_suppkey AS sk, 'VND-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS vendor_id, s_name,
  (['JP','CN','KR','TW','SG','MY','VN','DE','US','TH'])[CAST(s_nationkey % 10 AS BIGINT) + 1] AS country,
  (['JPY','CNY','KRW','TWD','SGD','MYR','VND','EUR','USD','THB'])[CAST(s_nationkey % 10 AS BIGINT) + 1] AS currency,
  (['NET30','NET60','NET90','2/10NET30'])[s_suppkey % 4 + 1] AS payment_terms,
  (['FOB','CIF','EXW'])[s_suppkey % 3 + 1] AS incoterms
FROM supplier"""

CTES["x_part"] = """
SELECT p_partkey AS pk, 'MAT-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS material_id, p_name,
  CASE p_type WHEN 'SMALL' THEN 'ELEC' WHEN 'MEDIUM' THEN 'MECH' WHEN 'LARGE' THEN 'MOTN'
    WHEN 'ECONOMY' THEN 'MRO' WHEN 'PROMO' THEN 'SRVC' ELSE 'PACK' END AS l1,
  CASE p_type WHEN 'MEDIUM' THEN 'RAW' WHEN 'LARGE' THEN 'ASSEMBLY' WHEN 'ECONOMY' THEN 'MRO'
    WHEN 'PROMO' THEN 'SERVICE' ELSE 'COMPONENT' END AS material_type,
  replace(p_brand, 'Brand#', 'B') AS brand, CAST(p_size AS BIGINT) // 10 AS band,
  CAST(round(p_retailprice * 100) AS BIGINT) * 5 AS standard_c
FROM part"""

CTES["x_line"] = """
SELECT l_orderkey AS ok, l_suppkey AS sk, l_partkey AS pk, CAST(l_quantity AS BIGINT) AS qty,
  CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS price_c,
  CAST(o_orderdate AS DATE) AS od, o_custkey AS ck, o_orderpriority,
  CAST(10 * row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_partkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_shipdate, l_linenumber, l_returnflag, l_linestatus) AS INTEGER) AS line,
  CAST(10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_shipdate, l_linenumber, l_returnflag, l_linestatus) AS INTEGER) AS pr_line,
  'PO-' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS po_id,
  'PR-' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS pr_id,
  'MAT-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS material_id,
  'VND-' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS vendor_id,
  'PL0' || CAST(o_custkey % 5 AS VARCHAR) AS plant_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTES["x_move"] = """
SELECT *, (pk + sk) % 3 <> 0 AND sk % 20 <> 3 AND od BETWEEN DATE '1995-06-01' AND DATE '2001-05-31' AS covered,
  (ok + sk) % 12 <> 0 AS received, (ok + sk) % 12 <> 0 AND (ok + sk) % 23 <> 0 AS invoiced,
  od + CAST(7 + pk % 54 AS INTEGER) AS requested,
  od + CAST(7 + pk % 54 + (pk * 5 + ok * 3 + sk) % 21 - 9 AS INTEGER) AS actual,
  (pk * 13 + ok * 7 + line) % 100 AS v,
  qty * CASE (pk * 13 + ok * 7 + line) % 10 WHEN 0 THEN 90 WHEN 1 THEN 105 ELSE 100 END AS received_h,
  CASE WHEN (pk + sk) % 8 = 0 THEN qty * 5 ELSE 0 END AS rejected_h,
  'GR-' || substr(po_id, 4) || '-' || CAST(line AS VARCHAR) AS gr_id
FROM x_line"""

CTES["company_code"] = """
SELECT '1000' AS company_code, 'Example Robotics' AS company_name, 'SG' AS country, 'USD' AS currency"""

CTES["purchasing_org"] = """
SELECT * FROM (VALUES ('PO01', 'Direct purchasing', '1000'), ('PO02', 'Indirect purchasing', '1000'))
  AS v(purch_org_id, purch_org_name, company_code)"""

CTES["purchasing_group"] = """
SELECT * FROM (VALUES ('PG01', 'Electronics', 'PO01', 'PG-ELEC'), ('PG02', 'Mechanics', 'PO01', 'PG-MECH'),
  ('PG03', 'Motion', 'PO01', 'PG-MOTN'), ('PG04', 'Maintenance', 'PO02', 'PG-MRO'),
  ('PG05', 'Services', 'PO02', 'PG-SRVC'), ('PG06', 'Packaging', 'PO02', 'PG-PACK'))
  AS v(purch_group_id, purch_group_name, purch_org_id, display_code)"""

CTES["x_owner"] = """
SELECT * FROM (VALUES ('ELEC', 'PG01', 'Electronics'), ('MECH', 'PG02', 'Mechanics'), ('MOTN', 'PG03', 'Motion'),
  ('MRO', 'PG04', 'Maintenance'), ('SRVC', 'PG05', 'Services'), ('PACK', 'PG06', 'Packaging')) AS v(l1, grp, l1_name)"""

CTES["plant"] = """
SELECT 'PL0' || CAST(r_regionkey AS VARCHAR) AS plant_id, r_name AS plant_name,
  (['SG','US','JP','DE','MY'])[CAST(r_regionkey AS BIGINT) + 1] AS country, 'City ' || r_name AS city,
  (['ASSEMBLY','LOGISTICS'])[CAST(r_regionkey % 2 AS BIGINT) + 1] AS "function", '1000' AS company_code
FROM region"""

CTES["storage_location"] = """
SELECT plant_id || '-' || k AS storage_loc_id, plant_id, n AS storage_loc_name, k AS storage_type
FROM plant, (VALUES ('RAW', 'Raw store'), ('FG', 'Finished goods')) AS v(k, n)"""

CTES["cost_center"] = """
SELECT 'CC-' || plant_id || '-' || k AS cost_center_id, n || ' ' || plant_id AS cost_center_name, plant_id,
  n AS department
FROM plant, (VALUES ('PRD', 'Production'), ('ENG', 'Engineering')) AS v(k, n)"""

CTES["category_hierarchy"] = """
SELECT l1 AS category_id, l1_name AS category_name, 1 AS level, CAST(NULL AS VARCHAR) AS parent_category_id,
  grp AS owner_purch_group_id FROM x_owner WHERE l1 IN (SELECT l1 FROM x_part)
UNION ALL
SELECT DISTINCT l1 || '-' || brand, l1 || ' ' || brand, 2, l1, CAST(NULL AS VARCHAR) FROM x_part
UNION ALL
SELECT DISTINCT l1 || '-' || brand || '-S' || band, l1 || ' ' || brand || ' size ' || band, 3, l1 || '-' || brand,
  CAST(NULL AS VARCHAR) FROM x_part"""

CTES["purchasing_group_category"] = """
SELECT grp AS purch_group_id, l1 AS category_id FROM x_owner WHERE l1 IN (SELECT l1 FROM x_part)"""

CTES["material_master"] = f"""
SELECT material_id, 'M' || pk AS display_code, p_name AS description, material_type,
  l1 || '-' || brand || '-S' || band AS category_id, 'EA' AS base_uom,
  CAST({D2.format('standard_c')} AS DECIMAL(12,2)) AS standard_cost, 'USD' AS currency,
  CASE WHEN pk % 10 = 0 THEN 'HIGH' WHEN pk % 10 < 3 THEN 'MEDIUM' ELSE 'LOW' END AS criticality,
  CASE WHEN pk % 10 = 0 THEN 'SAFETY' END AS criticality_reason_code, pk % 20 = 0 AS hazmat_flag,
  CAST(7 + pk % 54 AS INTEGER) AS default_lead_time_days,
  CASE WHEN pk % 6 = 0 THEN 'MAKE' ELSE 'BUY' END AS make_or_buy,
  CASE WHEN pk % 20 = 0 THEN 'RESTRICTED' WHEN l1 IN ('SRVC', 'PACK', 'MRO') THEN 'PUBLIC'
    ELSE 'INTERNAL' END AS confidentiality_tier
FROM x_part"""

CTES["material_plant_extension"] = """
SELECT DISTINCT material_id, plant_id, CAST(20 + pk % 80 AS INTEGER) AS reorder_point,
  CAST(10 + pk % 90 AS INTEGER) AS lot_size, CAST(1 + pk % 20 AS INTEGER) AS min_order_qty
FROM x_line"""

CTES["legal_entity"] = """
SELECT 'LE-' || lpad(CAST(sk // 2 AS VARCHAR), 6, '0') AS legal_entity_id, 'Entity ' || (sk // 2) AS legal_name,
  country AS country_of_incorporation, country || '-' || lpad(CAST(sk // 2 AS VARCHAR), 9, '0') AS registration_id
FROM x_vendor WHERE sk % 2 = 0"""

CTES["vendor_master"] = f"""
SELECT vendor_id, 'V' || lpad(CAST(sk AS VARCHAR), 6, '0') AS display_code,
  'LE-' || lpad(CAST(sk // 2 AS VARCHAR), 6, '0') AS legal_entity_id, s_name AS vendor_name, country,
  (['OEM','DISTRIBUTOR','CONTRACT_MFG','LOGISTICS','SERVICE'])[sk % 5 + 1] AS vendor_type,
  (['ELEC','MECH','MOTN','MRO','SRVC','PACK'])[sk % 6 + 1] || ', '
    || (['ELEC','MECH','MOTN','MRO','SRVC','PACK'])[(sk + 2) % 6 + 1] AS supported_categories,
  sk % 3 = 0 AS preferred_flag, incoterms AS incoterms_default, payment_terms, currency,
  CAST(5 + sk % 50 AS INTEGER) AS lead_time_days_typical,
  CAST((7000 + sk * 53 % 2900) / 100.0 AS DECIMAL(5,2)) AS on_time_delivery_rate,
  CAST(40 + sk * 37 % 59 AS INTEGER) AS quality_score, CAST(10 + sk * 29 % 76 AS INTEGER) AS risk_score,
  CASE WHEN sk % 5 = 0 THEN NULL ELSE CAST(40 + sk * 17 % 56 AS INTEGER) END AS esg_score,
  CASE WHEN sk % 40 = 7 THEN 'BLOCKED' WHEN sk % 20 = 3 THEN 'CONDITIONAL' ELSE 'ACTIVE' END AS status,
  country || '00' || lpad(CAST(sk AS VARCHAR), 10, '0') AS bank_account,
  CASE sk % 13 WHEN 0 THEN 'RESTRICTED' WHEN 1 THEN 'PUBLIC' ELSE 'INTERNAL' END AS confidentiality_tier,
  CASE WHEN sk % 10 IN (0, 1) THEN 'AL-' || (sk // 2) END AS alias_group
FROM x_vendor"""

CTES["vendor_category"] = """
SELECT DISTINCT x_line.vendor_id, l1 || '-' || brand AS category_id FROM x_line JOIN x_part USING (pk)"""

CTES["vendor_address"] = """
SELECT vendor_id, 'LEGAL' AS address_type, sk || ' Main Street' AS street, 'City ' || country AS city,
  'State ' || (sk % 50) AS state_province, country, lpad(CAST(sk % 100000 AS VARCHAR), 5, '0') AS postal_code
FROM x_vendor
UNION ALL
SELECT vendor_id, 'SHIPPING', sk || ' Dock Road', 'City ' || country, 'State ' || (sk % 50),
  CASE WHEN sk % 6 = 0 THEN 'HK' ELSE country END, lpad(CAST(sk % 100000 AS VARCHAR), 5, '0') FROM x_vendor"""

CTES["vendor_contact"] = """
SELECT 'CT-' || lpad(CAST(sk AS VARCHAR), 8, '0') AS contact_id, vendor_id, 'Contact ' || sk AS contact_name,
  'contact' || sk || '@example.com' AS email, '+65 ' || lpad(CAST(sk % 100000000 AS VARCHAR), 8, '0') AS phone,
  'SALES' AS role
FROM x_vendor"""

CTES["contract_header"] = """
SELECT 'CTR-' || lpad(CAST(sk AS VARCHAR), 6, '0') AS contract_id, 'C' || sk AS display_code, vendor_id,
  DATE '1995-06-01' AS valid_from,
  CAST(DATE '2001-05-31' + to_months(CAST(sk % 12 AS INTEGER)) AS DATE) AS valid_to,
  CASE WHEN sk % 2 = 0 THEN 'QUANTITY' ELSE 'VALUE' END AS contract_type,
  CASE WHEN sk % 12 >= 1 THEN 'ACTIVE' ELSE 'EXPIRED' END AS status, currency, incoterms,
  CASE sk % 9 WHEN 0 THEN 'RESTRICTED' WHEN 1 THEN 'PUBLIC' ELSE 'INTERNAL' END AS confidentiality_tier
FROM x_vendor WHERE sk % 20 <> 3"""

CTES["contract_item"] = f"""
WITH pair AS (SELECT DISTINCT sk, pk, material_id FROM x_line WHERE (pk + sk) % 3 <> 0 AND sk % 20 <> 3),
priced AS (SELECT pair.*, standard_c * (85 + pk % 36) // 100 AS agreed_c FROM pair JOIN x_part USING (pk))
SELECT 'CTR-' || lpad(CAST(sk AS VARCHAR), 6, '0') AS contract_id, 10 * (pk + 1) AS item_number, material_id,
  CAST(agreed_c / 100.0 AS DECIMAL(12,2)) AS agreed_price, 'EA' AS price_uom,
  CASE WHEN sk % 2 = 0 THEN CAST(500 + pk % 4500 AS INTEGER) END AS max_quantity,
  CASE WHEN sk % 2 = 1 THEN CAST(agreed_c * (50 + pk % 50) / 100.0 AS DECIMAL(12,2)) END AS target_value,
  CASE WHEN sk % 2 = 0 THEN CAST(pk * 7 % (500 + pk % 4500) AS INTEGER) END AS consumed_quantity,
  CASE WHEN sk % 2 = 1 THEN CAST((agreed_c * (50 + pk % 50) * (pk % 100) // 100) / 100.0 AS DECIMAL(12,2)) END
    AS consumed_value
FROM priced"""

CTES["source_list"] = """
SELECT material_id, plant_id, vendor_id,
  CAST(row_number() OVER (PARTITION BY pk, plant_id ORDER BY sk) AS INTEGER) AS preferred_rank,
  (pk + sk) % 3 <> 0 AND sk % 20 <> 3 AS contract_covered_flag,
  CASE WHEN sk % 20 = 3 THEN 'CONDITIONAL' ELSE 'APPROVED' END AS approval_status,
  CAST(5 + (pk + sk) % 56 AS INTEGER) AS lane_lead_time_days, 'VM-' || pk || '-' || sk AS vendor_material_code,
  CASE WHEN pk % 3 = 0 THEN NULL ELSE CAST(1 + pk % 20 AS INTEGER) END AS min_order_qty,
  'INTERNAL' AS confidentiality_tier, DATE '1995-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to
FROM (SELECT DISTINCT pk, sk, material_id, plant_id, vendor_id FROM x_line)"""

CTES["uom_conversion"] = """
SELECT material_id, 'EA' AS from_uom, 'BOX' AS to_uom, CAST(0.01 AS DECIMAL(10,4)) AS conversion_factor
FROM x_part WHERE pk % 50 = 0"""

CTES["x_pr"] = """
SELECT o_orderkey AS ok, 'PR-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS pr_id,
  CAST(o_orderdate AS DATE) - 7 AS pr_date, o_custkey AS ck, o_orderpriority,
  CASE WHEN o_orderkey % 20 = 9 THEN 'APPROVED' WHEN o_orderkey % 20 = 18 THEN 'OPEN'
    WHEN o_orderkey % 40 = 38 THEN 'CANCELLED' ELSE 'CONVERTED' END AS status
FROM orders"""

CTES["pr_header"] = """
SELECT pr_id, pr_date, 'Requester ' || ck AS requester_name,
  CASE ck % 2 WHEN 0 THEN 'Production' ELSE 'Engineering' END AS requester_department,
  'CC-PL0' || (ck % 5) || CASE ck % 2 WHEN 0 THEN '-PRD' ELSE '-ENG' END AS cost_center_id,
  'PL0' || (ck % 5) AS plant_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '5-LOW' THEN 'BLANKET' ELSE 'STANDARD' END AS pr_type,
  status, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
    WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority, CAST(NULL AS VARCHAR) AS notes
FROM x_pr"""

CTES["pr_line_item"] = f"""
SELECT x_line.pr_id, pr_line AS pr_line_number, x_line.material_id, CAST(qty AS DECIMAL(12,2)) AS quantity,
  'EA' AS uom, od + CAST(7 + x_line.pk % 54 AS INTEGER) AS requested_delivery_date,
  CASE WHEN x_line.pk % 17 <> 0 THEN CAST({D2.format('standard_c')} AS DECIMAL(12,2)) END AS estimated_price,
  'USD' AS currency, CASE x_pr.status WHEN 'CONVERTED' THEN 'PO_CREATED' WHEN 'CANCELLED' THEN 'CANCELLED'
    WHEN 'APPROVED' THEN 'ASSIGNED' ELSE 'OPEN' END AS status,
  (SELECT grp FROM x_owner WHERE x_owner.l1 = x_part.l1) AS assigned_purch_group_id
FROM x_line JOIN x_part USING (pk) JOIN x_pr USING (ok)"""

CTES["po_header"] = f"""
SELECT po_id, any_value(od) AS po_date, any_value(x_move.vendor_id) AS vendor_id,
  CASE any_value(ck) % 2 WHEN 0 THEN 'PO01' ELSE 'PO02' END AS purch_org_id,
  'PG0' || CAST(any_value(x_move.sk) % 6 + 1 AS VARCHAR) AS purch_group_id, any_value(plant_id) AS plant_id,
  CASE any_value(o_orderpriority) WHEN '1-URGENT' THEN 'RUSH' ELSE 'STANDARD' END AS po_type,
  CASE WHEN any_value(received) THEN 'FULLY_RECEIVED' ELSE 'SENT' END AS status,
  any_value(incoterms) AS incoterms, any_value(payment_terms) AS payment_terms, any_value(currency) AS currency,
  CAST(sum(CAST(qty * price_c AS BIGINT)) / 100.0 AS DECIMAL(14,2)) AS total_net_value,
  NOT bool_or(covered) AND (any_value(ok) + any_value(x_move.sk)) % 11 = 0 AS maverick_flag,
  CASE WHEN NOT bool_or(covered) AND (any_value(ok) + any_value(x_move.sk)) % 11 = 0
    THEN 'Maverick purchase, non-preferred vendor' END AS notes
FROM x_move JOIN x_vendor ON x_move.sk = x_vendor.sk GROUP BY po_id"""

CTES["po_line_item"] = f"""
SELECT po_id, line AS po_line_number, material_id, CAST(qty AS DECIMAL(12,2)) AS quantity, 'EA' AS uom,
  CAST(price_c / 100.0 AS DECIMAL(12,2)) AS unit_price, CAST(qty * price_c / 100.0 AS DECIMAL(14,2)) AS net_value,
  currency AS price_currency, requested AS requested_delivery_date,
  CASE WHEN received THEN actual END AS actual_delivery_date,
  CASE WHEN covered THEN 'CTR-' || lpad(CAST(x_move.sk AS VARCHAR), 6, '0') END AS contract_id,
  CASE WHEN covered THEN 10 * (pk + 1) END AS contract_item_number,
  CASE WHEN ok % 10 NOT IN (8, 9) THEN pr_id END AS pr_id,
  CASE WHEN ok % 10 NOT IN (8, 9) THEN pr_line END AS pr_line_number,
  CAST(10 AS DECIMAL(5,2)) AS over_delivery_tolerance, CAST(5 AS DECIMAL(5,2)) AS under_delivery_tolerance,
  CASE WHEN received THEN 'COMPLETE' ELSE 'OPEN' END AS gr_status,
  CASE WHEN invoiced THEN 'COMPLETE' ELSE 'OPEN' END AS invoice_status
FROM x_move JOIN x_vendor ON x_move.sk = x_vendor.sk"""

CTES["gr_header"] = """
SELECT gr_id, actual AS gr_date, po_id, plant_id, plant_id || '-RAW' AS storage_loc_id,
  'Clerk ' || (ck % 7) AS received_by,
  CASE WHEN (pk + sk) % 24 = 0 THEN 'QUALITY_HOLD' ELSE 'POSTED' END AS status, CAST(NULL AS VARCHAR) AS notes
FROM x_move WHERE received"""

CTES["gr_line_item"] = """
SELECT gr_id, 10 AS gr_line_number, po_id, line AS po_line_number, material_id,
  CAST(received_h / 100.0 AS DECIMAL(12,2)) AS quantity_received, 'EA' AS uom,
  CAST((received_h - rejected_h) / 100.0 AS DECIMAL(12,2)) AS quantity_accepted,
  CAST(rejected_h / 100.0 AS DECIMAL(12,2)) AS quantity_rejected,
  CASE WHEN rejected_h > 0 THEN (['DEFECTIVE','DAMAGED','EXPIRED','WRONG_ITEM'])[pk % 4 + 1] END AS rejection_reason,
  CASE WHEN pk % 2 = 0 THEN 'B' || pk || '-' || (ok % 1000) END AS batch_number
FROM x_move WHERE received"""

CTES["x_billed"] = """
SELECT ok, sk, pk, line, po_id, material_id, vendor_id, gr_id, actual, qty, price_c,
  'INV-' || substr(po_id, 4) AS invoice_id,
  CASE WHEN v BETWEEN 80 AND 87 OR v >= 97 THEN price_c * 105 // 100
    WHEN v BETWEEN 88 AND 91 THEN price_c * 92 // 100 ELSE price_c END AS inv_price_c,
  CASE WHEN v >= 92 THEN (received_h - rejected_h) * 108 // 100 ELSE received_h - rejected_h END AS inv_h,
  received_h - rejected_h AS accepted_h
FROM x_move WHERE invoiced"""

CTES["x_bill"] = """
WITH h AS (
SELECT invoice_id, any_value(ok) AS ok, any_value(b.sk) AS sk, any_value(po_id) AS po_id,
  any_value(b.vendor_id) AS vendor_id, any_value(x_vendor.payment_terms) AS payment_terms,
  any_value(x_vendor.currency) AS currency,
  min(actual) + CAST(1 + (any_value(ok) + any_value(b.sk)) % 5 AS INTEGER) AS invoice_date,
  CAST(sum((inv_price_c * inv_h + 50) // 100) AS BIGINT) AS gross_c,
  bool_or(abs(inv_price_c - price_c) * 100 > price_c * 2 OR abs(inv_price_c - price_c) > 50) AS price_bad,
  bool_or(abs(inv_h - accepted_h) > qty * 5) AS qty_bad
FROM x_billed b JOIN x_vendor ON b.sk = x_vendor.sk GROUP BY invoice_id)
SELECT *, (gross_c * 7 + 50) // 100 AS tax_c, gross_c + (gross_c * 7 + 50) // 100 AS net_c, '' AS suffix, 0 AS shift FROM h
UNION ALL
SELECT *, (gross_c * 7 + 50) // 100, gross_c + (gross_c * 7 + 50) // 100, 'D', 3 FROM h WHERE ok % 97 = 0"""

CTES["invoice_header"] = """
SELECT invoice_id || suffix AS invoice_id,
  'VIN-' || lpad(CAST(sk AS VARCHAR), 6, '0') || '-' || CASE suffix WHEN '' THEN lpad(CAST(ok AS VARCHAR), 8, '0')
    ELSE substr(lpad(CAST(ok AS VARCHAR), 8, '0'), 1, 7) || 'X' END AS vendor_invoice_number,
  invoice_date + shift AS invoice_date, invoice_date + shift + CAST(ok % 4 AS INTEGER) AS received_date, vendor_id,
  po_id, currency, CAST(gross_c / 100.0 AS DECIMAL(14,2)) AS total_gross_amount,
  CAST(tax_c / 100.0 AS DECIMAL(12,2)) AS tax_amount, CAST(net_c / 100.0 AS DECIMAL(14,2)) AS total_net_amount,
  CASE WHEN price_bad OR qty_bad THEN 'EXCEPTION' WHEN (ok + sk) % 9 <> 0 AND ok % 101 <> 0 THEN 'PAID'
    ELSE 'MATCHED' END AS status,
  CASE WHEN price_bad AND qty_bad THEN 'BOTH_VARIANCE' WHEN price_bad THEN 'PRICE_VARIANCE'
    WHEN qty_bad THEN 'QUANTITY_VARIANCE' ELSE 'FULL_MATCH' END AS match_status,
  invoice_date + shift + CASE payment_terms WHEN 'NET60' THEN 60 WHEN 'NET90' THEN 90 ELSE 30 END AS payment_due_date,
  price_bad OR qty_bad AS payment_block,
  CASE WHEN price_bad THEN 'PRICE_MISMATCH' WHEN qty_bad THEN 'QTY_MISMATCH' END AS block_reason
FROM x_bill"""

CTES["invoice_line_item"] = """
SELECT b.invoice_id || suffix AS invoice_id, line AS invoice_line_number, b.po_id, line AS po_line_number, material_id,
  CAST(inv_h / 100.0 AS DECIMAL(12,2)) AS quantity_invoiced,
  CAST(inv_price_c / 100.0 AS DECIMAL(12,2)) AS unit_price_invoiced,
  CAST(((inv_price_c * inv_h + 50) // 100) / 100.0 AS DECIMAL(14,2)) AS net_amount, gr_id, 10 AS gr_line_number,
  CAST((inv_price_c - price_c) / 100.0 AS DECIMAL(12,2)) AS price_variance,
  CAST((inv_h - accepted_h) / 100.0 AS DECIMAL(12,2)) AS quantity_variance
FROM x_billed b JOIN x_bill h ON b.invoice_id = h.invoice_id"""

CTES["x_paid"] = """
SELECT *, invoice_date + shift AS doc_date, invoice_date + shift
  + CASE payment_terms WHEN 'NET60' THEN 60 WHEN 'NET90' THEN 90 ELSE 30 END
  + CAST((ok * 7 + sk) % 31 - 15 AS INTEGER) AS payment_date,
  CASE WHEN payment_terms = '2/10NET30' AND 30 + (ok * 7 + sk) % 31 - 15 <= 10 THEN (net_c * 2 + 50) // 100 ELSE 0 END
    AS discount_c
FROM x_bill WHERE NOT price_bad AND NOT qty_bad AND (ok + sk) % 9 <> 0"""

CTES["payment"] = """
SELECT 'PAY-' || substr(invoice_id, 5) || suffix AS payment_id, payment_date, p.vendor_id,
  CASE ok % 2 WHEN 0 THEN 'BANK_TRANSFER' ELSE 'WIRE' END AS payment_method, p.currency,
  CAST((net_c - discount_c) / 100.0 AS DECIMAL(14,2)) AS total_amount,
  country || '00' || lpad(CAST(p.sk AS VARCHAR), 10, '0') AS bank_account_ref,
  p.payment_terms AS payment_terms_applied, CAST(discount_c / 100.0 AS DECIMAL(12,2)) AS early_payment_discount,
  CASE WHEN ok % 101 = 0 THEN 'FAILED' ELSE 'EXECUTED' END AS status
FROM x_paid p JOIN x_vendor ON p.sk = x_vendor.sk"""

CTES["payment_invoice_link"] = """
SELECT 'PAY-' || substr(invoice_id, 5) || suffix AS payment_id, invoice_id || suffix AS invoice_id,
  CAST((net_c - discount_c) / 100.0 AS DECIMAL(14,2)) AS amount_applied
FROM x_paid"""

_NAMES = {name: re.compile(rf"\b{name}\b") for name in CTES}


def _needs(sql: str) -> set[str]:
    return {name for name, pattern in _NAMES.items() if pattern.search(sql)}


_DIRECT = {name: _needs(body) - {name} for name, body in CTES.items()}


def with_adapter(sql: str) -> str:
    """Prepend the adapter CTEs that ``sql`` reads, in dependency order."""
    todo, seen = list(_needs(sql)), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo.extend(_DIRECT[name])
    ordered, placed = [], set()

    def place(name: str) -> None:
        if name not in placed:
            placed.add(name)
            for other in sorted(_DIRECT[name]):
                place(other)
            ordered.append(name)

    for name in sorted(seen):
        place(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in ordered)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
