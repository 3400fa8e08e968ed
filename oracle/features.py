"""DuckDB twins of the feature groups."""

PERF = """
WITH o AS (SELECT vendor_id, count(*) AS n, sum(total_net_value) AS v FROM po_header GROUP BY 1),
d AS (SELECT vendor_id, avg((actual_delivery_date <= requested_delivery_date)::INT) AS ot,
    avg(actual_delivery_date - requested_delivery_date) {delay} AS dl
  FROM po_line_item JOIN po_header USING (po_id) WHERE actual_delivery_date IS NOT NULL GROUP BY 1),
r AS (SELECT vendor_id, sum(quantity_rejected)::DOUBLE / sum(quantity_received)::DOUBLE AS rj
  FROM gr_line_item g JOIN gr_header gh ON gh.gr_id = g.gr_id JOIN po_header h ON h.po_id = gh.po_id GROUP BY 1),
m AS (SELECT vendor_id, count(DISTINCT material_id) AS k FROM po_line_item JOIN po_header USING (po_id) GROUP BY 1)
SELECT vendor_id, n AS v_total_po_count, CAST(v AS DECIMAL(18,2)) AS v_total_po_value, v::DOUBLE / n AS v_avg_po_value,
  coalesce(ot, 0.5) AS v_on_time_delivery_actual, coalesce(dl, 0.0)::DOUBLE AS v_avg_delivery_delay_days,
  coalesce(rj, 0.0)::DOUBLE AS v_rejection_rate, coalesce(k, 0) AS v_distinct_materials
FROM o LEFT JOIN d USING (vendor_id) LEFT JOIN r USING (vendor_id) LEFT JOIN m USING (vendor_id)"""

PCT = "CASE WHEN unit_price_invoiced > 0 THEN abs(price_variance)::DOUBLE / unit_price_invoiced::DOUBLE ELSE 0 END"
RATE = """avg((match_status = 'FULL_MATCH')::INT) AS v_invoice_match_rate,
  avg((match_status IN ('PRICE_VARIANCE', 'BOTH_VARIANCE'))::INT) AS v_price_variance_rate,
  avg((match_status IN ('QUANTITY_VARIANCE', 'BOTH_VARIANCE'))::INT) AS v_qty_variance_rate"""

BEHAVIOR = f"""bh AS (SELECT vendor_id, count(*) AS v_invoice_count, {RATE}, avg(payment_block::INT) AS v_payment_block_rate
  FROM invoice_header GROUP BY 1),
bl AS (SELECT vendor_id, avg({PCT}) AS v_avg_price_variance_pct FROM invoice_line_item JOIN invoice_header USING (invoice_id) GROUP BY 1)"""

# The definition, vendor by vendor and invoice by invoice, through exclusion windows.
LOO = f"""lh AS (SELECT invoice_id, vendor_id, count(*) OVER w AS n,
    avg((match_status = 'FULL_MATCH')::INT) OVER x AS a, avg((match_status IN ('PRICE_VARIANCE', 'BOTH_VARIANCE'))::INT) OVER x AS b,
    avg((match_status IN ('QUANTITY_VARIANCE', 'BOTH_VARIANCE'))::INT) OVER x AS c
  FROM invoice_header WINDOW w AS (PARTITION BY vendor_id),
    x AS (PARTITION BY vendor_id ORDER BY invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)),
ll AS (SELECT invoice_id, vendor_id, {PCT} AS p FROM invoice_line_item JOIN invoice_header USING (invoice_id)),
li AS (SELECT invoice_id, vendor_id, sum(p) AS s, count(*) AS k FROM ll GROUP BY ALL),
lx AS (SELECT invoice_id, sum(s) OVER x / sum(k) OVER x AS d FROM li
  WINDOW x AS (PARTITION BY vendor_id ORDER BY invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)),
lg AS (SELECT avg(v_invoice_match_rate) AS a, avg(v_price_variance_rate) AS b, avg(v_qty_variance_rate) AS c,
  avg(coalesce(v_avg_price_variance_pct, 0)) AS d FROM bh LEFT JOIN bl USING (vendor_id)),
loo AS (SELECT invoice_id, CASE WHEN n > 1 THEN lh.a ELSE lg.a END AS v_invoice_match_rate_loo,
  CASE WHEN n > 1 THEN lh.b ELSE lg.b END AS v_price_variance_rate_loo, CASE WHEN n > 1 THEN lh.c ELSE lg.c END AS v_qty_variance_rate_loo,
  CASE WHEN n > 1 THEN coalesce(lx.d, 0) ELSE lg.d END AS v_avg_price_variance_pct_loo
  FROM lh LEFT JOIN lx USING (invoice_id), lg)"""

PROFILE = """vp AS (SELECT v.vendor_id, (vendor_type = 'OEM')::INT AS v_type_oem, (vendor_type = 'DISTRIBUTOR')::INT AS v_type_distributor,
  (vendor_type = 'CONTRACT_MFG')::INT AS v_type_contract_mfg, (vendor_type = 'LOGISTICS')::INT AS v_type_logistics,
  (vendor_type = 'SERVICE')::INT AS v_type_service, preferred_flag::INT AS v_preferred,
  CASE status WHEN 'ACTIVE' THEN 2 WHEN 'CONDITIONAL' THEN 1 WHEN 'BLOCKED' THEN 0 ELSE -1 END AS v_status_encoded,
  CASE WHEN country IN ('JP', 'DE', 'US') THEN 1 WHEN country IN ('SG', 'KR') THEN 2 WHEN country IN ('TH', 'CN') THEN 3
    WHEN country = 'VN' THEN 4 ELSE -1 END AS v_country_risk,
  CASE payment_terms WHEN 'NET60' THEN 60 WHEN 'NET90' THEN 90 WHEN 'IMMEDIATE' THEN 0 ELSE 30 END AS v_payment_terms_days,
  (payment_terms = '2/10NET30')::INT AS v_has_early_discount,
  CASE confidentiality_tier WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'RESTRICTED' THEN 2 ELSE -1 END AS v_confidentiality_ordinal,
  coalesce(c, 0) AS v_category_count
  FROM vendor_master v LEFT JOIN (SELECT vendor_id, count(DISTINCT category_id) AS c FROM vendor_category GROUP BY 1) USING (vendor_id))"""

BENCH = """pb AS (SELECT po_id, po_line_number, l.material_id, unit_price, a AS p_avg_unit_price, s AS p_std_unit_price, lo AS p_min_unit_price,
  hi AS p_max_unit_price, unit_price::DOUBLE / standard_cost::DOUBLE AS p_price_to_standard_ratio, c AS p_contract_price
  FROM po_line_item l JOIN (SELECT material_id, sum(unit_price)::DOUBLE / count(*) AS a, coalesce(stddev_samp(unit_price::DOUBLE), 0) AS s,
    min(unit_price) AS lo, max(unit_price) AS hi FROM po_line_item GROUP BY 1) k ON k.material_id = l.material_id
  LEFT JOIN material_master m ON m.material_id = l.material_id
  LEFT JOIN (SELECT material_id, min(agreed_price) AS c FROM contract_item GROUP BY 1) q ON q.material_id = l.material_id)"""


def months(later, earlier):
    """Whole months plus days over 31; the two dates here are never both month ends."""
    return (f"round((year({later}) - year({earlier})) * 12 + month({later}) - month({earlier}) "
            f"+ CASE WHEN day({later}) = day({earlier}) OR (last_day({later}) = {later} AND last_day({earlier}) = {earlier}) THEN 0 "
            f"ELSE (day({later}) - day({earlier})) / 31.0::DOUBLE END, 8)")


SQL = {
    "f01_vendor_profile": f"WITH {PROFILE} SELECT * FROM vp",
    "f02_vendor_performance": PERF.format(delay=""),
    "f02_vendor_performance_late": PERF.format(delay="FILTER (actual_delivery_date > requested_delivery_date)"),
    "f02b_vendor_po_frequency": f"""SELECT vendor_id, round(n / greatest({months('hi', 'lo')}, 1), 6) AS v_po_frequency_monthly
FROM (SELECT vendor_id, count(*) AS n, min(po_date) AS lo, max(po_date) AS hi FROM po_header GROUP BY 1)""",
    "f03_invoice_behavior": f"""WITH {BEHAVIOR} SELECT bh.*, round(coalesce(v_avg_price_variance_pct, 0), 6) AS v_avg_price_variance_pct
FROM bh LEFT JOIN bl USING (vendor_id)""",
    "f03_invoice_behavior_by_line": f"""SELECT vendor_id, count(*) AS v_invoice_count, {RATE}, avg(payment_block::INT) AS v_payment_block_rate,
  round(avg({PCT}), 6) AS v_avg_price_variance_pct FROM invoice_header JOIN invoice_line_item USING (invoice_id) GROUP BY 1""",
    "f03b_invoice_to_payment_days": """SELECT i.vendor_id, avg(payment_date - invoice_date) AS v_avg_invoice_to_payment_days
FROM payment JOIN payment_invoice_link USING (payment_id) JOIN invoice_header i USING (invoice_id) GROUP BY 1""",
    "f04_invoice_behavior_loo": f"""WITH {BEHAVIOR}, {LOO} SELECT invoice_id, round(v_invoice_match_rate_loo, 6) AS v_invoice_match_rate_loo,
  round(v_price_variance_rate_loo, 6) AS v_price_variance_rate_loo, round(v_qty_variance_rate_loo, 6) AS v_qty_variance_rate_loo,
  round(v_avg_price_variance_pct_loo, 6) AS v_avg_price_variance_pct_loo FROM loo""",
    "f05_price_benchmarks": f"WITH {BENCH} SELECT * REPLACE (round(p_std_unit_price, 4) AS p_std_unit_price) FROM pb",
    "f05b_price_trend": """WITH l AS (SELECT material_id, vendor_id, po_date, unit_price FROM po_line_item JOIN po_header USING (po_id)),
g AS (SELECT material_id, vendor_id, sum(unit_price)::DOUBLE / count(*) AS a, coalesce(stddev_samp(unit_price::DOUBLE), 0) AS s,
    CASE WHEN count(DISTINCT po_date) > 1 THEN (count(*)::DOUBLE * sum((po_date - DATE '2001-06-30') * (unit_price * 100)::BIGINT)::DOUBLE
      - sum(po_date - DATE '2001-06-30')::DOUBLE * sum((unit_price * 100)::BIGINT)::DOUBLE) / (count(*)::DOUBLE * sum((po_date - DATE '2001-06-30')
      * (po_date - DATE '2001-06-30'))::DOUBLE - sum(po_date - DATE '2001-06-30')::DOUBLE * sum(po_date - DATE '2001-06-30')::DOUBLE) / 100 END AS k,
    min(unit_price) FILTER (po_date BETWEEN DATE '2001-05-31' AND DATE '2001-06-30') AS lo,
    max(unit_price) FILTER (po_date BETWEEN DATE '2001-05-31' AND DATE '2001-06-30') AS hi FROM l GROUP BY 1, 2),
c AS (SELECT vendor_id, material_id, min(agreed_price) AS p FROM contract_item JOIN contract_header USING (contract_id) GROUP BY 1, 2)
SELECT g.material_id, g.vendor_id, a AS p_avg_unit_price, round(s, 4) AS p_std_unit_price, a / standard_cost::DOUBLE AS p_price_to_standard_ratio,
  p AS p_contract_price, a / p::DOUBLE AS p_price_vs_contract, k AS p_price_trend_slope, lo AS p_min_price_30d, hi AS p_max_price_30d
FROM g JOIN material_master m ON m.material_id = g.material_id LEFT JOIN c ON c.vendor_id = g.vendor_id AND c.material_id = g.material_id""",
    "f06_material_risk": """WITH n AS (SELECT material_id, plant_id, count(DISTINCT vendor_id) AS n FROM source_list GROUP BY 1, 2),
s AS (SELECT material_id, max(n) AS hi, min(n) AS lo FROM n GROUP BY 1)
SELECT m.material_id, CASE criticality WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE -1 END AS m_criticality_ordinal,
  (material_type = 'COMPONENT')::INT AS m_type_component, (material_type = 'RAW')::INT AS m_type_raw, (material_type = 'ASSEMBLY')::INT AS m_type_assembly,
  (material_type = 'MRO')::INT AS m_type_mro, (material_type = 'SERVICE')::INT AS m_type_service, standard_cost AS m_standard_cost,
  round(ln(1 + standard_cost::DOUBLE), 6) AS m_standard_cost_log, coalesce(hi, 0) AS m_source_count, coalesce(lo, 0) AS m_min_source_count,
  (m.material_id IN (SELECT material_id FROM contract_item JOIN contract_header USING (contract_id) WHERE status = 'ACTIVE'))::INT AS m_contract_covered,
  hazmat_flag::INT AS m_hazmat, default_lead_time_days AS m_lead_time_days,
  CASE confidentiality_tier WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'RESTRICTED' THEN 2 ELSE -1 END AS m_confidentiality_ordinal,
  (make_or_buy = 'BUY')::INT AS m_make_or_buy
FROM material_master m LEFT JOIN s ON s.material_id = m.material_id""",
    "f07_contract_status": f"""WITH c AS (SELECT *, least(DATE '2001-06-30', valid_to) AS e,
  CASE contract_type WHEN 'QUANTITY' THEN consumed_quantity::DOUBLE / max_quantity ELSE consumed_value::DOUBLE / target_value::DOUBLE END AS pct
  FROM contract_item JOIN contract_header USING (contract_id))
SELECT contract_id, item_number, CAST(valid_to - DATE '2001-06-30' AS INTEGER) AS c_days_to_expiry, (status = 'ACTIVE')::INT AS c_is_active,
  pct AS c_consumption_pct, max_quantity - consumed_quantity AS c_remaining_quantity,
  CAST(target_value - consumed_value AS DECIMAL(14,2)) AS c_remaining_value, round({months('e', 'valid_from')}, 7) AS c_months_active,
  round(pct / {months('e', 'valid_from')}, 7) AS c_consumption_rate_monthly FROM c""",
    "f08_category_spend": """WITH l AS (SELECT m.category_id, h.po_id, h.vendor_id, l.material_id, net_value, maverick_flag FROM po_line_item l
  JOIN material_master m ON m.material_id = l.material_id JOIN po_header h ON h.po_id = l.po_id)
SELECT category_id, CAST(sum(net_value) AS DECIMAL(18,2)) AS cat_total_spend, sum(net_value)::DOUBLE / count(*) AS cat_avg_po_value,
  count(DISTINCT vendor_id) AS cat_vendor_count, count(DISTINCT material_id) AS cat_material_count,
  count(DISTINCT po_id) FILTER (maverick_flag) / count(DISTINCT po_id) AS cat_maverick_rate, any_value(level) AS cat_hierarchy_level,
  any_value(parent_category_id) AS cat_parent_id FROM l LEFT JOIN category_hierarchy c USING (category_id) GROUP BY category_id""",
    "f09_pair_performance": """WITH g AS (SELECT vendor_id, material_id, sum(quantity_rejected)::DOUBLE / sum(quantity_received)::DOUBLE AS r
  FROM gr_line_item JOIN po_header USING (po_id) GROUP BY 1, 2)
SELECT h.vendor_id, l.material_id, count(*) AS vm_order_count, sum(quantity)::DOUBLE / count(*) AS vm_avg_qty_per_order,
  avg(actual_delivery_date - requested_delivery_date) AS vm_avg_delivery_delay,
  round(stddev_samp(unit_price::DOUBLE) / avg(unit_price::DOUBLE), 6) AS vm_price_stability, max(po_date) AS vm_last_order_date,
  any_value(g.r) AS vm_rejection_rate
FROM po_line_item l JOIN po_header h ON h.po_id = l.po_id LEFT JOIN g ON g.vendor_id = h.vendor_id AND g.material_id = l.material_id
GROUP BY 1, 2""",
    "f10_vendor_geo": """SELECT v.vendor_id, country AS vg_country_code, CASE WHEN country = 'DE' THEN 'EMEA' WHEN country = 'US' THEN 'AMER' ELSE 'APAC' END AS vg_region,
  country_of_incorporation AS vg_incorporation_country, (country <> country_of_incorporation)::INT AS vg_cross_border,
  n AS vg_address_count, (k > 1)::INT AS vg_multi_country, alias_group AS vg_alias_group
FROM vendor_master v JOIN legal_entity USING (legal_entity_id)
JOIN (SELECT vendor_id, count(*) AS n, count(DISTINCT country) AS k FROM vendor_address GROUP BY 1) USING (vendor_id)""",
    "f11_vendor_scores": """SELECT vendor_id, quality_score AS uc02_vendor_quality_score, risk_score AS uc02_vendor_risk_score,
  on_time_delivery_rate AS uc02_vendor_otd_rate, esg_score AS uc02_vendor_esg_score FROM vendor_master""",
}
