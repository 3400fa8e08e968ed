"""DuckDB twins of the use cases."""

from buylens.usecases.invoice_match import FEATURES
from oracle.features import BEHAVIOR, LOO, PERF, PROFILE, months
from oracle.validation import TIERS

FX = """(CASE currency WHEN 'EUR' THEN 1.08 WHEN 'JPY' THEN 0.0067 WHEN 'SGD' THEN 0.74 WHEN 'KRW' THEN 0.00075 WHEN 'THB' THEN 0.028
  WHEN 'CNY' THEN 0.14 WHEN 'VND' THEN 0.000041 WHEN 'GBP' THEN 1.27 WHEN 'CHF' THEN 1.13 ELSE 1.0 END)::DOUBLE"""

BASE = """base AS (SELECT il.invoice_id, il.invoice_line_number, il.po_id, il.po_line_number, il.material_id, il.gr_id, il.gr_line_number,
  ih.invoice_date, ih.received_date, ih.vendor_id, ih.currency, ih.payment_due_date, ih.match_status, ph.po_date, ph.po_type, ph.incoterms,
  ph.payment_terms, ph.total_net_value AS po_total_net_value, ph.maverick_flag, pl.quantity AS po_quantity, pl.unit_price AS po_unit_price,
  pl.requested_delivery_date, pl.actual_delivery_date, pl.contract_id, pl.contract_item_number, gh.gr_date, gh.status AS gr_status,
  gl.quantity_received, gl.quantity_accepted, gl.quantity_rejected, gl.rejection_reason, mm.material_type, mm.category_id, mm.standard_cost,
  mm.criticality, mm.hazmat_flag, mm.default_lead_time_days, mm.make_or_buy, mm.confidentiality_tier AS material_confidentiality, ch.contract_type,
  ch.valid_from AS contract_valid_from, ch.valid_to AS contract_valid_to, ci.agreed_price AS contract_agreed_price
  FROM invoice_header ih JOIN invoice_line_item il ON ih.invoice_id = il.invoice_id JOIN po_header ph ON ih.po_id = ph.po_id
  JOIN po_line_item pl ON il.po_id = pl.po_id AND il.po_line_number = pl.po_line_number LEFT JOIN gr_header gh ON il.gr_id = gh.gr_id
  LEFT JOIN gr_line_item gl ON il.gr_id = gl.gr_id AND il.gr_line_number = gl.gr_line_number
  LEFT JOIN material_master mm ON il.material_id = mm.material_id LEFT JOIN contract_header ch ON pl.contract_id = ch.contract_id
  LEFT JOIN contract_item ci ON pl.contract_id = ci.contract_id AND pl.contract_item_number = ci.item_number)"""

TEMPORAL = {
    "invoice_month": "CAST(month(invoice_date) AS INTEGER)", "invoice_quarter": "CAST(quarter(invoice_date) AS INTEGER)",
    "days_po_to_invoice": "CAST(invoice_date - po_date AS INTEGER)", "days_gr_to_invoice": "CAST(invoice_date - gr_date AS INTEGER)",
}
SPECIFIC = {
    "uc02_is_contract_po": "(contract_id IS NOT NULL)::INT", "uc02_gr_qty_vs_po_qty": "quantity_received::DOUBLE / po_quantity::DOUBLE",
    "uc02_gr_has_rejection": "(quantity_rejected > 0)::INT", "uc02_days_gr_to_invoice": "CAST(invoice_date - gr_date AS INTEGER)",
    "uc02_is_maverick_po": "maverick_flag::INT", "uc02_po_type_rush": "(po_type = 'RUSH')::INT",
    "uc02_price_vs_standard": "po_unit_price::DOUBLE / standard_cost::DOUBLE",
    "uc02_delivery_delay_days": "CAST(actual_delivery_date - requested_delivery_date AS INTEGER)",
    "uc02_material_criticality": "CASE criticality WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE -1 END",
    "uc02_gr_status_quality_hold": "(gr_status = 'QUALITY_HOLD')::INT", "uc02_amount_usd": f"po_total_net_value::DOUBLE * {FX}",
    "uc02_hazmat_flag": "hazmat_flag::INT",
    "uc02_confidentiality": "CASE material_confidentiality WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'RESTRICTED' THEN 2 ELSE -1 END",
}
CLASS = "list_position(['FULL_MATCH', 'PRICE_VARIANCE', 'QUANTITY_VARIANCE', 'BOTH_VARIANCE'], match_status) - 1"


def cols(spec):
    return ", ".join(f"{e} AS {n}" for n, e in spec.items())


BASE_NUMBERS = ["po_total_net_value", "po_quantity", "po_unit_price", "quantity_received", "quantity_accepted", "quantity_rejected",
                "standard_cost", "default_lead_time_days", "contract_agreed_price"]
PROFILE_NAMES = ["v_type_oem", "v_type_distributor", "v_type_contract_mfg", "v_type_logistics", "v_type_service", "v_preferred", "v_status_encoded",
                 "v_country_risk", "v_payment_terms_days", "v_has_early_discount", "v_confidentiality_ordinal", "v_category_count"]
PERF_NAMES = ["v_total_po_count", "v_total_po_value", "v_avg_po_value", "v_on_time_delivery_actual", "v_avg_delivery_delay_days", "v_rejection_rate",
              "v_distinct_materials"]
RATES = ["v_invoice_match_rate_loo", "v_price_variance_rate_loo", "v_qty_variance_rate_loo", "v_avg_price_variance_pct_loo"]
SCORES = {"uc02_vendor_quality_score": "quality_score", "uc02_vendor_risk_score": "risk_score", "uc02_vendor_otd_rate": "on_time_delivery_rate",
          "uc02_vendor_esg_score": "esg_score"}
PRICE_NAMES = ["p_avg_unit_price", "p_std_unit_price", "p_min_unit_price", "p_max_unit_price", "p_price_to_standard_ratio", "p_contract_price"]


def table(rates, label="(match_status <> 'FULL_MATCH')::INT::DOUBLE"):
    """The full matrix; ``rates`` is a CTE named rt with one row per invoice."""
    perf = PERF.format(delay="").strip()
    names = BASE_NUMBERS + list(TEMPORAL) + PROFILE_NAMES + PERF_NAMES + RATES + PRICE_NAMES + list(SPECIFIC) + list(SCORES) + ["uc02_vendor_invoice_seq"]
    outs = []
    for n in names:
        value = f"coalesce({n}::DOUBLE, 0)"
        outs.append(f"round({value}, 4) AS {n}" if n in RATES + ["p_std_unit_price"] else f"{value} AS {n}")
    return f"""WITH {BASE}, {PROFILE}, vh AS ({perf}), {BEHAVIOR}, {rates},
ps AS (SELECT material_id, sum(unit_price)::DOUBLE / count(*) AS p_avg_unit_price, coalesce(stddev_samp(unit_price::DOUBLE), 0) AS p_std_unit_price,
  min(unit_price) AS p_min_unit_price, max(unit_price) AS p_max_unit_price FROM po_line_item GROUP BY 1),
pc AS (SELECT material_id, min(agreed_price) AS p_contract_price FROM contract_item GROUP BY 1),
vs AS (SELECT vendor_id, {', '.join(f'{c} AS {n}' for n, c in SCORES.items())} FROM vendor_master),
w AS (SELECT base.*, {cols(TEMPORAL)}, {cols(SPECIFIC)}, vp.* EXCLUDE (vendor_id), vh.* EXCLUDE (vendor_id), rt.* EXCLUDE (invoice_id),
  ps.* EXCLUDE (material_id), pc.p_contract_price, vs.* EXCLUDE (vendor_id), po_unit_price::DOUBLE / standard_cost::DOUBLE AS p_price_to_standard_ratio,
  row_number() OVER (PARTITION BY base.vendor_id ORDER BY invoice_date, base.invoice_id, invoice_line_number) AS uc02_vendor_invoice_seq
  FROM base LEFT JOIN vp ON vp.vendor_id = base.vendor_id LEFT JOIN vh ON vh.vendor_id = base.vendor_id LEFT JOIN rt ON rt.invoice_id = base.invoice_id
  LEFT JOIN ps ON ps.material_id = base.material_id LEFT JOIN pc ON pc.material_id = base.material_id LEFT JOIN vs ON vs.vendor_id = base.vendor_id)
SELECT invoice_id, invoice_line_number, invoice_date, {', '.join(outs)}, {label} AS label FROM w"""


SERVE_RATES = """rt AS (SELECT invoice_id, v_invoice_match_rate AS v_invoice_match_rate_loo, v_price_variance_rate AS v_price_variance_rate_loo,
  v_qty_variance_rate AS v_qty_variance_rate_loo, coalesce(v_avg_price_variance_pct, 0) AS v_avg_price_variance_pct_loo
  FROM invoice_header JOIN bh USING (vendor_id) LEFT JOIN bl USING (vendor_id))"""
LEAK = list(SPECIFIC) + PROFILE_NAMES + list(SCORES)

LINE = """l AS (SELECT pl.*, h.po_date, h.vendor_id, h.plant_id, h.po_type, h.notes, m.standard_cost, m.default_lead_time_days
  FROM po_line_item pl JOIN po_header h ON h.po_id = pl.po_id JOIN material_master m ON m.material_id = pl.material_id)"""

ZSCORE = f"""{LINE}, g AS (SELECT material_id, avg(unit_price::DOUBLE) AS a, stddev_samp(unit_price::DOUBLE) AS s,
    sum(unit_price * quantity)::DOUBLE / sum(quantity)::DOUBLE AS qw FROM l GROUP BY 1),
vv AS (SELECT vendor_id, avg(unit_price::DOUBLE / standard_cost::DOUBLE) AS p FROM l GROUP BY 1),
z AS (SELECT l.po_id, l.po_line_number, l.material_id, l.vendor_id, CASE WHEN s > 1e-9 THEN (unit_price::DOUBLE - a) / s END AS z,
  unit_price::DOUBLE / lag(unit_price) OVER (PARTITION BY l.material_id ORDER BY po_date, po_id, po_line_number)::DOUBLE AS lastp,
  unit_price::DOUBLE / agreed_price::DOUBLE AS vc, (l.contract_id IS NULL)::INT AS oc, p, qw
  FROM l JOIN g ON g.material_id = l.material_id JOIN vv ON vv.vendor_id = l.vendor_id
  LEFT JOIN contract_item ci ON ci.contract_id = l.contract_id AND ci.item_number = l.contract_item_number)"""

MAVERICK = f"""{LINE}, mv AS (SELECT l.po_id, l.po_line_number, (s.vendor_id IS NOT NULL)::INT AS uc01_has_source_list_entry,
  coalesce(preferred_rank, 999) AS uc01_source_list_rank, (unit_price - standard_cost)::DOUBLE / standard_cost::DOUBLE AS uc01_price_premium_pct,
  coalesce((approval_status = 'APPROVED')::INT, 0) AS uc01_vendor_is_approved, (po_type = 'RUSH')::INT AS uc01_po_type_rush,
  coalesce((notes ILIKE '%maverick%' OR notes ILIKE '%non-preferred%')::INT, 0) AS uc01_notes_contains_maverick,
  (contract_id IS NULL)::INT AS off_contract, unit_price::DOUBLE / standard_cost::DOUBLE AS price_ratio
  FROM l LEFT JOIN source_list s ON s.material_id = l.material_id AND s.plant_id = l.plant_id AND s.vendor_id = l.vendor_id)"""

SPEND = """sp AS (SELECT material_id, vendor_id, country, legal_entity_id, category_id, net_value FROM po_line_item JOIN po_header h USING (po_id)
  JOIN vendor_master v USING (vendor_id) JOIN material_master m USING (material_id))"""


def hhi(per, holder):
    return f"""(SELECT {per}, sum(s) AS total, count(*) AS holders, round(sum((s::DOUBLE / t) * (s::DOUBLE / t)), 6) AS hhi,
  max(s)::DOUBLE / sum(s)::DOUBLE AS top1 FROM (SELECT {per}, {holder}, sum(net_value) AS s, (sum(sum(net_value)) OVER (PARTITION BY {per}))::DOUBLE AS t
  FROM sp GROUP BY {per}, {holder}) GROUP BY {per})"""


UC08 = f"""{SPEND}, dp AS (SELECT material_id, min(n) AS d FROM (SELECT material_id, plant_id, count(*) AS n FROM source_list GROUP BY 1, 2) GROUP BY 1),
u8 AS (SELECT a.material_id, m.category_id, a.hhi AS uc08_hhi_by_material, a.top1 AS uc08_top1_vendor_share, b.hhi AS uc08_hhi_by_legal_entity,
  c.hhi AS uc08_geographic_hhi, e.hhi AS uc08_hhi_by_category, criticality AS uc08_material_criticality, d AS uc08_source_list_depth
  FROM {hhi('material_id', 'vendor_id')} a JOIN {hhi('material_id', 'legal_entity_id')} b ON a.material_id = b.material_id
  JOIN {hhi('material_id', 'country')} c ON a.material_id = c.material_id JOIN material_master m ON m.material_id = a.material_id
  JOIN {hhi('category_id', 'vendor_id')} e ON e.category_id = m.category_id LEFT JOIN dp ON dp.material_id = a.material_id)"""

UC10 = """u10 AS (SELECT pr_id, pr_line_number, priority, pr_type, list_position(['BLANKET', 'STANDARD', 'URGENT'], pr_type) - 1 AS uc10_pr_type_encoded,
  CAST(requested_delivery_date - pr_date AS INTEGER) - default_lead_time_days AS uc10_lead_time_gap,
  list_position(['LOW', 'MEDIUM', 'HIGH'], criticality) - 1 AS uc10_material_criticality,
  CAST(estimated_price * quantity AS DECIMAL(16,2)) AS uc10_estimated_value, requester_department AS uc10_department,
  ((l.material_id, h.plant_id) IN (SELECT (p.material_id, q.plant_id) FROM po_line_item p JOIN po_header q USING (po_id) WHERE p.gr_status = 'OPEN'))::INT
    AS uc10_open_po_exists
  FROM pr_line_item l JOIN pr_header h USING (pr_id) JOIN material_master m ON m.material_id = l.material_id),
r10 AS (SELECT *, 2 * uc10_material_criticality + 2 * uc10_pr_type_encoded + 2 * (uc10_lead_time_gap < 0)::INT - uc10_open_po_exists AS s FROM u10),
p10 AS (SELECT pr_id, pr_line_number, CAST(s AS INTEGER) AS priority_score, CASE WHEN uc10_material_criticality = 2 AND pr_type = 'URGENT' THEN 'CRITICAL'
  WHEN s >= 5 THEN 'HIGH' WHEN s >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS rule_priority FROM r10)"""

UC06 = f"""ci AS (SELECT contract_id, vendor_id, valid_from, valid_to, status, material_id,
  CASE contract_type WHEN 'QUANTITY' THEN consumed_quantity::DOUBLE / max_quantity ELSE consumed_value::DOUBLE / target_value::DOUBLE END AS pct,
  least(DATE '2001-06-30', valid_to) AS e FROM contract_item JOIN contract_header USING (contract_id)),
sv AS (SELECT material_id, count(DISTINCT vendor_id) AS n FROM source_list GROUP BY 1),
vh AS ({PERF.format(delay='').strip()}),
mr AS (SELECT vendor_id, avg((match_status = 'FULL_MATCH')::INT) AS r FROM invoice_header GROUP BY 1),
g AS (SELECT contract_id, ci.vendor_id, any_value(valid_from) AS vf, any_value(e) AS e, avg(pct) AS pct, max(list_position(['LOW', 'MEDIUM', 'HIGH'], criticality)) - 1 AS crit,
  greatest(min(coalesce(n, 0)) - 1, 0) AS alt, any_value({months('e', 'valid_from')}) AS mo
  FROM ci JOIN material_master m ON m.material_id = ci.material_id LEFT JOIN sv ON sv.material_id = ci.material_id GROUP BY 1, 2),
u6 AS (SELECT ch.contract_id, ch.vendor_id, CAST(ch.valid_to - DATE '2001-06-30' AS INTEGER) AS uc06_days_to_expiry, (ch.status = 'ACTIVE')::INT AS c_is_active, pct AS c_consumption_pct, pct / mo AS uc06_consumption_velocity,
  vf + CAST(floor((e - vf) / pct) AS INTEGER) AS uc06_estimated_exhaust_date, crit AS uc06_material_criticality_max, alt AS uc06_alternative_vendor_count,
  (coalesce(v_on_time_delivery_actual, 0.5) * 100 + quality_score + coalesce(r, 0) * 100) / 3 AS uc06_vendor_performance_score
  FROM contract_header ch LEFT JOIN g ON g.contract_id = ch.contract_id LEFT JOIN vendor_master v ON v.vendor_id = ch.vendor_id
  LEFT JOIN vh ON vh.vendor_id = ch.vendor_id LEFT JOIN mr ON mr.vendor_id = ch.vendor_id)"""

PLAN = """pp AS (SELECT i.invoice_id, i.vendor_id, total_net_amount,
  CASE payment_terms WHEN '2/10NET30' THEN invoice_date + 10 ELSE payment_due_date END AS plan_date,
  CAST(CASE payment_terms WHEN '2/10NET30' THEN round(total_net_amount * 0.02, 2) ELSE 0 END AS DECIMAL(12,2)) AS discount,
  CAST(CASE payment_terms WHEN '2/10NET30' THEN payment_due_date - invoice_date - 10 ELSE 0 END AS INTEGER) AS days_advanced,
  CASE WHEN d - payment_due_date < -3 THEN 'EARLY' WHEN d - payment_due_date <= 3 THEN 'ON_TIME' WHEN d IS NOT NULL THEN 'LATE' END AS paid_class
  FROM invoice_header i JOIN vendor_master v ON v.vendor_id = i.vendor_id LEFT JOIN (SELECT invoice_id, min(payment_date) AS d
    FROM payment JOIN payment_invoice_link USING (payment_id) WHERE payment.status = 'EXECUTED' GROUP BY 1) p ON p.invoice_id = i.invoice_id
  WHERE NOT payment_block)"""

MAD = """k AS (SELECT material_id, median(unit_price::DOUBLE) AS m FROM po_line_item GROUP BY 1),
d AS (SELECT po_id, po_line_number, l.material_id, unit_price, abs(unit_price::DOUBLE - m) AS d FROM po_line_item l JOIN k ON k.material_id = l.material_id),
q AS (SELECT material_id, median(d) AS mad FROM d GROUP BY 1)"""


def lag_links(source, keys, days):
    part = f"PARTITION BY {keys} ORDER BY invoice_date, invoice_id"
    return f"""SELECT f AS first_invoice_id, invoice_id, CAST(invoice_date - d AS INTEGER) AS date_gap_days FROM (
  SELECT invoice_id, invoice_date, lag(invoice_id) OVER ({part}) AS f, lag(invoice_date) OVER ({part}) AS d FROM {source}) WHERE invoice_date - d <= {days}"""


def quarter(metric_sql, extra=""):
    keys = "vendor_id" + (f", {extra}" if extra else "")
    return f"""SELECT *, lag(value) OVER (PARTITION BY {keys} ORDER BY quarter) AS previous_value,
  value - lag(value) OVER (PARTITION BY {keys} ORDER BY quarter) AS change FROM ({metric_sql})"""


GRQ = """SELECT h.vendor_id, CAST(date_trunc('quarter', gr_date) AS DATE) AS quarter, rejection_reason, quantity_received, quantity_rejected
  FROM gr_line_item g JOIN gr_header gh ON gh.gr_id = g.gr_id JOIN po_header h ON h.po_id = g.po_id"""

SQL = {
    "u201_uc02_base": f"WITH {BASE} SELECT * FROM base",
    "u202_temporal_features": f"WITH {BASE} SELECT invoice_id, invoice_line_number, {cols(TEMPORAL)} FROM base",
    "u203_uc02_features": f"WITH {BASE} SELECT invoice_id, invoice_line_number, {cols(SPECIFIC)} FROM base",
    "u204_vendor_invoice_seq": """SELECT invoice_id, invoice_line_number, vendor_id,
  row_number() OVER (PARTITION BY vendor_id ORDER BY invoice_date, invoice_id, invoice_line_number) AS uc02_vendor_invoice_seq
FROM invoice_line_item JOIN invoice_header USING (invoice_id)""",
    "u205_invoice_amount_ratio": """SELECT invoice_id, total_gross_amount::DOUBLE / total_net_value::DOUBLE AS uc02_invoice_amount_vs_po
FROM invoice_header JOIN po_header USING (po_id)""",
    "u206_match_labels": f"""SELECT invoice_id, invoice_line_number, (match_status <> 'FULL_MATCH')::INT AS target_binary,
  CAST({CLASS} AS INTEGER) AS target_multiclass FROM invoice_line_item JOIN invoice_header USING (invoice_id)""",
    "u207_uc02_table_train": table(f"{LOO}, rt AS (SELECT * FROM loo)"),
    "u207_uc02_table_serve": table(SERVE_RATES),
    "u208_feature_matrix_class": f"WITH {BASE} SELECT invoice_id, invoice_line_number, invoice_date, "
        + ", ".join(f"coalesce(({e})::DOUBLE, 0) AS {n}" for n, e in {**SPECIFIC, **TEMPORAL}.items()) + f", ({CLASS})::DOUBLE AS label FROM base",
    "u208_feature_vector": f"WITH {BASE} SELECT invoice_id, invoice_line_number, ["
        + ", ".join(f"coalesce(({e})::DOUBLE, 0)" for e in {**SPECIFIC, **TEMPORAL}.values()) + f"] AS features, ({CLASS})::DOUBLE AS label FROM base",
    "u209_missing_flag": f"WITH {BASE} SELECT invoice_id, invoice_line_number, (contract_agreed_price IS NOT NULL)::INT AS has_contract_agreed_price FROM base",
    "u210_leakage_report": f"""WITH {BASE}, {PROFILE}, x AS (SELECT {', '.join(f'coalesce(({e})::DOUBLE, 0) AS {n}' for n, e in SPECIFIC.items())},
  vp.* EXCLUDE (vendor_id), {', '.join(f'coalesce(v.{c}::DOUBLE, 0) AS {n}' for n, c in SCORES.items())}, (match_status <> 'FULL_MATCH')::INT::DOUBLE AS label
  FROM base JOIN vp ON vp.vendor_id = base.vendor_id
  JOIN (SELECT vendor_id, quality_score, risk_score, on_time_delivery_rate, esg_score FROM vendor_master) v ON v.vendor_id = base.vendor_id)
""" + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(abs(CASE WHEN min({n}) < max({n}) THEN corr({n}::DOUBLE, label) END), 6) AS abs_corr, "
                         f"coalesce(abs(CASE WHEN min({n}) < max({n}) THEN corr({n}::DOUBLE, label) END) > 0.9, false) AS leaks FROM x" for n in LEAK),
    "u211_drop_leakage": """SELECT h.invoice_id, vendor_invoice_number, invoice_date, received_date, vendor_id, h.po_id, currency, match_status, payment_due_date,
  invoice_line_number, po_line_number, material_id, gr_id, gr_line_number FROM invoice_header h JOIN invoice_line_item l ON l.invoice_id = h.invoice_id""",
    "u101_uc01_features": f"WITH {MAVERICK} SELECT * FROM mv",
    "u102_maverick_rule": f"""WITH {MAVERICK}, s AS (SELECT po_id, po_line_number, (price_ratio > 1.15)::INT + off_contract + 1 - uc01_vendor_is_approved AS n FROM mv)
SELECT po_id, po_line_number, n AS maverick_score, n >= 2 AS flagged FROM s""",
    "u301_uc03_features": """SELECT vendor_id, quality_score AS uc03_quality_score_raw, on_time_delivery_rate AS uc03_otd_rate_raw,
  coalesce(esg_score::DOUBLE, (SELECT quantile_cont(esg_score::DOUBLE, 0.5) FROM vendor_master)) AS uc03_esg_score, (esg_score IS NULL)::INT AS uc03_esg_missing,
  (SELECT count(*) FROM contract_header c WHERE c.vendor_id = v.vendor_id AND c.status = 'ACTIVE') AS uc03_active_contract_count,
  CAST(coalesce((SELECT max(list_position(['LOW', 'MEDIUM', 'HIGH'], criticality)) - 1 FROM source_list s JOIN material_master USING (material_id)
    WHERE s.vendor_id = v.vendor_id), -1) AS INTEGER) AS uc03_material_criticality_max,
  CASE WHEN alias_group IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY alias_group) END AS uc03_alias_vendor_count FROM vendor_master v""",
    "u302_derived_risk": f"""WITH vh AS ({PERF.format(delay='').strip()}),
mm AS (SELECT vendor_id, avg((match_status <> 'FULL_MATCH')::INT) AS x FROM invoice_header GROUP BY 1),
s AS (SELECT v.vendor_id, 0.25 * (100 - coalesce(v_on_time_delivery_actual, 0.5) * 100) + 0.25 * (100 - quality_score)
  + 0.25 * coalesce(v_rejection_rate, 0) * 100 + 0.25 * coalesce(x, 0) * 100 AS r FROM vendor_master v
  LEFT JOIN vh ON vh.vendor_id = v.vendor_id LEFT JOIN mm ON mm.vendor_id = v.vendor_id)
SELECT vendor_id, round(r, 6) AS risk_derived, CASE WHEN r < 20 THEN 'LOW' WHEN r < 35 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier FROM s""",
    "u401_uc04_features": f"""WITH {ZSCORE} SELECT po_id, po_line_number, material_id, vendor_id, round(z, 4) AS uc04_price_zscore, lastp AS uc04_price_vs_last_po,
  vc AS uc04_price_vs_contract, oc AS uc04_is_off_contract, round(p, 4) AS uc04_vendor_avg_premium, qw AS uc04_qty_weighted_price FROM z""",
    "u402_price_anomalies": f"WITH {ZSCORE} SELECT po_id, po_line_number, material_id FROM z WHERE abs(z) > 2",
    "u402_price_anomalies_top": f"WITH {ZSCORE} SELECT po_id, po_line_number FROM z WHERE abs(z) > 2 ORDER BY abs(z) DESC, po_id, po_line_number LIMIT 50",
    "u403_price_outliers_mad": f"""WITH {MAD} SELECT po_id, po_line_number, d.material_id, unit_price FROM d JOIN q ON q.material_id = d.material_id
WHERE mad > 0 AND d.d * 0.6745 / mad > 3.5""",
    "u403_price_outliers_iqr": """WITH q AS (SELECT material_id, quantile_cont(unit_price::DOUBLE, 0.25) AS a, quantile_cont(unit_price::DOUBLE, 0.75) AS b
  FROM po_line_item GROUP BY 1)
SELECT po_id, po_line_number, l.material_id, unit_price FROM po_line_item l JOIN q ON q.material_id = l.material_id
WHERE unit_price::DOUBLE < a - 1.5 * (b - a) OR unit_price::DOUBLE > b + 1.5 * (b - a)""",
    "u501_uc05_features": f"""WITH {LINE}, c AS (SELECT po_id, vendor_id, any_value(po_date) AS po_date,
    CASE WHEN bool_and(actual_delivery_date IS NOT NULL) THEN max(actual_delivery_date) ELSE DATE '9999-12-31' END AS closed FROM l GROUP BY 1, 2),
load AS (SELECT a.vendor_id, a.po_date, count(b.po_id) AS n FROM (SELECT DISTINCT vendor_id, po_date FROM c) a
  LEFT JOIN c b ON b.vendor_id = a.vendor_id AND b.po_date <= a.po_date AND b.closed > a.po_date GROUP BY 1, 2),
av AS (SELECT vendor_id, material_id, sum(quantity)::DOUBLE / count(*) AS q FROM l GROUP BY 1, 2)
SELECT po_id, po_line_number, lane_lead_time_days::DOUBLE / l.default_lead_time_days AS uc05_lead_time_ratio, quantity::DOUBLE / q AS uc05_order_qty_vs_avg,
  on_time_delivery_rate AS uc05_vendor_otd_rate, (po_type = 'RUSH')::INT AS uc05_is_rush_order, CAST(month(l.po_date) AS INTEGER) AS uc05_month_of_order,
  n AS uc05_vendor_current_load
FROM l JOIN av ON av.vendor_id = l.vendor_id AND av.material_id = l.material_id
LEFT JOIN source_list s ON s.material_id = l.material_id AND s.plant_id = l.plant_id AND s.vendor_id = l.vendor_id
JOIN vendor_master v ON v.vendor_id = l.vendor_id JOIN load ON load.vendor_id = l.vendor_id AND load.po_date = l.po_date""",
    "u502_late_label": """SELECT po_id, po_line_number, (actual_delivery_date > requested_delivery_date)::INT AS is_late FROM po_line_item
WHERE actual_delivery_date IS NOT NULL""",
    "u601_uc06_features": f"""WITH {UC06} SELECT contract_id, vendor_id, uc06_days_to_expiry, c_is_active, round(c_consumption_pct, 6) AS c_consumption_pct,
  round(uc06_consumption_velocity, 6) AS uc06_consumption_velocity, uc06_estimated_exhaust_date, CAST(uc06_material_criticality_max AS INTEGER) AS uc06_material_criticality_max,
  uc06_alternative_vendor_count, round(uc06_vendor_performance_score, 6) AS uc06_vendor_performance_score FROM u6""",
    "u602_renewal_rule": f"""WITH {UC06} SELECT contract_id, uc06_days_to_expiry <= 90 AND c_consumption_pct > 0.4 AS needs_renewal,
  uc06_days_to_expiry <= 60 AND c_consumption_pct > 0.4 AS urgent FROM u6""",
    "u602_renewal_rule_70": f"""WITH {UC06} SELECT contract_id, uc06_days_to_expiry <= 90 AND c_consumption_pct > 0.7 AS needs_renewal,
  uc06_days_to_expiry <= 60 AND c_consumption_pct > 0.7 AS urgent FROM u6""",
    "u701_uc07_features": """WITH c AS (SELECT vendor_id, count(*) AS n FROM contract_header WHERE status = 'ACTIVE' GROUP BY 1)
SELECT invoice_id, (payment_terms = '2/10NET30')::INT AS uc07_has_early_discount, CASE payment_terms WHEN '2/10NET30' THEN 2 ELSE 0 END AS uc07_discount_pct,
  CAST(CASE payment_terms WHEN '2/10NET30' THEN 10 ELSE 0 END - (DATE '2001-06-30' - invoice_date) AS INTEGER) AS uc07_discount_window_remaining,
  total_net_amount AS uc07_invoice_amount, round(preferred_flag::INT * 40 + least(coalesce(n, 0), 3) * 10 + quality_score * 0.3::DOUBLE, 6) AS uc07_vendor_strategic_score,
  payment_block::INT AS uc07_payment_block FROM invoice_header i JOIN vendor_master v ON v.vendor_id = i.vendor_id LEFT JOIN c ON c.vendor_id = v.vendor_id""",
    "u702_payment_plan": f"WITH {PLAN} SELECT * FROM pp",
    "u703_discount_portfolio": f"""WITH {PLAN} SELECT count(*) AS eligible_invoices, CAST(sum(discount) AS DECIMAL(18,2)) AS discount_captured,
  CAST(sum(total_net_amount - discount) AS DECIMAL(18,2)) AS cash_advanced,
  round(sum(discount)::DOUBLE * 365 / sum((total_net_amount - discount) * days_advanced)::DOUBLE, 6) AS annual_return FROM pp WHERE discount > 0""",
    "u801_concentration": f"""WITH {SPEND} SELECT material_id, CAST(total AS DECIMAL(18,2)) AS total_spend, holders, hhi, top1 AS top1_share
FROM {hhi('material_id', 'vendor_id')}""",
    "u801_concentration_by_category": f"""WITH {SPEND} SELECT category_id, CAST(total AS DECIMAL(18,2)) AS total_spend, holders, hhi, top1 AS top1_share
FROM {hhi('category_id', 'legal_entity_id')}""",
    "u801_uc08_features": f"WITH {UC08} SELECT * FROM u8",
    "u802_concentration_tier": f"""WITH {UC08} SELECT material_id, CASE WHEN uc08_hhi_by_material > 0.25 THEN CASE uc08_material_criticality WHEN 'HIGH' THEN 'CRITICAL'
  ELSE 'HIGH' END WHEN uc08_material_criticality = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS concentration_tier FROM u8""",
    "u803_what_if_loss": """WITH x AS (SELECT s.material_id, v.vendor_id, country IN ('CN', 'JP', 'VN', 'TW', 'MY') AS gone FROM source_list s JOIN vendor_master v
  ON v.vendor_id = s.vendor_id)
SELECT material_id, CAST(coalesce((SELECT sum(net_value) FROM po_line_item l JOIN po_header h ON h.po_id = l.po_id JOIN vendor_master v ON v.vendor_id = h.vendor_id
    WHERE l.material_id = x.material_id AND country IN ('CN', 'JP', 'VN', 'TW', 'MY')), 0) AS DECIMAL(18,2)) AS lost_spend, bool_and(gone) AS left_without_source
FROM x GROUP BY material_id HAVING bool_or(gone)""",
    "u804_alternative_vendors": """WITH v AS (SELECT category_id, v.vendor_id, legal_entity_id, quality_score, on_time_delivery_rate FROM vendor_category c
  JOIN vendor_master v ON v.vendor_id = c.vendor_id WHERE status = 'ACTIVE'
  QUALIFY row_number() OVER (PARTITION BY category_id, legal_entity_id ORDER BY quality_score DESC, on_time_delivery_rate DESC, v.vendor_id) = 1)
SELECT category_id, CAST(row_number() OVER (PARTITION BY category_id ORDER BY quality_score DESC, on_time_delivery_rate DESC, vendor_id) AS INTEGER) AS rank,
  vendor_id, legal_entity_id, quality_score, on_time_delivery_rate FROM v""",
    "u901_uc09_features": """WITH g AS (SELECT l.gr_id, gr_line_number, l.material_id, gh.plant_id, h.vendor_id, gr_date, quantity_rejected, p.quantity
  FROM gr_line_item l JOIN gr_header gh ON gh.gr_id = l.gr_id JOIN po_line_item p ON p.po_id = l.po_id AND p.po_line_number = l.po_line_number
  JOIN po_header h ON h.po_id = l.po_id)
SELECT gr_id, gr_line_number, quality_score AS uc09_vendor_quality_score, CASE WHEN quality_score > 85 THEN 'HIGH' WHEN quality_score < 70 THEN 'LOW' ELSE 'MEDIUM' END
    AS uc09_vendor_quality_tier, hazmat_flag::INT AS uc09_is_hazmat, quantity::DOUBLE / lot_size AS uc09_order_qty_vs_lot_size,
  row_number() OVER (PARTITION BY g.vendor_id ORDER BY gr_date, gr_id, gr_line_number) AS uc09_gr_sequence_for_vendor,
  CAST(gr_date - max(CASE WHEN quantity_rejected > 0 THEN gr_date END) OVER (PARTITION BY g.vendor_id ORDER BY gr_date
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS INTEGER) AS uc09_days_since_last_rejection, (quantity_rejected > 0)::INT AS label
FROM g JOIN vendor_master v ON v.vendor_id = g.vendor_id JOIN material_master m ON m.material_id = g.material_id
LEFT JOIN material_plant_extension e ON e.material_id = g.material_id AND e.plant_id = g.plant_id""",
    "u902_trend_rejection": quarter(f"SELECT vendor_id, quarter, sum(quantity_rejected)::DOUBLE / sum(quantity_received)::DOUBLE AS value FROM ({GRQ}) GROUP BY 1, 2"),
    "u902_trend_rejection_by_reason": quarter(f"""SELECT * FROM (SELECT vendor_id, quarter, rejection_reason,
  sum(quantity_rejected)::DOUBLE / (sum(sum(quantity_received)) OVER (PARTITION BY vendor_id, quarter))::DOUBLE AS value FROM ({GRQ})
  GROUP BY 1, 2, 3) WHERE rejection_reason IS NOT NULL""", "rejection_reason"),
    "u902_trend_late_share": quarter("""SELECT vendor_id, CAST(date_trunc('quarter', actual_delivery_date) AS DATE) AS quarter,
  avg((actual_delivery_date > requested_delivery_date)::INT) AS value FROM po_line_item JOIN po_header USING (po_id) WHERE actual_delivery_date IS NOT NULL GROUP BY 1, 2"""),
    "u902_trend_price_variance": quarter("""SELECT vendor_id, CAST(date_trunc('quarter', invoice_date) AS DATE) AS quarter,
  avg((match_status IN ('PRICE_VARIANCE', 'BOTH_VARIANCE'))::INT) AS value FROM invoice_header GROUP BY 1, 2"""),
    "u1001_uc10_features": f"WITH {UC10} SELECT * FROM u10",
    "u1002_pr_priority": f"WITH {UC10} SELECT * FROM p10",
    "u1002_priority_queue": f"""WITH {UC10} SELECT *, CAST(row_number() OVER (PARTITION BY rule_priority ORDER BY priority_score DESC, pr_id, pr_line_number) AS INTEGER)
  AS queue_rank FROM p10""",
    "u1101_duplicate_links": lag_links("invoice_header", "vendor_id, total_gross_amount", 7),
    "u1102_duplicate_counts": """SELECT invoice_id,
  count(*) OVER (PARTITION BY vendor_id, total_gross_amount ORDER BY invoice_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 30 DAY FOLLOWING) - 1
    AS uc11_same_vendor_same_amount,
  count(*) OVER (PARTITION BY po_id ORDER BY invoice_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 30 DAY FOLLOWING) - 1 AS uc11_same_po_reference
FROM invoice_header""",
    "u1103_fuzzy_pairs": f"""WITH nv AS (SELECT invoice_id, invoice_date, vendor_id,
    unnest(list_distinct([vendor_invoice_number] ||
      list_transform(range(1, length(vendor_invoice_number) + 1), lambda i: substr(vendor_invoice_number, 1, i - 1) || '_' || substr(vendor_invoice_number, i + 1)) ||
      list_transform(range(1, length(vendor_invoice_number) + 1), lambda i: substr(vendor_invoice_number, 1, i - 1) || substr(vendor_invoice_number, i + 1)))) AS variant
  FROM invoice_header),
ac AS MATERIALIZED (SELECT vendor_id, material_id, quantity_invoiced, invoice_date, total_gross_amount AS amount, min(invoice_id) AS invoice_id
  FROM invoice_header JOIN invoice_line_item USING (invoice_id) GROUP BY ALL),
p AS (SELECT first_invoice_id, invoice_id FROM ({lag_links('invoice_header', 'vendor_id, total_gross_amount', 30)})
  UNION SELECT first_invoice_id, invoice_id FROM ({lag_links('invoice_header', 'vendor_id, po_id', 30)})
  UNION SELECT first_invoice_id, invoice_id FROM ({lag_links('nv', 'vendor_id, variant', 30)})
  UNION SELECT a.invoice_id, b.invoice_id FROM ac a JOIN ac b ON a.vendor_id = b.vendor_id AND a.material_id = b.material_id
    AND a.quantity_invoiced = b.quantity_invoiced AND (a.invoice_date, a.invoice_id) < (b.invoice_date, b.invoice_id) AND b.invoice_date - a.invoice_date <= 30
    AND a.amount <> b.amount AND abs(a.amount - b.amount) * 100 <= abs(a.amount) * 5),
s AS (SELECT invoice_id, list(DISTINCT material_id || '/' || quantity_invoiced) AS s FROM invoice_line_item GROUP BY 1)
SELECT first_invoice_id, p.invoice_id, CAST(levenshtein(a.vendor_invoice_number, b.vendor_invoice_number) AS INTEGER) AS uc11_invoice_number_distance,
  abs(a.total_gross_amount - b.total_gross_amount)::DOUBLE / a.total_gross_amount::DOUBLE AS uc11_amount_deviation,
  CAST(abs(b.invoice_date - a.invoice_date) AS INTEGER) AS uc11_date_gap_days,
  len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) AS uc11_line_item_overlap
FROM p JOIN invoice_header a ON a.invoice_id = first_invoice_id JOIN invoice_header b ON b.invoice_id = p.invoice_id
JOIN s x ON x.invoice_id = first_invoice_id JOIN s y ON y.invoice_id = p.invoice_id""",
    "u1201_uc12_features": """WITH n AS (SELECT material_id, category_id, count(*) AS n FROM (SELECT DISTINCT material_id, vendor_id FROM source_list)
  JOIN vendor_category USING (vendor_id) GROUP BY 1, 2),
m AS (SELECT material_id, category_id AS c FROM n QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY n DESC, category_id) = 1)
SELECT mm.material_id, category_id, material_type AS uc12_material_type, (standard_cost >= 4600)::INT + (standard_cost >= 4700)::INT + (standard_cost >= 4800)::INT
  + (standard_cost >= 4900)::INT AS uc12_standard_cost_range, base_uom AS uc12_uom, c AS uc12_vendor_categories FROM material_master mm
LEFT JOIN m ON m.material_id = mm.material_id""",
    "u1203_category_profile": """WITH g AS (SELECT category_id, count(DISTINCT s.vendor_id) AS n FROM source_list s JOIN vendor_master v ON v.vendor_id = s.vendor_id
  JOIN material_master m ON m.material_id = s.material_id WHERE quality_score >= 70 GROUP BY 1)
SELECT m.category_id, count(*) AS n, min(standard_cost)::DOUBLE AS minimum, quantile_cont(standard_cost::DOUBLE, 0.25) AS q1, quantile_cont(standard_cost::DOUBLE, 0.5) AS median,
  quantile_cont(standard_cost::DOUBLE, 0.75) AS q3, max(standard_cost)::DOUBLE AS maximum, coalesce(any_value(g.n), 0) AS good_vendors
FROM material_master m LEFT JOIN g ON g.category_id = m.category_id GROUP BY m.category_id""",
    "u1301_uc13_features": """SELECT s.material_id, plant_id, s.vendor_id, hazmat_flag::INT AS uc13_is_hazmat, material_type AS uc13_material_type,
  v.confidentiality_tier AS uc13_vendor_tier, (bank_account <> '')::INT AS uc13_has_bank_info, list_position(['LOW', 'MEDIUM', 'HIGH'], criticality) - 1 AS uc13_criticality,
  (s.material_id IN (SELECT material_id FROM contract_item JOIN contract_header h USING (contract_id) WHERE h.status = 'ACTIVE'))::INT AS uc13_contract_exists
FROM source_list s JOIN material_master m ON m.material_id = s.material_id JOIN vendor_master v ON v.vendor_id = s.vendor_id""",
    "u1302_tier_discrepancies": f"""WITH m AS (SELECT material_id, confidentiality_tier AS t, CASE WHEN hazmat_flag THEN 'RESTRICTED' WHEN material_type = 'SERVICE' THEN 'PUBLIC'
  ELSE 'INTERNAL' END AS r FROM material_master)
SELECT 'MATERIAL' AS entity, material_id AS entity_id, t AS stored_tier, r AS rule_tier FROM m WHERE t <> r
UNION ALL SELECT 'SOURCE', vendor_id || '@' || material_id || '@' || plant_id, (['PUBLIC', 'INTERNAL', 'RESTRICTED'])[own], (['PUBLIC', 'INTERNAL', 'RESTRICTED'])[need]
FROM ({TIERS}) WHERE own < need""",
}


SQL["u208_feature_matrix_all"] = table(f"{LOO}, rt AS (SELECT * FROM loo)", f"({CLASS})::DOUBLE")
SQL["u210_leakage_report_all"] = f"WITH x AS ({SQL['u207_uc02_table_train']}) " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(abs(CASE WHEN min({n}) < max({n}) THEN corr({n}::DOUBLE, label) END), 4) AS abs_corr, "
    f"coalesce(abs(CASE WHEN min({n}) < max({n}) THEN corr({n}::DOUBLE, label) END) > 0.9, false) AS leaks FROM x" for n in FEATURES)
