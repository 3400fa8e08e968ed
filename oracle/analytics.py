"""DuckDB twins of reports and statistics."""

INV = """i AS (SELECT h.*, quality_score, risk_score, on_time_delivery_rate, vendor_type, esg_score
  FROM invoice_header h JOIN vendor_master v ON v.vendor_id = h.vendor_id)"""
STATUS = ["FULL_MATCH", "PRICE_VARIANCE", "QUANTITY_VARIANCE", "BOTH_VARIANCE"]
CATEGORY = "split_part(category_id, '-', 1)"


def quantiles(x):
    return (f"min({x})::DOUBLE AS minimum, quantile_cont({x}::DOUBLE, 0.25) AS q1, quantile_cont({x}::DOUBLE, 0.5) AS median, "
            f"quantile_cont({x}::DOUBLE, 0.75) AS q3, max({x})::DOUBLE AS maximum")


COLUMNS = ["quality_score", "risk_score", "on_time_delivery_rate", "esg_score", "total_net_amount"]
PO_LINE = ["po_id", "po_line_number", "material_id", "quantity", "uom", "unit_price", "net_value", "price_currency", "requested_delivery_date",
           "actual_delivery_date", "contract_id", "contract_item_number", "pr_id", "pr_line_number", "over_delivery_tolerance",
           "under_delivery_tolerance", "gr_status", "invoice_status"]

def pearson(x: str, y: str, table: str) -> str:
    """The p-value is the t density integrated by Simpson's rule, as an integral of cos(theta) ** (n - 3)."""
    return f"""WITH c AS (SELECT corr({x}, {y}) AS r, count(*) AS n FROM {table}),
g AS (SELECT *, asin(abs(r)) AS lo, (pi() / 2 - asin(abs(r))) / 20000 AS h FROM c),
p AS (SELECT any_value(r) AS r, any_value(n) AS n, sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(lo + k * h), 0), n - 3)) * any_value(h) / 3
  * 2 * exp(lgamma((any_value(n) - 1) / 2) - lgamma((any_value(n) - 2) / 2)) / sqrt(pi()) AS p FROM g, generate_series(0, 20000) AS s(k))
SELECT round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_statistic, round(p, 6) AS p_value FROM p"""


def chi_square(rows: str, a: str, b: str) -> str:
    """The p-value is one less the gamma density integrated by Simpson's rule over the square root of its argument."""
    return f"""WITH {rows}, o AS (SELECT a, b, (SELECT count(*) FROM i WHERE {a} = a AND {b} = b) AS o
  FROM (SELECT DISTINCT {a} AS a FROM i), (SELECT DISTINCT {b} AS b FROM i)),
e AS (SELECT *, sum(o) OVER (PARTITION BY a)::DOUBLE * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM o),
c AS (SELECT sum((o - e) * (o - e) / e) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM e),
p AS (SELECT any_value(chi2) AS chi2, any_value(dof) AS dof, 1 - sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * 2 * pow(u, dof - 1) * exp(-u * u - lgamma(dof / 2))) * any_value(h) / 3 AS p
  FROM (SELECT *, sqrt(chi2 / 2) / 20000 AS h, sqrt(chi2 / 2) / 20000 * k AS u FROM c, generate_series(0, 20000) AS s(k)))
SELECT round(chi2, 6) AS chi2, dof, round(p, 6) AS p_value FROM p"""


SQL = {
    "rq01_spend_by_vendor": """SELECT vendor_id, CAST(s AS DECIMAL(18,2)) AS total_spend, po_count,
  CAST(row_number() OVER (ORDER BY s DESC, vendor_id) AS INTEGER) AS spend_rank, vendor_name
FROM (SELECT vendor_id, sum(total_net_value) AS s, count(DISTINCT po_id) AS po_count FROM po_header GROUP BY vendor_id)
JOIN vendor_master USING (vendor_id) QUALIFY spend_rank <= 10""",
    "rq01_spend_by_vendor_all": """SELECT vendor_id, CAST(sum(total_net_value) AS DECIMAL(18,2)) AS total_spend,
  count(DISTINCT po_id) AS po_count, any_value(vendor_name) AS vendor_name FROM po_header JOIN vendor_master USING (vendor_id) GROUP BY vendor_id""",
    "rq02_spend_by_category": """SELECT m.category_id, any_value(category_name) AS category_name,
  CAST(sum(net_value) AS DECIMAL(18,2)) AS total_spend, count(*) AS item_count
FROM po_line_item JOIN material_master m USING (material_id) JOIN category_hierarchy c ON c.category_id = m.category_id
GROUP BY m.category_id ORDER BY total_spend DESC, m.category_id LIMIT 10""",
    "rq02_spend_by_top_category": f"""SELECT c.category_id, category_name, CAST(sum(net_value) AS DECIMAL(18,2)) AS total_spend, count(*) AS item_count
FROM po_line_item JOIN material_master m USING (material_id) JOIN category_hierarchy c ON c.category_id = split_part(m.category_id, '-', 1)
GROUP BY ALL""",
    "rq02_spend_rollup": """SELECT split_part(category_id, '-', 1) AS level_1,
  split_part(category_id, '-', 1) || '-' || split_part(category_id, '-', 2) AS level_2, category_id AS level_3,
  CAST(sum(net_value) AS DECIMAL(20,2)) AS total_spend
FROM po_line_item JOIN material_master USING (material_id) GROUP BY ROLLUP (1, 2, 3)""",
    "rq03_po_filter": """SELECT po_id, po_date, vendor_id, p.status, total_net_value, maverick_flag, vendor_name
FROM po_header p JOIN vendor_master USING (vendor_id) WHERE p.status = 'SENT' AND maverick_flag AND total_net_value >= 1000
ORDER BY total_net_value DESC, po_id LIMIT 20""",
    "rq04_invoice_aging": """SELECT match_status, status, count(*) AS invoices, CAST(sum(total_net_amount) AS DECIMAL(18,2)) AS total_amount
FROM invoice_header GROUP BY ALL""",
    "rq05_overdue_invoices": """SELECT invoice_id, vendor_id, payment_due_date, total_net_amount, match_status,
  CAST(DATE '2001-06-30' - payment_due_date AS INTEGER) AS days_overdue, vendor_name
FROM invoice_header i JOIN vendor_master USING (vendor_id) WHERE payment_due_date < DATE '2001-06-30' AND i.status <> 'PAID'
ORDER BY payment_due_date, invoice_id LIMIT 20""",
    "rq05_overdue_invoices_all": """SELECT invoice_id, vendor_id, payment_due_date, total_net_amount, match_status,
  CAST(DATE '2001-06-30' - payment_due_date AS INTEGER) AS days_overdue, vendor_name
FROM invoice_header i JOIN vendor_master USING (vendor_id) WHERE payment_due_date < DATE '2001-06-30' AND i.status <> 'PAID'""",
    "rq06_vendor_risk": """SELECT vendor_id, vendor_name, risk_score, quality_score, on_time_delivery_rate, esg_score FROM vendor_master
WHERE risk_score > 70""",
    "rq07_critical_single_source": """SELECT material_id, plant_id, description, vendor_id, risk_score FROM (
  SELECT material_id, plant_id, description, any_value(vendor_id) AS vendor_id FROM source_list JOIN material_master USING (material_id)
  WHERE criticality = 'HIGH' GROUP BY ALL HAVING count(DISTINCT vendor_id) = 1) JOIN vendor_master USING (vendor_id) WHERE risk_score > 40""",
    "rq08_maverick_vs_contract": """SELECT vendor_id, count(*) FILTER (maverick_flag) AS maverick_pos, count(*) AS pos,
  count(*) FILTER (maverick_flag) / count(*) AS maverick_share
FROM po_header WHERE vendor_id IN (SELECT vendor_id FROM contract_header WHERE status = 'ACTIVE') GROUP BY vendor_id
HAVING count(*) FILTER (maverick_flag) > 0""",
    "rq09_aging_buckets": """SELECT CASE WHEN d <= 0 THEN '0' WHEN d <= 30 THEN '1-30' WHEN d <= 60 THEN '31-60' WHEN d <= 90 THEN '61-90'
  ELSE '90+' END AS bucket, count(*) AS invoices, CAST(sum(total_net_amount) AS DECIMAL(18,2)) AS total_amount
FROM (SELECT *, DATE '2001-06-30' - payment_due_date AS d FROM invoice_header WHERE status <> 'PAID') GROUP BY 1""",
    "rq10_contract_coverage_by_category": f"""SELECT {CATEGORY} AS category_id, CAST(sum(net_value) AS DECIMAL(18,2)) AS total_spend,
  CAST(coalesce(sum(net_value) FILTER (contract_id IS NOT NULL), 0) AS DECIMAL(18,2)) AS contract_spend,
  CAST(coalesce(sum(net_value) FILTER (contract_id IS NOT NULL), 0) AS DOUBLE) / CAST(sum(net_value) AS DOUBLE) AS contract_share
FROM po_line_item JOIN material_master USING (material_id) GROUP BY 1""",
    "rq11_blocked_by_vendor": """SELECT invoice_id, vendor_id, block_reason, total_net_amount, invoice_count, match_rate, quality_score
FROM invoice_header JOIN (SELECT vendor_id, count(*) AS invoice_count, count(*) FILTER (match_status = 'FULL_MATCH') / count(*) AS match_rate
  FROM invoice_header GROUP BY 1) USING (vendor_id) JOIN vendor_master USING (vendor_id) WHERE payment_block""",
    "e01_value_counts": """WITH d AS (SELECT * FROM (VALUES (0, 'FULL_MATCH'), (1, 'PRICE_VARIANCE'), (2, 'QUANTITY_VARIANCE'),
  (3, 'BOTH_VARIANCE'), (4, 'NOT_CHECKED')) AS v(position, match_status))
SELECT position, match_status, count(invoice_id) AS n, 100.0::DOUBLE * count(invoice_id) / (SELECT count(*) FROM invoice_header) AS percent
FROM d LEFT JOIN invoice_header USING (match_status) GROUP BY ALL""",
    "e02_monthly_volume": "SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, count(*) AS n FROM invoice_header GROUP BY 1",
    "e03_crosstab": "SELECT year(invoice_date) || 'Q' || quarter(invoice_date) AS row_key, " + ", ".join(
        f"count(*) FILTER (match_status = '{s}') AS {s}" for s in STATUS) + " FROM invoice_header GROUP BY 1",
    "e04_crosstab_pct": f"WITH {INV} SELECT vendor_type AS row_key, " + ", ".join(
        f"100.0::DOUBLE * count(*) FILTER (match_status = '{s}') / count(*) AS {s}" for s in STATUS) + " FROM i GROUP BY 1",
    "e05_crosstab_margins": f"""WITH {INV} SELECT vendor_type, match_status, count(*) AS n,
  CAST(grouping(vendor_type, match_status) AS BIGINT) AS level FROM i GROUP BY CUBE (vendor_type, match_status)""",
    "e06_match_rate_by_vendor": """SELECT vendor_id, count(*) AS n, avg((match_status = 'FULL_MATCH')::INT) AS rate, any_value(quality_score) AS quality_score,
  any_value(risk_score) AS risk_score FROM invoice_header JOIN vendor_master USING (vendor_id) GROUP BY 1 HAVING count(*) >= 3""",
    "e07_five_number": f"WITH {INV} SELECT match_status, count(*) AS n, {quantiles('quality_score')} FROM i GROUP BY 1",
    "e07_five_number_amounts": f"SELECT match_status, count(*) AS n, {quantiles('total_net_amount')} FROM invoice_header GROUP BY 1",
    "e08_pearson": pearson("quality_score", "risk_score", "vendor_master"),
    "e08_pearson_small": pearson("quality_score", "on_time_delivery_rate", "vendor_master WHERE quality_score > 75"),
    "e09_chi_square": chi_square(INV, "vendor_type", "match_status"),
    "e09_chi_square_contract": chi_square("""i AS (SELECT has_contract, match_status FROM invoice_header JOIN (SELECT po_id, bool_or(contract_id IS NOT NULL) AS has_contract
  FROM po_line_item GROUP BY 1) USING (po_id))""", "has_contract", "match_status"),
    "e10_corr_matrix": f"WITH {INV} " + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}::DOUBLE, {y}::DOUBLE), 6) AS r FROM i"
        for n, x in enumerate(COLUMNS) for y in COLUMNS[n + 1:]),
    "e11_histogram": """WITH b AS (SELECT min(total_net_amount)::DOUBLE AS lo, (max(total_net_amount)::DOUBLE - min(total_net_amount)::DOUBLE) / 20 AS w
  FROM invoice_header)
SELECT CAST(least(floor((total_net_amount::DOUBLE - lo) / w), 19) AS INTEGER) AS bin, match_status,
  any_value(lo) + least(floor((total_net_amount::DOUBLE - lo) / w), 19) * any_value(w) AS low, count(*) AS n
FROM invoice_header, b GROUP BY least(floor((total_net_amount::DOUBLE - lo) / w), 19), match_status""",
    "e12_rejection_rate_by_status": """SELECT match_status, count(*) AS n, avg((quantity_rejected > 0)::INT) AS rate
FROM invoice_line_item l JOIN gr_line_item g ON g.gr_id = l.gr_id AND g.gr_line_number = l.gr_line_number
JOIN invoice_header h ON h.invoice_id = l.invoice_id GROUP BY 1""",
    "e13_null_report": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS percent FROM po_line_item"
        for c in PO_LINE),
    "e14_describe": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, {quantiles(c)} FROM vendor_master"
        for c in ["quality_score", "risk_score", "esg_score", "on_time_delivery_rate"]),
    "e15_rate_by_band": f"""WITH {INV} SELECT (quality_score >= 65)::INT + (quality_score >= 75)::INT + (quality_score >= 85)::INT AS band,
  count(*) AS n, min(quality_score) AS low, max(quality_score) AS high, avg((match_status = 'FULL_MATCH')::INT) AS rate FROM i GROUP BY 1""",
    "e16_risk_curve": """SELECT invoice_id || '/' || invoice_line_number AS line_id, abs(price_variance) AS score,
  row_number() OVER (ORDER BY abs(price_variance) DESC, invoice_id || '/' || invoice_line_number) AS rank FROM invoice_line_item""",
    "e17_stratified_sample": """SELECT invoice_id, match_status FROM invoice_header
QUALIFY row_number() OVER (PARTITION BY match_status ORDER BY md5(invoice_id), invoice_id) <= 25""",
    "pr01_mask_ids": r"""WITH x AS (SELECT conv_id, turn, text FROM conversations UNION ALL
  SELECT CAST(substr(pr_id, 4) AS BIGINT), -1, 'requested by S' || substr(pr_id, 5, 7) || 'D and T' || substr(pr_id, 5, 7) || 'Z, not X'
    || substr(pr_id, 5, 7) FROM pr_header)
SELECT conv_id, turn, regexp_replace(text, '\b[STFGM][0-9]{7}[A-Z]\b', '[ID]', 'g') AS text,
  CAST(len(regexp_extract_all(text, '\b[STFGM][0-9]{7}[A-Z]\b')) AS INTEGER) AS masked_entities FROM x""",
    "pr02_redact": """SELECT vendor_id, vendor_name, NULL AS bank_account FROM vendor_master
UNION ALL SELECT vendor_id, vendor_name, bank_account FROM vendor_master""",
}
