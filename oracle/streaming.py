"""DuckDB twins of the streams: what they must have written once the input is used up."""

from oracle.features import PERF
from oracle.rules import MATCH
from oracle.usecases import MAVERICK, ZSCORE, lag_links


def windows(starts):
    """Windows closed by the watermark, one hour behind the last event."""
    return f"""WITH e AS (SELECT ts, event_type, unnest({starts}) AS s FROM events)
SELECT s AS window_start, s + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM e
WHERE ts >= s AND ts < s + INTERVAL 1 DAY AND s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL"""


SQL = {
    "st01_stream_match": f"""WITH {MATCH} SELECT invoice_id, invoice_line_number, price_variance, quantity_variance,
  CASE WHEN price_breach AND quantity_breach THEN 'BOTH_VARIANCE' WHEN price_breach THEN 'PRICE_VARIANCE' WHEN quantity_breach THEN 'QUANTITY_VARIANCE'
    ELSE 'FULL_MATCH' END AS match_status, CASE WHEN price_breach THEN 'PRICE_MISMATCH' WHEN quantity_breach THEN 'QTY_MISMATCH' END AS block_reason FROM f""",
    "st02_stream_po_check": f"""WITH {MAVERICK}, {ZSCORE.replace('l AS (', 'l2 AS (', 1)}
SELECT mv.po_id, mv.po_line_number, (price_ratio > 1.15)::INT + off_contract + 1 - uc01_vendor_is_approved AS maverick_score, coalesce(abs(z.z) > 2, false) AS price_anomaly
FROM mv JOIN z ON z.po_id = mv.po_id AND z.po_line_number = mv.po_line_number""",
    "st03_refresh_performance": f"SELECT * EXCLUDE (v_distinct_materials) FROM ({PERF.format(delay='').strip()})",
    "st03_refresh_prices": """SELECT material_id, sum(unit_price * 100)::DOUBLE / count(*) / 100 AS p_avg_unit_price,
  round(coalesce(stddev_samp(unit_price::DOUBLE), 0), 4) AS p_std_unit_price, min(unit_price) AS p_min_unit_price, max(unit_price) AS p_max_unit_price
FROM po_line_item GROUP BY 1""",
    "st03_refresh_behavior": """SELECT vendor_id, count(*) AS v_invoice_count, avg((match_status = 'FULL_MATCH')::INT) AS v_invoice_match_rate,
  avg((match_status IN ('PRICE_VARIANCE', 'BOTH_VARIANCE'))::INT) AS v_price_variance_rate,
  avg((match_status IN ('QUANTITY_VARIANCE', 'BOTH_VARIANCE'))::INT) AS v_qty_variance_rate, avg(payment_block::INT) AS v_payment_block_rate
FROM invoice_header GROUP BY 1""",
    "st03_refresh_distinct_materials": """SELECT vendor_id, count(DISTINCT material_id) AS v_distinct_materials FROM po_line_item JOIN po_header USING (po_id) GROUP BY 1""",
    "st03_refresh_price_quantiles": """SELECT material_id, count(*) AS n, quantile_cont(unit_price::DOUBLE, 0.5) AS p_median_unit_price,
  quantile_cont(unit_price::DOUBLE, 0.25) AS p_q1_unit_price, quantile_cont(unit_price::DOUBLE, 0.75) AS p_q3_unit_price FROM po_line_item GROUP BY 1""",
    "st03_refresh_sketches": """SELECT DISTINCT vendor_id, true AS distinct_within_bound, true AS median_within_bound FROM po_line_item JOIN po_header USING (po_id)""",
    "st04_stream_counts_day": windows("[date_trunc('day', ts)]"),
    "st04_stream_counts_sliding": windows("[date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('day', ts) - INTERVAL 12 HOUR]"),
    "st05_stream_duplicates": lag_links("invoice_header", "vendor_id, total_gross_amount", 7),
    "st06_stream_overdue_receipts": """SELECT po_id, CAST(requested_delivery_date AS TIMESTAMP) AS due_ts FROM po_line_item p
WHERE NOT EXISTS (SELECT 1 FROM gr_header g WHERE g.po_id = p.po_id AND g.gr_date <= p.requested_delivery_date + 20)
AND requested_delivery_date + 20 < (SELECT least(max(requested_delivery_date), (SELECT max(gr_date) FROM gr_header)) FROM po_line_item) - 1""",
    "st07_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s""",
    "st07_sessions_by_day": """WITH x AS (SELECT vendor_id, po_date, CASE WHEN po_date - lag(po_date) OVER w < 20 THEN 0 ELSE 1 END AS b FROM po_header
  WINDOW w AS (PARTITION BY vendor_id ORDER BY po_date, po_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY vendor_id ORDER BY po_date RANGE UNBOUNDED PRECEDING) AS s FROM x)
SELECT vendor_id, min(po_date) AS first_day, max(po_date) AS last_day, count(*) AS n FROM g GROUP BY vendor_id, s""",
}
