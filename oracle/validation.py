"""DuckDB twins of the data-quality checks."""

from buylens.schemas import FOREIGN_KEYS, MAX_LENGTH, PRIMARY_KEYS, SCHEMAS, parent_columns

ROWS = {}    # offenders: a text column d
VALUES = {}  # measured values: columns d, bad


def _orphans(child, column, parent, key, show):
    return (f"SELECT {show} AS d FROM {child} c WHERE c.{column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})")


META = {
    "v01_fk_material_category": ("FK material_master.category_id", "FATAL", "orphan material_master rows"),
    "v02_fk_source_material": ("FK source_list.material_id", "FATAL", "orphan source_list rows"),
    "v03_fk_source_vendor": ("FK source_list.vendor_id", "FATAL", "orphan source_list rows"),
    "v04_fk_source_plant": ("FK source_list.plant_id", "FATAL", "orphan source_list rows"),
    "v05_fk_contract_material": ("FK contract_item.material_id", "FATAL", "orphan contract_item rows"),
    "v06_fk_contract_vendor": ("FK contract_header.vendor_id", "FATAL", "orphan contract_header rows"),
    "v07_fk_vendor_entity": ("FK vendor_master.legal_entity_id", "FATAL", "orphan vendor_master rows"),
    "v08_fk_category_group": ("FK purchasing_group_category.purch_group_id", "FATAL", "orphan purchasing_group_category rows"),
    "v09_fk_group_category": ("FK purchasing_group_category.category_id", "FATAL", "orphan purchasing_group_category rows"),
    "v10_fk_vendor_category": ("FK vendor_category.vendor_id", "FATAL", "orphan vendor_category rows"),
    "v11_fk_plant_extension": ("FK material_plant_extension", "FATAL", "orphan material_plant_extension rows"),
    "v12_fk_pr_material": ("FK pr_line_item.material_id", "FATAL", "orphan pr_line_item rows"),
    "v13_fk_pr_plant": ("FK pr_header.plant_id", "FATAL", "orphan pr_header rows"),
    "v14_fk_po_vendor": ("FK po_header.vendor_id", "FATAL", "orphan po_header rows"),
    "v15_fk_gr_po": ("FK gr_header.po_id", "FATAL", "orphan gr_header rows"),
    "v16_fk_invoice_po": ("FK invoice_header.po_id", "FATAL", "orphan invoice_header rows"),
    "v17_fk_payment_vendor": ("FK payment.vendor_id", "FATAL", "orphan payment rows"),
    "v18_fk_payment_link": ("FK payment_invoice_link", "FATAL", "orphan payment_invoice_link rows"),
    "v21_high_without_reason": ("HIGH criticality needs reason", "FATAL", "HIGH materials without reason"),
    "v22_missing_tiers": ("No missing tiers", "FATAL", "entities without tier"),
    "v23_blocked_sources": ("Blocked vendor sourcing", "FATAL", "approved sources of blocked vendors"),
    "v24_split_alias_groups": ("Alias group integrity", "FATAL", "alias groups across entities"),
    "v25_low_source_tiers": ("Source tier propagation", "FATAL", "source rows below required tier"),
    "v26_uncovered_claims": ("Contract coverage claims", "FATAL", "covered sources without active contract"),
    "v27_blocked_orders": ("No orders to blocked vendors", "FATAL", "orders to blocked vendors"),
    "v28_category_orphans": ("Category tree", "FATAL", "category tree findings"),
    "v29_empty_tables": ("Tables not empty", "FATAL", "empty tables"),
    "v30_row_targets": ("Row targets", "WARNING", "tables off target"),
    "v31_leaf_range": ("Leaf category range", "WARNING", "counts out of range"),
    "v32_criticality_mix": ("Criticality mix", "WARNING", "findings"),
    "v33_contract_share": ("On-contract share", "WARNING", "shares out of range"),
    "v34_maverick_share": ("Maverick share", "WARNING", "shares out of range"),
    "v35_match_share": ("Full-match share", "WARNING", "shares out of range"),
    "v36_single_sources": ("Single sources at risk", "WARNING", "critical single sources"),
    "v37_one_country_supply": ("Supply from one country", "WARNING", "materials from one country"),
    "v38_public_bank_data": ("Bank data not public", "FATAL", "public vendors with bank data"),
    "v39_mixed_tiers": ("Mixed source tiers", "WARNING", "material plants with mixed tiers"),
    "v40_off_contract_materials": ("Off-contract materials", "WARNING", "materials without coverage"),
    "v41_alias_disagreement": ("Alias agreement", "FATAL", "disagreeing alias members"),
    "v42_sourcing_gaps": ("Sourcing gaps", "WARNING", "plants without source"),
    "v43_long_lanes": ("Long lanes", "WARNING", "lanes with long lead time"),
    "v44_excluded_groups": ("Excluded groups", "FATAL", "groups with excluded categories"),
    "v45_dear_contracts": ("Contract price above cost", "WARNING", "dear contract items"),
    "v46_weak_conditional_vendors": ("Weak conditional vendors", "WARNING", "conditional vendors of low quality"),
    "v47_cross_plant_lead_times": ("Cross-plant lead times", "WARNING", "materials with differing lead times"),
    "v49_temporal_order": ("Document order", "WARNING", "documents out of order"),
    "v50_long_fields": ("Field lengths", "WARNING", "columns over length"),
}

ROWS["v01_fk_material_category"] = _orphans("material_master", "category_id", "category_hierarchy", "category_id", "material_id")
SOURCE_KEY = "material_id || '@' || plant_id || '@' || vendor_id"
ROWS["v02_fk_source_material"] = _orphans("source_list", "material_id", "material_master", "material_id", SOURCE_KEY)
ROWS["v03_fk_source_vendor"] = _orphans("source_list", "vendor_id", "vendor_master", "vendor_id", SOURCE_KEY)
ROWS["v04_fk_source_plant"] = _orphans("source_list", "plant_id", "plant", "plant_id", SOURCE_KEY)
ROWS["v05_fk_contract_material"] = _orphans("contract_item", "material_id", "material_master", "material_id",
                                            "contract_id || '@' || item_number")
ROWS["v06_fk_contract_vendor"] = _orphans("contract_header", "vendor_id", "vendor_master", "vendor_id", "contract_id")
ROWS["v07_fk_vendor_entity"] = _orphans("vendor_master", "legal_entity_id", "legal_entity", "legal_entity_id", "vendor_id")
ROWS["v08_fk_category_group"] = _orphans("purchasing_group_category", "purch_group_id", "purchasing_group", "purch_group_id",
                                         "purch_group_id || '@' || category_id")
ROWS["v09_fk_group_category"] = _orphans("purchasing_group_category", "category_id", "category_hierarchy", "category_id",
                                         "purch_group_id || '@' || category_id")
ROWS["v10_fk_vendor_category"] = _orphans("vendor_category", "vendor_id", "vendor_master", "vendor_id",
                                          "vendor_id || '@' || category_id")
ROWS["v11_fk_plant_extension"] = """SELECT material_id || '@' || plant_id AS d FROM material_plant_extension
WHERE material_id NOT IN (SELECT material_id FROM material_master) OR plant_id NOT IN (SELECT plant_id FROM plant)"""
ROWS["v12_fk_pr_material"] = _orphans("pr_line_item", "material_id", "material_master", "material_id",
                                      "pr_id || '@' || pr_line_number")
ROWS["v13_fk_pr_plant"] = _orphans("pr_header", "plant_id", "plant", "plant_id", "pr_id")
ROWS["v14_fk_po_vendor"] = _orphans("po_header", "vendor_id", "vendor_master", "vendor_id", "po_id")
ROWS["v15_fk_gr_po"] = _orphans("gr_header", "po_id", "po_header", "po_id", "gr_id")
ROWS["v16_fk_invoice_po"] = _orphans("invoice_header", "po_id", "po_header", "po_id", "invoice_id")
ROWS["v17_fk_payment_vendor"] = _orphans("payment", "vendor_id", "vendor_master", "vendor_id", "payment_id")
ROWS["v18_fk_payment_link"] = """SELECT payment_id || '@' || invoice_id AS d FROM payment_invoice_link
WHERE payment_id NOT IN (SELECT payment_id FROM payment) OR invoice_id NOT IN (SELECT invoice_id FROM invoice_header)"""
ROWS["v21_high_without_reason"] = """SELECT material_id AS d FROM material_master WHERE criticality = 'HIGH'
AND coalesce(criticality_reason_code, '') = ''"""
ROWS["v22_missing_tiers"] = """SELECT material_id AS d FROM material_master WHERE coalesce(confidentiality_tier, '') = ''
UNION ALL SELECT vendor_id FROM vendor_master WHERE coalesce(confidentiality_tier, '') = ''"""
LANE = "vendor_id || '@' || material_id || '@' || plant_id"
ROWS["v23_blocked_sources"] = f"""SELECT {LANE} AS d FROM source_list WHERE approval_status = 'APPROVED'
AND vendor_id IN (SELECT vendor_id FROM vendor_master WHERE status = 'BLOCKED')"""
ROWS["v24_split_alias_groups"] = """SELECT alias_group AS d FROM vendor_master WHERE alias_group IS NOT NULL
GROUP BY alias_group HAVING count(DISTINCT legal_entity_id) > 1"""
TIERS = """SELECT sl.material_id, sl.plant_id, sl.vendor_id,
  greatest(list_position(t.o, v.confidentiality_tier), list_position(t.o, m.confidentiality_tier),
    CASE WHEN sl.contract_covered_flag THEN coalesce((SELECT min(list_position(t.o, h.confidentiality_tier)) FROM contract_header h
      JOIN contract_item i USING (contract_id) WHERE h.status = 'ACTIVE' AND h.vendor_id = sl.vendor_id
      AND i.material_id = sl.material_id), 1) ELSE 1 END) AS need, list_position(t.o, sl.confidentiality_tier) AS own
FROM source_list sl JOIN vendor_master v ON v.vendor_id = sl.vendor_id JOIN material_master m ON m.material_id = sl.material_id,
  (SELECT ['PUBLIC', 'INTERNAL', 'RESTRICTED'] AS o) t"""
ROWS["v25_low_source_tiers"] = f"SELECT {LANE} AS d FROM ({TIERS}) WHERE own < need"
ROWS["v26_uncovered_claims"] = f"""SELECT {LANE} AS d FROM source_list sl WHERE contract_covered_flag AND NOT EXISTS (
  SELECT 1 FROM contract_header h JOIN contract_item i USING (contract_id) WHERE h.status = 'ACTIVE'
  AND h.vendor_id = sl.vendor_id AND i.material_id = sl.material_id)"""
ROWS["v27_blocked_orders"] = """SELECT po_id AS d FROM po_header JOIN vendor_master v USING (vendor_id) WHERE v.status = 'BLOCKED'"""
VALUES["v28_category_orphans"] = """SELECT category_id AS d, true AS bad FROM category_hierarchy WHERE parent_category_id IS NOT NULL
AND parent_category_id NOT IN (SELECT category_id FROM category_hierarchy)
UNION ALL SELECT 'leaves=' || count(*), count(*) < 45 FROM category_hierarchy WHERE level = 3"""
ROWS["v29_empty_tables"] = " UNION ALL ".join(
    f"SELECT '{t}' AS d WHERE (SELECT count(*) FROM {t}) = 0" for t in SCHEMAS)
VALUES["v30_row_targets"] = """SELECT t || '=' || n || ' target ' || goal AS d, abs(n - goal) >= goal * tol AS bad FROM (
  SELECT 'material_master' AS t, (SELECT count(*) FROM material_master) AS n, 800 AS goal, 0.15 AS tol
  UNION ALL SELECT 'vendor_master', (SELECT count(*) FROM vendor_master), 120, 0.15
  UNION ALL SELECT 'contract_header', (SELECT count(*) FROM contract_header), 40, 0.20)"""
VALUES["v31_leaf_range"] = """SELECT 'leaves=' || count(*) AS d, count(*) NOT BETWEEN 45 AND 55 AS bad FROM category_hierarchy
WHERE level = 3"""
VALUES["v32_criticality_mix"] = """SELECT 'HIGH=' || count(*) FILTER (criticality = 'HIGH') || ', MEDIUM='
  || count(*) FILTER (criticality = 'MEDIUM') || ', LOW=' || count(*) FILTER (criticality = 'LOW') AS d, false AS bad
FROM material_master"""


def _share(table, condition, low, high):
    return (f"SELECT count(*) FILTER ({condition}) || '/' || count(*) AS d, "
            f"count(*) FILTER ({condition}) / count(*) NOT BETWEEN {low} AND {high} AS bad FROM {table}")


VALUES["v33_contract_share"] = _share("po_line_item", "contract_id IS NOT NULL", 0.60, 0.85)
VALUES["v34_maverick_share"] = _share("po_header", "maverick_flag", 0.02, 0.12)
VALUES["v35_match_share"] = _share("invoice_header", "match_status = 'FULL_MATCH'", 0.70, 0.95)
ROWS["v36_single_sources"] = """SELECT s.material_id || '@' || s.plant_id AS d FROM source_list s
JOIN vendor_master v ON v.vendor_id = s.vendor_id JOIN material_master m ON m.material_id = s.material_id
WHERE m.criticality = 'HIGH' AND v.risk_score > 70
AND (s.material_id, s.plant_id) IN (SELECT (material_id, plant_id) FROM source_list GROUP BY material_id, plant_id HAVING count(*) = 1)
AND EXISTS (SELECT 1 FROM contract_header h JOIN contract_item i USING (contract_id) WHERE h.vendor_id = s.vendor_id
  AND i.material_id = s.material_id AND h.valid_to - DATE '2001-06-30' <= 60)"""
ROWS["v37_one_country_supply"] = """SELECT material_id AS d FROM (SELECT DISTINCT material_id, vendor_id FROM source_list)
JOIN vendor_master USING (vendor_id) GROUP BY material_id
HAVING count(*) > 1 AND count(DISTINCT country) = 1 AND count(DISTINCT quality_score) > 1"""
ROWS["v38_public_bank_data"] = "SELECT vendor_id AS d FROM vendor_master WHERE bank_account <> '' AND confidentiality_tier = 'PUBLIC'"
ROWS["v39_mixed_tiers"] = f"""SELECT material_id || '@' || plant_id AS d FROM ({TIERS}) GROUP BY material_id, plant_id
HAVING count(DISTINCT greatest(own, need)) > 1"""
ROWS["v40_off_contract_materials"] = """SELECT material_id AS d FROM source_list JOIN material_master USING (material_id)
WHERE criticality = 'HIGH' GROUP BY material_id HAVING NOT bool_or(contract_covered_flag)"""
ROWS["v41_alias_disagreement"] = """SELECT a.alias_group AS d FROM vendor_master a JOIN vendor_master b USING (alias_group)
WHERE a.legal_entity_id <> b.legal_entity_id GROUP BY 1
UNION ALL SELECT a.legal_entity_id FROM vendor_master a JOIN vendor_master b USING (legal_entity_id)
WHERE a.alias_group <> b.alias_group GROUP BY 1"""
ROWS["v42_sourcing_gaps"] = """SELECT m.material_id || '@' || p.plant_id AS d
FROM (SELECT DISTINCT material_id FROM source_list) m CROSS JOIN plant p
WHERE (m.material_id, p.plant_id) NOT IN (SELECT (material_id, plant_id) FROM source_list)
AND (m.material_id, p.plant_id) NOT IN (SELECT (material_id, plant_id) FROM material_plant_extension)"""
ROWS["v43_long_lanes"] = f"SELECT {LANE} AS d FROM source_list WHERE lane_lead_time_days >= 60"
ROWS["v44_excluded_groups"] = """SELECT purch_group_id || '@' || category_id AS d FROM purchasing_group_category
WHERE purch_group_id = 'PG02' AND category_id LIKE 'ELEC%'"""
ROWS["v45_dear_contracts"] = """SELECT contract_id || '@' || material_id AS d FROM contract_item JOIN material_master USING (material_id)
WHERE agreed_price > standard_cost * 1.2"""
ROWS["v46_weak_conditional_vendors"] = "SELECT vendor_id AS d FROM vendor_master WHERE status = 'CONDITIONAL' AND quality_score < 70"
ROWS["v47_cross_plant_lead_times"] = """SELECT material_id AS d FROM source_list WHERE preferred_rank = 1 GROUP BY material_id
HAVING count(*) > 1 AND count(DISTINCT lane_lead_time_days) > 1"""
ROWS["v49_temporal_order"] = """SELECT gr_id AS d FROM gr_header JOIN po_header USING (po_id) WHERE gr_date <= po_date
UNION ALL SELECT invoice_id FROM invoice_header i WHERE invoice_date < (SELECT min(gr_date) FROM gr_header g WHERE g.po_id = i.po_id)
UNION ALL SELECT invoice_id FROM invoice_header WHERE received_date < invoice_date
UNION ALL SELECT payment_id FROM payment JOIN payment_invoice_link USING (payment_id) JOIN invoice_header USING (invoice_id)
  WHERE payment_date < received_date"""
ROWS["v50_long_fields"] = " UNION ALL ".join(
    f"SELECT '{t}.{f.name}' AS d WHERE (SELECT max(length(\"{f.name}\")) FROM {t}) > {MAX_LENGTH[f.name]}"
    for t, schema in SCHEMAS.items() for f in schema if f.dataType.simpleString() == "string")


def _found(key):
    return VALUES[key] if key in VALUES else f"SELECT d, true AS bad FROM ({ROWS[key]})"


def _report(key):
    name, severity, text = META[key]
    return f"""WITH found AS ({_found(key)}),
n AS (SELECT coalesce(sum(bad::INT), 0)::BIGINT AS n FROM found)
SELECT '{name}' AS check_name, '{severity}' AS severity, n = 0 AS passed, n AS violation_count, n || ' {text}' AS message,
  coalesce((SELECT list(d ORDER BY bad DESC, d) FROM (SELECT d, bad FROM found ORDER BY bad DESC, d LIMIT 10)), []::VARCHAR[]) AS details
FROM n"""


SQL = {key: _report(key) for key in META}

SQL["v19_foreign_keys"] = " UNION ALL ".join(
    f"SELECT '{fk[0]}' AS child_table, '{','.join(fk[1])}' AS child_columns, '{fk[2]}' AS parent_table, count(*) AS orphans "
    f"FROM {fk[0]} c WHERE {' AND '.join(f'c.{x} IS NOT NULL' for x in fk[1])} AND NOT EXISTS (SELECT 1 FROM {fk[2]} p WHERE "
    f"{' AND '.join(f'p.{k} = c.{x}' for k, x in zip(parent_columns(fk), fk[1]))})" for fk in FOREIGN_KEYS)

SQL["v20_primary_keys"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) FILTER (n > 1) AS repeated_keys, "
    f"CAST(coalesce(sum(n) FILTER ({' OR '.join(f'{k} IS NULL' for k in keys)}), 0) AS BIGINT) AS null_keys "
    f"FROM (SELECT {', '.join(keys)}, count(*) AS n FROM {t} GROUP BY ALL)" for t, keys in PRIMARY_KEYS.items())

SQL["v48_run_suite"] = "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{META[k][1]}' AS severity, coalesce(sum(bad::INT), 0)::BIGINT AS n FROM ({_found(k)})" for k in META) + """)
SELECT severity, n = 0 AS passed, count(*) AS checks, CAST(sum(n) AS BIGINT) AS violations,
  severity <> 'FATAL' OR n = 0 AS gate_ok FROM c GROUP BY ALL"""
