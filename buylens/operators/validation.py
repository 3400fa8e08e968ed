"""Data-quality checks. A check yields findings; the report counts them and keeps ten.

Findings are rows ``(detail, bad)``. Row checks return offenders only; measured checks
return one row that carries the measured value and whether it is out of bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buylens.functions.columns import tier_value
from buylens.operators.confidentiality import propagate_confidentiality, required_tiers
from buylens.operators.contracts import contract_coverage
from buylens.schemas import FOREIGN_KEYS, MAX_LENGTH, PRIMARY_KEYS, SCHEMAS, parent_columns

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    text: str
    findings: Callable[[Tables], DataFrame]


def _detail(df: DataFrame, *columns: str, sep: str = "@") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("detail"),
                     F.lit(True).alias("bad"))


def _measured(df: DataFrame, detail: Column, bad: Column) -> DataFrame:
    return df.select(detail.alias("detail"), F.coalesce(bad, F.lit(True)).alias("bad"))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose complete key has no parent; a NULL in the key passes."""
    have = parent.select(*[F.col(k).alias(c) for k, c in zip(keys, columns)])
    return child.dropna(subset=columns).join(have, columns, "left_anti")


def _fk(child: str, columns: list[str], parent: str, show: list[str]):
    def findings(t: Tables) -> DataFrame:
        rows = t[child].select(*dict.fromkeys([*columns, *show]))
        return _detail(orphans(rows, columns, t[parent], PRIMARY_KEYS[parent]), *show)
    return findings


def _fk_any(child: str, parents: dict[str, str], show: list[str]):
    """Child rows missing at least one of several parents."""
    def findings(t: Tables) -> DataFrame:
        df = t[child].select(*show)
        missing = F.lit(False)
        for column, parent in parents.items():
            hit = f"has_{parent}"
            df = df.join(t[parent].select(PRIMARY_KEYS[parent][0]).withColumnRenamed(PRIMARY_KEYS[parent][0], column)
                         .withColumn(hit, F.lit(True)), column, "left")
            missing = missing | F.col(hit).isNull()
        return _detail(df.filter(missing), *show)
    return findings


# --- rules ------------------------------------------------------------------

def high_without_reason(t):
    return _detail(t["material_master"].filter(
        (F.col("criticality") == "HIGH") & (F.coalesce("criticality_reason_code", F.lit("")) == "")), "material_id")


def missing_tiers(t):
    empty = F.coalesce("confidentiality_tier", F.lit("")) == ""
    return _detail(t["material_master"].filter(empty).select(F.col("material_id").alias("id")).unionByName(
        t["vendor_master"].filter(empty).select(F.col("vendor_id").alias("id"))), "id")


def _blocked(t):
    return t["vendor_master"].filter(F.col("status") == "BLOCKED").select("vendor_id")


def blocked_sources(t):
    return _detail(t["source_list"].filter(F.col("approval_status") == "APPROVED").join(
        _blocked(t), "vendor_id", "left_semi"), "vendor_id", "material_id", "plant_id")


def split_alias_groups(t):
    return _detail(t["vendor_master"].filter(F.col("alias_group").isNotNull()).groupBy("alias_group").agg(
        F.countDistinct("legal_entity_id").alias("n")).filter("n > 1"), "alias_group")


def low_source_tiers(t):
    need = required_tiers(t["source_list"], t["vendor_master"], t["material_master"], t["contract_header"],
                          t["contract_item"])
    return _detail(need.filter(tier_value("confidentiality_tier") < tier_value("required_tier")),
                   "vendor_id", "material_id", "plant_id")


def uncovered_claims(t):
    cover = contract_coverage(t["contract_header"], t["contract_item"])
    return _detail(t["source_list"].filter("contract_covered_flag").join(
        cover, ["vendor_id", "material_id"], "left_anti"), "vendor_id", "material_id", "plant_id")


def blocked_orders(t):
    return _detail(t["po_header"].join(_blocked(t), "vendor_id", "left_semi"), "po_id")


def category_orphans(t, min_leaves: int = 45):
    cat = t["category_hierarchy"]
    lost = orphans(cat.select("category_id", "parent_category_id"), ["parent_category_id"], cat, ["category_id"])
    leaves = cat.agg(F.count_if(F.col("level") == 3).alias("n")).select(
        F.concat(F.lit("leaves="), F.col("n")).alias("detail"), (F.col("n") < min_leaves).alias("bad"))
    return _detail(lost, "category_id").unionByName(leaves)


def empty_tables(t, names: Iterable[str] = tuple(SCHEMAS)):
    """One finding per table; reads no more than one row of each."""
    return reduce(DataFrame.unionByName, [
        t[n].limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("detail"), (F.col("n") == 0).alias("bad"))
        for n in names]).filter("bad")


def row_targets(t, targets: Mapping[str, tuple[int, float]] | None = None):
    targets = targets or {"material_master": (800, 0.15), "vendor_master": (120, 0.15), "contract_header": (40, 0.20)}
    return reduce(DataFrame.unionByName, [
        _measured(t[n].agg(F.count(F.lit(1)).alias("n")), F.concat(F.lit(f"{n}="), F.col("n"), F.lit(f" target {goal}")),
                  F.abs(F.col("n") - goal) >= goal * share)
        for n, (goal, share) in targets.items()])


def leaf_range(t, low: int = 45, high: int = 55):
    return _measured(t["category_hierarchy"].agg(F.count_if(F.col("level") == 3).alias("n")),
                     F.concat(F.lit("leaves="), F.col("n")), ~F.col("n").between(low, high))


def criticality_mix(t):
    counts = t["material_master"].agg(*[F.count_if(F.col("criticality") == c).alias(c) for c in ("HIGH", "MEDIUM", "LOW")])
    return _measured(counts, F.concat(F.lit("HIGH="), "HIGH", F.lit(", MEDIUM="), "MEDIUM", F.lit(", LOW="), "LOW"),
                     F.lit(False))


def _share_check(df: DataFrame, condition: Column, low: float, high: float) -> DataFrame:
    n = df.agg(F.count_if(condition).alias("hits"), F.count(F.lit(1)).alias("n"))
    part = F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double"))
    return _measured(n, F.concat_ws("/", F.col("hits").cast("string"), F.col("n").cast("string")),
                     ~part.between(low, high))


def contract_share(t, low: float = 0.60, high: float = 0.85):
    return _share_check(t["po_line_item"], F.col("contract_id").isNotNull(), low, high)


def maverick_share(t, low: float = 0.02, high: float = 0.12):
    return _share_check(t["po_header"], F.col("maverick_flag"), low, high)


def match_share(t, low: float = 0.70, high: float = 0.95):
    return _share_check(t["invoice_header"], F.col("match_status") == "FULL_MATCH", low, high)


# --- scenarios ----------------------------------------------------------------

def single_sources(t, as_of: str = "2001-06-30", plants: list[str] | None = None, risk: int = 70, days: int = 60):
    lanes = t["source_list"] if plants is None else t["source_list"].filter(F.col("plant_id").isin(plants))
    lonely = lanes.groupBy("material_id", "plant_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("vendor_id").alias("vendor_id")).filter("n = 1")
    expiring = t["contract_header"].filter(F.datediff("valid_to", F.lit(as_of).cast("date")) <= days).join(
        t["contract_item"], "contract_id").select("vendor_id", "material_id").distinct()
    return _detail(
        lonely.join(t["material_master"].filter("criticality = 'HIGH'").select("material_id"), "material_id", "left_semi")
        .join(t["vendor_master"].filter(F.col("risk_score") > risk).select("vendor_id"), "vendor_id", "left_semi")
        .join(expiring, ["vendor_id", "material_id"], "left_semi"), "material_id", "plant_id")


def one_country_supply(t):
    pairs = t["source_list"].select("material_id", "vendor_id").distinct().join(
        t["vendor_master"].select("vendor_id", "country", "quality_score"), "vendor_id")
    return _detail(pairs.groupBy("material_id").agg(
        F.count(F.lit(1)).alias("vendors"), F.min("country").alias("lo"), F.max("country").alias("hi"),
        F.min("quality_score").alias("qlo"), F.max("quality_score").alias("qhi"),
    ).filter("vendors > 1 and lo = hi and qlo < qhi"), "material_id")


def public_bank_data(t):
    return _detail(t["vendor_master"].filter(
        (F.coalesce("bank_account", F.lit("")) != "") & (F.col("confidentiality_tier") == "PUBLIC")), "vendor_id")


def mixed_tiers(t):
    tiers = propagate_confidentiality(t["source_list"], t["vendor_master"], t["material_master"], t["contract_header"],
                                      t["contract_item"])
    return _detail(tiers.groupBy("material_id", "plant_id").agg(
        F.min("confidentiality_tier").alias("lo"), F.max("confidentiality_tier").alias("hi")).filter("lo <> hi"),
        "material_id", "plant_id")


def off_contract_materials(t, condition: str = "criticality = 'HIGH'"):
    return _detail(t["source_list"].join(t["material_master"].filter(condition).select("material_id"), "material_id", "left_semi")
                   .groupBy("material_id").agg(F.max("contract_covered_flag").alias("covered")).filter("not covered"), "material_id")


def alias_disagreement(t):
    """Members of one alias group in two entities, or of one entity in two alias groups."""
    v = t["vendor_master"].filter(F.col("alias_group").isNotNull())
    def split(by, other):
        return v.groupBy(by).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).filter("lo <> hi").select(
            F.col(by).alias("id"))
    return _detail(split("alias_group", "legal_entity_id").unionByName(split("legal_entity_id", "alias_group")), "id")


def sourcing_gaps(t):
    """Plants where a sourced material has neither a source nor a plant extension."""
    plants = t["plant"].agg(F.collect_set("plant_id").alias("p")).scalar()
    there = t["source_list"].select("material_id", "plant_id", F.lit(1).alias("sourced")).unionByName(
        t["material_plant_extension"].select("material_id", "plant_id", F.lit(0).alias("sourced")))
    # The set holds at most one entry per plant.
    seen = there.groupBy("material_id").agg(F.collect_set("plant_id").alias("seen"), F.max("sourced").alias("sourced"))
    return _detail(seen.filter("sourced = 1").select("material_id", F.explode(F.array_except(plants, "seen")).alias("plant_id")),
                   "material_id", "plant_id")


def long_lanes(t, days: int = 60):
    return _detail(t["source_list"].filter(F.col("lane_lead_time_days") >= days), "vendor_id", "material_id", "plant_id")


def excluded_groups(t, exclusions: Mapping[str, str] | None = None):
    rules = exclusions or {"PG02": "ELEC"}
    wrong = reduce(lambda a, b: a | b, [(F.col("purch_group_id") == g) & F.col("category_id").startswith(p)
                                        for g, p in rules.items()])
    return _detail(t["purchasing_group_category"].filter(wrong), "purch_group_id", "category_id")


def dear_contracts(t, ratio: str = "1.20"):
    return _detail(t["contract_item"].join(t["material_master"].select("material_id", "standard_cost"), "material_id").filter(
        F.col("agreed_price") > F.col("standard_cost") * F.lit(ratio).cast("decimal(6,4)")), "contract_id", "material_id")


def weak_conditional_vendors(t, quality: int = 70):
    return _detail(t["vendor_master"].filter((F.col("status") == "CONDITIONAL") & (F.col("quality_score") < quality)),
                   "vendor_id")


def cross_plant_lead_times(t):
    """Materials whose first-ranked sources at two plants have different lead times."""
    return _detail(t["source_list"].filter("preferred_rank = 1").groupBy("material_id").agg(
        F.count(F.lit(1)).alias("plants"), F.min("lane_lead_time_days").alias("lo"),
        F.max("lane_lead_time_days").alias("hi")).filter("plants > 1 and lo < hi"), "material_id")


def temporal_order(t):
    """Documents dated before the document they follow."""
    po = t["po_header"].select("po_id", "po_date")
    gr = t["gr_header"].select("po_id", "gr_date", "gr_id")
    inv = t["invoice_header"].select("invoice_id", "po_id", "invoice_date", "received_date")
    first = t["gr_header"].groupBy("po_id").agg(F.min("gr_date").alias("first_gr"))
    pay = t["payment"].select("payment_id", "payment_date").join(t["payment_invoice_link"].select("payment_id", "invoice_id"), "payment_id")
    parts = [
        gr.join(po, "po_id").filter("gr_date <= po_date").select("gr_id"),
        inv.join(first, "po_id").filter("invoice_date < first_gr").select("invoice_id"),
        inv.filter("received_date < invoice_date").select("invoice_id"),
        pay.join(inv, "invoice_id").filter("payment_date < received_date").select("payment_id"),
    ]
    return reduce(DataFrame.unionByName, [_detail(p, p.columns[0]) for p in parts])


def long_fields(t, names: Iterable[str] = tuple(SCHEMAS)):
    """Columns holding text longer than declared; one pass per table."""
    found = []
    for name in names:
        texts = [f.name for f in SCHEMAS[name] if isinstance(f.dataType, T.StringType)]
        widest = t[name].agg(*[F.max(F.length(c)).alias(c) for c in texts])
        long = widest.select(F.explode(F.array(*[
            F.struct(F.lit(f"{name}.{c}").alias("detail"), (F.coalesce(F.col(c), F.lit(0)) > MAX_LENGTH[c]).alias("bad"))
            for c in texts])).alias("x"))
        found.append(long.select("x.detail", "x.bad").filter("bad"))
    return reduce(DataFrame.unionByName, found)


def _fk_check(key: str, child: str, column: str, parent: str, show: list[str] | None = None) -> tuple[str, Check]:
    return key, Check(f"FK {child}.{column}", "FATAL", f"orphan {child} rows",
                      _fk(child, [column], parent, show or PRIMARY_KEYS[child]))


CHECKS: dict[str, Check] = dict([
    _fk_check("v01_fk_material_category", "material_master", "category_id", "category_hierarchy"),
    _fk_check("v02_fk_source_material", "source_list", "material_id", "material_master"),
    _fk_check("v03_fk_source_vendor", "source_list", "vendor_id", "vendor_master"),
    _fk_check("v04_fk_source_plant", "source_list", "plant_id", "plant"),
    _fk_check("v05_fk_contract_material", "contract_item", "material_id", "material_master"),
    _fk_check("v06_fk_contract_vendor", "contract_header", "vendor_id", "vendor_master"),
    _fk_check("v07_fk_vendor_entity", "vendor_master", "legal_entity_id", "legal_entity"),
    _fk_check("v08_fk_category_group", "purchasing_group_category", "purch_group_id", "purchasing_group"),
    _fk_check("v09_fk_group_category", "purchasing_group_category", "category_id", "category_hierarchy"),
    _fk_check("v10_fk_vendor_category", "vendor_category", "vendor_id", "vendor_master"),
    ("v11_fk_plant_extension", Check("FK material_plant_extension", "FATAL", "orphan material_plant_extension rows",
                                     _fk_any("material_plant_extension", {"material_id": "material_master", "plant_id": "plant"},
                                             ["material_id", "plant_id"]))),
    _fk_check("v12_fk_pr_material", "pr_line_item", "material_id", "material_master"),
    _fk_check("v13_fk_pr_plant", "pr_header", "plant_id", "plant"),
    _fk_check("v14_fk_po_vendor", "po_header", "vendor_id", "vendor_master"),
    _fk_check("v15_fk_gr_po", "gr_header", "po_id", "po_header"),
    _fk_check("v16_fk_invoice_po", "invoice_header", "po_id", "po_header"),
    _fk_check("v17_fk_payment_vendor", "payment", "vendor_id", "vendor_master"),
    ("v18_fk_payment_link", Check("FK payment_invoice_link", "FATAL", "orphan payment_invoice_link rows",
                                  _fk_any("payment_invoice_link", {"payment_id": "payment", "invoice_id": "invoice_header"},
                                          ["payment_id", "invoice_id"]))),
    ("v21_high_without_reason", Check("HIGH criticality needs reason", "FATAL", "HIGH materials without reason", high_without_reason)),
    ("v22_missing_tiers", Check("No missing tiers", "FATAL", "entities without tier", missing_tiers)),
    ("v23_blocked_sources", Check("Blocked vendor sourcing", "FATAL", "approved sources of blocked vendors", blocked_sources)),
    ("v24_split_alias_groups", Check("Alias group integrity", "FATAL", "alias groups across entities", split_alias_groups)),
    ("v25_low_source_tiers", Check("Source tier propagation", "FATAL", "source rows below required tier", low_source_tiers)),
    ("v26_uncovered_claims", Check("Contract coverage claims", "FATAL", "covered sources without active contract", uncovered_claims)),
    ("v27_blocked_orders", Check("No orders to blocked vendors", "FATAL", "orders to blocked vendors", blocked_orders)),
    ("v28_category_orphans", Check("Category tree", "FATAL", "category tree findings", category_orphans)),
    ("v29_empty_tables", Check("Tables not empty", "FATAL", "empty tables", empty_tables)),
    ("v30_row_targets", Check("Row targets", "WARNING", "tables off target", row_targets)),
    ("v31_leaf_range", Check("Leaf category range", "WARNING", "counts out of range", leaf_range)),
    ("v32_criticality_mix", Check("Criticality mix", "WARNING", "findings", criticality_mix)),
    ("v33_contract_share", Check("On-contract share", "WARNING", "shares out of range", contract_share)),
    ("v34_maverick_share", Check("Maverick share", "WARNING", "shares out of range", maverick_share)),
    ("v35_match_share", Check("Full-match share", "WARNING", "shares out of range", match_share)),
    ("v36_single_sources", Check("Single sources at risk", "WARNING", "critical single sources", single_sources)),
    ("v37_one_country_supply", Check("Supply from one country", "WARNING", "materials from one country", one_country_supply)),
    ("v38_public_bank_data", Check("Bank data not public", "FATAL", "public vendors with bank data", public_bank_data)),
    ("v39_mixed_tiers", Check("Mixed source tiers", "WARNING", "material plants with mixed tiers", mixed_tiers)),
    ("v40_off_contract_materials", Check("Off-contract materials", "WARNING", "materials without coverage", off_contract_materials)),
    ("v41_alias_disagreement", Check("Alias agreement", "FATAL", "disagreeing alias members", alias_disagreement)),
    ("v42_sourcing_gaps", Check("Sourcing gaps", "WARNING", "plants without source", sourcing_gaps)),
    ("v43_long_lanes", Check("Long lanes", "WARNING", "lanes with long lead time", long_lanes)),
    ("v44_excluded_groups", Check("Excluded groups", "FATAL", "groups with excluded categories", excluded_groups)),
    ("v45_dear_contracts", Check("Contract price above cost", "WARNING", "dear contract items", dear_contracts)),
    ("v46_weak_conditional_vendors", Check("Weak conditional vendors", "WARNING", "conditional vendors of low quality",
                                           weak_conditional_vendors)),
    ("v47_cross_plant_lead_times", Check("Cross-plant lead times", "WARNING", "materials with differing lead times",
                                         cross_plant_lead_times)),
    ("v49_temporal_order", Check("Document order", "WARNING", "documents out of order", temporal_order)),
    ("v50_long_fields", Check("Field lengths", "WARNING", "columns over length", long_fields)),
])


def run_checks(t: Tables, checks: Iterable[Check], keep: int = 10) -> DataFrame:
    """One result row per check: count of violations and the first ``keep`` details."""
    checks = list(checks)
    named = [c.findings(t).select(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"), F.lit(c.text).alias("text"),
                                  "detail", "bad") for c in checks]
    found = reduce(DataFrame.unionByName, named)
    # One empty finding per check, so a check without findings has a row as well.
    catalog = found.sparkSession.createDataFrame([(c.name, c.severity, c.text, None, False) for c in checks],
                                                 "check_name string, severity string, text string, detail string, bad boolean")
    counts = found.unionByName(catalog).groupBy("check_name", "severity", "text").agg(F.count_if("bad").alias("n")).withColumn(
        "d", F.lit(None).cast("array<struct<rn:int,detail:string>>"))
    # The rank filter is applied per task before the shuffle, so at most ten rows per check and task move.
    order = W.partitionBy("check_name", "severity", "text").orderBy(F.col("bad").desc(), "detail")
    first = found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep).groupBy("check_name", "severity", "text").agg(
        F.lit(None).cast("bigint").alias("n"), F.sort_array(F.collect_list(F.struct("rn", "detail"))).alias("d"))
    n = F.col("n")
    return counts.unionByName(first).groupBy("check_name", "severity", "text").agg(F.max("n").alias("n"), F.max("d").alias("d")).select(
        "check_name", "severity", (n == 0).alias("passed"), n.alias("violation_count"), F.concat_ws(" ", n.cast("string"), "text").alias("message"),
        F.coalesce(F.transform("d", lambda x: x["detail"]), F.array().cast("array<string>")).alias("details"))


def run_suite(t: Tables, checks: Iterable[Check] | None = None) -> DataFrame:
    return run_checks(t, CHECKS.values() if checks is None else checks)


def suite_summary(results: DataFrame) -> DataFrame:
    """Checks per severity and outcome; ``gate_ok`` is false while a FATAL check fails."""
    failed = F.count_if((F.col("severity") == "FATAL") & ~F.col("passed"))
    return results.groupBy("severity", "passed").agg(
        F.count(F.lit(1)).alias("checks"), F.sum("violation_count").alias("violations"), (failed == 0).alias("gate_ok"))


def _key_text(columns: list[str]) -> Column:
    """A key as one text, its parts with their lengths in front so that different keys differ; NULL if a part is."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for c in parts for x in (F.length(c).cast("string"), F.lit(":"), c)])


def foreign_key_report(t: Tables) -> DataFrame:
    """Orphans of every declared relationship.

    Each child table is read once: all of its keys are counted in one pass, by relationship and value, and most tables point at few parents. Each set of parent
    keys is read once as well, and one join tells which counted keys have no parent.
    """
    targets = {fk: (fk[2], ",".join(parent_columns(fk))) for fk in map(_hashable, FOREIGN_KEYS)}
    numbers = {target: k for k, target in enumerate(dict.fromkeys(targets.values()))}
    relations = list(targets)
    children = {}
    for k, fk in enumerate(relations):
        children.setdefault(fk[0], []).append(F.struct(F.lit(k).alias("relation"), F.lit(numbers[targets[fk]]).alias("target"), _key_text(list(fk[1])).alias("key")))
    used = reduce(DataFrame.unionByName, [
        t[child].select(F.inline(F.array(*keys))).filter(F.col("key").isNotNull()).groupBy("relation", "target", "key").agg(F.count(F.lit(1)).alias("n"))
        for child, keys in children.items()])
    parents = {}
    for (parent, columns), k in numbers.items():
        parents.setdefault(parent, []).append(F.struct(F.lit(k).alias("target"), _key_text(columns.split(",")).alias("key")))
    known = reduce(DataFrame.unionByName, [t[parent].select(F.inline(F.array(*keys))) for parent, keys in parents.items()])
    # An anti join would be pushed into every branch of the union, and the parents read for each child.
    lost = used.join(known.withColumn("hit", F.lit(True)), ["target", "key"], "left").filter("hit is null").groupBy("relation").agg(F.sum("n").alias("orphans"))
    names = t[relations[0][0]].sparkSession.createDataFrame(
        [(k, fk[0], ",".join(fk[1]), fk[2]) for k, fk in enumerate(relations)], "relation int, child_table string, child_columns string, parent_table string")
    return names.join(lost, "relation", "left").select("child_table", "child_columns", "parent_table", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans"))


def _hashable(fk: tuple) -> tuple:
    return tuple(tuple(x) if isinstance(x, list) else x for x in fk)


def primary_key_report(t: Tables, names: Iterable[str] | None = None) -> DataFrame:
    """Repeated and incomplete keys of every table."""
    parts = []
    for name in names or PRIMARY_KEYS:
        keys = PRIMARY_KEYS[name]
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        sizes = t[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        parts.append(sizes.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"),
                               F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_keys")).select(
            F.lit(name).alias("table_name"), "repeated_keys", "null_keys"))
    return reduce(DataFrame.unionByName, parts)
