"""Master-data use cases: spend classification and confidentiality tiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.functions.columns import CRITICALITY, flag, ordinal, tier_value
from buylens.operators.confidentiality import required_tiers
from buylens.operators.contracts import active_items
from buylens.operators.statistics import FIVE, group_quantiles
from buylens.session import splittable

Tables = Mapping[str, DataFrame]


def usual_categories(pairs: DataFrame, vendor_categories: DataFrame) -> DataFrame:
    """The category that most vendors of a material have, the least name of equally common ones.

    A vendor's categories are bits of numbered words, 64 categories each, and a second set where a category is listed again. Pairs of material and vendor
    move with those to the material, where they are counted: the many triples of material, vendor and category never move.
    """
    codes = vendor_categories.select("category_id").distinct().withColumn("code", F.row_number().over(W.orderBy("category_id")))  # one row per category
    listed = vendor_categories.join(codes, vendor_categories["category_id"].eqNullSafe(codes["category_id"])).select("vendor_id", "code")
    words = listed.withColumn("time", F.row_number().over(W.partitionBy("vendor_id", "code").orderBy("code"))).groupBy(
        "vendor_id", "time", F.expr("code div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, code % 64)")).alias("bits"))
    sets = splittable(words.groupBy("vendor_id").agg(F.collect_list(F.struct("word", "bits")).alias("words")))
    votes = pairs.join(sets, "vendor_id").select("material_id", "words").repartition("material_id").select("material_id", F.inline("words")).select(
        "material_id", F.explode(F.expr("transform(filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1), i -> word * 64 + i)")).alias("code"))
    most = votes.groupBy("material_id", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("material_id").agg(
        F.min_by("code", F.struct((-F.col("n")).alias("n"), "code")).alias("code"))
    return most.join(codes, "code").select("material_id", F.col("category_id").alias("uc12_vendor_categories"))


def uc12_features(t: Tables, cost_cuts: tuple[int, ...] = (4600, 4700, 4800, 4900)) -> DataFrame:
    """Category by lookup with type, cost bin, unit and the usual category of the vendors."""
    usual = usual_categories(t["source_list"].select("material_id", "vendor_id").distinct(), t["vendor_category"])
    bin_no = sum((flag(F.col("standard_cost") >= c) for c in cost_cuts), F.lit(0))
    return t["material_master"].join(usual, "material_id", "left").select(
        "material_id", "category_id", F.col("material_type").alias("uc12_material_type"), bin_no.alias("uc12_standard_cost_range"),
        F.col("base_uom").alias("uc12_uom"), "uc12_vendor_categories")


def category_profile(t: Tables, quality: int = 70) -> DataFrame:
    """Cost range, size and good vendors of every category."""
    cost = group_quantiles(t["material_master"].select("category_id", "standard_cost"), ["category_id"], "standard_cost", FIVE)
    good = t["source_list"].select("material_id", "vendor_id").distinct().join(
        t["vendor_master"].filter(F.col("quality_score") >= quality).select("vendor_id"), "vendor_id", "left_semi").join(
        t["material_master"].select("material_id", "category_id"), "material_id").groupBy("category_id").agg(
        F.countDistinct("vendor_id").alias("good_vendors"))
    return cost.join(good, "category_id", "left").na.fill(0, ["good_vendors"])


def uc13_features(t: Tables) -> DataFrame:
    """Tier signals of source-list rows."""
    covered = active_items(t["contract_header"], t["contract_item"]).select("material_id").distinct().withColumn("hit", F.lit(1))
    return (t["source_list"].select("material_id", "plant_id", "vendor_id")
            .join(t["material_master"].select("material_id", "hazmat_flag", "material_type", "criticality"), "material_id")
            .join(t["vendor_master"].select("vendor_id", "confidentiality_tier", "bank_account"), "vendor_id")
            .join(covered, "material_id", "left").select(
        "material_id", "plant_id", "vendor_id", flag(F.col("hazmat_flag")).alias("uc13_is_hazmat"), F.col("material_type").alias("uc13_material_type"),
        F.col("confidentiality_tier").alias("uc13_vendor_tier"), flag(F.coalesce("bank_account", F.lit("")) != "").alias("uc13_has_bank_info"),
        ordinal("criticality", CRITICALITY).alias("uc13_criticality"), F.coalesce("hit", F.lit(0)).alias("uc13_contract_exists")))


def tier_discrepancies(t: Tables) -> DataFrame:
    """Materials stored in another tier than the rule's, and source rows below what they inherit."""
    rule = F.when(F.col("hazmat_flag"), "RESTRICTED").when(F.col("material_type") == "SERVICE", "PUBLIC").otherwise("INTERNAL")
    materials = t["material_master"].select(
        F.lit("MATERIAL").alias("entity"), F.col("material_id").alias("entity_id"), F.col("confidentiality_tier").alias("stored_tier"),
        rule.alias("rule_tier")).filter(F.coalesce("stored_tier", F.lit("")) != F.col("rule_tier"))
    need = required_tiers(t["source_list"], t["vendor_master"], t["material_master"], t["contract_header"], t["contract_item"])
    sources = need.filter(tier_value("confidentiality_tier") < tier_value("required_tier")).select(
        F.lit("SOURCE").alias("entity"), F.concat_ws("@", "vendor_id", "material_id", "plant_id").alias("entity_id"),
        F.col("confidentiality_tier").alias("stored_tier"), F.col("required_tier").alias("rule_tier"))
    return materials.unionByName(sources)
