"""Units, aliases and keyed lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buylens.schemas import PRIMARY_KEYS


def convert_uom(df: DataFrame, conversions: DataFrame, quantity: str, from_uom: str, to_uom: str) -> DataFrame:
    """Quantity in ``to_uom``; rows without a conversion keep quantity and unit."""
    rules = conversions.filter(F.col("to_uom") == to_uom).select("material_id", F.col("from_uom").alias(from_uom),
                                                                 "conversion_factor")
    factor = F.coalesce("conversion_factor", F.lit(1).cast("decimal(10,4)"))
    return df.join(rules, ["material_id", from_uom], "left").withColumn(
        "converted_quantity", F.round(F.col(quantity) * factor, 4).cast("decimal(18,4)")).withColumn(
        "converted_uom", F.when(F.col("conversion_factor").isNotNull(), to_uom).otherwise(F.col(from_uom))).drop(
        "conversion_factor")


def alias_groups(vendors: DataFrame, by: str = "legal_entity_id") -> DataFrame:
    """Vendors that share a legal entity (or alias group), one row per member."""
    sizes = vendors.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("group_size"))
    return vendors.select("vendor_id", by, "alias_group" if by != "alias_group" else "legal_entity_id").join(
        sizes.filter("group_size > 1"), by)


def lookup_rows(t: Mapping[str, DataFrame], table: str, **keys) -> DataFrame:
    """Rows of a table whose columns equal the given values; the filter reaches the scan."""
    df = t[table]
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def id_set(t: Mapping[str, DataFrame], table: str, condition: str | None = None) -> DataFrame:
    df = t[table] if condition is None else t[table].filter(condition)
    return df.select(*PRIMARY_KEYS[table]).distinct()
