"""Walks over the category tree, of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_closure(categories: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) pairs, each node being its own ancestor at depth 0.

    A recursive query climbs from every node until no parent is known. A cycle in the data is an error: it
    runs into ``spark.sql.cteRecursionLevelLimit``.
    """
    return categories.sparkSession.sql("""
        with recursive up(ancestor, descendant, depth) as (
          select category_id, category_id, 0 from {nodes}
          union all
          select p.category_id, up.descendant, up.depth + 1 from up
          join {nodes} c on c.category_id = up.ancestor join {nodes} p on p.category_id = c.parent_category_id)
        select ancestor, descendant, depth from up""", nodes=categories.select("category_id", "parent_category_id"))


def category_root(categories: DataFrame) -> DataFrame:
    """Top-level category of every node."""
    return category_closure(categories).groupBy(F.col("descendant").alias("category_id")).agg(
        F.max_by("ancestor", "depth").alias("root_category_id"))


def purch_group_for(categories: DataFrame) -> DataFrame:
    """Responsible group: the owner of the nearest ancestor that has one."""
    owners = categories.filter(F.col("owner_purch_group_id").isNotNull()).select(
        F.col("category_id").alias("ancestor"), "owner_purch_group_id")
    nearest = category_closure(categories).join(owners, "ancestor").groupBy(
        F.col("descendant").alias("category_id")).agg(F.min_by("owner_purch_group_id", "depth").alias("purch_group_id"))
    return categories.select("category_id").join(nearest, "category_id", "left")
