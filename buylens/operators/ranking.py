"""Running totals over a whole table without moving it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.session import cut_lineage, splittable


def ranks_within(df: DataFrame, by: str, order: list[Column | str], name: str) -> DataFrame:
    """Rank of each row inside its group, from 1, however large the group is."""
    placed = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), [by, *order], {"_at": "_one"})
    first = placed.groupBy(by).agg((F.min("_at") - 1).alias("_before"))
    return placed.join(splittable(first), by).withColumn(name, (F.col("_at") - F.col("_before")).cast("int")).drop("_one", "_at", "_before")


def running_totals(df: DataFrame, order: list[Column | str], values: dict[str, str]) -> DataFrame:
    """Inclusive running sums of ``values`` (new name -> column) in the given order.

    The rows are range-partitioned and written with their partition, so a repeated task sees the same
    partitions; each partition then needs only the sum of the partitions before it.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = cut_lineage(df.withColumns({f"_o{i}": k for i, k in enumerate(keys)}).repartitionByRange(
        *[f"_o{i}" for i in range(len(keys))]).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in values.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = W.partitionBy("_part").orderBy(*[f"_o{i}" for i in range(len(keys))]).rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumns({f"_r_{n}": F.sum(c).over(inside) for n, c in values.items()}).join(F.broadcast(offsets), "_part")
    out = out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_b_{n}") for n in values})
    return out.drop("_part", *[f"_o{i}" for i in range(len(keys))], *[f"_r_{n}" for n in values], *[f"_b_{n}" for n in values])
