"""Window functions over (key, date, tie) that stay spread when one key is hot.

A plain window puts all rows of a key into one task. Here rows are ranked inside a key and
day, and the days of a key, one row each, carry what has to pass from day to day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _days(keys: list[str], date: str):
    return W.partitionBy(*keys).orderBy(date)


def _inside(keys: list[str], date: str, tie: list[str]):
    return W.partitionBy(*keys, date).orderBy(*tie)


def sequence(df: DataFrame, keys: list[str], date: str, tie: list[str], name: str) -> DataFrame:
    """Number the rows of each key by date and tie, from one."""
    before = F.sum("_n").over(_days(keys, date).rowsBetween(W.unboundedPreceding, -1))
    offsets = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, date, F.coalesce(before, F.lit(0)).alias("_offset"))
    return (df.withColumn("_rn", F.row_number().over(_inside(keys, date, tie))).join(offsets, [*keys, date])
            .withColumn(name, (F.col("_offset") + F.col("_rn")).cast("bigint")).drop("_rn", "_offset"))


def previous(df: DataFrame, keys: list[str], date: str, tie: list[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row before, in the order of date and tie."""
    last = df.groupBy(*keys, date).agg(F.max_by(value, F.struct(*tie)).alias("_last"))
    carried = last.select(*keys, date, F.lag("_last").over(_days(keys, date)).alias("_carried"))
    inside = _inside(keys, date, tie)
    return (df.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_prev", F.lag(value).over(inside))
            .join(carried, [*keys, date])
            .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
            .drop("_first", "_prev", "_carried"))


def last_date_before(df: DataFrame, keys: list[str], date: str, condition: Column, name: str) -> DataFrame:
    """Latest earlier day on which the condition held for the key."""
    days = df.groupBy(*keys, date).agg(F.max(F.when(condition, F.col(date))).alias("_hit"))
    earlier = F.last("_hit", ignorenulls=True).over(_days(keys, date).rowsBetween(W.unboundedPreceding, -1))
    return df.join(days.select(*keys, date, earlier.alias(name)), [*keys, date])


def nearby_count(df: DataFrame, keys: list[str], date: str, days: int, name: str) -> DataFrame:
    """Other rows of the key within so many days before or after."""
    number = F.unix_date(F.col(date))
    span = W.partitionBy(*keys).orderBy("_day").rangeBetween(-days, days)
    counts = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", number)
    totals = counts.select(*keys, date, F.sum("_n").over(span).alias("_total"))
    return df.join(totals, [*keys, date]).withColumn(name, F.col("_total") - 1).drop("_total")


def running_level(changes: DataFrame, keys: list[str], date: str, amount: str, name: str) -> DataFrame:
    """Running sum of signed changes per key, one row per day on which something changed."""
    daily = changes.groupBy(*keys, date).agg(F.sum(amount).alias("_d"))
    return daily.select(*keys, date, F.sum("_d").over(_days(keys, date).rowsBetween(W.unboundedPreceding, 0)).alias(name))
