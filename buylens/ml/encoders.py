"""Feature encodings; statistics are taken from the frame in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import cyclical, flag, one_hot, ordinal
from buylens.operators.statistics import group_quantiles


def encode_ordinal(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Integer code per value, -1 for unknown and NULL."""
    return df.withColumn(f"{column}_ord", ordinal(column, mapping))


def encode_onehot(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Indicator columns over a fixed domain in place of the column."""
    return df.select(*[c for c in df.columns if c != column], *one_hot(column, domain, column))


def encode_cyclical(df: DataFrame, column: str, period: int) -> DataFrame:
    return df.select("*", *cyclical(column, period, column))


def _stats(df: DataFrame, column: str) -> Column:
    x = F.col(column).cast("double")
    return df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()


def encode_zscore(df: DataFrame, column: str) -> DataFrame:
    s = _stats(df, column)
    return df.withColumn(f"{column}_z", F.try_divide(F.col(column).cast("double") - s["mean"], s["std"]))


def encode_minmax(df: DataFrame, column: str) -> DataFrame:
    s = _stats(df, column)
    return df.withColumn(f"{column}_01", F.try_divide(F.col(column).cast("double") - s["lo"], s["hi"] - s["lo"]))


def encode_log(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_log", F.log1p(F.col(column).cast("double")))


def encode_missing(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_missing", flag(F.col(column).isNull()))


def encode_median(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Fill NULLs with the exact median, of the group where one is named."""
    if by is None:
        median = group_quantiles(df.select(F.lit(1).alias("g"), column), ["g"], column, {"m": 0.5}).agg(F.max("m")).scalar()
        return df.withColumn(f"{column}_filled", F.coalesce(F.col(column).cast("double"), median))
    medians = group_quantiles(df.select(by, column), [by], column, {"m": 0.5}).drop("n")
    return df.join(medians, by, "left").withColumn(f"{column}_filled", F.coalesce(F.col(column).cast("double"), "m")).drop("m")


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the saved feature columns in their order; one that is missing is 0."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(0.0)).cast("double").alias(c) for c in columns])
