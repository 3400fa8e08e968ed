"""Drift of features, predictions and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.functions.columns import flag, ratio, share
from buylens.session import splittable


def psi(base: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, epsilon: float = 1e-4, limit: float = 0.2) -> DataFrame:
    """Population stability index per column over equal-width bins of the base range.

    Values outside the base range go to the first or last bin.
    """
    def long(df: DataFrame, period: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.explode(pairs).alias("x")).select("x.column_name", "x.v", F.lit(period).alias("period")).filter("v is not null")
    old = long(base, 0)
    ends = old.groupBy("column_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0))))
    cells = old.unionByName(long(current, 1)).join(ends, "column_name").groupBy("column_name", place.alias("bin")).agg(
        F.sum(flag(F.col("period") == 0)).alias("b"), F.sum(F.col("period")).alias("c"))
    # At most `bins` cells per column.
    total = W.partitionBy("column_name")
    p = F.greatest(ratio(F.col("b"), F.sum("b").over(total)), F.lit(epsilon))
    q = F.greatest(ratio(F.col("c"), F.sum("c").over(total)), F.lit(epsilon))
    return cells.select("column_name", ((q - p) * F.log(q / p)).alias("part")).groupBy("column_name").agg(F.sum("part").alias("psi")).withColumn(
        "alert", F.col("psi") > limit)


def rate_drift(df: DataFrame, date: str, positive: Column, period: str = "week", limit: float = 0.10) -> DataFrame:
    """Positive rate per period, its shift, and an alert where the shift is above the limit."""
    rates = df.groupBy(F.date_trunc(period, F.col(date).cast("timestamp")).cast("date").alias("period_start")).agg(
        F.count(F.lit(1)).alias("n"), share(positive).alias("rate"))
    shift = F.col("rate") - F.lag("rate").over(W.orderBy("period_start"))  # one row per period
    return rates.withColumn("shift", shift).withColumn("alert", F.coalesce(F.abs("shift") > limit, F.lit(False)))


def multivariate_outliers(df: DataFrame, by: str, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Distance of each row from the mean of its group, in deviations of each column."""
    stats = df.groupBy(by).agg(*[x for c in columns for x in (
        F.avg(F.col(c).cast("double")).alias(f"_m_{c}"), F.stddev_samp(F.col(c).cast("double")).alias(f"_s_{c}"))])
    z2 = [F.coalesce(F.pow(F.try_divide(F.col(c).cast("double") - F.col(f"_m_{c}"), F.when(F.col(f"_s_{c}") > 1e-9, F.col(f"_s_{c}"))), 2), F.lit(0.0))
          for c in columns]
    distance = F.sqrt(reduce(lambda a, b: a + b, z2))
    return df.join(splittable(stats), by).withColumn("distance", distance).withColumn("outlier", F.col("distance") > limit).drop(
        *[f"_{k}_{c}" for c in columns for k in "ms"])


def mahalanobis(df: DataFrame, by: str, columns: list[str], limit: float = 3.0, least: float = 1e-9) -> DataFrame:
    """Distance of each row from the mean of its group in the metric of the group's covariance.

    A row that breaks the columns' usual relation is far away even if each of its values is common. Means and products come from two aggregates per group;
    the covariance's Cholesky factor is worked out on one row per group, the distance by forward substitution on each row. A column that others determine
    (a pivot below ``least`` of its variance) adds nothing. Rows with a null have a null distance.
    """
    k = range(len(columns))
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in x])
    means = splittable(df.filter(whole).groupBy(by).agg(*[F.avg(v).alias(f"_m{i}") for i, v in zip(k, x)]))
    centred = df.join(means, by, "left").withColumns({f"_d{i}": v - F.col(f"_m{i}") for i, v in zip(k, x)})
    products = [F.covar_samp(x[i], x[j]).alias(f"_c{i}_{j}") for i in k for j in range(i + 1)]
    factor = df.filter(whole).groupBy(by).agg(*products)
    for i in k:
        for j in range(i + 1):
            rest = reduce(lambda a, b: a - b, [F.col(f"_l{i}_{m}") * F.col(f"_l{j}_{m}") for m in range(j)], F.col(f"_c{i}_{j}"))
            if i == j:
                factor = factor.withColumn(f"_l{i}_{i}", F.when(rest > least * F.col(f"_c{i}_{i}"), F.sqrt(rest)).otherwise(0.0))
            else:
                factor = factor.withColumn(f"_l{i}_{j}", F.coalesce(F.try_divide(rest, F.when(F.col(f"_l{j}_{j}") > 0, F.col(f"_l{j}_{j}"))), F.lit(0.0)))
    out = centred.join(splittable(factor.select(by, *[f"_l{i}_{j}" for i in k for j in range(i + 1)])), by, "left")
    for i in k:
        rest = reduce(lambda a, b: a - b, [F.col(f"_l{i}_{m}") * F.col(f"_z{m}") for m in range(i)], F.col(f"_d{i}"))
        out = out.withColumn(f"_z{i}", F.coalesce(F.try_divide(rest, F.when(F.col(f"_l{i}_{i}") > 0, F.col(f"_l{i}_{i}"))), F.when(rest.isNotNull(), 0.0)))
    distance = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"_z{i}") * F.col(f"_z{i}") for i in k]))
    return out.withColumn("distance", distance).withColumn("outlier", F.col("distance") > limit).select(*[f"`{c}`" for c in df.columns], "distance", "outlier")
