"""Exploratory statistics as DataFrames."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from buylens.functions.columns import flag, mean, ratio, share
from buylens.functions.distributions import chi_square_p, correlation_p
from buylens.graph.views import sequential_ids
from buylens.operators.ranking import running_totals
from buylens.session import splittable


def _domain(df: DataFrame, column: str, domain: list) -> DataFrame:
    rows = [(n, v) for n, v in enumerate(domain)]
    kind = df.schema[column].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"position int, {column} {kind}")


def value_counts(df: DataFrame, column: str, domain: list | None = None) -> DataFrame:
    """Rows and percent per value; with a domain every value appears, in its order."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if domain is not None:
        counts = _domain(df, column, domain).join(counts, column, "left").na.fill(0, ["n"])
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn("percent", ratio(F.col("n") * 100, total))


def monthly_volume(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.trunc(date, "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str | Column, b: str, domain: list, name: str = "row_key") -> DataFrame:
    """Counts with one column per value of the fixed domain."""
    key = F.col(a) if isinstance(a, str) else a
    return df.withColumn(name, key).groupBy(name).pivot(b, domain).count().na.fill(0)


def crosstab_pct(df: DataFrame, a: str, b: str, domain: list) -> DataFrame:
    """Row percentages with one column per value of the fixed domain."""
    n = F.count(F.lit(1))
    return df.groupBy(F.col(a).alias("row_key")).agg(*[
        ratio(F.sum(flag(F.col(b) == v)) * 100, n).alias(str(v)) for v in domain])


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs with both margins and the total; margins carry level > 0."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def rate_by(df: DataFrame, key: str, condition: Column, min_n: int = 1, attributes: DataFrame | None = None) -> DataFrame:
    """Rows and rate per key with at least ``min_n`` rows; ``attributes`` has one row per key, whose columns are added after counting."""
    rates = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), share(condition).alias("rate")).filter(F.col("n") >= min_n)
    return rates if attributes is None else rates.join(attributes, key, "left")


def group_quantiles(df: DataFrame, by: list[str], x: str, probabilities: dict[str, float], count: str | None = None) -> DataFrame:
    """Exact quantiles per group with linear interpolation, and the group's row count ``n``; a row stands for ``count`` rows if given.

    Equal values are merged first. All groups' values are then put in one global order by range partitions, so a group of any
    size is ranked by as many tasks as it fills.
    """
    values = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("x")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("c"))
    ranked = running_totals(values, [*by, "x"], {"upto": "c"})
    groups = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("_before"))
    ranked = ranked.join(splittable(groups), by).withColumn("hi", F.col("upto") - F.col("_before")).withColumn("lo", F.col("hi") - F.col("c"))
    outs, lows, highs = [], [], []
    for name, p in probabilities.items():
        pos = F.lit(p) * (F.col("n") - 1)
        lo_rank, hi_rank = F.floor(pos), F.ceil(pos)
        at = lambda k: F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col("x").cast("double"))
        lows.append(F.max(at(lo_rank)).alias(f"_lo_{name}"))
        highs.append(F.max(at(hi_rank)).alias(f"_hi_{name}"))
        outs.append((F.col(f"_lo_{name}") + (pos - F.floor(pos)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return ranked.groupBy(*by, "n").agg(*lows, *highs).select(*by, "n", *outs)


FIVE = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}


def five_number(df: DataFrame, by: str, x: str) -> DataFrame:
    return group_quantiles(df, [by], x, FIVE)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation, its t statistic and the two-sided p-value; t is null for a perfect correlation, whose p is 0."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = both.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r")))
    return r.withColumn("t_statistic", t).withColumn("p_value", correlation_p(F.col("r"), F.col("n")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Test of independence on the contingency table: statistic, degrees of freedom, p-value."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    # Empty cells add their expected count; all expected counts add up to n.
    joined = cells.join(rows, "a").join(cols, "b")
    n = cells.agg(F.sum("o").alias("n")).scalar()
    expected = F.col("ra") * F.col("cb") / n
    stat = joined.agg(
        (F.sum(F.pow(F.col("o") - expected, 2) / expected) + F.first(n) - F.sum(expected)).alias("chi2"),
        ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).cast("bigint").alias("dof"))
    return stat.withColumn("p_value", chi_square_p(F.col("chi2"), F.col("dof")))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair in long form, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("p")).select("p.x", "p.y", "p.r")


def histogram(df: DataFrame, x: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins over the whole range; the maximum falls into the last bin."""
    rows = df.filter(F.col(x).isNotNull()).withColumn("_x", F.col(x).cast("double"))
    ends = rows.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("e")).scalar()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / F.lit(bins)
    bucket = F.least(F.coalesce(F.floor(F.try_divide(F.col("_x") - lo, width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    keys = [bucket.alias("bin")] + ([F.col(by)] if by else [])
    return rows.select("*", lo.alias("_lo"), width.alias("_w")).groupBy(*keys, "_lo", "_w").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", *([by] if by else []), (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), "n")


def null_report(df: DataFrame) -> DataFrame:
    """NULLs per column, counted in one pass."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(flag(F.col(c).isNull())).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("nulls")) for c in names])
    return one.select("_n", F.explode(pairs).alias("p")).select(
        "p.column_name", "p.nulls", ratio(F.col("p.nulls") * 100, F.col("_n")).alias("percent"))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"))
                                         for c in columns])).alias("p")).select("p.column_name", "p.v")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per column, in long form."""
    long = _long(df, columns)
    moments = long.groupBy("column_name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return moments.join(group_quantiles(long, ["column_name"], "v", FIVE).drop("n"), "column_name", "left")


def rate_by_band(df: DataFrame, x: str, cuts: list[int], condition: Column) -> DataFrame:
    """Rate per band of ``x``; band k holds values below cuts[k], the last one the rest."""
    band = reduce(lambda acc, i: acc.when(F.col(x) < cuts[i], i), range(1, len(cuts)), F.when(F.col(x) < cuts[0], 0)).otherwise(len(cuts))
    return df.filter(F.col(x).isNotNull()).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), share(condition).alias("rate"))


def risk_curve(scores: DataFrame, score: str, key: str) -> DataFrame:
    """Rank 1 is the highest score; ranked across tasks."""
    ordered = scores.select((-F.col(score)).alias("_neg"), key, F.col(score))
    return sequential_ids(ordered, ["_neg", key], "rank").drop("_neg")


def stratified_sample(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """Up to ``n`` rows per class, the same ones each time; the limit is applied per task first."""
    order = W.partitionBy(by).orderBy(F.md5(F.col(key).cast("binary")), key)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def weighted_mean(x: str, w: str) -> Column:
    return ratio(F.sum(F.col(x) * F.col(w)), F.sum(w))
