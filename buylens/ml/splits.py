"""Train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buylens.graph.views import sequential_ids


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, repeat: int = 0) -> DataFrame:
    """Fold 0..k-1 with each label spread evenly, the same for the same repeat.

    Rows are numbered in the order of label and a hash of the key; a label is one run of
    numbers, so number mod k deals it out evenly.
    """
    salted = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{repeat}")).cast("binary")))
    return sequential_ids(salted, [label, "_h", key], "_n").withColumn("fold", (F.col("_n") % k).cast("int")).drop("_h", "_n")


def temporal_split(df: DataFrame, date: str, validation_from: str, test_from: str) -> DataFrame:
    day = F.col(date)
    return df.withColumn("split", F.when(day < F.lit(validation_from).cast("date"), "TRAIN")
                         .when(day < F.lit(test_from).cast("date"), "VALIDATION").otherwise("TEST"))


def expanding_folds(df: DataFrame, date: str, k: int = 5) -> DataFrame:
    """Fold j trains on the first j of k + 1 stretches of months and validates on the next."""
    month = F.trunc(date, "month")
    months = df.select(month.alias("_m")).distinct()
    # One row per calendar month.
    stretch = months.withColumn("_stretch", F.ntile(k + 1).over(W.orderBy("_m")))
    folds = F.explode(F.sequence(F.lit(1), F.lit(k)))
    return (df.withColumn("_m", month).join(stretch, "_m").withColumn("fold", folds)
            .filter(F.col("_stretch") <= F.col("fold") + 1)
            .withColumn("role", F.when(F.col("_stretch") <= F.col("fold"), "TRAIN").otherwise("VALIDATION")).drop("_m", "_stretch"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) and the ratio of other rows to the class's own."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()  # one row per class
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"),
                         ((F.sum("n").over(every) - F.col("n")) / F.col("n")).alias("other_ratio"))


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Each row with the weight of its class. There is one row per class, which goes to the rows, never the rows to it; a row without a label has no class."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)
