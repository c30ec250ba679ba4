"""Class distribution, imbalance measures and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions.sizing import bounded_rows, lookup_join

def whole():
    """The frame of a whole per-class table."""
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def class_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows and percent per class."""
    return class_counts(df).withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(whole()))


def imbalance(df: DataFrame) -> DataFrame:
    """One row: samples, classes, smallest and largest class, max/min ratio.

    The ratio is 1.0 with fewer than two classes.
    """
    return class_counts(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples"),
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("min_class"),
        F.max("n").alias("max_class"),
        F.when(F.count(F.lit(1)) < 2, F.lit(1.0)).otherwise(F.max("n").cast("double") / F.min("n")).alias("ratio"),
    )


def recommend_strategy(ratio: Column) -> Column:
    return (
        F.when(ratio < fv.RATIO_CLASS_WEIGHTS, "none").when(ratio < fv.RATIO_SMOTE, "class_weights").otherwise("smote")
    )


def should_apply_smote(ratio: Column, threshold: float = fv.SMOTE_TRIGGER) -> Column:
    return ratio > threshold


def class_weights(df: DataFrame, strategy: str = "balanced", custom: dict | None = None) -> DataFrame:
    """(label, weight): balanced n/(C*n_c), uniform 1.0, or the given map."""
    counts = class_counts(df)
    if strategy == "balanced":
        weight = F.sum("n").over(whole()) / (F.count(F.lit(1)).over(whole()) * F.col("n").cast("double"))
    elif strategy == "uniform":
        weight = F.lit(1.0)
    elif strategy == "custom":
        if not custom:
            raise ValueError("the custom strategy needs a map of weights")
        rows = [(int(k), float(v)) for k, v in custom.items()]
        return df.sparkSession.createDataFrame(rows, "label int, weight double")
    else:
        raise ValueError(f"unknown weighting strategy: {strategy}")
    return counts.select("label", weight.alias("weight"))


def normalize_weights(weights: DataFrame) -> DataFrame:
    """Weights scaled to sum to the number of classes; all 1.0 when they sum to 0."""
    total = F.sum("weight").over(whole())
    scaled = F.col("weight") * F.count(F.lit(1)).over(whole()) / total
    return weights.withColumn("weight", F.when(total == 0, F.lit(1.0)).otherwise(scaled))


def attach_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Per-sample weight from its class; classes without a weight get 0.0."""
    return lookup_join(df, weights, ["label"]).withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def missing_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(label, missing_in): classes that one of two tables lacks."""
    a, b = left.select("label").distinct(), right.select("label").distinct()
    return a.join(b, "label", "left_anti").withColumn("missing_in", F.lit("right")).unionByName(
        b.join(a, "label", "left_anti").withColumn("missing_in", F.lit("left"))
    )


def count_map(df: DataFrame, key: str = "label") -> dict:
    """Rows per class on the driver; at most one entry per class code."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return {r[0]: r[1] for r in bounded_rows(counts)}
