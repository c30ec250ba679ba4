"""Checks of training data and previews of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions import geometry as geo


def duplicate_features(polygons: DataFrame) -> DataFrame:
    """One row: repeats of (class, centroid to six decimals) after the first."""
    cx, cy = geo.centroid(F.col("ring"))
    keyed = polygons.select("class", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))
    copies = keyed.filter(F.col("cx").isNotNull()).groupBy("class", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def training_quality_report(polygons: DataFrame) -> DataFrame:
    """(check, severity, value) rows of everything that looks wrong."""
    per_class = polygons.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~geo.valid_ring(F.col("ring"))).alias("bad")
    )
    facts = per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("features"),
        F.count(F.lit(1)).alias("classes"),
        F.max("n").alias("hi"),
        F.min("n").alias("lo"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.count_if(F.col("n") < fv.QUALITY_CLASS_CRITICAL).alias("below_10"),
        F.count_if(F.col("n") < fv.QUALITY_CLASS_WARNING).alias("below_30"),
    )
    one = F.lit(1).alias("_one")
    facts = facts.select("*", one).join(duplicate_features(polygons).select("*", one), "_one")
    n = F.col("features")
    ratio = F.try_divide(F.col("hi").cast("double"), F.col("lo"))
    bad_share = F.try_divide(F.col("bad") * 100.0, n)
    copy_share = F.try_divide(F.col("duplicates") * 100.0, n)

    def issue(check: str, severity: Column, value: Column) -> Column:
        row = F.struct(F.lit(check).alias("check"), severity.alias("severity"), value.cast("double").alias("value"))
        return F.when(severity.isNotNull(), row)

    level = lambda *arms: _case(arms)
    issues = F.array(
        issue("small_dataset", level((n < fv.QUALITY_SMALL_DATASET, "warning")), n),
        issue("single_class", level((F.col("classes") == 1, "critical")), F.col("classes")),
        issue(
            "class_imbalance",
            level(
                (F.col("classes") < 2, None),
                (ratio > fv.QUALITY_RATIO_CRITICAL, "critical"),
                (ratio > fv.QUALITY_RATIO_WARNING, "warning"),
                (ratio > fv.QUALITY_RATIO_INFO, "info"),
            ),
            ratio,
        ),
        issue(
            "low_class_count",
            level((F.col("below_10") > 0, "critical"), (F.col("below_30") > 0, "warning")),
            F.when(F.col("below_10") > 0, F.col("below_10")).otherwise(F.col("below_30")),
        ),
        issue(
            "invalid_geometry",
            level((F.col("bad") == 0, None), (bad_share > fv.QUALITY_INVALID_PERCENT, "critical"), (F.lit(True), "warning")),
            bad_share,
        ),
        issue("spatial_data", level((n - F.col("bad") >= fv.QUALITY_SPATIAL_FEATURES, "info")), n),
        issue(
            "duplicates",
            level((F.col("duplicates") == 0, None), (copy_share > fv.QUALITY_DUPLICATE_PERCENT, "warning"), (F.lit(True), "info")),
            copy_share,
        ),
    )
    return facts.select(F.explode(F.array_compact(issues)).alias("i")).select("i.*")


def _case(arms) -> Column:
    out = None
    for condition, value in arms:
        value = F.lit(value).cast("string")
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def split_preview(split: DataFrame, key: str = "class") -> DataFrame:
    """Train and test counts per class of a marked split, with warnings.

    Warnings: the spread over all cells is above 10:1, fewer than five test
    features, a class missing on one side.
    """
    counts = split.groupBy(key).agg(
        F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test")
    )
    cell = lambda fn, c: fn(F.when(F.col(c) > 0, F.col(c)))
    spread = counts.agg(
        F.greatest(cell(F.max, "train"), cell(F.max, "test")).alias("_hi"),
        F.least(cell(F.min, "train"), cell(F.min, "test")).alias("_lo"),
    ).select("*", F.lit(1).alias("_one"))
    joined = counts.withColumn("_one", F.lit(1)).join(spread, "_one")
    return joined.select(
        key, "train", "test",
        (F.col("_hi") / F.col("_lo") > fv.PREVIEW_RATIO).alias("severe_imbalance"),
        ((F.col("test") > 0) & (F.col("test") < fv.PREVIEW_MIN_TEST)).alias("small_test"),
        F.when(F.col("train") == 0, "train").when(F.col("test") == 0, "test").alias("missing_in"),
    )
