"""Statistics of prediction confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions.ordering import exact_quantiles


def unit_confidence(df: DataFrame, column: str = "confidence", nodata: float = fv.NO_CONFIDENCE) -> DataFrame:
    """Confidence without nodata, on 0..1; a maximum above 1.5 means percent."""
    valid = df.filter(F.col(column).isNotNull() & (F.col(column) != nodata)).select(
        F.col(column).cast("double").alias("confidence")
    )
    top = valid.agg(F.max("confidence")).collect()[0][0] or 0.0
    if top > fv.PERCENT_SCALE_ABOVE:
        valid = valid.withColumn("confidence", F.col("confidence") / 100.0)
    return valid


def confidence_statistics(unit: DataFrame) -> DataFrame:
    """One row of statistics; quartiles are exact at any size."""
    c = F.col("confidence")
    share = lambda cond: 100.0 * F.count_if(cond) / F.count(F.lit(1))
    base = unit.agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.count(F.lit(1)).alias("total_pixels"),
        share(c < fv.CONFIDENCE_LOW).alias("low_pct"),
        share((c >= fv.CONFIDENCE_LOW) & (c < fv.CONFIDENCE_HIGH)).alias("medium_pct"),
        share(c >= fv.CONFIDENCE_HIGH).alias("high_pct"),
    )
    q = exact_quantiles(unit, "confidence", [0.25, 0.5, 0.75])
    pair = base.withColumn("_one", F.lit(1)).join(
        q.select(F.lit(1).alias("_one"), F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75")),
        "_one",
    )
    return pair.drop("_one")


def confidence_bin(c: Column) -> Column:
    """1..20, equal bins on [0, 1]; the last bin is closed on the right."""
    return F.least(F.width_bucket(c, F.lit(0.0), F.lit(1.0), F.lit(fv.CONFIDENCE_BINS)), F.lit(fv.CONFIDENCE_BINS))


def confidence_histogram(unit: DataFrame) -> DataFrame:
    """(bin, n, level); values outside [0, 1] have no bin."""
    inside = unit.filter(F.col("confidence").between(0.0, 1.0))
    counts = inside.groupBy(confidence_bin(F.col("confidence")).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bins = unit.sparkSession.range(1, fv.CONFIDENCE_BINS + 1).select(F.col("id").cast("int").alias("bin"))
    center = (F.col("bin") - 0.5) / fv.CONFIDENCE_BINS
    return bins.join(counts, "bin", "left").select(
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(center < fv.CONFIDENCE_LOW, "low").when(center < fv.CONFIDENCE_HIGH, "medium").otherwise("high").alias("level"),
    )


def low_confidence_pixels(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.filter((F.col("confidence") != fv.NO_CONFIDENCE) & (F.col("confidence") < threshold))
