"""Recipe catalogues: scoring against rasters, ranking, presets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions import scalar
from bandloom.functions.sizing import bounded_rows

RECIPE_LIMIT = 1000


def describe_rasters(rasters: DataFrame) -> DataFrame:
    """Sensor, land cover and hints from the file name."""
    name = F.col("name")
    return rasters.select(
        "*",
        scalar.detect_sensor(name).alias("sensor"),
        scalar.detect_landcover(name).alias("landcover"),
        scalar.filename_hints(name).alias("hints"),
    )


def recommend_recipes(rasters: DataFrame, recipes: DataFrame) -> DataFrame:
    """Every described raster with the score of every recipe above 0.

    Recipes are documents written by people; the list is checked to be short and
    then carried along as an array, so rasters are not shuffled.
    """
    fields = ["name", "description", "classifier", "smote", "shap"]
    rows = bounded_rows(recipes.select(*fields), RECIPE_LIMIT)
    listed = F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in rows])
    pairs = rasters.withColumn("_r", F.explode(listed))
    raster = {k: F.col(k) for k in ("sensor", "bands", "size_mb", "landcover", "hints")}
    score = scalar.score_recipe(raster, {f: F.col(f"_r.{f}") for f in fields})
    scored = pairs.select(*rasters.columns, F.col("_r.name").alias("recipe"), score.alias("score"))
    return scored.filter(F.col("score") > 0)


def rank_recommendations(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Place of each recipe for a raster, best score first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "recipe")
    return scored.withColumn("place", F.row_number().over(order))


def accuracy_rank(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return (
        F.when(v.contains("very_high") | v.contains("highest"), 4)
        .when(v.contains("high"), 3)
        .when(v.contains("medium"), 2)
        .when(v.contains("low") | v.contains("baseline"), 1)
        .otherwise(2)
    )


def runtime_rank(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(v.contains("fast"), 1).when(v.contains("slow"), 3).otherwise(2)


def recipe_order(mode: str) -> list[Column]:
    name = F.lower("name")
    fast, good = runtime_rank(F.col("runtime")), -accuracy_rank(F.col("accuracy"))
    if mode.startswith("name"):
        return [name]
    if mode.startswith("fastest"):
        return [fast, name]
    if mode.startswith("highest"):
        return [good, name]
    return [F.when(F.col("builtin"), 0).otherwise(1), fast, good, name]


def rank_recipes(recipes: DataFrame, mode: str = "default") -> DataFrame:
    """Place of every recipe in the chosen order.

    Rows are ranked within their leading sort value and shifted by the rows
    before it; the leading values are few, the names within them many.
    """
    *lead, name = recipe_order(mode)
    lead_cols = [c.alias(f"_l{i}") for i, c in enumerate(lead)] + [F.substring(name, 1, 2).alias("_l9")]
    keys = [f"_l{i}" for i in range(len(lead))] + ["_l9"]
    keyed = recipes.select("*", *lead_cols, name.alias("_name"))
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("_name")
    ranked = keyed.withColumn("_rn", F.row_number().over(inside)).join(offsets, keys)
    return ranked.select(*recipes.columns, (F.col("_before") + F.col("_rn")).alias("place"))


def preset(recipes: DataFrame, focus: str) -> DataFrame:
    """FAST keeps the recipes of the best runtime rank, QUALITY of the best accuracy."""
    ranks = {"FAST": runtime_rank(F.col("runtime")), "QUALITY": -accuracy_rank(F.col("accuracy"))}
    if focus not in ranks:
        return recipes
    ranked = recipes.withColumn("_rank", ranks[focus])
    best = ranked.agg(F.min("_rank")).collect()[0][0]
    return ranked.filter(F.col("_rank") == best).drop("_rank")
