"""Prediction of whole image collections and the assessment of maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions import scalar
from bandloom.operators import metrics, prepare, spatial
from bandloom.operators.learners import Fitted
from bandloom.operators.prepare import Scaler
from bandloom.sources.tables import PIXEL_KEY


def predict_raster(
    pixels: DataFrame, fitted: Fitted, scaler: Scaler | None = None, nodata: float | None = None, masked: bool = False,
    probability: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Class and confidence of every valid pixel of all rasters.

    Filter, scale and predict in one pass without a shuffle; the bounds stored
    with the model are used, never those of the image.
    """
    kept = prepare.masked_pixels(pixels, nodata) if masked else prepare.valid_pixels(pixels, nodata)
    slim = kept.select(*PIXEL_KEY, *keep, "bands")
    ready = scaler.transform(slim) if scaler else slim
    return fitted.predict(ready, [*PIXEL_KEY, *keep], probability)


def raster_products(
    pixels: DataFrame, fitted: Fitted, scaler: Scaler | None = None, nodata: float | None = None, masked: bool = False,
    fill: int = fv.NODATA_DEFAULT,
) -> DataFrame:
    """Class and confidence in percent of every pixel, predicted or not.

    Pixels left out hold 0, or `fill` under a mask, and confidence -1. They are
    read by a second scan with the opposite filter and appended, so the map is
    complete without joining predictions back to the image.
    """
    value = float(fv.NODATA_DEFAULT if nodata is None else nodata)
    usable = F.coalesce(F.col("bands")[0] != value, F.lit(False))
    if masked:
        usable = usable & (F.coalesce(F.col("mask"), F.lit(0)) != 0)
    done = predict_raster(pixels, fitted, scaler, nodata, masked).select(
        *PIXEL_KEY, "class", (F.col("confidence") * 100).alias("confidence"))
    blank = pixels.filter(~usable).select(
        *PIXEL_KEY, F.lit(fill if masked else fv.UNLABELLED).alias("class"), F.lit(float(fv.NO_CONFIDENCE)).alias("confidence"))
    return done.unionByName(blank)


def confusion_on_map(predictions: DataFrame, polygons: DataFrame) -> DataFrame:
    """Confusion cells of predicted pixels against labelled polygons."""
    renamed = predictions.withColumnRenamed("class", "prediction")
    burned = spatial.rasterize_labels(renamed, polygons, keep=["prediction"])
    return metrics.cell_counts(burned)


def assess_map(predictions: DataFrame, polygons: DataFrame) -> DataFrame:
    """Accuracy, kappa and mean F1 of a map against polygons."""
    return metrics.overall_scores(confusion_on_map(predictions, polygons))


def list_rasters(rasters: DataFrame, column: str = "path") -> DataFrame:
    """Inputs that are GeoTIFF files, with the output each one gets."""
    named = rasters.filter(F.lower(F.col(column)).rlike(r"\.tiff?$"))
    return named.withColumn("output", scalar.classified_path(F.col(column)))


def classify_batch(pixels: DataFrame, fitted: Fitted, scaler: Scaler | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(predictions, summary) of a collection, in one job for all rasters.

    The summary has a row per raster: its pixels, the classified ones, the
    output name, and whether anything was classified.
    """
    predictions = predict_raster(pixels, fitted, scaler, **options)
    done = predictions.groupBy("raster_id").agg(F.count(F.lit(1)).alias("classified"))
    total = pixels.groupBy("raster_id").agg(F.count(F.lit(1)).alias("pixels"))
    summary = total.join(done, "raster_id", "left").select(
        "raster_id", "pixels", F.coalesce("classified", F.lit(0)).alias("classified"),
        F.concat(F.lit("classified_"), "raster_id").alias("output"), F.coalesce(F.col("classified") > 0, F.lit(False)).alias("success"),
    )
    return predictions, summary
