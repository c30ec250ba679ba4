"""Readers and writers of pixel, polygon, sample and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom import fixed_values as fv

PIXEL_KEY = ["raster_id", "row", "col"]


def read_pixels(spark: SparkSession, path: str, bands: Sequence[str] | None = None) -> DataFrame:
    """A pixel table (Parquet). Wide band columns are gathered into `bands`."""
    df = spark.read.parquet(path)
    if bands:
        rest = [c for c in df.columns if c not in bands]
        df = df.select(*rest, F.array(*[F.col(b).cast("double") for b in bands]).alias("bands"))
    return df


def read_polygons(spark: SparkSession, path: str, class_field: str, fmt: str = "parquet") -> DataFrame:
    """Training polygons with a usable class."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return labelled_polygons(reader.load(path), class_field)


def labelled_polygons(polygons: DataFrame, class_field: str = "class") -> DataFrame:
    """Skip features without a class; NULL and empty text mean none."""
    text = F.col(class_field).cast("string")
    return polygons.filter(text.isNotNull() & (text != "")).withColumn("class", F.col(class_field).cast("int"))


def ring_from_wkt(wkt: Column) -> Column:
    """Vertices of the outer ring of a WKT polygon, without the closing one."""
    outer = F.regexp_extract(wkt, r"\(\(([^()]*)\)", 1)
    points = F.transform(
        F.split(outer, r"\s*,\s*"),
        lambda p: F.struct(
            F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"),
            F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"),
        ),
    )
    closed = (F.size(points) > 1) & (points[0] == F.element_at(points, -1))
    return F.when(closed, F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)


def roi_attributes(df: DataFrame, prefix: str, *fields: str) -> DataFrame:
    """Columns that start with `prefix` as the band vector, named fields beside it."""
    found = [c for c in df.columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"no column starts with {prefix!r}; columns are {', '.join(df.columns)}")
    return df.select(*fields, F.array(*[F.col(c).cast("double") for c in found]).alias("bands"))


def class_map(pixels: DataFrame, predictions: DataFrame, masked: bool, nodata: int = fv.NODATA_DEFAULT) -> DataFrame:
    """Class of every pixel; pixels without one hold 0, or nodata under a mask."""
    fill = nodata if masked else fv.UNLABELLED
    grid = pixels.select(*PIXEL_KEY)
    return grid.join(predictions.select(*PIXEL_KEY, "class"), PIXEL_KEY, "left").withColumn(
        "class", F.coalesce("class", F.lit(fill)).cast("int")
    )


def confidence_map(pixels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Confidence in percent of every pixel, -1 where nothing was predicted."""
    grid = pixels.select(*PIXEL_KEY)
    percent = (F.col("confidence") * 100).alias("confidence")
    return grid.join(predictions.select(*PIXEL_KEY, percent), PIXEL_KEY, "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(float(fv.NO_CONFIDENCE)))
    )


def confidence_per_class(pixels: DataFrame, predictions: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row per pixel and class: probability in percent, -1 where not predicted."""
    codes = F.array(*[F.lit(int(c)) for c in classes])
    blank = F.array_repeat(F.lit(fv.NO_CONFIDENCE / 100.0), len(classes))
    joined = pixels.select(*PIXEL_KEY).join(predictions.select(*PIXEL_KEY, "probability"), PIXEL_KEY, "left")
    pairs = F.arrays_zip(codes.alias("class"), F.coalesce("probability", blank).alias("p"))
    return joined.select(*PIXEL_KEY, F.explode(pairs).alias("e")).select(
        *PIXEL_KEY, F.col("e.class").alias("class"), (F.col("e.p") * 100).alias("confidence")
    )


def class_bytes(top: int) -> str:
    """Storage type of a class map: 16 bits once a class is above 255."""
    return "int" if top > fv.CLASS_BYTE_MAX else "smallint"


def write_class_map(classes: DataFrame, path: str) -> None:
    """A class map as Parquet, one folder per raster."""
    top = classes.agg(F.max("class")).collect()[0][0] or 0
    classes.withColumn("class", F.col("class").cast(class_bytes(top))).write.mode("overwrite").partitionBy(
        "raster_id"
    ).parquet(path)


def write_confidence(confidence: DataFrame, path: str) -> None:
    """A confidence map as Parquet, one folder per raster."""
    confidence.write.mode("overwrite").partitionBy("raster_id").parquet(path)


def write_tiles(pixels: DataFrame, path: str, bx: int, by: int) -> None:
    """A pixel table laid out by raster and tile row so that readers can prune."""
    from bandloom.operators.prepare import assign_tiles

    tiled = assign_tiles(pixels, bx, by)
    tiled.repartition("raster_id", "tile_row", "tile_col").sortWithinPartitions("raster_id", "tile_row").write.mode(
        "overwrite"
    ).partitionBy("raster_id", "tile_row").parquet(path)
