"""Filters, cleaning and scaling of pixels and samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv


def band_count(df: DataFrame, bands: str = "bands") -> int:
    """Bands per row, read from one row; every row of an image has the same."""
    row = df.select(F.size(bands).alias("d")).first()
    if row is None:
        raise ValueError("no rows to read the band count from")
    return row["d"]


def valid_pixels(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Pixels whose first band is not the nodata value."""
    value = fv.NODATA_DEFAULT if nodata is None else nodata
    return pixels.filter(F.col("bands")[0] != F.lit(float(value)))


def masked_pixels(pixels: DataFrame, nodata: float | None = None, mask: str = "mask") -> DataFrame:
    """Valid pixels under a non-zero mask."""
    return valid_pixels(pixels, nodata).filter(F.coalesce(F.col(mask), F.lit(0)) != 0)


def labelled_pixels(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull() & (F.col("label") != fv.UNLABELLED))


def is_finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def drop_nonfinite_labels(df: DataFrame) -> DataFrame:
    return df.filter(is_finite(F.col("label")))


def nonfinite_label_report(df: DataFrame) -> DataFrame:
    """One row: kept and dropped label counts."""
    good = F.coalesce(is_finite(F.col("label")), F.lit(False))
    return df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def finite_value(v: Column) -> Column:
    return (
        F.when(F.isnan(v), F.lit(fv.NAN_FILL))
        .when(v == F.lit(float("inf")), F.lit(fv.POS_INF_FILL))
        .when(v == F.lit(float("-inf")), F.lit(fv.NEG_INF_FILL))
        .otherwise(v)
    )


def impute_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinite band values replaced by fixed numbers."""
    return df.withColumn("bands", F.transform("bands", finite_value))


@dataclass(frozen=True)
class Scaler:
    """Bounds per band; a band with equal bounds passes through unscaled."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]

    def column(self, bands: Column, i: int) -> Column:
        lo, hi = self.lo[i], self.hi[i]
        if lo == hi:
            return bands[i]
        return 2.0 * (bands[i] - F.lit(lo)) / F.lit(hi - lo) - 1.0

    def transform(self, df: DataFrame, bands: str = "bands") -> DataFrame:
        source = F.col(bands)
        scaled = F.array(*[self.column(source, i) for i in range(len(self.lo))])
        wrong = F.raise_error(F.concat(F.lit(f"bounds of {len(self.lo)} bands, rows of "), F.size(source).cast("string")))
        return df.withColumn(bands, F.when(F.size(source) != len(self.lo), wrong.cast("array<double>")).otherwise(scaled))

    def rows(self) -> list[tuple[int, float, float]]:
        return [(i + 1, lo, hi) for i, (lo, hi) in enumerate(zip(self.lo, self.hi))]


def fit_scaler(df: DataFrame, d: int | None = None) -> Scaler:
    """Smallest and largest value of every band, in one aggregate."""
    d = d or band_count(df)
    b = F.col("bands")
    row = df.agg(*[F.min(b[i]) for i in range(d)], *[F.max(b[i]) for i in range(d)]).collect()[0]
    if row[0] is None:
        raise ValueError("no samples to take band bounds from")
    return Scaler(tuple(row[:d]), tuple(row[d:]))


def pixel_to_coord(row: Column, col: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    """Map position of a pixel from (ulx, xres, xskew, uly, yskew, yres)."""
    ulx, xres, xskew, uly, yskew, yres = transform
    return col * xres + row * xskew + ulx, col * yskew + row * yres + uly


def class_range_filter(df: DataFrame, column: str, nodata: float | None = None) -> DataFrame:
    """Class values worth counting: no nodata, 0 to 10000."""
    kept = df.filter(F.col(column).between(fv.CLASS_COUNT_MIN, fv.CLASS_COUNT_MAX))
    return kept if nodata is None else kept.filter(F.col(column) != nodata)


def assign_tiles(pixels: DataFrame, bx: int, by: int) -> DataFrame:
    """Block coordinates of every pixel and one tile number per raster."""
    return pixels.withColumn("tile_row", F.floor(F.col("row") / by).cast("int")).withColumn(
        "tile_col", F.floor(F.col("col") / bx).cast("int")
    )


def band_columns(df: DataFrame, d: int, bands: str = "bands", prefix: str = "b") -> DataFrame:
    """Bands as columns b1..bd in place of the array."""
    rest = [c for c in df.columns if c != bands]
    return df.select(*rest, *[F.col(bands)[i].alias(f"{prefix}{i + 1}") for i in range(d)])
