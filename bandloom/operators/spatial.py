"""Joins on position: polygon labels, masks, neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions import geometry as geo
from bandloom.functions.ordering import seeded_hash
from bandloom.functions.sizing import BROADCAST_ROWS, bounded_rows, lookup_join, small_or_none
from bandloom.session import cut_lineage
from bandloom.sources.tables import PIXEL_KEY

# Corners a broadcast polygon table may hold in total.
BROADCAST_CORNERS = 2_000_000
MAX_LEVELS = 64


def polygon_cells(polygons: DataFrame, base: float) -> DataFrame:
    """Polygons with edges and bounds, one row per grid cell they touch.

    The cell size doubles with the level, and a polygon lives on the level whose
    cells are as large as its bounds: at most four cells, however large it is.
    """
    b = geo.bounds(F.col("ring"))
    shaped = polygons.select(
        "*", geo.ring_edges(F.col("ring")).alias("_edges"), *[c.alias(f"_{k}") for k, c in b.items()]
    )
    span = F.greatest(F.col("_xmax") - F.col("_xmin"), F.col("_ymax") - F.col("_ymin"), F.lit(base))
    level = F.ceil(F.log2(span / F.lit(base))).cast("int")
    leveled = shaped.withColumn("_level", level)
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda v: F.floor(F.col(v) / size).cast("bigint")
    return leveled.withColumn("_cx", F.explode(F.sequence(cell("_xmin"), cell("_xmax")))).withColumn(
        "_cy", F.explode(F.sequence(cell("_ymin"), cell("_ymax")))
    )


def point_cells(points: DataFrame, base: float, levels: Sequence[int]) -> DataFrame:
    """Points with their cell on every level in use."""
    options = F.array(*[
        F.struct(
            F.lit(int(lv)).alias("_level"),
            F.floor(F.col("x") / F.lit(base * 2.0**lv)).cast("bigint").alias("_cx"),
            F.floor(F.col("y") / F.lit(base * 2.0**lv)).cast("bigint").alias("_cy"),
        )
        for lv in levels
    ])
    return points.withColumn("_cell", F.explode(options)).select("*", "_cell.*").drop("_cell")


def polygon_matches(points: DataFrame, polygons: DataFrame, fields: Sequence[str], base: float = 16.0) -> DataFrame:
    """All (point, polygon) pairs with the point inside, by an equi-join on cells.

    A polygon table that is small in rows and corners is broadcast and the points
    stay where they are; a larger one is joined by shuffling on the cells.
    """
    cells = polygon_cells(polygons, base).select("_level", "_cx", "_cy", "_edges", "_xmin", "_xmax", "_ymin", "_ymax", *fields)
    levels = [r[0] for r in bounded_rows(cells.select("_level").distinct(), MAX_LEVELS)]
    if not levels:
        return points.limit(0).crossJoin(polygons.select(*fields).limit(0))
    rows, corners = cells.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.size("_edges"))).collect()[0]
    small = rows <= BROADCAST_ROWS and corners <= BROADCAST_CORNERS
    placed = point_cells(points, base, levels)
    joined = placed.join(F.broadcast(cells) if small else cells, ["_level", "_cx", "_cy"])
    hit = joined.filter(
        F.col("x").between(F.col("_xmin"), F.col("_xmax"))
        & F.col("y").between(F.col("_ymin"), F.col("_ymax"))
        & geo.inside(F.col("_edges"), F.col("x"), F.col("y"))
    )
    return hit.select(*points.columns, *fields)


def rasterize_labels(pixels: DataFrame, polygons: DataFrame, keep: Sequence[str] = ("bands",)) -> DataFrame:
    """Pixels whose centre lies in a polygon, with the label of the last one.

    Later features (larger fid) overwrite earlier ones. Columns in `keep` travel
    along, so the pixel table is not joined a second time.
    """
    fields = [c for c in ("fid", "class", "stand_id") if c in polygons.columns]
    points = pixels.select(*PIXEL_KEY, "x", "y", *keep)
    hits = polygon_matches(points, polygons, fields)
    # Plain numbers, so that the aggregate can hash; only kept arrays make it sort.
    best = [F.max("fid").alias("polygon_id"), F.max_by(F.col("class").cast("int"), "fid").alias("label")]
    if "stand_id" in fields:
        best.append(F.max_by("stand_id", "fid").alias("stand_id"))
    carried = [c for c in ("x", "y", *keep) if c not in PIXEL_KEY]
    won = hits.groupBy(*PIXEL_KEY).agg(*best, *[F.first(c).alias(c) for c in carried])
    out = ["label", "polygon_id", *(["stand_id"] if "stand_id" in fields else [])]
    return won.select(*PIXEL_KEY, *carried, *out)


def position_join(pixels: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on the pixel position, which is unique per side, so no key is hot."""
    local = small_or_none(other)
    return pixels.join(F.broadcast(local) if local is not None else other, PIXEL_KEY, how)


def samples_from_roi(pixels: DataFrame, roi: DataFrame, stands: DataFrame | None = None) -> DataFrame:
    """Labelled samples: pixels under a non-zero label, with the stand if given."""
    labelled = roi.filter(F.col("label").isNotNull() & (F.col("label") != 0))
    if stands is not None:
        labelled = labelled.join(stands, PIXEL_KEY)
    return position_join(pixels, labelled, "inner")


def apply_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The mask value beside every pixel; NULL outside the mask."""
    return position_join(pixels, mask.select(*PIXEL_KEY, "mask"), "left")


def label_names(polygons: DataFrame, manual: dict[int, str] | None = None) -> DataFrame:
    """(class, name): the manual name, else the first name found for the class."""
    named = polygons.filter(F.col("label_name").isNotNull() & (F.col("label_name") != ""))
    found = named.groupBy("class").agg(F.min_by("label_name", "fid").alias("name"))
    if not manual:
        return found
    given = polygons.sparkSession.createDataFrame(
        [(int(k), str(v)) for k, v in manual.items()], f"class {polygons.schema['class'].dataType.simpleString()}, manual string"
    )
    return found.join(given, "class", "full").select("class", F.coalesce("manual", "name").alias("name"))


def near_join(
    left: DataFrame, right: DataFrame, coords: Sequence[str], radius: float, on: Sequence[str] = (), copy: bool = False, width: int = 1
) -> DataFrame:
    """Rows of both sides within `radius`, columns renamed a_* and b_*.

    `left` should be the smaller side: it is copied to its neighbouring cells.
    Cells have the size of the radius, so the equi-join sees every neighbour. Cells
    `width` (2 or more) times as wide need fewer copies, only to the cells that the
    radius reaches. With `copy` a left side of checked size is broadcast and `right`
    is not shuffled; otherwise both are, for the copies are more than Spark expects.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius) * width)).cast("bigint")
    names = [f"_c{i}" for i in range(len(coords))]
    offsets = product((-1, 0, 1) if width == 1 else (-1, 1), repeat=len(coords))
    reached = lambda c, o: F.floor((F.col(c) + F.lit(o * float(radius) * (1 + 1e-9))) / F.lit(float(radius) * width)).cast("bigint")
    place = (lambda c, o: cell(c) + F.lit(o)) if width == 1 else reached
    around = F.array_distinct(F.array(*[
        F.struct(*[place(c, o).alias(n) for c, o, n in zip(coords, offset, names)]) for offset in offsets
    ]))
    a = left.withColumn("_near", F.explode(around)).select(
        *on, *[F.col(f"_near.{n}").alias(n) for n in names], *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in on]
    )
    local = small_or_none(a) if copy else None
    a = a.hint("merge") if local is None else F.broadcast(local)
    b = right.select(
        *on, *[cell(c).alias(n) for c, n in zip(coords, names)], *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in on]
    )
    distance = geo.euclidean([F.col(f"a_{c}") for c in coords], [F.col(f"b_{c}") for c in coords])
    return b.join(a, [*on, *names]).withColumn("distance", distance).filter(F.col("distance") <= radius).drop(*names)


def positions(samples: DataFrame, coords: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Distinct positions with the smallest sample id and the number of copies."""
    return samples.groupBy(*on, *coords).agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("copies"))


def pairwise_distance(samples: DataFrame, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """Distances between distinct positions up to `radius`, each pair once.

    Copies of a position are counted, not paired.
    """
    p = positions(samples, ["x", "y"], on)
    pairs = near_join(p, p, ["x", "y"], radius, on)
    return pairs.filter(F.col("a_sample_id") < F.col("b_sample_id")).select(
        *on, "a_sample_id", "b_sample_id", "a_copies", "b_copies", "distance"
    )


def geodesic_pairs(samples: DataFrame, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """Geodesic distances in metres up to `radius`; x is longitude, y latitude."""
    px, py, pz = geo.geocentric(F.col("x"), F.col("y"))
    p = positions(samples, ["x", "y"], on).select("*", px.alias("gx"), py.alias("gy"), pz.alias("gz"))
    pairs = near_join(p, p, ["gx", "gy", "gz"], radius, on, width=3).filter(F.col("a_sample_id") < F.col("b_sample_id"))
    exact = geo.geodesic(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    return (
        pairs.select(*on, "a_sample_id", "b_sample_id", "a_copies", "b_copies", exact.alias("distance"))
        .filter(F.col("distance") <= radius)
    )


def within_buffer(samples: DataFrame, held_out: DataFrame, distance: float, strict: bool = True) -> DataFrame:
    """(iter, label, sample_id) of same-class samples too close to train with.

    Only this complement is ever materialised: the training side of a fold is
    its class without these rows, however large the class is. With `strict`
    samples exactly at the distance are excluded too. Held-out rows are one per
    iteration and class, so they are the side that is copied to nearby cells.
    """
    right = samples.select("label", "sample_id", "x", "y")
    left = held_out.select("label", "iter", "x", "y", "sample_id")
    near = near_join(left, right, ["x", "y"], distance, ["label"], copy=True)
    if not strict:
        own = F.col("a_sample_id") == F.col("b_sample_id")
        near = near.filter(own | (F.col("distance") < distance) | (F.col("distance") <= 0.1))
    return near.select(F.col("a_iter").alias("iter"), "label", F.col("b_sample_id").alias("sample_id"))


# Samples a leaf of the grid should hold, and the most levels it may have.
LEAF_ROWS = 512
GRID_LEVELS = 8


def farthest(samples: DataFrame, held_out: DataFrame, want: int, seed: int | str = 0, ties: bool = False) -> DataFrame:
    """(iter, label, sample_id): the `want` samples of the class farthest from each held-out one.

    Equal distances are taken in seeded order, or all of them with `ties`. Positions
    lie on a square grid per class, each level with 16 cells in place of one. A cell
    is followed down only if its far corner reaches what the near corners of other
    cells already promise `want` samples beyond, so samples are measured in the
    outermost leaves alone. Samples without a finite position are never taken.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    slim = samples.filter(finite("x") & finite("y")).select("label", "sample_id", "x", "y")
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    classes = slim.groupBy("label").agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.when(extent > 0, extent).otherwise(1.0).alias("_w"), F.count(F.lit(1)).alias("_n"))
    classes = slim.sparkSession.createDataFrame(bounded_rows(classes), classes.schema)
    largest = classes.agg(F.max("_n")).first()[0] or 1
    depth = min(GRID_LEVELS, max(1, math.ceil(math.log(largest / LEAF_ROWS, 16)))) if largest > LEAF_ROWS else 1
    leaf = lambda c, c0: F.least(F.floor((F.col(c) - F.col(c0)) / F.col("_w") * 4**depth), F.lit(4**depth - 1)).cast("int")
    placed = lookup_join(slim, classes.drop("_n"), ["label"]).select(
        "label", "sample_id", "x", "y", leaf("x", "_x0").alias("_gx"), leaf("y", "_y0").alias("_gy"))
    counted = cut_lineage(placed.groupBy("label", "_gx", "_gy").agg(F.count(F.lit(1)).alias("_n")), "cells")

    front = held_out.filter(finite("x") & finite("y")).select("iter", "label", F.col("x").alias("_px"), F.col("y").alias("_py"))
    front = lookup_join(front, classes.drop("_n"), ["label"], "inner")
    fold = Window.partitionBy("iter", "label")
    for level in range(1, depth + 1):
        up = 2 * (depth - level)
        cells = counted.groupBy("label", F.shiftright("_gx", up).alias("_cx"), F.shiftright("_gy", up).alias("_cy")).agg(F.sum("_n").alias("_n"))
        cells = cells.withColumns({"_ux": F.shiftright("_cx", 2), "_uy": F.shiftright("_cy", 2)})
        if level == 1:
            front = front.join(cells.drop("_ux", "_uy"), "label")
        else:
            above = front.drop("_n", "_low", "_far").withColumnsRenamed({"_cx": "_ux", "_cy": "_uy"})
            front = above.join(cells, ["label", "_ux", "_uy"]).drop("_ux", "_uy")
        width = F.col("_w") / 4**level
        lows = {"x": F.col("_x0") + F.col("_cx") * width, "y": F.col("_y0") + F.col("_cy") * width}
        gap = [F.greatest(lo - F.col(f"_p{c}"), F.col(f"_p{c}") - lo - width, F.lit(0.0)) for c, lo in lows.items()]
        reach = [F.greatest(F.abs(lo - F.col(f"_p{c}")), F.abs(lo + width - F.col(f"_p{c}"))) for c, lo in lows.items()]
        front = front.withColumn("_near", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1])).withColumn("_far", F.sqrt(reach[0] * reach[0] + reach[1] * reach[1]))
        beyond = F.sum("_n").over(fold.orderBy(F.desc("_near")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        front = front.withColumn("_low", F.when(beyond >= want, F.col("_near")))
        # A little lower than promised, for corners and positions are rounded.
        low = F.max("_low").over(fold.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        front = front.withColumn("_low", F.coalesce(low * (1 - 1e-9) - F.col("_w") * 1e-9, F.lit(-1.0))).filter(F.col("_far") >= F.col("_low"))
        front = front.drop("_near")
    front = front.select("iter", "label", F.col("_cx").alias("_gx"), F.col("_cy").alias("_gy"), "_px", "_py", "_low")
    front = cut_lineage(front, "front")
    met = lookup_join(placed, front, ["label", "_gx", "_gy"], "inner")
    met = met.withColumn("_away", geo.euclidean([F.col("x"), F.col("y")], [F.col("_px"), F.col("_py")])).filter(F.col("_away") >= F.col("_low"))
    if ties:
        place = F.rank().over(fold.orderBy(F.desc("_away")))
    else:
        met = met.withColumn("_h", seeded_hash(seed, "sample_id"))
        place = F.row_number().over(fold.orderBy(F.desc("_away"), "_h", "sample_id"))
    return met.withColumn("_place", place).filter(F.col("_place") <= want).select("iter", "label", "sample_id")
