"""Queries on polygon labels, distances and map assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.operators import metrics, spatial
from bandloom.plans import inputs as inp
from bandloom.plans.registry import query
from bandloom.sources import tables

R6 = lambda c: F.round(c, 6)

# Even-odd test of every pixel centre against every polygon, edge by edge.
BURN = f"""
p AS ({inp.GRID}), poly AS ({inp.POLY}), ring AS ({inp.RING}),
edge AS (SELECT fid, CAST(class AS INTEGER) AS class, stand_id, px[i] AS x1, py[i] AS y1, px[i % len(px) + 1] AS x2, py[i % len(px) + 1] AS y2
  FROM (SELECT *, generate_subscripts(px, 1) AS i FROM ring WHERE class <> '')),
hit AS (SELECT p.raster_id, p."row", p."col", e.fid, e.class, e.stand_id FROM p JOIN edge e
  ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * ((y - y1) / (y2 - y1)) + x1
  GROUP BY ALL HAVING count(*) % 2 = 1),
burn AS (SELECT raster_id, "row", "col", arg_max(class, fid) AS label, max(fid) AS polygon_id, arg_max(stand_id, fid) AS stand_id FROM hit GROUP BY 1, 2, 3)"""


def burned(spark, sf):
    polygons = tables.labelled_polygons(inp.supplier_polygons(spark, sf))
    return spatial.rasterize_labels(inp.grid_pixels(spark, sf).drop("label"), polygons)


@query("c1_rasterize_labels", f"""
WITH {BURN} SELECT raster_id, "row", "col", label, polygon_id, stand_id FROM burn""")
def rasterize(spark, sf):
    return burned(spark, sf).select("raster_id", "row", "col", "label", "polygon_id", "stand_id")


@query("c5_pairwise_distance", f"""
WITH p AS ({inp.GRID})
SELECT a.label, a.sample_id AS a_sample_id, b.sample_id AS b_sample_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
FROM p a JOIN p b ON a.label = b.label AND a.sample_id < b.sample_id AND abs(a.x - b.x) <= 2.5 AND b."row" BETWEEN a."row" AND a."row" + 3
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.5 * 2.5""")
def pairwise(spark, sf):
    return spatial.pairwise_distance(inp.grid_pixels(spark, sf), 2.5, ["label"]).select(
        "label", "a_sample_id", "b_sample_id", R6("distance").alias("distance"))


EARTH = "2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(b.y / 100 - a.y / 100) / 2), 2) + cos(radians(a.y / 100)) * cos(radians(b.y / 100)) * pow(sin(radians(b.x / 100 - a.x / 100) / 2), 2)))"


def on_earth(spark, sf):
    """The orders raster with a hundredth of a degree per pixel."""
    return inp.grid_pixels(spark, sf).withColumn("x", F.col("x") / 100).withColumn("y", F.col("y") / 100)


@query("c5_great_circle", f"""
WITH p AS ({inp.GRID}) SELECT a.sample_id AS a_sample_id, b.sample_id AS b_sample_id, round({EARTH}, 3) AS distance
FROM p a JOIN p b ON a."col" = b."col" AND b."row" = a."row" + 1""")
def great_circle(spark, sf):
    from bandloom.functions.geometry import haversine

    p = on_earth(spark, sf).select("row", "col", "sample_id", "x", "y")
    a = p.select((F.col("row") + 1).alias("row"), "col", *[F.col(c).alias(f"a_{c}") for c in ("sample_id", "x", "y")])
    b = p.select("row", "col", *[F.col(c).alias(f"b_{c}") for c in ("sample_id", "x", "y")])
    return a.join(b, ["row", "col"]).select(
        "a_sample_id", "b_sample_id", F.round(haversine(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")), 3).alias("distance"))


def around_earth(spark, sf):
    """The orders raster wound around the earth, a hundredth of a degree per pixel.

    Rows run east and columns north. A turn of 36,000 rows ends two degrees farther
    north, so turns stay apart and the raster may have a million rows before it
    leaves the latitudes (57 degrees) where only its grid neighbours are near.
    """
    row, col = F.col("row"), F.col("col")
    return inp.grid_pixels(spark, sf).withColumn("x", (row + 0.5) / 100).withColumn("y", (col + 0.5) / 100 + row / 18000)


# Within these latitudes neighbours are 606 to 1114 m apart, other pixels at least 1210 m.
@query("c5_geodesic_pairs", f"""
WITH p AS ({inp.GRID}) SELECT a.label, a.sample_id AS a_sample_id, b.sample_id AS b_sample_id
FROM p a JOIN p b ON a.label = b.label AND a.sample_id < b.sample_id AND abs(b."row" - a."row") + abs(b."col" - a."col") = 1 AND b."row" BETWEEN a."row" AND a."row" + 1""")
def geodesic_pairs(spark, sf):
    return spatial.geodesic_pairs(around_earth(spark, sf), 1200.0, ["label"]).select("label", "a_sample_id", "b_sample_id")


def held_by_hash(spark, sf):
    """Three held-out pixels per class: the smallest hashes of three seeds."""
    p = inp.grid_pixels(spark, sf)
    picks = F.explode(F.array(*[
        F.struct(F.lit(i).alias("iter"), F.md5(F.concat_ws("|", F.lit(str(i)), F.col("sample_id").cast("string"))).alias("h"))
        for i in range(3)]))
    spread = p.select("label", "sample_id", "x", "y", picks.alias("d"))
    best = spread.groupBy("label", F.col("d.iter").alias("iter")).agg(
        F.min_by(F.struct("sample_id", "x", "y"), F.col("d.h")).alias("s"))
    return best.select("label", "iter", "s.*")


@query("c6_spatial_buffer_exclude", f"""
WITH p AS ({inp.GRID}), i AS (SELECT unnest([0, 1, 2]) AS iter),
h AS (SELECT label, iter, arg_min(sample_id, md5(iter || '|' || sample_id)) AS sample_id FROM p, i GROUP BY 1, 2),
c AS (SELECT h.*, p.x, p.y FROM h JOIN p ON p.sample_id = h.sample_id)
SELECT c.iter, c.label, p.sample_id FROM c JOIN p ON p.label = c.label
WHERE sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) <= 12""")
def buffer_exclude(spark, sf):
    return spatial.within_buffer(inp.grid_pixels(spark, sf), held_by_hash(spark, sf), 12.0)


PREDICTED = f"{BURN}, pred AS (SELECT raster_id, \"row\", \"col\", CAST(b2 % 5 + 1 AS INTEGER) AS prediction FROM p WHERE b1 <> -9999)"


def map_cells(spark, sf):
    from bandloom.plans.classify import confusion_on_map

    pixels = inp.grid_pixels(spark, sf)
    predictions = pixels.filter(F.col("bands")[0] != -9999).select(
        *tables.PIXEL_KEY, "x", "y", (F.col("bands")[1] % 5 + 1).cast("int").alias("class"))
    return confusion_on_map(predictions, tables.labelled_polygons(inp.supplier_polygons(spark, sf)))


@query("c10_confusion_join", f"""
WITH {PREDICTED} SELECT label, prediction, count(*) AS n FROM burn JOIN pred USING (raster_id, "row", "col") GROUP BY 1, 2""")
def confusion_join(spark, sf):
    return map_cells(spark, sf)


@query("i21_assess_map", f"""
WITH {PREDICTED}, s AS (SELECT label, prediction FROM burn JOIN pred USING (raster_id, "row", "col")),
k AS (SELECT DISTINCT label AS class FROM s UNION SELECT DISTINCT prediction FROM s),
m AS (SELECT class, (SELECT count(*) FROM s WHERE label = class) AS r, (SELECT count(*) FROM s WHERE prediction = class) AS c,
  (SELECT count(*) FROM s WHERE prediction = class AND label = class) AS d FROM k),
t AS (SELECT CAST(sum(r) AS DOUBLE) AS n, CAST(sum(d) AS DOUBLE) AS d, sum(CAST(r AS DOUBLE) * c) AS rc, avg(2e0 * d / (r + c)) AS f1 FROM m)
SELECT CAST(n AS BIGINT) AS n, round(d / n, 6) AS overall_accuracy, round((n * d - rc) / (n * n - rc), 6) AS kappa, round(f1, 6) AS f1_mean FROM t""")
def assess_map(spark, sf):
    return metrics.overall_scores(map_cells(spark, sf)).select(
        "n", *[R6(c).alias(c) for c in ("overall_accuracy", "kappa", "f1_mean")])
