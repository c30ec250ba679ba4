"""Queries on readers, filters, cleaning, scaling and map tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.functions import scalar
from bandloom.operators import prepare
from bandloom.plans import inputs as inp
from bandloom.plans.registry import query
from bandloom.session import scratch_path
from bandloom.sources import tables

R6 = lambda c: F.round(c, 6)


@query("a1_read_pixels", f"""
WITH p AS ({inp.GRID}) SELECT raster_id, "row", "col", x, y, b1, b2 FROM p""")
def read_pixels(spark, sf):
    return prepare.band_columns(inp.grid_pixels(spark, sf).select("raster_id", "row", "col", "x", "y", "bands"), 2)


@query("a2_assign_tiles", f"""
WITH p AS ({inp.GRID}) SELECT CAST("row" // 24 AS INTEGER) AS tile_row, CAST("col" // 32 AS INTEGER) AS tile_col, count(*) AS n,
 min("row") AS first_row, max("col") AS last_col FROM p GROUP BY 1, 2""")
def assign_tiles(spark, sf):
    tiled = prepare.assign_tiles(inp.grid_pixels(spark, sf), bx=32, by=24)
    return tiled.groupBy("tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))


@query("a3_read_polygons", f"""
WITH poly AS ({inp.POLY}), r AS ({inp.RING})
SELECT fid, CAST(class AS INTEGER) AS class, stand_id, CAST(len(px) AS INTEGER) AS corners FROM r WHERE class IS NOT NULL AND class <> ''""")
def read_polygons(spark, sf):
    polygons = tables.labelled_polygons(inp.supplier_polygons(spark, sf))
    return polygons.select("fid", "class", "stand_id", F.size("ring").alias("corners"))


@query("a4_roi_attributes", """
SELECT c_nationkey AS class, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(sum(CAST(c_custkey % 7 AS DOUBLE)), 2) AS total2
FROM customer GROUP BY c_nationkey""")
def roi_attributes(spark, sf):
    c = inp.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("class"), F.col("c_acctbal").alias("band_1"), (F.col("c_custkey") % 7).alias("band_2"))
    roi = tables.roi_attributes(c, "band_", "class")
    return roi.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("bands")[0]), 2).alias("total"),
        F.round(F.sum(F.col("bands")[1]), 2).alias("total2"))


def stub_predictions(spark, sf, masked):
    """Predictions by a fixed rule, so that only the map writing is under test."""
    pixels = inp.grid_pixels(spark, sf)
    kept = prepare.masked_pixels(pixels) if masked else prepare.valid_pixels(pixels)
    b = F.col("bands")[1]
    first, second = b % 10 / 20, b % 7 / 20
    return kept.select(
        *tables.PIXEL_KEY, (b % 3 + 1).cast("int").alias("class"), (b % 50 / 50).alias("confidence"),
        F.array(first, second, 1.0 - first - second).alias("probability"))


PRED = f"""p AS ({inp.GRID}), v AS (SELECT *, b1 <> -9999 AS valid, b1 <> -9999 AND mask <> 0 AS kept FROM p)"""


@query("a6_write_class_map", f"""
WITH {PRED} SELECT raster_id, "row", "col", CAST(CASE WHEN valid THEN b2 % 3 + 1 ELSE 0 END AS INTEGER) AS class FROM v""")
def write_class_map(spark, sf):
    classes = tables.class_map(inp.grid_pixels(spark, sf), stub_predictions(spark, sf, False), masked=False)
    path = scratch_path(spark, "class-map")
    tables.write_class_map(classes, path)
    back = spark.read.parquet(path)
    return back.select("raster_id", "row", "col", F.col("class").cast("int").alias("class"))


@query("a6_masked_class_map", f"""
WITH {PRED} SELECT raster_id, "row", "col", CAST(CASE WHEN kept THEN b2 % 3 + 1 ELSE -9999 END AS INTEGER) AS class FROM v""")
def masked_class_map(spark, sf):
    return tables.class_map(inp.grid_pixels(spark, sf), stub_predictions(spark, sf, True), masked=True)


@query("a7_write_confidence", f"""
WITH {PRED} SELECT raster_id, "row", "col", round(CASE WHEN valid THEN b2 % 50 / 50 * 100 ELSE -1e0 END, 6) AS confidence FROM v""")
def write_confidence(spark, sf):
    return tables.confidence_map(inp.grid_pixels(spark, sf), stub_predictions(spark, sf, False)).withColumn(
        "confidence", R6("confidence"))


@query("a8_confidence_per_class", f"""
WITH {PRED}, q AS (SELECT *, b2 % 10 / 20 AS p1, b2 % 7 / 20 AS p2 FROM v)
SELECT raster_id, "row", "col", 1 AS class, round(CASE WHEN valid THEN p1 * 100 ELSE -1e0 END, 6) AS confidence FROM q
UNION ALL SELECT raster_id, "row", "col", 2, round(CASE WHEN valid THEN p2 * 100 ELSE -1e0 END, 6) FROM q
UNION ALL SELECT raster_id, "row", "col", 3, round(CASE WHEN valid THEN (1 - p1 - p2) * 100 ELSE -1e0 END, 6) FROM q""")
def confidence_per_class(spark, sf):
    return tables.confidence_per_class(
        inp.grid_pixels(spark, sf), stub_predictions(spark, sf, False), [1, 2, 3]).withColumn("confidence", R6("confidence"))


@query("b1_valid_pixels", f"""
WITH p AS ({inp.GRID}) SELECT raster_id, "row", "col", b1 FROM p WHERE b1 <> -9999""")
def valid_pixels(spark, sf):
    return prepare.valid_pixels(inp.grid_pixels(spark, sf)).select("raster_id", "row", "col", F.col("bands")[0].alias("b1"))


@query("b2_masked_pixels", f"""
WITH p AS ({inp.GRID}) SELECT raster_id, "row", "col", b1 FROM p WHERE b1 <> -9999 AND mask <> 0""")
def masked_pixels(spark, sf):
    return prepare.masked_pixels(inp.grid_pixels(spark, sf)).select("raster_id", "row", "col", F.col("bands")[0].alias("b1"))


@query("b3_labelled_pixels", f"""
WITH p AS ({inp.GRID}) SELECT raster_id, "row", "col", CAST(label - 1 AS INTEGER) AS label FROM p WHERE label - 1 <> 0""")
def labelled_pixels(spark, sf):
    p = inp.grid_pixels(spark, sf).withColumn("label", F.col("label") - 1)
    return prepare.labelled_pixels(p).select("raster_id", "row", "col", "label")


def broken_labels(spark, sf):
    """events with labels that are NaN, infinite or missing for some types."""
    label = (
        F.when(F.col("event_type") == "click", F.lit(float("nan")))
        .when(F.col("event_type") == "error", F.lit(float("inf")))
        .when(F.col("event_type") != "view", F.col("user_id").cast("double"))
    )
    return inp.table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), label.alias("label"), "value")


@query("b4_drop_nonfinite_labels", """
SELECT event_id AS sample_id, CAST(user_id AS DOUBLE) AS label FROM events WHERE event_type NOT IN ('click', 'error', 'view')""")
def drop_nonfinite_labels(spark, sf):
    return prepare.drop_nonfinite_labels(broken_labels(spark, sf)).select("sample_id", "label")


@query("b4_nonfinite_label_report", """
SELECT count(*) FILTER (event_type NOT IN ('click', 'error', 'view')) AS kept,
       count(*) FILTER (event_type IN ('click', 'error', 'view')) AS dropped FROM events""")
def nonfinite_label_report(spark, sf):
    return prepare.nonfinite_label_report(broken_labels(spark, sf))


@query("b5_impute_nonfinite", """
SELECT event_id AS sample_id, CASE event_type WHEN 'click' THEN 0e0 WHEN 'error' THEN 1e10 WHEN 'view' THEN -1e10 ELSE value END AS b1, value AS b2 FROM events""")
def impute_nonfinite(spark, sf):
    e = inp.table(spark, sf, "events")
    broken = (F.when(F.col("event_type") == "click", F.lit(float("nan"))).when(F.col("event_type") == "error", F.lit(float("inf")))
              .when(F.col("event_type") == "view", F.lit(float("-inf"))).otherwise(F.col("value")))
    fixed = prepare.impute_nonfinite(e.select(F.col("event_id").alias("sample_id"), F.array(broken, "value").alias("bands")))
    return prepare.band_columns(fixed, 2)


@query("b6_normalize_class_key", """
WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_brand ELSE '0' || p_size END AS value, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE value END AS class_key FROM v""")
def normalize_class_key(spark, sf):
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    value = (F.when(k == 0, F.concat(size, F.lit(".0"))).when(k == 1, F.concat(size, F.lit(".5")))
             .when(k == 2, F.col("p_brand")).otherwise(F.concat(F.lit("0"), size)))
    return inp.table(spark, sf, "part").select("p_partkey", scalar.normalize_class_key(value).alias("class_key"))


@query("b7_labels_to_1d", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label FROM embeddings""")
def labels_to_1d(spark, sf):
    return inp.table(spark, sf, "embeddings").select("vec_id", scalar.argmax_position(F.col("embedding")).alias("label"))


@query("b8_scale_minmax", f"""
WITH s AS (SELECT *, 7e0 AS b5 FROM ({inp.LINE})),
m AS (SELECT min(b1) l1, max(b1) h1, min(b2) l2, max(b2) h2, min(b3) l3, max(b3) h3, min(b4) l4, max(b4) h4 FROM s)
SELECT sample_id, round(2 * (b1 - l1) / (h1 - l1) - 1, 6) AS b1, round(2 * (b2 - l2) / (h2 - l2) - 1, 6) AS b2,
  round(2 * (b3 - l3) / (h3 - l3) - 1, 6) AS b3, round(2 * (b4 - l4) / (h4 - l4) - 1, 6) AS b4, b5 FROM s, m""")
def scale_minmax(spark, sf):
    s = inp.line_samples(spark, sf).select("sample_id", F.concat("bands", F.array(F.lit(7.0))).alias("bands"))
    scaled = prepare.band_columns(prepare.fit_scaler(s, 5).transform(s), 5)
    return scaled.select("sample_id", *[R6(f"b{i}").alias(f"b{i}") for i in range(1, 6)])


@query("b8_scaler_bounds", f"""
WITH s AS ({inp.LINE}) SELECT 1 AS band, min(b1) AS lo, max(b1) AS hi FROM s UNION ALL SELECT 2, min(b2), max(b2) FROM s
UNION ALL SELECT 3, min(b3), max(b3) FROM s UNION ALL SELECT 4, min(b4), max(b4) FROM s""")
def scaler_bounds(spark, sf):
    scaler = prepare.fit_scaler(inp.line_samples(spark, sf), 4)
    return spark.createDataFrame(scaler.rows(), "band int, lo double, hi double")


@query("b9_pixel_to_coord", f"""
WITH p AS ({inp.GRID}) SELECT raster_id, "row", "col", round("col" * 10e0 + "row" * 0.5e0 + 600000e0, 6) AS x,
  round("col" * 0.25e0 + "row" * -10e0 + 4800000e0, 6) AS y FROM p""")
def pixel_to_coord(spark, sf):
    x, y = prepare.pixel_to_coord(F.col("row"), F.col("col"), (600000.0, 10.0, 0.5, 4800000.0, 0.25, -10.0))
    return inp.grid_pixels(spark, sf).select("raster_id", "row", "col", R6(x).alias("x"), R6(y).alias("y"))


@query("b10_class_range_filter", """
SELECT CAST(floor(o_totalprice / 20) AS INTEGER) AS class, count(*) AS n FROM orders
WHERE floor(o_totalprice / 20) BETWEEN 0 AND 10000 AND floor(o_totalprice / 20) <> 255 GROUP BY 1""")
def class_range_filter(spark, sf):
    o = inp.table(spark, sf, "orders").select(F.floor(F.col("o_totalprice") / 20).cast("int").alias("class"))
    return prepare.class_range_filter(o, "class", nodata=255).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("c2_samples_from_roi", f"""
WITH p AS ({inp.GRID}) SELECT label, stand_id, count(*) AS n, round(sum(b2), 4) AS total FROM (
  SELECT p.b2, r.label, r.stand_id FROM p JOIN (
    SELECT raster_id, "row", "col", label, b2 % 11 AS stand_id FROM p WHERE label > 2) r
  ON p.raster_id = r.raster_id AND p."row" = r."row" AND p."col" = r."col") GROUP BY 1, 2""")
def samples_from_roi(spark, sf):
    from bandloom.operators.spatial import samples_from_roi as join_roi

    pixels = inp.grid_pixels(spark, sf)
    roi = pixels.filter(F.col("label") > 2).select(*tables.PIXEL_KEY, "label")
    stands = pixels.select(*tables.PIXEL_KEY, (F.col("bands")[1] % 11).alias("stand_id"))
    joined = join_roi(pixels.drop("label"), roi, stands)
    return joined.groupBy("label", "stand_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("bands")[1]), 4).alias("total"))


@query("c3_apply_mask", f"""
WITH p AS ({inp.GRID}) SELECT raster_id, "row", "col", b1 FROM p WHERE b1 <> -9999 AND label < 3""")
def apply_mask(spark, sf):
    from bandloom.operators.spatial import apply_mask as join_mask

    pixels = inp.grid_pixels(spark, sf)
    mask = pixels.select(*tables.PIXEL_KEY, F.when(F.col("label") < 3, 1).otherwise(0).alias("mask"))
    joined = join_mask(pixels.drop("mask"), mask)
    return prepare.masked_pixels(joined).select("raster_id", "row", "col", F.col("bands")[0].alias("b1"))


@query("c4_label_name_map", f"""
WITH poly AS ({inp.POLY}), f AS (SELECT class, arg_min(label_name, fid) AS name FROM poly WHERE class <> '' AND label_name <> '' GROUP BY class)
SELECT CAST(class AS INTEGER) AS class, CASE class WHEN '2' THEN 'manual two' ELSE name END AS name FROM f
UNION ALL SELECT 2, 'manual two' WHERE NOT EXISTS (SELECT 1 FROM f WHERE class = '2')""")
def label_name_map(spark, sf):
    from bandloom.operators.spatial import label_names

    return label_names(tables.labelled_polygons(inp.supplier_polygons(spark, sf)), {2: "manual two"})
