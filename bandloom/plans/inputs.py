"""The given tables in the roles the engine works with.

Each view has a SQL twin, a subquery to be used as `WITH name AS (...)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_WIDTH = 100


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_samples(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as samples: four bands, three even classes, a stand-in prediction."""
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents.cast("string")
        ).alias("sample_id"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("bands"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("label"),
        (F.col("l_linenumber") % 3 + 1).alias("prediction"),
        F.col("l_orderkey").alias("polygon_id"),
        F.col("l_suppkey").alias("stand_id"),
        (F.col("l_quantity") / 50).alias("score"),
    )


LINE = """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS sample_id,
         l_quantity AS b1, l_extendedprice AS b2, l_discount AS b3, l_tax AS b4,
         CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INTEGER) AS label,
         CAST(l_linenumber % 3 + 1 AS INTEGER) AS prediction,
         l_orderkey AS polygon_id, l_suppkey AS stand_id, l_quantity / 50 AS score
  FROM lineitem"""


def grid_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """orders as one raster, 100 pixels wide; every pixel has its own position.

    Band 1 is nodata for orders of status P; the mask is 0 for low priorities.
    """
    o = table(spark, sf, "orders")
    row = F.floor(F.col("o_orderkey") / GRID_WIDTH).cast("int")
    col = (F.col("o_orderkey") % GRID_WIDTH).cast("int")
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.concat(F.lit("scene_"), F.lower("o_orderstatus")).alias("raster_id"),
        row.alias("row"),
        col.alias("col"),
        (col + 0.5).alias("x"),
        (row + 0.5).alias("y"),
        F.array(
            F.when(F.col("o_orderstatus") == "P", F.lit(-9999.0)).otherwise(F.col("o_totalprice") / 1000),
            (F.col("o_custkey") % 251).cast("double"),
        ).alias("bands"),
        F.when(priority < 5, 1).otherwise(0).alias("mask"),
        priority.alias("label"),
        F.col("o_orderkey").alias("sample_id"),
    )


GRID = """
  SELECT 'scene_' || lower(o_orderstatus) AS raster_id,
         CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS "col",
         CAST(o_orderkey % 100 AS DOUBLE) + 0.5e0 AS x, CAST(o_orderkey // 100 AS DOUBLE) + 0.5e0 AS y,
         CASE WHEN o_orderstatus = 'P' THEN -9999e0 ELSE o_totalprice / 1000 END AS b1,
         CAST(o_custkey % 251 AS DOUBLE) AS b2,
         CAST(CASE WHEN CAST(o_orderpriority[1:1] AS INTEGER) < 5 THEN 1 ELSE 0 END AS INTEGER) AS mask,
         CAST(o_orderpriority[1:1] AS INTEGER) AS label,
         o_orderkey AS sample_id
  FROM orders"""


def supplier_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """supplier as training polygons over the orders raster.

    Rectangles and six-cornered L shapes; some without a class, as empty labels.
    """
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    x0 = (k * 37 % 90) + 0.2
    y0 = k * 1.4 + 0.3
    w = (k % 7 + 4) * 1.0
    h = (k % 5 + 3) * 1.0

    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    box = F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h))
    ell = F.array(
        point(x0, y0),
        point(x0 + w, y0),
        point(x0 + w, y0 + h / 2),
        point(x0 + w / 2, y0 + h / 2),
        point(x0 + w / 2, y0 + h),
        point(x0, y0 + h),
    )
    return s.select(
        k.alias("fid"),
        F.when(F.col("s_nationkey") == 24, F.lit("")).otherwise((F.col("s_nationkey") % 5 + 1).cast("string")).alias("class"),
        F.col("s_nationkey").cast("bigint").alias("stand_id"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("cover "), (F.col("s_nationkey") % 5 + 1).cast("string"))).alias("label_name"),
        F.when(k % 3 == 0, ell).otherwise(box).alias("ring"),
    )


POLY = """
  SELECT s_suppkey AS fid,
         CASE WHEN s_nationkey = 24 THEN '' ELSE CAST(s_nationkey % 5 + 1 AS VARCHAR) END AS class,
         CAST(s_nationkey AS BIGINT) AS stand_id,
         CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'cover ' || (s_nationkey % 5 + 1) END AS label_name,
         CAST(s_suppkey * 37 % 90 AS DOUBLE) + 0.2e0 AS x0, s_suppkey * 1.4e0 + 0.3e0 AS y0,
         CAST(s_suppkey % 7 + 4 AS DOUBLE) AS w, CAST(s_suppkey % 5 + 3 AS DOUBLE) AS h,
         s_suppkey % 3 = 0 AS ell
  FROM supplier"""

# Corners of the polygons in order, as lists.
RING = """
  SELECT *, CASE WHEN ell THEN [x0, x0+w, x0+w, x0+w/2, x0+w/2, x0] ELSE [x0, x0+w, x0+w, x0] END AS px,
         CASE WHEN ell THEN [y0, y0, y0+h/2, y0+h/2, y0+h, y0+h] ELSE [y0, y0, y0+h, y0+h] END AS py
  FROM poly"""


def vector_samples(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as samples with 64 bands; classes 1 to 10."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("bands"),
        (F.col("label") + 1).alias("label"),
    )


VEC = """
  SELECT vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS bands, label + 1 AS label
  FROM embeddings"""


def quality_samples(spark: SparkSession, sf: str) -> DataFrame:
    """documents with a quality label: two uneven classes, two bands."""
    d = table(spark, sf, "documents")
    q = table(spark, sf, "labels")
    return d.join(q, "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        F.array(F.log1p(F.col("n_chars").cast("double")), F.length("lang") * 1.0 + F.length("source")).alias("bands"),
        (F.col("quality") + 1).alias("label"),
    )


QUAL = """
  SELECT d.doc_id AS sample_id, ln(1 + CAST(n_chars AS DOUBLE)) AS b1,
         CAST(length(lang) AS DOUBLE) + length(source) AS b2, quality + 1 AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    """events as samples: the value and the number in props are the bands."""
    e = table(spark, sf, "events")
    return shape_events(e)


def shape_events(e: DataFrame) -> DataFrame:
    codes = F.element_at(
        F.create_map(*[F.lit(v) for pair in EVENT_CODES.items() for v in pair]), F.col("event_type")
    )
    return e.select(
        F.col("event_id").alias("sample_id"),
        F.array(F.col("value"), F.get_json_object("props", "$.k").cast("double")).alias("bands"),
        codes.alias("label"),
    )


EVENT_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
EVENT = """
  SELECT event_id AS sample_id, value AS b1, CAST(json_extract(props, '$.k') AS DOUBLE) AS b2,
         CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
              WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS INTEGER) AS label
  FROM events"""
