"""Queries on splits, subsets, folds and training data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.operators import folds, quality, sampling
from bandloom.plans import inputs as inp
from bandloom.plans.registry import query
from bandloom.sources import tables

R6 = lambda c: F.round(c, 6)


def rank_sql(source, keys, seed, ident):
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5('{seed}|' || {ident})) AS rk,
      count(*) OVER (PARTITION BY {keys}) AS n FROM ({source})"""


@query("e1_split_pixels", f"""
WITH r AS ({rank_sql(inp.LINE, 'label', 7, 'sample_id')})
SELECT sample_id, label, CASE WHEN rk <= floor(n * (70 / 100e0)) THEN 'train' ELSE 'test' END AS role FROM r""")
def split_pixels(spark, sf):
    return sampling.split_pixels(inp.line_samples(spark, sf), 70, seed=7).select("sample_id", "label", "role")


# Largest remainder with the open rows moved by remainder order; one step suffices on these tables.
ALLOC = f"""
v AS (SELECT c_custkey AS fid, c_mktsegment AS class FROM customer),
c AS (SELECT class, count(*) AS n, sum(count(*)) OVER () AS total FROM v GROUP BY class),
e AS (SELECT class, n, CAST(round_even(0.6e0 * total, 0) AS BIGINT) AS want, n * CAST(round_even(0.6e0 * total, 0) AS BIGINT) / CAST(total AS DOUBLE) AS expected FROM c),
b AS (SELECT class, n, want, expected - floor(expected) AS rest, greatest(1, least(n - 1, CAST(floor(expected) AS BIGINT))) AS base FROM e),
d AS (SELECT *, want - sum(base) OVER () AS delta,
  CASE WHEN base < n - 1 THEN row_number() OVER (PARTITION BY base < n - 1 ORDER BY rest DESC, class DESC) END AS up,
  CASE WHEN base > 1 THEN row_number() OVER (PARTITION BY base > 1 ORDER BY rest, class) END AS down FROM b),
q AS (SELECT class, base + CASE WHEN delta > 0 AND up <= delta THEN 1 WHEN delta < 0 AND down <= -delta THEN -1 ELSE 0 END AS quota FROM d),
rk AS (SELECT v.*, row_number() OVER (PARTITION BY class ORDER BY md5('0|' || fid)) AS rk FROM v),
split AS (SELECT fid, rk.class, CASE WHEN rk <= quota THEN 'train' ELSE 'test' END AS role FROM rk JOIN q ON q.class = rk.class)"""


def polygon_split(spark, sf):
    features = inp.table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_mktsegment").alias("class"))
    return sampling.split_features(features, 0.6, seed=0)


@query("e2_split_features", f"WITH {ALLOC} SELECT fid, class, role FROM split")
def split_features(spark, sf):
    return polygon_split(spark, sf).select("fid", "class", "role")


@query("d26_split_preview", f"""
WITH {ALLOC}, p AS (SELECT class, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test FROM split GROUP BY class),
cells AS (SELECT train AS x FROM p WHERE train > 0 UNION ALL SELECT test FROM p WHERE test > 0)
SELECT class, train, test, (SELECT max(x) / min(x) FROM cells) > 10 AS severe_imbalance, test > 0 AND test < 5 AS small_test,
 CASE WHEN train = 0 THEN 'train' WHEN test = 0 THEN 'test' END AS missing_in FROM p""")
def split_preview(spark, sf):
    return quality.split_preview(polygon_split(spark, sf))


@query("e4_stratified_subset", f"""
WITH s AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY label),
t AS (SELECT label, n, greatest(1, least(n, CAST(round_even(n / CAST(total AS DOUBLE) * 61, 0) AS BIGINT))) AS target FROM c),
o AS (SELECT *, sum(target) OVER () - 61 AS over_by, coalesce(sum(target - 1) OVER (ORDER BY target DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut_before,
  coalesce(sum(n - target) OVER (ORDER BY n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS add_before FROM t),
q AS (SELECT label, target - greatest(0, least(target - 1, over_by - cut_before)) + greatest(0, least(n - target, -over_by - add_before)) AS quota FROM o),
r AS ({rank_sql('SELECT * FROM s', 'label', 3, 'sample_id')})
SELECT sample_id, r.label FROM r JOIN q ON q.label = r.label WHERE rk <= quota""")
def stratified_subset(spark, sf):
    return sampling.stratified_subset(inp.quality_samples(spark, sf), 61, seed=3).select("sample_id", "label")


@query("e5_stratified_kfold", f"""
WITH r AS ({rank_sql(inp.EVENT, 'label', 11, 'sample_id')}) SELECT sample_id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r""")
def stratified_kfold(spark, sf):
    return folds.stratified_kfold(inp.event_samples(spark, sf), 5, seed=11).select("sample_id", "label", "fold")


@query("e6_stratified_group_kfold", f"""
WITH s AS ({inp.LINE}), c AS (SELECT polygon_id, label, count(*) AS n FROM s GROUP BY 1, 2),
g AS (SELECT polygon_id, CAST(sum(n) AS BIGINT) AS size, arg_max(label, n * 1000 - label) AS main FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY main ORDER BY size DESC, md5('5|' || polygon_id)) - 1 AS p FROM g)
SELECT polygon_id, main, size, CAST(CASE WHEN (p // 3) % 2 = 0 THEN p % 3 ELSE 2 - p % 3 END AS INTEGER) AS fold FROM r""")
def group_kfold(spark, sf):
    return folds.group_folds(inp.line_samples(spark, sf), 3, seed=5)


@query("e6_group_fold_samples", f"""
WITH s AS ({inp.LINE}), c AS (SELECT polygon_id, label, count(*) AS n FROM s GROUP BY 1, 2),
g AS (SELECT polygon_id, CAST(sum(n) AS BIGINT) AS size, arg_max(label, n * 1000 - label) AS main FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY main ORDER BY size DESC, md5('5|' || polygon_id)) - 1 AS p FROM g),
f AS (SELECT polygon_id, CAST(CASE WHEN (p // 3) % 2 = 0 THEN p % 3 ELSE 2 - p % 3 END AS INTEGER) AS fold FROM r)
SELECT fold, label, count(*) AS n, count(DISTINCT s.polygon_id) AS polygons, CAST(sum(s.polygon_id) AS BIGINT) AS polygon_sum
FROM s JOIN f ON f.polygon_id = s.polygon_id GROUP BY 1, 2""")
def group_fold_samples(spark, sf):
    folded = folds.stratified_group_kfold(inp.line_samples(spark, sf), 3, seed=5)
    return folded.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("polygon_id").alias("polygons"), F.sum("polygon_id").alias("polygon_sum"))


HELD = f"""
p AS ({inp.GRID}), r AS ({rank_sql('SELECT * FROM p', 'label', 2, 'sample_id')}),
i AS (SELECT CAST(unnest(generate_series(0, 5)) AS INTEGER) AS iter), c AS (SELECT label, count(*) AS n FROM p GROUP BY label),
w AS (SELECT label, iter, n, CAST(1 + CAST('0x' || left(md5('2|' || iter || '|' || label), 8) AS UBIGINT) % n AS BIGINT) AS rank FROM c, i),
h AS (SELECT w.iter, w.label, w.n, r.sample_id, r.x, r.y FROM w JOIN r ON r.label = w.label AND r.rk = w.rank)"""


@query("e7_sloo_folds", f"""
WITH {HELD}, d AS (SELECT h.iter, h.label, h.sample_id AS held_out, h.n, p.sample_id, sqrt((h.x - p.x) * (h.x - p.x) + (h.y - p.y) * (h.y - p.y)) AS dist
  FROM h JOIN p ON p.label = h.label)
SELECT iter, label, held_out, count(*) FILTER (dist >= 15 AND dist > 0.1) AS n_train FROM d GROUP BY 1, 2, 3""")
def sloo_folds(spark, sf):
    pixels = inp.grid_pixels(spark, sf)
    held, excluded = folds.sloo_folds(pixels, 15.0, max_iter=6, seed=2)
    return folds.sloo_sizes(pixels, held, excluded)


@query("e7_sloo_training", f"""
WITH {HELD} SELECT p.label, count(*) AS n, CAST(sum(p.sample_id) AS BIGINT) AS id_sum FROM h JOIN p ON p.label = h.label
WHERE iter = 3 AND sqrt((h.x - p.x) * (h.x - p.x) + (h.y - p.y) * (h.y - p.y)) >= 15 GROUP BY p.label""")
def sloo_training(spark, sf):
    pixels = inp.grid_pixels(spark, sf)
    _, excluded = folds.sloo_folds(pixels, 15.0, max_iter=6, seed=2)
    return folds.sloo_training(pixels, excluded, 3).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("id_sum"))


# Distance of every sample of a class to the one that was drawn.
AWAY = f"""{HELD}, d AS (SELECT h.iter, h.label, h.sample_id AS held_out, r.sample_id, r.rk, sqrt((h.x - r.x) * (h.x - r.x) + (h.y - r.y) * (h.y - r.y)) AS dist
  FROM h JOIN r ON r.label = h.label)"""


@query("e7_sloo_min_train", f"""
WITH {AWAY}, f AS (SELECT *, row_number() OVER (PARTITION BY iter, label ORDER BY dist DESC, md5('2|' || sample_id)) <= 25 AS drawn FROM d)
SELECT iter, label, count(*) FILTER (dist >= 15 AND NOT drawn) AS n_train, count(*) FILTER (drawn) AS n_valid,
  CAST(sum(sample_id) FILTER (drawn) AS BIGINT) AS valid_sum FROM f GROUP BY 1, 2""")
def sloo_min_train(spark, sf):
    return folds.sloo_sides(inp.grid_pixels(spark, sf), 15.0, max_iter=6, seed=2, min_train=25).sizes()


@query("e7_sloo_share", f"""
WITH {AWAY}, q AS (SELECT label, n, CAST(CAST('0x' || left(md5('2|moved|3|' || label), 8) AS UBIGINT) % n AS BIGINT) AS start,
  greatest(0, CAST(floor(0.3e0 * n) AS BIGINT) - 1) AS quota FROM c),
o AS (SELECT d.*, quota, row_number() OVER (PARTITION BY d.label, dist >= 15 ORDER BY (rk - 1 - start + n) % n) AS place FROM d JOIN q ON q.label = d.label WHERE iter = 3),
f AS (SELECT *, CASE WHEN sample_id = held_out OR (dist >= 15 AND place <= quota) THEN 'valid' WHEN dist >= 15 THEN 'train' END AS role FROM o)
SELECT label, role, count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS id_sum FROM f WHERE role IS NOT NULL GROUP BY 1, 2""")
def sloo_share(spark, sf):
    sides = folds.sloo_sides(inp.grid_pixels(spark, sf), 15.0, max_iter=6, seed=2, min_train=0.3)
    rows = [side(3).select("label", F.lit(role).alias("role"), "sample_id") for role, side in (("train", sides.training), ("valid", sides.validation))]
    return rows[0].unionByName(rows[1]).groupBy("label", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("id_sum"))


STANDS = f"s AS ({inp.LINE}), st AS (SELECT label, stand_id, count(*) AS n FROM s GROUP BY 1, 2), tot AS (SELECT label, CAST(sum(n) AS BIGINT) AS t, count(*) AS m FROM st GROUP BY label)"


@query("e8_stand_folds_leave_one", f"""
WITH {STANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('4|' || stand_id)) AS rk FROM st),
i AS (SELECT CAST(unnest(generate_series(0, 6)) AS INTEGER) AS iter),
w AS (SELECT label, iter, t, CAST(1 + CAST('0x' || left(md5('4|' || iter || '|' || label), 8) AS UBIGINT) % m AS BIGINT) AS rank FROM tot, i)
SELECT w.iter, w.label, t - r.n AS n_train, r.n AS n_valid FROM w JOIN r ON r.label = w.label AND r.rk = w.rank""")
def stand_folds_one(spark, sf):
    s = inp.line_samples(spark, sf)
    return folds.stand_fold_sizes(s, folds.stand_folds(s, max_iter=7, sloo=True, seed=4))


@query("e8_stand_folds_half", f"""
WITH {STANDS}, i AS (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS iter),
r AS (SELECT iter, st.label, st.n, t, m, row_number() OVER (PARTITION BY iter, st.label ORDER BY md5('4|' || iter || '|' || stand_id)) AS rk FROM st JOIN tot ON tot.label = st.label, i)
SELECT iter, label, CAST(sum(n) FILTER (rk <= floor(m * 0.5e0)) AS BIGINT) AS n_train, CAST(sum(n) FILTER (rk > floor(m * 0.5e0)) AS BIGINT) AS n_valid FROM r GROUP BY 1, 2""")
def stand_folds_half(spark, sf):
    s = inp.line_samples(spark, sf)
    return folds.stand_fold_sizes(s, folds.stand_folds(s, max_iter=5, sloo=False, seed=4))


@query("e9_min_stands_per_class", f"""
WITH s AS ({inp.LINE}) SELECT min(m) AS min_stands FROM (SELECT count(DISTINCT stand_id) AS m FROM s GROUP BY label)""")
def min_stands(spark, sf):
    return folds.min_stands_per_class(inp.line_samples(spark, sf))


@query("e11_sample_pixels", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('9|' || sample_id)) AS rk, count(*) OVER () AS n FROM ({inp.GRID})),
d AS (SELECT i AS draw, CAST(1 + CAST('0x' || left(md5('9|draw|' || i), 8) AS UBIGINT) % (SELECT max(n) FROM r) AS BIGINT) AS rank FROM (SELECT unnest(generate_series(0, 999)) AS i))
SELECT draw, "row", "col", b2 FROM d JOIN r ON r.rk = d.rank""")
def sample_pixels(spark, sf):
    drawn = sampling.draw_rows(inp.grid_pixels(spark, sf), 1000, seed=9)
    return drawn.select("draw", "row", "col", F.col("bands")[1].alias("b2"))


def policy_sql(source):
    return f"""WITH s AS ({source}), c AS (SELECT label, count(*) AS n FROM s GROUP BY label),
a AS (SELECT CAST(sum(n) AS BIGINT) AS samples, min(n) AS lo, max(n) / CAST(min(n) AS DOUBLE) AS ratio FROM c),
f AS (SELECT *, samples > 20000 OR ratio > 50 OR lo < 30 AS fast FROM a)
SELECT samples, lo AS min_class, round(ratio, 6) AS ratio, fast AS fast_mode,
 CASE WHEN lo < (CASE WHEN fast THEN 2 ELSE 3 END) THEN greatest(2, lo) ELSE CAST(CASE WHEN fast THEN 2 ELSE 3 END AS BIGINT) END AS folds,
 CASE WHEN fast THEN least(samples, 15000) ELSE samples END AS search_rows, CAST(CASE WHEN fast THEN 25 ELSE 100 END AS BIGINT) AS trials FROM f"""


@query("e12_fast_mode_policy", policy_sql(inp.LINE))
def fast_mode(spark, sf):
    return sampling.fast_mode_policy(inp.line_samples(spark, sf)).withColumn("ratio", R6("ratio"))


@query("e12_normal_mode_policy", policy_sql(inp.EVENT))
def normal_mode(spark, sf):
    return sampling.fast_mode_policy(inp.event_samples(spark, sf)).withColumn("ratio", R6("ratio"))


@query("d7_polygons_per_class", f"""
WITH poly AS ({inp.POLY}) SELECT class, count(*) AS n FROM poly WHERE class <> '' GROUP BY class""")
def polygons_per_class(spark, sf):
    return folds.polygons_per_class(inp.supplier_polygons(spark, sf))


@query("d8_polygon_coverage", f"""
WITH s AS (SELECT label, polygon_id FROM ({inp.LINE}) UNION ALL SELECT 4 + CAST(o_orderkey % 3 AS INTEGER), CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey END FROM orders)
SELECT label, count(DISTINCT polygon_id) AS polygons FROM s GROUP BY label HAVING count(DISTINCT polygon_id) < 2""")
def polygon_coverage(spark, sf):
    o = inp.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    more = o.select((k + 4).cast("int").alias("label"), F.when(k == 0, F.lit(1)).otherwise(F.col("o_orderkey")).alias("polygon_id"))
    return folds.polygon_coverage(inp.line_samples(spark, sf).select("label", "polygon_id").unionByName(more), 2)


@query("d25_duplicate_features", f"""
WITH poly AS (SELECT * FROM ({inp.POLY}) UNION ALL SELECT * FROM ({inp.POLY}) WHERE h = 4),
ring AS ({inp.RING}), e AS (SELECT *, row_number() OVER () AS rid FROM ring WHERE class <> ''),
seg AS (SELECT rid, class, px[i] AS x1, py[i] AS y1, px[i % len(px) + 1] AS x2, py[i % len(px) + 1] AS y2 FROM (SELECT *, generate_subscripts(px, 1) AS i FROM e)),
cen AS (SELECT rid, class, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cx, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cy FROM seg GROUP BY 1, 2)
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM cen GROUP BY class, cx, cy)""")
def duplicate_features(spark, sf):
    p = tables.labelled_polygons(inp.supplier_polygons(spark, sf))
    return quality.duplicate_features(p.unionByName(p.filter(F.col("fid") % 5 == 1)))


@query("d24_training_quality_report", f"""
WITH poly AS ({inp.POLY}), c AS (SELECT class, count(*) AS n FROM poly WHERE class <> '' GROUP BY class),
f AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, CAST(max(n) AS DOUBLE) / min(n) AS ratio, count(*) FILTER (n < 10) AS b10, count(*) FILTER (n < 30) AS b30 FROM c)
SELECT 'small_dataset' AS "check", 'warning' AS severity, n AS value FROM f WHERE n < 50
UNION ALL SELECT 'single_class', 'critical', CAST(k AS DOUBLE) FROM f WHERE k = 1
UNION ALL SELECT 'class_imbalance', CASE WHEN ratio > 50 THEN 'critical' WHEN ratio > 10 THEN 'warning' ELSE 'info' END, round(ratio, 6) FROM f WHERE ratio > 3 AND k > 1
UNION ALL SELECT 'low_class_count', CASE WHEN b10 > 0 THEN 'critical' ELSE 'warning' END, CAST(CASE WHEN b10 > 0 THEN b10 ELSE b30 END AS DOUBLE) FROM f WHERE b30 > 0
UNION ALL SELECT 'spatial_data', 'info', n FROM f WHERE n >= 10""")
def training_quality(spark, sf):
    report = quality.training_quality_report(tables.labelled_polygons(inp.supplier_polygons(spark, sf)))
    return report.withColumn("value", R6("value"))
