"""Queries on Spark ML classifiers, searches, oversampling, attribution and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.operators import explain, gaussian, learners, metrics, oversample, prepare, sampling, tuning
from bandloom.plans import classify, inputs as inp
from bandloom.plans.catalogue.models import DISC, SCALED, gauss_sql, scaled_lines
from bandloom.plans.catalogue.scores import PRF
from bandloom.plans.catalogue.splitting import STANDS
from bandloom.plans.registry import query
from bandloom.plans.train import TrainConfig, train
from bandloom.session import scratch_path
from bandloom.sources import models, reports, tables
from bandloom.streaming import gaussian as streams

R6 = lambda c: F.round(c, 6)


def scored(fitted, test):
    return metrics.overall_scores(metrics.cell_counts(
        fitted.predict(test, ["label"]).withColumnRenamed("class", "prediction")))


def split(samples, seed=0, percent=70):
    both = sampling.split_pixels(samples, percent, seed=seed)
    return both.filter("role = 'train'").drop("role"), both.filter("role = 'test'").drop("role")


def learner_query(code, params, source):
    def run(spark, sf):
        tr, te = split(source(spark, sf))
        return scored(learners.fit(code, tr, params, seed=0), te)

    return run


query("i6_rf_fit")(learner_query("RF", {"n_estimators": 20, "max_depth": 6, "max_features": "sqrt"}, inp.vector_samples))
query("i7_svm_rbf_fit")(learner_query("SVM", {"C": 1.0, "gamma": "scale"}, inp.quality_samples))
query("i9_xgb_fit")(learner_query("XGB", {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.1}, inp.quality_samples))
query("i9_cb_fit")(learner_query("CB", {"iterations": 8, "depth": 3, "learning_rate": 0.1}, inp.quality_samples))
query("i9_gbc_fit")(learner_query("GBC", {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.2}, inp.event_samples))
query("i10_extra_trees_fit")(learner_query("ET", {"n_estimators": 20, "max_depth": 6}, inp.vector_samples))
query("i11_logistic_fit")(learner_query("LR", {"C": 1.0, "max_iter": 50}, inp.vector_samples))
query("i13_mlp_fit")(learner_query("MLP", {"hidden_layer_sizes": (16,), "max_iter": 40}, inp.vector_samples))


_BOOST = {"n_estimators": 2, "max_depth": 1, "learning_rate": 0.3, "reg_lambda": 1.0, "min_child_weight": 1, "binning": "width", "bins": 8}


def _boost_round(r: int) -> str:
    """CTEs of one round of three stumps on equal-width thresholds: losses, best splits, new margins."""
    margin = ", ".join(f"f{k} + 0.3 * CASE WHEN [b1, b2, b3, b4][a{k}] <= e{k} THEN l{k} ELSE r{k} END AS f{k}" for k in (1, 2, 3))
    chosen = ", ".join(f"max(band) FILTER (k = {k}) AS a{k}, max(edge) FILTER (k = {k}) AS e{k}, max(vl) FILTER (k = {k}) AS l{k}, max(vr) FILTER (k = {k}) AS r{k}" for k in (1, 2, 3))
    return f"""
p{r} AS (SELECT *, [exp(f1) / (exp(f1) + exp(f2) + exp(f3)), exp(f2) / (exp(f1) + exp(f2) + exp(f3)), exp(f3) / (exp(f1) + exp(f2) + exp(f3))] AS p FROM s{r}),
w{r} AS (SELECT label, b1, b2, b3, b4, unnest([1, 2, 3]) AS k, unnest(p) AS p FROM p{r}),
m{r} AS (SELECT k, p - CASE WHEN label = k THEN 1 ELSE 0 END AS g, p * (1 - p) AS h, unnest([1, 2, 3, 4]) AS band, unnest([b1, b2, b3, b4]) AS v FROM w{r}),
q{r} AS (SELECT k, m.band, j, edge, sum(g) FILTER (v <= edge) AS gl, sum(h) FILTER (v <= edge) AS hl, count(*) FILTER (v <= edge) AS nl, sum(g) AS g, sum(h) AS h, count(*) AS n
  FROM m{r} m JOIN edges e ON m.band = e.band GROUP BY ALL),
c{r} AS (SELECT *, -gl / (hl + 1) AS vl, -(g - gl) / (h - hl + 1) AS vr FROM q{r} WHERE hl >= 1 AND h - hl >= 1 AND nl > 0 AND nl < n
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) DESC, band, j) = 1),
x{r} AS (SELECT {chosen} FROM c{r}),
s{r + 1} AS (SELECT sample_id, label, b1, b2, b3, b4, {margin} FROM s{r}, x{r})"""


BOOSTED = f"""
s0 AS (SELECT sample_id, label, b1, b2, b3, b4, 0e0 AS f1, 0e0 AS f2, 0e0 AS f3 FROM ({inp.LINE})),
lim AS (SELECT unnest([1, 2, 3, 4]) AS band, unnest([min(b1), min(b2), min(b3), min(b4)]) AS lo, unnest([max(b1), max(b2), max(b3), max(b4)]) AS hi FROM s0),
edges AS (SELECT band, j, lo + (hi - lo) * j / 8 AS edge FROM lim, (SELECT unnest(range(1, 8)) AS j)), {_boost_round(0)}, {_boost_round(1)}"""


def _loss(r: int) -> str:
    return f"SELECT CAST({r} AS INTEGER) AS round, round(avg(ln(exp(f1) + exp(f2) + exp(f3)) - [f1, f2, f3][label]), 6) AS loss FROM s{r}"


@query("i9_boosted_losses", f"WITH {BOOSTED} {_loss(0)} UNION ALL {_loss(1)} UNION ALL {_loss(2)}")
def boosted_losses(spark, sf):
    fitted = learners.fit("XGB", inp.line_samples(spark, sf), _BOOST)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(fitted.losses)], "round int, loss double").withColumn("loss", R6("loss"))


_STUMPS = " UNION ALL ".join(f"SELECT {r} AS round, k, band, edge, vl, vr, nl / n AS share FROM c{r}" for r in (0, 1))


# A stump's attribution is the leaf's value less the mean over the training rows.
@query("i22_path_importance", f"""
WITH {BOOSTED}, stumps AS ({_STUMPS}),
v AS (SELECT sample_id, k, band, sum(0.3 * CASE WHEN [b1, b2, b3, b4][band] <= edge THEN (1 - share) * (vl - vr) ELSE share * (vr - vl) END) AS value
  FROM s0, stumps GROUP BY 1, 2, 3),
i AS (SELECT band, sum(abs(value)) AS total FROM v GROUP BY band)
SELECT CAST(b AS INTEGER) AS band, round(coalesce(total, 0) / (SELECT sum(total) FROM i), 6) AS importance FROM (SELECT unnest([1, 2, 3, 4]) AS b) LEFT JOIN i ON band = b""")
def path_importance(spark, sf):
    fitted = learners.fit("XGB", inp.line_samples(spark, sf), _BOOST)
    ranked = explain.rank_features(explain.shapley_importance(fitted, inp.line_samples(spark, sf), method="paths"))
    return ranked.select("band", R6("importance").alias("importance"))


def _draw(tree: str, node: str, band: str) -> str:
    return f"CAST('0x' || substr(md5('0|cut|' || {tree} || '|' || {node} || '|' || ({band} - 1)), 1, 13) AS BIGINT) / 4503599627370496e0"


def _random_level(source: str, out: str) -> str:
    """Best of one random threshold per band for every node of `source` (tree, node, label, b1 to b4)."""
    return f"""
{out}_v AS (SELECT tree, node, label, unnest([1, 2, 3, 4]) AS band, unnest([b1, b2, b3, b4]) AS v FROM {source}),
{out}_c AS (SELECT tree, node, band, min(v) + {_draw("tree", "node", "band")} * (max(v) - min(v)) AS cut FROM {out}_v GROUP BY tree, node, band),
{out}_k AS (SELECT v.tree, v.node, v.band, c.cut, label, count(*) AS w, count(*) FILTER (v <= cut) AS wl FROM {out}_v v JOIN {out}_c c ON v.tree = c.tree AND v.node = c.node AND v.band = c.band GROUP BY ALL),
{out}_s AS (SELECT tree, node, band, cut, sum(w) AS n, sum(wl) AS nl, sum(wl * wl) / sum(wl) + sum((w - wl) * (w - wl)) / (sum(w) - sum(wl)) AS purity FROM {out}_k GROUP BY ALL),
{out} AS (SELECT * FROM {out}_s QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY purity DESC NULLS LAST, band) = 1)"""


@query("i10_random_thresholds", f"""
WITH s AS ({inp.LINE}), n0 AS (SELECT tree, 0 AS node, label, b1, b2, b3, b4 FROM s, (SELECT unnest([0, 1]) AS tree)), {_random_level("n0", "t0")},
n1 AS (SELECT n0.tree, CASE WHEN [b1, b2, b3, b4][band] <= cut THEN 1 ELSE 2 END AS node, label, b1, b2, b3, b4 FROM n0 JOIN t0 ON n0.tree = t0.tree), {_random_level("n1", "t1")}
SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(band AS INTEGER) AS band, round(cut, 6) AS threshold, CAST(n AS BIGINT) AS n_rows, CAST(nl AS BIGINT) AS n_left
FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1)""")
def random_thresholds(spark, sf):
    fitted = learners.fit("ET", inp.line_samples(spark, sf), {"n_estimators": 2, "max_depth": 2, "max_features": None})
    rows = [(t, i, int(tree.band[i]) + 1, float(tree.threshold[i]), int(tree.cover[i]), int(tree.cover[tree.left[i]]))
            for t, tree in enumerate(fitted.trees) for i in range(len(tree.band)) if tree.band[i] >= 0]
    table = spark.createDataFrame(rows, "tree int, node int, band int, threshold double, n_rows bigint, n_left bigint")
    return table.withColumn("threshold", R6("threshold"))


@query("i15_grid_search")
def grid_search(spark, sf):
    found = tuning.grid_search("RF", inp.event_samples(spark, sf), {"n_estimators": [5], "max_depth": [2, 4]}, folds=2)
    return found.table(spark)


KNN_FOLDS = f"""
s AS ({inp.VEC}), t AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('0|' || sample_id)) - 1) % 3 AS fold FROM s),
d AS (SELECT a.sample_id, a.label AS truth, a.fold, b.sample_id AS ref_id, b.label, list_distance(a.bands, b.bands) AS distance FROM t a JOIN t b ON a.fold <> b.fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, ref_id) AS place FROM d QUALIFY place <= 10),
k AS (SELECT unnest([1, 3, 10]) AS k), v AS (SELECT k, fold, sample_id, truth, label, count(*) AS votes FROM nn JOIN k ON place <= k GROUP BY ALL),
c AS (SELECT k, fold, sample_id, truth, arg_max(label, votes * 1000 - label) AS class FROM v GROUP BY ALL),
f AS (SELECT k, fold, avg(CASE WHEN truth = class THEN 1e0 ELSE 0e0 END) AS score FROM c GROUP BY ALL),
g AS (SELECT k, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM f GROUP BY k)"""


def knn_search(spark, sf):
    return tuning.grid_search("KNN", inp.vector_samples(spark, sf), {"n_neighbors": [1, 3, 10]}, folds=3)


@query("i15_grid_search_knn", f"""
WITH {KNN_FOLDS} SELECT CAST(CASE k WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INTEGER) AS place, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score FROM g""")
def grid_search_knn(spark, sf):
    return knn_search(spark, sf).table(spark).select("place", R6("mean_score").alias("mean_score"), R6("std_score").alias("std_score"))


@query("f2_best_params", f"""
WITH {KNN_FOLDS} SELECT CAST(k AS BIGINT) AS n_neighbors, round(mean_score, 6) AS mean_score FROM g ORDER BY mean_score DESC, k LIMIT 1""")
def best_params(spark, sf):
    best = knn_search(spark, sf).best
    return spark.createDataFrame([(best["params"]["n_neighbors"], best["mean"])], "n_neighbors bigint, mean_score double").withColumn(
        "mean_score", R6("mean_score"))


@query("i16_random_search")
def random_search(spark, sf):
    found = tuning.random_search("LR", inp.event_samples(spark, sf), n_trials=3, folds=2, seed=1, limits={"max_iter": 20})
    return found.table(spark)


@query("i17_nested_cv")
def nested_cv(spark, sf):
    return tuning.nested_cv("NB", inp.vector_samples(spark, sf), {"var_smoothing": [1e-9, 1e-3]}, outer=3, inner=2)


@query("e10_learning_curve", f"""
WITH s AS ({inp.EVENT}), o AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('0|' || sample_id)) - 1) % 2 AS fold FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('0|curve|' || sample_id)) AS rk, count(*) OVER (PARTITION BY fold) AS nf FROM o),
sh AS (SELECT unnest([0.2e0, 0.6e0, 1e0]) AS share), ff AS (SELECT unnest([0, 1]) AS f),
tr AS (SELECT share, f, t.* FROM t JOIN ff ON fold <> f JOIN sh ON rk <= floor(nf * share)),
eps AS (SELECT share, f, 1e-9 * greatest(var_pop(b1), var_pop(b2)) AS eps, count(*) AS n FROM tr GROUP BY 1, 2),
m AS (SELECT tr.share, tr.f, label, avg(b1) AS m1, avg(b2) AS m2, var_pop(b1) + max(eps) AS v1, var_pop(b2) + max(eps) AS v2, count(*) / CAST(max(n) AS DOUBLE) AS prior
  FROM tr JOIN eps ON eps.share = tr.share AND eps.f = tr.f GROUP BY 1, 2, 3),
ev AS (SELECT share, f, 'train' AS side, sample_id, label, b1, b2 FROM tr UNION ALL SELECT share, f, 'valid', sample_id, label, b1, b2 FROM t JOIN ff ON fold = f, sh),
k AS (SELECT ev.share, ev.f, side, sample_id, ev.label AS truth, arg_min(m.label, ln(v1) + (b1 - m1) * (b1 - m1) / v1 + ln(v2) + (b2 - m2) * (b2 - m2) / v2 - 2 * ln(prior)) AS class
  FROM ev JOIN m ON m.share = ev.share AND m.f = ev.f GROUP BY 1, 2, 3, 4, 5),
sc AS (SELECT share, f, side, avg(CASE WHEN truth = class THEN 1e0 ELSE 0e0 END) AS score FROM k GROUP BY 1, 2, 3)
SELECT share, round(avg(score) FILTER (side = 'train'), 6) AS train_mean, round(stddev_pop(score) FILTER (side = 'train'), 6) AS train_std,
 round(avg(score) FILTER (side = 'valid'), 6) AS valid_mean, round(stddev_pop(score) FILTER (side = 'valid'), 6) AS valid_std FROM sc GROUP BY share""")
def learning_curve(spark, sf):
    curve = tuning.learning_curve("NB", inp.event_samples(spark, sf), sizes=(0.2, 0.6, 1.0), folds=2)
    return curve.select("share", *[R6(c).alias(c) for c in curve.columns[1:]])


@query("i19_apply_class_weights")
def apply_class_weights(spark, sf):
    tr, te = split(inp.quality_samples(spark, sf))
    weighted = learners.with_class_weights("LR", tr)
    return scored(learners.fit("LR", weighted, {"C": 1.0, "max_iter": 50}), te)


@query("i18_smote", f"""
WITH q AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM q GROUP BY label)
SELECT label, false AS synthetic, n FROM c UNION ALL SELECT label, true, most - n FROM c WHERE n < most""")
def smote(spark, sf):
    both = oversample.smote(inp.quality_samples(spark, sf), seed=3)
    return both.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("i18_smote_points", f"""
WITH q AS ({inp.EVENT}), c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS most, row_number() OVER (ORDER BY count(*), label) AS small FROM q GROUP BY label),
w AS (SELECT label, n, most - n AS need FROM c WHERE small > 1 AND n < most),
r AS (SELECT q.*, need // n + CASE WHEN row_number() OVER (PARTITION BY q.label ORDER BY md5('3|' || sample_id)) <= need % n THEN 1 ELSE 0 END AS copies FROM q JOIN w ON w.label = q.label),
s AS (SELECT * FROM r WHERE copies > 0),
p AS (SELECT s.sample_id, o.b1, o.b2, row_number() OVER (PARTITION BY s.sample_id ORDER BY (o.b1 - s.b1) * (o.b1 - s.b1) + (o.b2 - s.b2) * (o.b2 - s.b2), o.sample_id) - 1 AS nth
  FROM s JOIN q o ON o.label = s.label AND o.sample_id <> s.sample_id QUALIFY nth < 5),
m AS (SELECT s.*, unnest(generate_series(1, copies)) AS copy FROM s), h AS (SELECT *, md5('3|' || sample_id || '|' || copy) AS h FROM m),
u AS (SELECT *, CAST('0x' || left(md5(h), 8) AS UBIGINT) / 4294967296e0 AS part, CAST('0x' || left(h, 6) AS UBIGINT) % 5 AS pick FROM h)
SELECT u.sample_id || '#' || copy AS sample_id, label, round(u.b1 + part * (p.b1 - u.b1), 6) AS b1, round(u.b2 + part * (p.b2 - u.b2), 6) AS b2
FROM u JOIN p ON p.sample_id = u.sample_id AND p.nth = pick""")
def smote_points(spark, sf):
    made = oversample.smote(inp.event_samples(spark, sf), seed=3, strategy="not minority").filter("synthetic")
    return made.select("sample_id", "label", *[F.round(F.col("bands")[i], 6).alias(f"b{i + 1}") for i in range(2)])


# Every synthetic point must lie between a seed of its class and another row of it.
@query("g1_append_synthetic", f"""
WITH q AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n FROM q GROUP BY label), r AS (SELECT label, min(b1) AS lo, max(b1) AS hi FROM q GROUP BY label)
SELECT r.label, (SELECT max(n) FROM c) AS n, true AS inside FROM r""")
def append_synthetic(spark, sf):
    q = inp.quality_samples(spark, sf)
    b = F.col("bands")[0]
    limits = q.groupBy("label").agg(F.min(b).alias("lo"), F.max(b).alias("hi"))
    both = oversample.smote(q, seed=3).join(limits, "label")
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((b >= F.col("lo") - 1e-9) & (b <= F.col("hi") + 1e-9)).alias("inside"))


ATTR = f"""
a AS (SELECT sample_id, 1 AS class, 1 AS band, b3 - 0.05 AS value FROM ({inp.LINE}) UNION ALL SELECT sample_id, 2, 1, b4 - 0.04 FROM ({inp.LINE})
 UNION ALL SELECT sample_id, 1, 2, b4 * 2 - 0.1 FROM ({inp.LINE}) UNION ALL SELECT sample_id, 2, 2, b3 * b4 FROM ({inp.LINE}))"""


def attributions(spark, sf):
    b = F.col("bands")
    cell = lambda c, f, v: F.struct(F.lit(c).alias("class"), F.lit(f).alias("band"), v.alias("value"))
    cells = F.array(cell(1, 1, b[2] - 0.05), cell(2, 1, b[3] - 0.04), cell(1, 2, b[3] * 2 - 0.1), cell(2, 2, b[2] * b[3]))
    return inp.line_samples(spark, sf).select("sample_id", F.explode(cells).alias("c")).select("sample_id", "c.*")


@query("d31_shap_aggregate", f"""
WITH {ATTR}, s AS (SELECT sample_id, band, avg(abs(value)) AS v, avg(value) AS m FROM a GROUP BY 1, 2), f AS (SELECT band, avg(v) AS mean_abs, avg(m) AS mean, max(v) AS max_abs FROM s GROUP BY band)
SELECT band, 'mean_abs' AS how, round(mean_abs / sum(mean_abs) OVER (), 6) AS importance FROM f
UNION ALL SELECT band, 'mean', round(CASE WHEN sum(mean) OVER () > 0 THEN mean / sum(mean) OVER () ELSE mean END, 6) FROM f
UNION ALL SELECT band, 'max_abs', round(max_abs / sum(max_abs) OVER (), 6) FROM f""")
def shap_aggregate(spark, sf):
    values, out = attributions(spark, sf), None
    for how in explain.AGGREGATES:
        part = explain.aggregate_attributions(values, how).select("band", F.lit(how).alias("how"), R6("importance").alias("importance"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f1_rank_features", f"""
WITH {ATTR}, s AS (SELECT sample_id, band, avg(abs(value)) AS v FROM a GROUP BY 1, 2), f AS (SELECT band, avg(v) AS v FROM s GROUP BY band)
SELECT band, round(v / sum(v) OVER (), 6) AS importance FROM f ORDER BY importance DESC""")
def rank_features(spark, sf):
    ranked = explain.rank_features(explain.aggregate_attributions(attributions(spark, sf)))
    return ranked.select("band", R6("importance").alias("importance"))


@query("i22_shapley_importance", f"""
WITH {SCALED}, {gauss_sql()},
q AS (SELECT sample_id, x, y FROM z ), bg AS (SELECT sample_id AS bid, x AS g_x, y AS g_y FROM z ORDER BY md5('1|ground|' || sample_id) LIMIT 50),
c AS (SELECT unnest([0, 1, 2, 3]) AS cid),
t AS (SELECT sample_id, cid, bid, CASE WHEN cid & 1 = 1 THEN x ELSE g_x END AS x, CASE WHEN cid & 2 = 2 THEN y ELSE g_y END AS y FROM q, bg, c),
k AS (SELECT t.sample_id, t.cid, t.bid, gi.label, {DISC} AS k FROM t CROSS JOIN gi),
e AS (SELECT *, exp((min(k) OVER (PARTITION BY sample_id, cid, bid) - k) / 2) AS e FROM k),
p AS (SELECT sample_id, cid, label, e / sum(e) OVER (PARTITION BY sample_id, cid, bid) AS p FROM e),
v AS (SELECT sample_id, cid, label, avg(p) AS v FROM p GROUP BY 1, 2, 3),
w AS (SELECT sample_id, label, max(v) FILTER (cid = 0) AS v0, max(v) FILTER (cid = 1) AS v1, max(v) FILTER (cid = 2) AS v2, max(v) FILTER (cid = 3) AS v3 FROM v GROUP BY 1, 2),
f AS (SELECT avg(abs((v1 - v0 + v3 - v2) / 2)) AS f1, avg(abs((v2 - v0 + v3 - v1) / 2)) AS f2 FROM w)
SELECT 1 AS band, round(f1 / (f1 + f2), 5) AS importance FROM f UNION ALL SELECT 2, round(f2 / (f1 + f2), 5) FROM f""")
def shapley_importance(spark, sf):
    z = scaled_lines(spark, sf).select("sample_id", "label", "bands")
    fitted = learners.fit("GMM", z)
    ranked = explain.rank_features(explain.shapley_importance(fitted, z, seed=1, background_limit=50))
    return ranked.select("band", F.round("importance", 5).alias("importance"))


GRIDZ = f"""
p AS ({inp.GRID}), s AS (SELECT * FROM p WHERE b1 <> -9999), bd AS (SELECT min(b1) l1, max(b1) h1, min(b2) l2, max(b2) h2 FROM s),
z AS (SELECT label, 2 * (b1 - l1) / (h1 - l1) - 1 AS x, 2 * (b2 - l2) / (h2 - l2) - 1 AS y FROM s, bd), {gauss_sql()},
t AS (SELECT raster_id, "row", "col", label AS truth, mask, 2 * (b1 - l1) / (h1 - l1) - 1 AS x, 2 * (b2 - l2) / (h2 - l2) - 1 AS y FROM p, bd WHERE b1 <> -9999),
k AS (SELECT t.raster_id, t."row", t."col", t.mask, gi.label, {DISC} AS k FROM t CROSS JOIN gi),
b AS (SELECT *, min(k) OVER (PARTITION BY raster_id, "row", "col") AS lo FROM k),
out AS (SELECT raster_id, "row", "col", max(mask) AS mask, arg_min(label, k) AS class, 1 / sum(exp((lo - k) / 2)) AS confidence FROM b GROUP BY 1, 2, 3)"""


def grid_model(spark, sf):
    """A Gaussian model of the labelled orders raster, with its bounds."""
    pixels = inp.grid_pixels(spark, sf)
    samples = prepare.valid_pixels(pixels).select("sample_id", "label", "bands")
    result = train(samples, TrainConfig(code="GMM", split=100))
    return pixels, result


@query("i20_predict_raster", f"""
WITH {GRIDZ} SELECT raster_id, "row", "col", class, round(confidence, 5) AS confidence FROM out""")
def predict_raster(spark, sf):
    pixels, result = grid_model(spark, sf)
    return classify.predict_raster(pixels, result.fitted, result.scaler).withColumn("confidence", F.round("confidence", 5))


@query("i20_predict_raster_masked", f"""
WITH {GRIDZ} SELECT raster_id, "row", "col", class FROM out WHERE mask <> 0""")
def predict_raster_masked(spark, sf):
    pixels, result = grid_model(spark, sf)
    return classify.predict_raster(pixels, result.fitted, result.scaler, masked=True).drop("confidence")


@query("i20_raster_products", f"""
WITH {GRIDZ} SELECT p.raster_id, p."row", p."col", CAST(coalesce(out.class, -9999) AS INTEGER) AS class, round(coalesce(out.confidence * 100, -1), 3) AS confidence
FROM p LEFT JOIN out ON out."row" = p."row" AND out."col" = p."col" AND p.mask <> 0""")
def raster_products(spark, sf):
    pixels, result = grid_model(spark, sf)
    products = classify.raster_products(pixels, result.fitted, result.scaler, masked=True)
    return products.withColumn("confidence", F.round("confidence", 3))


@query("a12_classify_batch", f"""
WITH {GRIDZ}, n AS (SELECT raster_id, count(*) AS pixels FROM p GROUP BY 1), c AS (SELECT raster_id, count(*) AS classified FROM out GROUP BY 1)
SELECT n.raster_id, pixels, coalesce(classified, 0) AS classified, 'classified_' || n.raster_id AS output, coalesce(classified > 0, false) AS success FROM n LEFT JOIN c ON c.raster_id = n.raster_id""")
def classify_batch(spark, sf):
    pixels, result = grid_model(spark, sf)
    return classify.classify_batch(pixels, result.fitted, result.scaler)[1]


@query("a12_list_rasters", """
WITH f AS (SELECT page_id, '/in/' || page_id || CASE page_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.png' ELSE '.tif.xml' END AS path FROM pages)
SELECT path, replace(path, '/in/', '/in/classified_') AS output FROM f WHERE page_id % 4 < 2""")
def list_rasters(spark, sf):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, ".tif").when(k == 1, ".TIFF").when(k == 2, ".png").otherwise(".tif.xml")
    files = inp.table(spark, sf, "pages").select(F.concat(F.lit("/in/"), F.col("page_id").cast("string"), tail).alias("path"))
    return classify.list_rasters(files)


@query("i23_importance_map", f"""
WITH {GRIDZ}, o AS (SELECT sum(prior * ca) AS wx, sum(prior * cc) AS wy FROM g)
SELECT raster_id, "row", "col", 1 AS band, round(100 * wx / (wx + wy + 1e-10), 5) AS importance FROM p, o
UNION ALL SELECT raster_id, "row", "col", 2, round(100 * wy / (wx + wy + 1e-10), 5) FROM p, o""")
def importance_map(spark, sf):
    pixels, result = grid_model(spark, sf)
    shares = gaussian.feature_importance(result.fitted.model, "variance")
    return explain.importance_map(pixels, shares).withColumn("importance", F.round("importance", 5))


@query("a10_save_load_model", f"""
WITH {GRIDZ} SELECT raster_id, "row", "col", class, round(confidence, 5) AS confidence FROM out""")
def save_load_model(spark, sf):
    pixels, result = grid_model(spark, sf)
    path = scratch_path(spark, "model")
    models.save_model(spark, result.fitted, result.scaler, path)
    back = models.load_model(spark, path)
    return classify.predict_raster(pixels, back.fitted, back.scaler).withColumn("confidence", F.round("confidence", 5))


@query("i24_train_nb")
def train_nb(spark, sf):
    result = train(inp.vector_samples(spark, sf), code="NB", split=75, search="grid", grid={"var_smoothing": [1e-9, 1e-2]}, folds=2)
    return result.scores()


def fold_gauss(tau):
    """Two-band classes per iteration from `tz` (iter, label, x, y), and the class predicted for `t`."""
    return f"""g AS (SELECT iter, label, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY iter) AS prior, avg(x) AS mx, avg(y) AS my,
 var_pop(x) AS ca, covar_pop(x, y) AS cb, var_pop(y) AS cc FROM tz GROUP BY iter, label),
gi AS (SELECT *, ca + {tau} AS a, cc + {tau} AS c, (ca + {tau}) * (cc + {tau}) - cb * cb AS det FROM g),
k AS (SELECT t.iter, t.sample_id, t.label AS truth, arg_min(gi.label, {DISC}) AS class FROM t JOIN gi ON gi.iter = t.iter GROUP BY 1, 2, 3)
SELECT iter, truth AS label, class AS prediction, count(*) AS n FROM k GROUP BY 1, 2, 3"""


STAND_SIDES = f"""{SCALED}, {STANDS.replace('s AS (' + inp.LINE + '), ', '')}, rs AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || stand_id)) AS rk FROM st),
i AS (SELECT CAST(unnest(generate_series(0, 1)) AS INTEGER) AS iter),
w AS (SELECT label, iter, CAST(1 + CAST('0x' || left(md5('0|' || iter || '|' || label), 8) AS UBIGINT) % m AS BIGINT) AS rank FROM tot, i),
h AS (SELECT w.iter, w.label, stand_id FROM w JOIN rs ON rs.label = w.label AND rs.rk = w.rank),
zz AS (SELECT z.*, s.stand_id FROM z JOIN s ON s.sample_id = z.sample_id),
tz AS (SELECT h.iter, zz.* FROM zz JOIN h ON h.label = zz.label AND h.stand_id <> zz.stand_id),
t AS (SELECT h.iter, zz.* FROM zz JOIN h ON h.label = zz.label AND h.stand_id = zz.stand_id)"""


@query("i24_train_stand", f"WITH {STAND_SIDES}, {fold_gauss('0.01')}")
def train_stand(spark, sf):
    s = inp.line_samples(spark, sf).select("sample_id", "label", F.slice("bands", 1, 2).alias("bands"), "stand_id")
    return train(s, code="GMM", split="STAND", max_iter=2, sloo=True, params={"tau": 0.01}).fold_cells.select("iter", "label", "prediction", "n")


SLOO_DRAWS = f"""p AS (SELECT * FROM ({inp.GRID}) WHERE b1 <> -9999), bd AS (SELECT min(b1) l1, max(b1) h1, min(b2) l2, max(b2) h2 FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || sample_id)) AS rk, count(*) OVER (PARTITION BY label) AS n FROM p),
i AS (SELECT CAST(unnest(generate_series(0, 2)) AS INTEGER) AS iter), cn AS (SELECT label, count(*) AS n FROM p GROUP BY label),
w AS (SELECT label, iter, CAST(1 + CAST('0x' || left(md5('0|' || iter || '|' || label), 8) AS UBIGINT) % n AS BIGINT) AS rank FROM cn, i),
h AS (SELECT w.iter, r.label, r.sample_id, r.x AS px, r.y AS py FROM w JOIN r ON r.label = w.label AND r.rk = w.rank),
sc AS (SELECT sample_id, label, x AS px, y AS py, 2 * (b1 - l1) / (h1 - l1) - 1 AS x, 2 * (b2 - l2) / (h2 - l2) - 1 AS y FROM p, bd)"""


def fold_means(place, tau):
    """Mean accuracy over the iterations for one ridge."""
    return f"""SELECT CAST({place} AS INTEGER) AS place, round(avg(accuracy), 6) AS mean_score FROM (
  SELECT iter, sum(n) FILTER (label = prediction) / CAST(sum(n) AS DOUBLE) AS accuracy FROM (WITH {STAND_SIDES}, {fold_gauss(tau)}) GROUP BY iter)"""


@query("i24_train_stand_search", f"{fold_means(0, '0.01')} UNION ALL {fold_means(1, '0.5')} UNION ALL {fold_means(2, '10')}")
def train_stand_search(spark, sf):
    """The ridge is chosen on the same stands that assess the model."""
    s = inp.line_samples(spark, sf).select("sample_id", "label", F.slice("bands", 1, 2).alias("bands"), "stand_id")
    found = train(s, code="GMM", split="STAND", max_iter=2, sloo=True, search="grid", grid={"tau": [0.01, 0.5, 10.0]}).search
    return found.table(spark).select("place", F.round("mean_score", 6).alias("mean_score"))


@query("i24_train_sloo", f"""
WITH {SLOO_DRAWS},
tz AS (SELECT h.iter, sc.label, sc.x, sc.y FROM sc JOIN h ON h.label = sc.label AND sqrt((sc.px - h.px) * (sc.px - h.px) + (sc.py - h.py) * (sc.py - h.py)) >= 10),
t AS (SELECT h.iter, sc.* FROM sc JOIN h ON h.sample_id = sc.sample_id), {fold_gauss('0')}""")
def train_sloo(spark, sf):
    p = inp.grid_pixels(spark, sf)
    s = prepare.valid_pixels(p).select("sample_id", "label", "bands", "x", "y")
    return train(s, code="GMM", split="SLOO", max_iter=3, distance=10.0).fold_cells.select("iter", "label", "prediction", "n")


@query("i24_train_sloo_min_train", f"""
WITH {SLOO_DRAWS},
dd AS (SELECT h.iter, sc.*, sqrt((sc.px - h.px) * (sc.px - h.px) + (sc.py - h.py) * (sc.py - h.py)) AS dist FROM sc JOIN h ON h.label = sc.label),
dr AS (SELECT *, row_number() OVER (PARTITION BY iter, label ORDER BY dist DESC, md5('0|' || sample_id)) <= 20 AS drawn FROM dd),
tz AS (SELECT iter, label, x, y FROM dr WHERE dist >= 10 AND NOT drawn), t AS (SELECT iter, sample_id, label, x, y FROM dr WHERE drawn), {fold_gauss('0')}""")
def train_sloo_min_train(spark, sf):
    """Per iteration the 20 samples of a class farthest from the drawn one are assessed."""
    s = prepare.valid_pixels(inp.grid_pixels(spark, sf)).select("sample_id", "label", "bands", "x", "y")
    result = train(s, code="GMM", split="SLOO", max_iter=3, distance=10.0, min_train=20)
    return result.fold_cells.select("iter", "label", "prediction", "n")


@query("i24_train_polygon_groups")
def train_polygon_groups(spark, sf):
    s = inp.line_samples(spark, sf).select("sample_id", "label", "bands", "polygon_id")
    result = train(s, code="GMM", split=80, search="grid", grid={"tau": [0.0, 0.1]}, folds=2, polygon_groups=True)
    return result.scores()


@query("a9_write_report_tables", f"""
WITH {PRF}, n AS (SELECT k.class AS label, q.class AS prediction, (SELECT count(*) FROM s WHERE s.label = k.class AND s.prediction = q.class) AS n FROM k, k q),
l AS (SELECT label, string_agg(CAST(n AS VARCHAR), ',' ORDER BY prediction) AS cells FROM n GROUP BY label)
SELECT 'confusion_matrix_numeric.csv' AS artifact, cells AS value FROM l
UNION ALL SELECT 'confusion_matrix_labeled.csv', 'c' || label || ',' || cells FROM l
UNION ALL SELECT 'confusion_matrix_labeled.csv', 'true/pred,c1,c2,c3'
UNION ALL SELECT 'per_class_metrics.csv', 'class_value,class_name,precision,recall,f1,support'
UNION ALL SELECT 'per_class_metrics.csv', class || ',c' || class || format(',{{:.6f}},{{:.6f}},{{:.6f}},', "precision", recall, f1) || support FROM f""")
def write_report_tables(spark, sf):
    cells = metrics.cell_counts(inp.line_samples(spark, sf))
    path = scratch_path(spark, "report")
    names = {1: "c1", 2: "c2", 3: "c3"}
    reports.write_report_tables(cells, path, {"classifier_code": "GMM", "split_mode": "RANDOM_SPLIT", "split_config": "70"}, names)
    return reports.read_report_lines(spark, path).filter(F.col("artifact").endswith(".csv"))


@query("a11_load_confusion_reports", f"""
WITH s AS ({inp.LINE}), k AS (SELECT unnest([1, 2, 3]) AS k), f AS (SELECT DISTINCT stand_id % 3 AS part FROM s)
SELECT 'part_' || f.part AS report, CAST(a.k AS VARCHAR) AS label, CAST(b.k AS VARCHAR) AS prediction, count(s.sample_id) AS n
FROM f CROSS JOIN k a CROSS JOIN k b LEFT JOIN s ON s.stand_id % 3 = f.part AND s.label = a.k AND s.prediction = b.k GROUP BY 1, 2, 3""")
def load_confusion_reports(spark, sf):
    path = scratch_path(spark, "reports")
    s = inp.line_samples(spark, sf)
    for part in range(3):
        cells = metrics.cell_counts(s.filter(F.col("stand_id") % 3 == part))
        reports.write_text(reports.matrix_lines(cells)[1], f"{path}/part_{part}/confusion_matrix_labeled.csv")
    cells = reports.load_confusion_reports(spark, path)
    report = F.regexp_extract("file", r"([^/]+)/[^/]+/[^/]+$", 1)
    return cells.select(report.alias("report"), "label", "prediction", "n")


def event_stream(spark, sf):
    """events as a stream of samples."""
    schema = inp.table(spark, sf, "events").schema
    return inp.shape_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query("j1_stream_gmm_fit", f"""
WITH s AS ({inp.EVENT}) SELECT label, count(*) AS n, round(avg(b1), 5) AS mean_1, round(avg(b2), 5) AS mean_2,
 round(var_pop(b1), 4) AS c11, round(covar_pop(b1, b2), 4) AS c12, round(var_pop(b2), 4) AS c22 FROM s GROUP BY label""")
def stream_gmm_fit(spark, sf):
    table = streams.stream_moment_table(event_stream(spark, sf), 2, scratch_path(spark, "moments"))
    fit = gaussian.class_parameters(table, "empirical")
    pick = lambda c, i, p: F.round(F.col(c)[i], p)
    return fit.select("label", "n", pick("mean", 0, 5).alias("mean_1"), pick("mean", 1, 5).alias("mean_2"),
                      pick("cov", 0, 4).alias("c11"), pick("cov", 1, 4).alias("c12"), pick("cov", 3, 4).alias("c22"))


@query("j2_stream_predict", f"""
WITH s AS ({inp.EVENT}), z AS (SELECT sample_id, label, b1 AS x, b2 AS y FROM s), {gauss_sql(tau='0.5')},
k AS (SELECT t.sample_id, gi.label, {DISC} AS k FROM z t CROSS JOIN gi)
SELECT sample_id, arg_min(label, k) AS class FROM k GROUP BY 1""")
def stream_predict(spark, sf):
    fitted = learners.fit("GMM", inp.event_samples(spark, sf), {"tau": 0.5, "center": True})
    stream = streams.stream_predict(event_stream(spark, sf), fitted, keep=["sample_id"])
    return streams.stream_to_table(stream, scratch_path(spark, "predictions")).select("sample_id", "class")
