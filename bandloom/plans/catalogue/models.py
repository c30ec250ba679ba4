"""Queries on the models the engine implements itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.operators import bayes, gaussian, labels, neighbors, prepare, sampling
from bandloom.plans import inputs as inp
from bandloom.plans.registry import query
from bandloom.plans.train import train

R6 = lambda c: F.round(c, 6)


def two_bands(samples):
    return samples.withColumn("bands", F.slice("bands", 1, 2))


def scaled_lines(spark, sf, d=2):
    s = inp.line_samples(spark, sf)
    s = s.withColumn("bands", F.slice("bands", 1, d)) if d < 4 else s
    return prepare.fit_scaler(s, d).transform(s)


SCALED = f"""
s AS ({inp.LINE}), bd AS (SELECT min(b1) l1, max(b1) h1, min(b2) l2, max(b2) h2, min(b3) l3, max(b3) h3, min(b4) l4, max(b4) h4 FROM s),
z AS (SELECT sample_id, label, 2 * (b1 - l1) / (h1 - l1) - 1 AS x, 2 * (b2 - l2) / (h2 - l2) - 1 AS y,
  2 * (b3 - l3) / (h3 - l3) - 1 AS u, 2 * (b4 - l4) / (h4 - l4) - 1 AS v FROM s, bd)"""


def gauss_sql(source="z", tau="0"):
    """Parameters of two-band classes and the discriminant as SQL text."""
    return f"""g AS (SELECT label, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS prior, avg(x) AS mx, avg(y) AS my,
  var_pop(x) AS ca, covar_pop(x, y) AS cb, var_pop(y) AS cc FROM {source} GROUP BY label),
gi AS (SELECT *, ca + {tau} AS a, cc + {tau} AS c, (ca + {tau}) * (cc + {tau}) - cb * cb AS det FROM g)"""


DISC = "(gi.c * (t.x - gi.mx) * (t.x - gi.mx) - 2 * gi.cb * (t.x - gi.mx) * (t.y - gi.my) + gi.a * (t.y - gi.my) * (t.y - gi.my)) / gi.det + ln(gi.det) - 2 * ln(gi.prior)"


@query("d10_gaussian_moments", f"""
WITH {SCALED}, l AS (SELECT label, [x, y, u, v] AS b FROM z), p AS (SELECT unnest([1, 2, 3, 4]) AS i)
SELECT label, CAST(a.i AS INTEGER) AS i, CAST(c.i AS INTEGER) AS j, count(*) AS n, round(avg(b[a.i]), 6) AS mean_i, round(covar_pop(b[a.i], b[c.i]), 6) AS cov
FROM l, p a, p c WHERE a.i <= c.i GROUP BY 1, 2, 3""")
def gaussian_moments(spark, sf):
    return covariance_rows(gaussian.moments(scaled_lines(spark, sf, 4), 4), 4)


def covariance_rows(table, d):
    """Moments as (label, i, j, n, mean_i, cov) rows."""
    n = F.col("n").cast("double")
    cells = F.array(*[
        F.struct(
            F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), (F.col("s")[i] / n).alias("mean_i"),
            (F.col("ss")[at] / n - F.col("s")[i] / n * F.col("s")[j] / n).alias("cov"))
        for at, (i, j) in enumerate(gaussian.pairs(d))])
    return table.select("label", "n", F.explode(cells).alias("c")).select(
        "label", "c.i", "c.j", "n", R6("c.mean_i").alias("mean_i"), R6("c.cov").alias("cov"))


@query("d10_moments_64_bands", f"""
WITH s AS ({inp.VEC}), e AS (SELECT sample_id, label, unnest(bands) AS b, generate_subscripts(bands, 1) AS i FROM s)
SELECT p.label, CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, count(*) AS n, round(avg(p.b), 5) AS mean_i, round(covar_pop(p.b, q.b), 5) AS cov
FROM e p JOIN e q ON p.sample_id = q.sample_id AND p.i <= q.i GROUP BY 1, 2, 3""")
def moments_64(spark, sf):
    table = gaussian.moments(inp.vector_samples(spark, sf), 64)
    n, d = F.col("n").cast("double"), 64
    places = spark.createDataFrame([(at, i + 1, j + 1) for at, (i, j) in enumerate(gaussian.pairs(d))], "at int, i int, j int")
    cells = table.select("label", "n", "s", F.posexplode("ss").alias("at", "v")).join(F.broadcast(places), "at")
    mean = lambda at: F.get("s", F.col(at) - 1) / n
    return cells.select(
        "label", "i", "j", "n", F.round(mean("i"), 5).alias("mean_i"),
        F.round(F.col("v") / n - mean("i") * mean("j"), 5).alias("cov"))


def fitted(spark, sf, **options):
    return gaussian.fit_gaussian(scaled_lines(spark, sf), 2, **options)


@query("i1_gmm_fit", f"""
WITH {SCALED}, {gauss_sql()}
SELECT label, n, round(prior, 6) AS prior, round(mx, 6) AS mean_1, round(my, 6) AS mean_2,
 round((ca + cc) / 2 + sqrt((ca - cc) * (ca - cc) / 4 + cb * cb), 6) AS eig_1, round((ca + cc) / 2 - sqrt((ca - cc) * (ca - cc) / 4 + cb * cb), 6) AS eig_2 FROM g""")
def gmm_fit(spark, sf):
    table = gaussian.class_parameters(gaussian.moments(scaled_lines(spark, sf), 2))
    return table.select(
        "label", "n", R6("prior").alias("prior"), R6(F.col("mean")[0]).alias("mean_1"), R6(F.col("mean")[1]).alias("mean_2"),
        R6(F.col("eigval")[0]).alias("eig_1"), R6(F.col("eigval")[1]).alias("eig_2"))


@query("i2_shrinkage", f"""
WITH {SCALED}, {gauss_sql()}, k AS (SELECT *, (ca + cc) / 2 AS mu, ca * ca + 2 * cb * cb + cc * cc AS sq, ca + cc AS tr FROM g),
w AS (SELECT *, (ca - mu) * (ca - mu) + 2 * cb * cb + (cc - mu) * (cc - mu) AS delta FROM k),
h AS (SELECT *, least(delta / (n - 1) / (delta + 1e-10), 1) AS lw, least(1, greatest(0, (tr * tr) / (n * (sq - tr * tr / 2)))) AS oas FROM w)
SELECT label, 'ledoit_wolf' AS reg_type, round(ca, 7) AS c11, round((1 - lw) * cb, 7) AS c12, round(cc, 7) AS c22 FROM h
UNION ALL SELECT label, 'oas', round((1 - oas) * ca + oas * mu, 7), round((1 - oas) * cb, 7), round((1 - oas) * cc + oas * mu, 7) FROM h
UNION ALL SELECT label, 'ridge', round(ca, 7), round(cb, 7), round(cc, 7) FROM h""")
def shrinkage(spark, sf):
    table = gaussian.moments(scaled_lines(spark, sf), 2).cache()
    out = None
    for kind, target in (("ledoit_wolf", "diagonal"), ("oas", "identity"), ("ridge", "diagonal")):
        part = gaussian.class_parameters(table, kind, target).select(
            "label", F.lit(kind).alias("reg_type"),
            *[F.round(F.col("cov")[i], 7).alias(c) for i, c in ((0, "c11"), (1, "c12"), (3, "c22"))])
        out = part if out is None else out.unionByName(part)
    return out


@query("i3_gmm_predict", f"""
WITH {SCALED}, {gauss_sql(tau='0.05')}, k AS (SELECT t.sample_id, gi.label, {DISC} AS k FROM z t CROSS JOIN gi),
b AS (SELECT sample_id, label, k, min(k) OVER (PARTITION BY sample_id) AS lo FROM k)
SELECT sample_id, arg_min(label, k) AS class, round(1 / sum(exp((lo - k) / 2)), 5) AS confidence FROM b GROUP BY sample_id""")
def gmm_predict(spark, sf):
    model = fitted(spark, sf, tau=0.05)
    return gaussian.predict(scaled_lines(spark, sf), model, ["sample_id"]).withColumn("confidence", F.round("confidence", 5))


@query("i3_gmm_predict_proba", f"""
WITH {SCALED}, {gauss_sql()}, k AS (SELECT t.sample_id, gi.label, {DISC} AS k FROM z t CROSS JOIN gi),
b AS (SELECT sample_id, label, exp((min(k) OVER (PARTITION BY sample_id) - k) / 2) AS e FROM k)
SELECT sample_id, label AS class, round(e / sum(e) OVER (PARTITION BY sample_id), 5) AS probability FROM b""")
def gmm_predict_proba(spark, sf):
    model = fitted(spark, sf)
    p = gaussian.predict(scaled_lines(spark, sf), model, ["sample_id"], probability=True)
    codes = F.array(*[F.lit(c) for c in model.classes])
    return p.select("sample_id", F.explode(F.arrays_zip(codes.alias("c"), "probability")).alias("e")).select(
        "sample_id", F.col("e.c").alias("class"), F.round("e.probability", 5).alias("probability"))


@query("i3_gmm_predict_64_bands")
def gmm_predict_64(spark, sf):
    v = inp.vector_samples(spark, sf)
    model = gaussian.fit_gaussian(v, 64, reg_type="ledoit_wolf", tau=0.01, center=True)
    return gaussian.predict(v, model, ["sample_id", "label"], probability=True)


@query("h12_mahalanobis", f"""
WITH {SCALED}, {gauss_sql()} SELECT t.sample_id, t.label, round({DISC}, 5) AS k FROM z t JOIN gi ON gi.label = t.label""")
def mahalanobis(spark, sf):
    model = fitted(spark, sf)
    k = gaussian.discriminant_columns(model)
    own = F.element_at(F.array(*k), F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("label")).cast("int"))
    return scaled_lines(spark, sf).select("sample_id", "label", F.round(own, 5).alias("k"))


@query("d23_bic", f"""
WITH {SCALED}, {gauss_sql(tau='0.1')}, k AS (SELECT {DISC} AS k FROM z t JOIN gi ON gi.label = t.label)
SELECT round(sum(k) + (3 * 5 + 2) * ln((SELECT count(*) FROM z)), 3) AS bic FROM k""")
def bic(spark, sf):
    return gaussian.bic(scaled_lines(spark, sf), fitted(spark, sf), tau=0.1).select(F.round("bic", 3).alias("bic"))


@query("d21_gmm_feature_importance", f"""
WITH {SCALED}, {gauss_sql()}, o AS (SELECT sum(prior * mx) AS ox, sum(prior * my) AS oy, sum(prior * ca) AS wx, sum(prior * cc) AS wy FROM g),
f AS (SELECT max(wx) AS wx, max(wy) AS wy, sum(prior * (mx - ox) * (mx - ox)) / (max(wx) + 1e-10) AS fx, sum(prior * (my - oy) * (my - oy)) / (max(wy) + 1e-10) AS fy FROM g, o)
SELECT 'variance' AS method, 1 AS band, round(wx / (wx + wy + 1e-10), 6) AS importance FROM f UNION ALL SELECT 'variance', 2, round(wy / (wx + wy + 1e-10), 6) FROM f
UNION ALL SELECT 'discriminative', 1, round(fx / (fx + fy + 1e-10), 6) FROM f UNION ALL SELECT 'discriminative', 2, round(fy / (fx + fy + 1e-10), 6) FROM f""")
def gmm_importance(spark, sf):
    model = fitted(spark, sf)
    rows = [(m, b, v) for m in ("variance", "discriminative") for b, v in gaussian.feature_importance(model, m)]
    return spark.createDataFrame(rows, "method string, band int, importance double").withColumn("importance", R6("importance"))


@query("d22_covariance_diagnostics", f"""
WITH {SCALED}, {gauss_sql()}, e AS (SELECT label, (ca + cc) / 2 + sqrt((ca - cc) * (ca - cc) / 4 + cb * cb) AS hi, (ca + cc) / 2 - sqrt((ca - cc) * (ca - cc) / 4 + cb * cb) AS lo FROM g)
SELECT label, round(hi / greatest(lo, 1e-15), 5) AS condition_number, round(lo, 6) AS min_eigenvalue, round(hi, 6) AS max_eigenvalue,
 CAST(CASE WHEN lo > 1e-6 THEN 2 ELSE 1 END AS BIGINT) AS effective_rank, round(hi / (hi + lo + 1e-10), 6) AS explained_1 FROM e""")
def covariance_diagnostics(spark, sf):
    rows = gaussian.covariance_diagnostics(fitted(spark, sf))
    table = spark.createDataFrame(
        [(r["label"], r["condition_number"], r["min_eigenvalue"], r["max_eigenvalue"], r["effective_rank"], r["explained"][0]) for r in rows],
        "label int, condition_number double, min_eigenvalue double, max_eigenvalue double, effective_rank bigint, explained_1 double")
    return table.select("label", F.round("condition_number", 5).alias("condition_number"), R6("min_eigenvalue").alias("min_eigenvalue"),
                        R6("max_eigenvalue").alias("max_eigenvalue"), "effective_rank", R6("explained_1").alias("explained_1"))


TAUS = [0.0, 0.01, 0.1, 1.0]


@query("i4_gmm_tune_tau", f"""
WITH {SCALED}, t AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('6|' || sample_id)) - 1) % 3 AS fold FROM z),
f AS (SELECT unnest([0, 1, 2]) AS f), tau AS (SELECT unnest([0e0, 0.01e0, 0.1e0, 1e0]) AS tau),
g AS (SELECT f, label, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY f) AS prior, avg(x) AS mx, avg(y) AS my, var_pop(x) AS ca, covar_pop(x, y) AS cb, var_pop(y) AS cc
  FROM t, f WHERE t.fold <> f GROUP BY f, label),
gi AS (SELECT *, ca + tau AS a, cc + tau AS c, (ca + tau) * (cc + tau) - cb * cb AS det FROM g, tau),
k AS (SELECT t.sample_id, t.label AS truth, t.fold, gi.tau, arg_min(gi.label, {DISC}) AS class FROM t JOIN gi ON gi.f = t.fold GROUP BY 1, 2, 3, 4),
sc AS (SELECT tau, fold, avg(CASE WHEN class = truth THEN 100e0 ELSE 0e0 END) AS score FROM k GROUP BY 1, 2)
SELECT tau, round(avg(score), 4) AS accuracy FROM sc GROUP BY tau""")
def gmm_tune_tau(spark, sf):
    scores = gaussian.tune_tau(scaled_lines(spark, sf).select("sample_id", "label", "bands"), TAUS, folds=3, seed=6, d=2)
    return scores.select("tau", F.round("accuracy", 4).alias("accuracy"))


@query("i5_gmm_partial_fit", f"""
WITH {SCALED}, {gauss_sql()} SELECT label, n, round(prior, 6) AS prior, round(mx, 6) AS mean_1, round(my, 6) AS mean_2, round(ca, 6) AS c11, round(cb, 6) AS c12, round(cc, 6) AS c22 FROM g""")
def gmm_partial_fit(spark, sf):
    z = scaled_lines(spark, sf)
    batches = [gaussian.moments(z.filter(F.pmod(F.xxhash64("sample_id"), F.lit(3)) == i), 2) for i in range(3)]
    table = gaussian.class_parameters(gaussian.merge_moments(*batches), "empirical")
    pick = lambda c, i: R6(F.col(c)[i])
    return table.select(
        "label", "n", R6("prior").alias("prior"), pick("mean", 0).alias("mean_1"), pick("mean", 1).alias("mean_2"),
        pick("cov", 0).alias("c11"), pick("cov", 1).alias("c12"), pick("cov", 3).alias("c22"))


SPLIT_VEC = f"""
s AS ({inp.VEC}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1|' || sample_id)) AS rk, count(*) OVER (PARTITION BY label) AS n FROM s),
tr AS (SELECT * FROM r WHERE rk <= floor(n * (80 / 100e0))), te AS (SELECT * FROM r WHERE rk > floor(n * (80 / 100e0)))"""


def split_vectors(spark, sf):
    both = sampling.split_pixels(inp.vector_samples(spark, sf), 80, seed=1)
    return both.filter("role = 'train'"), both.filter("role = 'test'")


KNN = f"""{SPLIT_VEC}, d AS (SELECT te.sample_id, te.label AS truth, tr.sample_id AS ref_id, tr.label, list_distance(te.bands, tr.bands) AS distance FROM te CROSS JOIN tr),
nn AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, ref_id) AS place FROM d QUALIFY place <= 10)"""


@query("c7_knn_join", f"""
WITH {KNN} SELECT sample_id, place, ref_id, round(distance, 5) AS distance FROM nn WHERE place <= 5""")
def knn_join(spark, sf):
    train, test = split_vectors(spark, sf)
    found = neighbors.knn_join(test, train, 5, 64)
    return found.select("sample_id", F.posexplode("neighbors").alias("p", "e")).select(
        "sample_id", (F.col("p") + 1).cast("bigint").alias("place"), "e.ref_id", F.round("e.distance", 5).alias("distance"))


@query("c7_knn_join_blocked", f"""
WITH {KNN} SELECT sample_id, place, ref_id, round(distance, 5) AS distance FROM nn WHERE place <= 5""")
def knn_join_blocked(spark, sf):
    train, test = split_vectors(spark, sf)
    found = neighbors.knn_join(test, train, 5, 64, limit=1)
    return found.select("sample_id", F.posexplode("neighbors").alias("p", "e")).select(
        "sample_id", (F.col("p") + 1).cast("bigint").alias("place"), "e.ref_id", F.round("e.distance", 5).alias("distance"))


@query("i8_knn_predict", f"""
WITH {KNN}, v AS (SELECT sample_id, truth, label, count(*) AS votes FROM nn GROUP BY 1, 2, 3)
SELECT sample_id, truth, arg_max(label, votes * 1000 - label) AS class, round(max(votes) / 10e0, 6) AS confidence FROM v GROUP BY 1, 2""")
def knn_predict(spark, sf):
    train, test = split_vectors(spark, sf)
    p = neighbors.knn_predict(test.withColumnRenamed("label", "truth"), train, 10, 64, ["sample_id", "truth"])
    return p.withColumn("confidence", R6("confidence"))


@query("i12_naive_bayes", f"""
WITH {SPLIT_VEC}, e AS (SELECT label, unnest(bands) AS b, generate_subscripts(bands, 1) AS i FROM tr),
eps AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(b) AS v FROM e GROUP BY i)),
m AS (SELECT label, i, avg(b) AS mean, var_pop(b) + (SELECT eps FROM eps) AS var FROM e GROUP BY 1, 2),
pr AS (SELECT label, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS prior FROM tr GROUP BY label),
q AS (SELECT sample_id, label AS truth, unnest(bands) AS b, generate_subscripts(bands, 1) AS i FROM te),
k AS (SELECT q.sample_id, q.truth, m.label, sum(ln(m.var) + (q.b - m.mean) * (q.b - m.mean) / m.var) - 2 * ln(max(pr.prior)) AS k FROM q JOIN m ON m.i = q.i JOIN pr ON pr.label = m.label GROUP BY 1, 2, 3),
z AS (SELECT *, min(k) OVER (PARTITION BY sample_id) AS lo FROM k)
SELECT sample_id, truth, arg_min(label, k) AS class, round(1 / sum(exp((lo - k) / 2)), 4) AS confidence FROM z GROUP BY 1, 2""")
def naive_bayes(spark, sf):
    train, test = split_vectors(spark, sf)
    model = bayes.fit_naive_bayes(train, 64)
    return bayes.predict(test, model, ["sample_id", "label"]).select(
        "sample_id", F.col("label").alias("truth"), "class", F.round("confidence", 4).alias("confidence"))


@query("i14_encode_labels", f"""
WITH s AS (SELECT sample_id, label * label - 1 AS label FROM ({inp.EVENT})), c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM s))
SELECT sample_id, s.label, CAST(code AS INTEGER) AS code, s.label AS decoded FROM s JOIN c ON c.label = s.label""")
def encode_labels(spark, sf):
    s = inp.event_samples(spark, sf).select("sample_id", (F.col("label") * F.col("label") - 1).alias("label"))
    codes = labels.label_codes(s)
    return labels.decode_labels(labels.encode_labels(s, codes), codes).select("sample_id", "label", "code", "decoded")


def assess_sql(marked):
    """Scores of a two-band Gaussian classifier from `o`, the samples of LINE with `train`; the others are assessed."""
    return f"""WITH s AS ({inp.LINE}), {marked},
bd AS (SELECT min(b1) l1, max(b1) h1, min(b2) l2, max(b2) h2 FROM o WHERE train),
z AS (SELECT sample_id, label, train, 2 * (b1 - l1) / (h1 - l1) - 1 AS x, 2 * (b2 - l2) / (h2 - l2) - 1 AS y FROM o, bd),
{gauss_sql('(SELECT * FROM z WHERE train)')},
k AS (SELECT t.sample_id, t.label AS truth, arg_min(gi.label, {DISC}) AS class FROM (SELECT * FROM z WHERE NOT train) t CROSS JOIN gi GROUP BY 1, 2),
c AS (SELECT DISTINCT truth AS class FROM k UNION SELECT DISTINCT class FROM k),
m AS (SELECT class, (SELECT count(*) FROM k WHERE truth = c.class) AS r, (SELECT count(*) FROM k WHERE k.class = c.class) AS p, (SELECT count(*) FROM k WHERE k.class = c.class AND truth = c.class) AS d FROM c),
w AS (SELECT CAST(sum(r) AS DOUBLE) AS n, CAST(sum(d) AS DOUBLE) AS d, sum(CAST(r AS DOUBLE) * p) AS rc, avg(2e0 * d / (r + p)) AS f1 FROM m)
SELECT CAST(n AS BIGINT) AS n, round(d / n, 6) AS overall_accuracy, round((n * d - rc) / (n * n - rc), 6) AS kappa, round(f1, 6) AS f1_mean FROM w"""


def score_row(result):
    return result.scores().select("n", *[R6(c).alias(c) for c in ("overall_accuracy", "kappa", "f1_mean")])


@query("train_assess_gmm", assess_sql("""
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || sample_id)) AS rk, count(*) OVER (PARTITION BY label) AS cn FROM s),
o AS (SELECT *, rk <= floor(cn * (70 / 100e0)) AS train FROM r)"""))
def train_assess_gmm(spark, sf):
    samples = two_bands(inp.line_samples(spark, sf)).select("sample_id", "label", "bands")
    return score_row(train(samples, code="GMM", split=70, seed=42))


@query("i24_train_validation_table", assess_sql("o AS (SELECT *, stand_id % 3 <> 0 AS train FROM s)"))
def train_validation_table(spark, sf):
    """Samples of one set of stands train, a table of the other stands is assessed."""
    lines = two_bands(inp.line_samples(spark, sf))
    given, apart = (lines.filter(c).select("sample_id", "label", "bands") for c in (F.col("stand_id") % 3 != 0, F.col("stand_id") % 3 == 0))
    return score_row(train(given, code="GMM", validation=apart))
