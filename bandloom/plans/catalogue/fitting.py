"""Queries on networks step by step, kernel features and weighted fits, with their SQL twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from bandloom.operators import bayes, gaussian, kernels, learners, perceptron
from bandloom.plans import inputs as inp
from bandloom.plans.catalogue.models import SCALED, scaled_lines
from bandloom.plans.registry import query

R6 = lambda c: F.round(c, 6)

# A network of two bands, two tanh units and three classes, in the order of its flat parameters.
_START = [round(math.sin(i + 1) / 2, 4) for i in range(15)]
_RATE, _ALPHA = 0.05, 0.5


def _adam_step(r: int) -> str:
    """CTEs of one full step: units, class shares, mean gradients, moved parameters."""
    errors = ", ".join(f"e{k} / (e1 + e2 + e3) - CASE WHEN label = {k} THEN 1 ELSE 0 END AS d{k}" for k in (1, 2, 3))
    back = [" + ".join(f"d{k} * p{6 + 3 * h + k - 1}" for k in (1, 2, 3)) for h in (0, 1)]
    slopes = [f"({back[h]}) * (1 - a{h + 1} * a{h + 1})" for h in (0, 1)]
    per_row = [f"x * ({slopes[0]})", f"x * ({slopes[1]})", f"y * ({slopes[0]})", f"y * ({slopes[1]})", slopes[0], slopes[1],
               *(f"a{h} * d{k}" for h in (1, 2) for k in (1, 2, 3)), "d1", "d2", "d3"]
    decayed = [i for i in range(15) if i not in (4, 5, 12, 13, 14)]
    gradients = ", ".join(f"avg({g}) + {f'{_ALPHA}e0 * any_value(p{i}) / count(*)' if i in decayed else '0e0'} AS g{i}" for i, g in enumerate(per_row))
    squares = " + ".join(f"any_value(p{i}) * any_value(p{i})" for i in decayed)
    firsts = ", ".join(f"0.9e0 * m{i} + 0.1e0 * g{i} AS m{i}" for i in range(15))
    seconds = ", ".join(f"0.999e0 * v{i} + 0.001e0 * g{i} * g{i} AS v{i}" for i in range(15))
    pace = f"{_RATE}e0 * sqrt(1 - pow(0.999e0, {r + 1})) / (1 - pow(0.9e0, {r + 1}))"
    moved = ", ".join(f"p{i} - {pace} * m{i} / (sqrt(v{i}) + 1e-8) AS p{i}" for i in range(15))
    kept = ", ".join(f"m{i}, v{i}" for i in range(15))
    return f"""
h{r} AS (SELECT z.label, z.x, z.y, n.*, tanh(x * p0 + y * p2 + p4) AS a1, tanh(x * p1 + y * p3 + p5) AS a2 FROM z, n{r} n),
o{r} AS (SELECT *, exp(a1 * p6 + a2 * p9 + p12) AS e1, exp(a1 * p7 + a2 * p10 + p13) AS e2, exp(a1 * p8 + a2 * p11 + p14) AS e3 FROM h{r}),
d{r} AS (SELECT *, ln(e1 + e2 + e3) - ln([e1, e2, e3][label]) AS loss, {errors} FROM o{r}),
g{r} AS (SELECT {gradients}, avg(loss) + {_ALPHA}e0 / 2 * ({squares}) / count(*) AS loss FROM d{r}),
u{r} AS (SELECT {firsts}, {seconds}, {", ".join(f"p{i}" for i in range(15))} FROM n{r}, g{r}),
n{r + 1} AS (SELECT {moved}, {kept} FROM u{r})"""


_FIRST = ", ".join(f"{v}e0 AS p{i}, 0e0 AS m{i}, 0e0 AS v{i}" for i, v in enumerate(_START))


@query("i13_adam_steps", f"""
WITH {SCALED}, n0 AS (SELECT {_FIRST}), {_adam_step(0)}, {_adam_step(1)}, {_adam_step(2)}
SELECT 'loss' AS part, CAST(i AS INTEGER) AS place, round(v, 6) AS value FROM (SELECT 0 AS i, loss AS v FROM g0 UNION ALL SELECT 1, loss FROM g1 UNION ALL SELECT 2, loss FROM g2)
UNION ALL SELECT 'parameter', CAST(i AS INTEGER), round(v, 6) FROM (SELECT unnest(range(15)) AS i, unnest([{", ".join(f"p{i}" for i in range(15))}]) AS v FROM n3)""")
def adam_steps(spark, sf):
    flat = np.array(_START)
    start = perceptron.Network((flat[:4].reshape(2, 2), flat[6:12].reshape(2, 3)), (flat[4:6], flat[12:]), "tanh")
    z = scaled_lines(spark, sf)
    fitted = learners.fit("MLP", z, {
        "start": start, "learning_rate_init": _RATE, "alpha": _ALPHA, "max_iter": 3, "batch_size": z.count()})
    rows = [("loss", i, float(v)) for i, v in enumerate(fitted.losses)] + [
        ("parameter", i, float(v)) for i, v in enumerate(fitted.network.flat())]
    return spark.createDataFrame(rows, "part string, place int, value double").withColumn("value", R6("value"))


# In two bands the cubic kernel has ten dimensions, so landmark features meet it exactly.
@query("i7_polynomial_features", f"""
WITH {SCALED}
SELECT sample_id, round(pow(0.5e0 * (x * x + y * y) + 1, 3), 5) AS own FROM z""")
def polynomial_features(spark, sf):
    z = scaled_lines(spark, sf).select("sample_id", "bands")
    made, _ = kernels.landmark_map(z, "poly", 0.5, degree=3, coef0=1.0, seed=1)
    square = F.aggregate(F.transform("bands", lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    return made(z).select("sample_id", F.round(square, 5).alias("own"))


_WEIGHTED = f"""
s AS ({inp.LINE}), w AS (SELECT label, b1 AS x, b3 AS y, score AS w FROM s WHERE score > 0),
m AS (SELECT label, count(*) AS n, sum(w) AS mass, sum(w) * sum(w) / sum(w * w) AS effective, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY label),
c AS (SELECT m.*, cxx, cxy, cyy, mass / sum(mass) OVER () AS prior FROM m JOIN (
  SELECT w.label, sum(w * (x - mx) * (x - mx)) / sum(w) AS cxx, sum(w * (x - mx) * (y - my)) / sum(w) AS cxy, sum(w * (y - my) * (y - my)) / sum(w) AS cyy
  FROM w JOIN m ON w.label = m.label GROUP BY w.label) v ON v.label = m.label)"""


def weighted_lines(spark, sf):
    """Quantity and discount of every line, weighted by its score."""
    b = F.col("bands")
    return inp.line_samples(spark, sf).select("sample_id", "label", F.array(b[0], b[2]).alias("bands"), F.col("score").alias("weight"))


# The shrunk covariance of the oracle-approximating rule takes the effective number of samples.
@query("i19_weighted_gaussian", f"""
WITH {_WEIGHTED}, k AS (SELECT *, (cxx + cyy) / 2 AS mu, cxx * cxx + 2 * cxy * cxy + cyy * cyy AS sq, cxx + cyy AS tr FROM c),
h AS (SELECT *, least(1, greatest(0, tr * tr / (effective * (sq - tr * tr / 2)))) AS t FROM k)
SELECT label, n, round(prior, 6) AS prior, round(mx, 6) AS mean_1, round(my, 6) AS mean_2, round((1 - t) * cxx + t * mu, 5) AS c11, round((1 - t) * cxy, 5) AS c12,
 round((1 - t) * cyy + t * mu, 5) AS c22 FROM h""")
def weighted_gaussian(spark, sf):
    df = weighted_lines(spark, sf)
    shift = gaussian.band_means(df, 2)
    table = gaussian.class_parameters(gaussian.weighted_moments(df, 2, shift=shift), "oas", "spherical", shift)
    return table.select("label", "n", R6("prior").alias("prior"), R6(F.col("mean")[0]).alias("mean_1"), R6(F.col("mean")[1]).alias("mean_2"),
                        *[F.round(F.col("cov")[i], 5).alias(c) for i, c in ((0, "c11"), (1, "c12"), (3, "c22"))])


@query("i19_weighted_naive_bayes", f"""
WITH {_WEIGHTED}, o AS (SELECT greatest(sum(prior * (cxx + (mx - gx) * (mx - gx))), sum(prior * (cyy + (my - gy) * (my - gy)))) * 0.001 AS eps
  FROM c, (SELECT sum(prior * mx) AS gx, sum(prior * my) AS gy FROM c)),
t AS (SELECT sample_id, b1 AS x, b3 AS y FROM s),
k AS (SELECT sample_id, label, ln(cxx + eps) + (x - mx) * (x - mx) / (cxx + eps) + ln(cyy + eps) + (y - my) * (y - my) / (cyy + eps) - 2 * ln(prior) AS k FROM t, c, o),
b AS (SELECT *, min(k) OVER (PARTITION BY sample_id) AS lo FROM k)
SELECT sample_id, round(1 / sum(exp((lo - k) / 2)), 5) AS confidence FROM b GROUP BY sample_id""")
def weighted_naive_bayes(spark, sf):
    df = weighted_lines(spark, sf)
    model = bayes.fit_naive_bayes(df, 2, 0.001)
    return bayes.predict(df, model, ["sample_id"]).select("sample_id", F.round("confidence", 5).alias("confidence"))
