"""Queries on class balance, confusion tables, scores and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom.operators import balance, confidence, metrics
from bandloom.plans import inputs as inp
from bandloom.plans.registry import query

R6 = lambda c: F.round(c, 6)


def cells(spark, sf):
    return metrics.cell_counts(inp.line_samples(spark, sf))


@query("d1_class_distribution", f"""
WITH q AS ({inp.QUAL})
SELECT label, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS percent
FROM q GROUP BY label""")
def class_distribution(spark, sf):
    return balance.class_distribution(inp.quality_samples(spark, sf)).withColumn("percent", R6("percent"))


@query("d2_imbalance_ratio", f"""
WITH q AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n FROM q GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS samples, count(*) AS classes, min(n) AS min_class, max(n) AS max_class,
       round(CASE WHEN count(*) < 2 THEN 1e0 ELSE CAST(max(n) AS DOUBLE) / min(n) END, 6) AS ratio FROM c""")
def imbalance_ratio(spark, sf):
    return balance.imbalance(inp.quality_samples(spark, sf)).withColumn("ratio", R6("ratio"))


@query("d3_class_weights", f"""
WITH q AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n FROM q GROUP BY label)
SELECT label, round(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 6) AS weight FROM c""")
def class_weights(spark, sf):
    return balance.class_weights(inp.quality_samples(spark, sf)).withColumn("weight", R6("weight"))


@query("d4_normalize_weights", f"""
WITH q AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n FROM q GROUP BY label),
w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)) AS weight FROM c)
SELECT label, round(weight * count(*) OVER () / sum(weight) OVER (), 6) AS weight FROM w""")
def normalize_weights(spark, sf):
    weights = balance.class_weights(inp.quality_samples(spark, sf))
    return balance.normalize_weights(weights).withColumn("weight", R6("weight"))


@query("d5_recommend_strategy", f"""
WITH q AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n FROM q GROUP BY label),
r AS (SELECT CASE WHEN count(*) < 2 THEN 1e0 ELSE CAST(max(n) AS DOUBLE) / min(n) END AS ratio FROM c)
SELECT round(ratio, 6) AS ratio, CASE WHEN ratio < 2 THEN 'none' WHEN ratio < 5 THEN 'class_weights' ELSE 'smote' END AS strategy
FROM r""")
def recommend_strategy(spark, sf):
    row = balance.imbalance(inp.quality_samples(spark, sf))
    return row.select(R6("ratio").alias("ratio"), balance.recommend_strategy(F.col("ratio")).alias("strategy"))


@query("d6_should_apply_smote", f"""
WITH q AS ({inp.QUAL}), c AS (SELECT label, count(*) AS n FROM q GROUP BY label)
SELECT CASE WHEN count(*) < 2 THEN 1e0 ELSE CAST(max(n) AS DOUBLE) / min(n) END > 1.5 AS apply FROM c""")
def should_apply_smote(spark, sf):
    return balance.imbalance(inp.quality_samples(spark, sf)).select(
        balance.should_apply_smote(F.col("ratio")).alias("apply"))


@query("c8_attach_weights", f"""
WITH s AS ({inp.EVENT}), c AS (SELECT label, count(*) AS n FROM s WHERE label <> 3 GROUP BY label),
w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)) AS weight FROM c)
SELECT s.label, count(*) AS n, round(sum(coalesce(w.weight, 0e0)), 4) AS total_weight
FROM s LEFT JOIN w ON s.label = w.label GROUP BY s.label""")
def attach_weights(spark, sf):
    samples = inp.event_samples(spark, sf)
    weights = balance.class_weights(samples.filter(F.col("label") != 3))
    return balance.attach_weights(samples, weights).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("total_weight"))


@query("c9_missing_classes", f"""
WITH s AS ({inp.EVENT}), a AS (SELECT DISTINCT label FROM s WHERE b1 < 20), b AS (SELECT DISTINCT label + 1 AS label FROM s WHERE b1 >= 20)
SELECT label, 'right' AS missing_in FROM a WHERE label NOT IN (SELECT label FROM b)
UNION ALL SELECT label, 'left' FROM b WHERE label NOT IN (SELECT label FROM a)""")
def missing_classes(spark, sf):
    samples = inp.event_samples(spark, sf)
    value = F.col("bands")[0]
    return balance.missing_classes(
        samples.filter(value < 20), samples.filter(value >= 20).withColumn("label", F.col("label") + 1))


@query("g2_label_universe", f"""
WITH s AS ({inp.LINE}) SELECT label AS class FROM s UNION SELECT prediction + 1 FROM s""")
def label_universe(spark, sf):
    shifted = inp.line_samples(spark, sf).withColumn("prediction", F.col("prediction") + 1)
    return metrics.class_universe(metrics.cell_counts(shifted))


@query("d11_confusion_matrix", f"""
WITH s AS ({inp.LINE}), c AS (SELECT CAST(unnest(generate_series(1, (SELECT max(label) FROM s))) AS INTEGER) AS k)
SELECT a.k AS label, b.k AS prediction, count(s.sample_id) AS n
FROM c a CROSS JOIN c b LEFT JOIN s ON s.label = a.k AND s.prediction = b.k GROUP BY 1, 2""")
def confusion_matrix(spark, sf):
    return metrics.confusion_dense(cells(spark, sf))


@query("d11_confusion_union", f"""
WITH s AS (SELECT sample_id, label, prediction + 1 AS prediction FROM ({inp.LINE})),
c AS (SELECT label AS k FROM s UNION SELECT prediction FROM s)
SELECT a.k AS label, b.k AS prediction, count(s.sample_id) AS n
FROM c a CROSS JOIN c b LEFT JOIN s ON s.label = a.k AND s.prediction = b.k GROUP BY 1, 2""")
def confusion_union(spark, sf):
    shifted = inp.line_samples(spark, sf).withColumn("prediction", F.col("prediction") + 1)
    return metrics.confusion_union(metrics.cell_counts(shifted))


@query("d11_confusion_wide", f"""
WITH s AS ({inp.LINE})
SELECT label, count(*) FILTER (prediction = 1) AS p1, count(*) FILTER (prediction = 2) AS p2,
       count(*) FILTER (prediction = 3) AS p3 FROM s GROUP BY label""")
def confusion_wide(spark, sf):
    return metrics.confusion_wide(cells(spark, sf), [1, 2, 3])


MARGINS = f"""
s AS ({inp.LINE}), k AS (SELECT DISTINCT label AS class FROM s UNION SELECT DISTINCT prediction FROM s),
m AS (SELECT class, (SELECT count(*) FROM s WHERE label = class) AS support,
             (SELECT count(*) FROM s WHERE prediction = class) AS predicted,
             (SELECT count(*) FROM s WHERE prediction = class AND label = class) AS hits FROM k)"""


@query("d12_accuracy_kappa", f"""
WITH {MARGINS}, t AS (SELECT CAST(sum(support) AS DOUBLE) AS n, CAST(sum(hits) AS DOUBLE) AS d,
       sum(CAST(support AS DOUBLE) * predicted) AS rc FROM m)
SELECT CAST(n AS BIGINT) AS n, round(d / n, 6) AS overall_accuracy, round((n * d - rc) / (n * n - rc), 6) AS kappa FROM t""")
def accuracy_kappa(spark, sf):
    return metrics.overall_scores(cells(spark, sf)).select(
        "n", R6("overall_accuracy").alias("overall_accuracy"), R6("kappa").alias("kappa"))


@query("d13_f1_mean", f"""
WITH {MARGINS} SELECT round(avg(2e0 * hits / (support + predicted)), 6) AS f1_mean FROM m""")
def f1_mean(spark, sf):
    return metrics.overall_scores(cells(spark, sf)).select(R6("f1_mean").alias("f1_mean"))


PRF = f"""{MARGINS},
p AS (SELECT class, support, predicted, hits,
        CASE WHEN predicted = 0 THEN 0e0 ELSE CAST(hits AS DOUBLE) / predicted END AS "precision",
        CASE WHEN support = 0 THEN 0e0 ELSE CAST(hits AS DOUBLE) / support END AS recall FROM m),
f AS (SELECT *, CASE WHEN "precision" + recall = 0 THEN 0e0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM p)"""


@query("d14_precision_recall_f1", f"""
WITH {PRF} SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
  support FROM f""")
def precision_recall_f1(spark, sf):
    return metrics.class_scores(cells(spark, sf)).select(
        "class", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"), "support")


AVERAGES = """
SELECT 'macro avg' AS "row", avg("precision") AS "precision", avg(recall) AS recall, avg(f1) AS f1, CAST(sum(support) AS BIGINT) AS support FROM f
UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f"""


@query("d14_average_scores", f"""
WITH {PRF}, a AS ({AVERAGES}
UNION ALL SELECT 'micro avg', x, x, x, s FROM (SELECT CAST(sum(hits) AS DOUBLE) / sum(support) AS x, CAST(sum(support) AS BIGINT) AS s FROM f))
SELECT "row" AS average, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a""")
def average_scores(spark, sf):
    return metrics.average_scores(cells(spark, sf)).select(
        "average", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"), "support")


@query("d15_classification_report", f"""
WITH {PRF}, a AS ({AVERAGES}
UNION ALL SELECT coalesce(r_name, CAST(class AS VARCHAR)), "precision", recall, f1, support FROM f
LEFT JOIN region ON r_regionkey = class)
SELECT "row", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a""")
def classification_report(spark, sf):
    names = inp.table(spark, sf, "region").select(F.col("r_regionkey").alias("class"), F.col("r_name").alias("name"))
    return metrics.classification_report(cells(spark, sf), names).select(
        "row", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"), "support")


@query("d16_normalized_confusion", f"""
WITH s AS ({inp.LINE}), c AS (SELECT label, prediction, count(*) AS n FROM s GROUP BY 1, 2)
SELECT label, prediction, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY label), 6) AS share FROM c""")
def normalized_confusion(spark, sf):
    return metrics.normalized_confusion(cells(spark, sf)).select("label", "prediction", R6("share").alias("share"))


def scored_lines(spark, sf):
    return inp.line_samples(spark, sf).select(
        F.lit(1).alias("class"), "score", (F.col("label") == 3).alias("positive"))


def ovr_lines(spark, sf):
    s = inp.line_samples(spark, sf).withColumn(
        "probability",
        F.array(F.col("score") / 2, F.col("bands")[2], F.col("bands")[3] * 5))
    return metrics.one_vs_rest(s, [1, 2, 3])


BINARY = f"""s AS ({inp.LINE}), c AS (SELECT score, count(*) FILTER (label = 3) AS pos, count(*) FILTER (label <> 3) AS neg
  FROM s GROUP BY score), t AS (SELECT sum(pos) AS p, sum(neg) AS q FROM c),
r AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM c)"""
OVR = f"""s AS ({inp.LINE}), o AS (
  SELECT 1 AS class, score / 2 AS score, label = 1 AS positive FROM s
  UNION ALL SELECT 2, b3, label = 2 FROM s UNION ALL SELECT 3, b4 * 5, label = 3 FROM s),
c AS (SELECT class, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM o GROUP BY 1, 2),
t AS (SELECT class, sum(pos) AS p, sum(neg) AS q FROM c GROUP BY class),
r AS (SELECT class, score, pos, neg, sum(pos) OVER (PARTITION BY class ORDER BY score DESC) AS cp FROM c),
a AS (SELECT r.class, sum(neg * (cp - pos / 2e0)) / (max(CAST(p AS DOUBLE)) * max(q)) AS auc, CAST(max(p) AS BIGINT) AS support
      FROM r JOIN t ON r.class = t.class GROUP BY r.class)"""


@query("d17_roc_curve", f"""
WITH {BINARY} SELECT score AS threshold, round(CAST(cn AS DOUBLE) / q, 6) AS fpr, round(CAST(cp AS DOUBLE) / p, 6) AS tpr
FROM r, t""")
def roc_curve(spark, sf):
    return metrics.roc_points(scored_lines(spark, sf)).select("threshold", R6("fpr").alias("fpr"), R6("tpr").alias("tpr"))


@query("d17_auc_per_class", f"""
WITH {OVR} SELECT class, round(auc, 6) AS auc, support FROM a""")
def auc_per_class(spark, sf):
    return metrics.auc(ovr_lines(spark, sf)).withColumn("auc", R6("auc"))


@query("d18_multiclass_auc", f"""
WITH {OVR}, mc AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM c GROUP BY score),
mr AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp FROM mc)
SELECT 'macro' AS average, round(avg(auc), 6) AS auc FROM a
UNION ALL SELECT 'weighted', round(sum(auc * support) / sum(support), 6) FROM a
UNION ALL SELECT 'micro', round(sum(neg * (cp - pos / 2e0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) FROM mr""")
def multiclass_auc(spark, sf):
    return metrics.multiclass_auc(ovr_lines(spark, sf)).withColumn("auc", R6("auc"))


CONF = f"conf AS (SELECT b1 * 2 AS v, b3 FROM ({inp.LINE})), u AS (SELECT v / 100 AS v FROM conf WHERE b3 <> 0)"


def unit(spark, sf):
    """Percent-like confidence from two bands; rows without a discount carry nodata."""
    s = inp.line_samples(spark, sf).select(
        F.when(F.col("bands")[2] == 0, -1.0).otherwise(F.col("bands")[0] * 2).alias("confidence"))
    return confidence.unit_confidence(s)


@query("d19_confidence_statistics", f"""
WITH {CONF} SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std,
  min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75,
  count(*) AS total_pixels, round(100e0 * count(*) FILTER (v < 0.5e0) / count(*), 6) AS low_pct,
  round(100e0 * count(*) FILTER (v >= 0.5e0 AND v < 0.8e0) / count(*), 6) AS medium_pct,
  round(100e0 * count(*) FILTER (v >= 0.8e0) / count(*), 6) AS high_pct FROM u""")
def confidence_statistics(spark, sf):
    stats = confidence.confidence_statistics(unit(spark, sf))
    exact = ("min", "max", "total_pixels")
    return stats.select(*[c if c in exact else R6(c).alias(c) for c in stats.columns])


@query("d20_confidence_histogram", f"""
WITH {CONF}, b AS (SELECT least(CAST(floor(v * 20) AS INTEGER) + 1, 20) AS bin, count(*) AS n FROM u GROUP BY 1),
a AS (SELECT CAST(unnest(generate_series(1, 20)) AS INTEGER) AS bin)
SELECT a.bin, coalesce(n, 0) AS n, CASE WHEN (a.bin - 0.5e0) / 20 < 0.5 THEN 'low' WHEN (a.bin - 0.5e0) / 20 < 0.8 THEN 'medium' ELSE 'high' END AS level
FROM a LEFT JOIN b ON a.bin = b.bin""")
def confidence_histogram(spark, sf):
    return confidence.confidence_histogram(unit(spark, sf))


@query("b11_low_confidence_pixels", """
SELECT sample_id, score FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round(l_extendedprice * 100) AS BIGINT)) AS sample_id, l_quantity * 2 AS score, l_discount FROM lineitem)
WHERE l_discount <> 0 AND score < 30""")
def low_confidence(spark, sf):
    s = inp.line_samples(spark, sf).withColumn(
        "confidence", F.when(F.col("bands")[2] == 0, -1.0).otherwise(F.col("bands")[0] * 2))
    return confidence.low_confidence_pixels(s, 30).select("sample_id", F.col("confidence").alias("score"))


@query("d27_fold_score_summary", f"""
WITH s AS ({inp.LINE}), f AS (SELECT stand_id % 5 AS fold, avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END) AS score FROM s GROUP BY 1)
SELECT round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, count(*) AS folds FROM f""")
def fold_score_summary(spark, sf):
    by_fold = metrics.overall_scores(
        metrics.cell_counts(inp.line_samples(spark, sf).withColumn("fold", F.col("stand_id") % 5), ["fold"]), ["fold"])
    return metrics.fold_summary(by_fold.select("fold", F.col("overall_accuracy").alias("score"))).select(
        R6("mean_score").alias("mean_score"), R6("std_score").alias("std_score"), "folds")


@query("d28_per_fold_confusion", f"""
WITH s AS ({inp.LINE}) SELECT stand_id % 5 AS iter, label, prediction, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def per_fold_confusion(spark, sf):
    folds = inp.line_samples(spark, sf).withColumn("iter", F.col("stand_id") % 5)
    return metrics.cell_counts(folds, ["iter"])


@query("d29_alternate_level_confusion", f"""
WITH n AS (SELECT c_nationkey AS label, (c_custkey * 7 + c_nationkey) % 25 AS prediction FROM customer)
SELECT a.n_regionkey AS label, b.n_regionkey AS prediction, count(*) AS n
FROM n JOIN nation a ON a.n_nationkey = n.label JOIN nation b ON b.n_nationkey = n.prediction GROUP BY 1, 2""")
def alternate_level(spark, sf):
    c = inp.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("label"),
        ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 25).cast("int").alias("prediction"))
    levels = inp.table(spark, sf, "nation").select(F.col("n_nationkey").alias("class"), F.col("n_regionkey").alias("level"))
    return metrics.recode_cells(metrics.cell_counts(c), levels)


@query("d30_result_insights", f"""
WITH {PRF}, t AS (SELECT CAST(sum(hits) AS DOUBLE) / sum(support) AS acc, avg(f1) AS f1_macro, min(support) AS lo, max(support) AS hi FROM f)
SELECT round(acc, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, lo AS min_support, hi AS max_support,
 CASE WHEN acc >= 0.9 THEN 'excellent' WHEN acc >= 0.8 THEN 'good' WHEN acc >= 0.7 THEN 'medium' WHEN acc >= 0.6 THEN 'fair' ELSE 'poor' END AS accuracy_band,
 CASE WHEN abs(acc - f1_macro) * 100 < 5 THEN 'balanced' WHEN abs(acc - f1_macro) * 100 < 10 THEN 'moderate imbalance' ELSE 'significant imbalance' END AS balance_band,
 'spatial_leakage_risk' || CASE WHEN acc < 0.6 THEN ',low_overall_accuracy' ELSE '' END || CASE WHEN lo < 10 THEN ',low_minority_support' ELSE '' END AS risk_flags,
 CASE WHEN lo = 0 OR CAST(hi AS DOUBLE) / lo > 10 THEN 'severe' WHEN CAST(hi AS DOUBLE) / lo > 5 THEN 'moderate' ELSE 'none' END AS support_imbalance
FROM t""")
def result_insights(spark, sf):
    row = metrics.result_insights(cells(spark, sf), "RANDOM_SPLIT")
    return (row.withColumn("risk_flags", F.concat_ws(",", "risk_flags"))
            .withColumn("accuracy", R6("accuracy")).withColumn("f1_macro", R6("f1_macro")))
