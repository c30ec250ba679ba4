import numpy as np
import pytest
from helpers import cells, labels, pairs
from pyspark.sql import functions as F

from bandloom.operators import balance, confidence, metrics


def test_accuracy_from_pairs(spark):
    p = pairs(spark, [1, 1, 1, 2, 2, 2, 2, 2, 1, 1], [1, 1, 1, 1, 2, 2, 2, 2, 2, 2])
    assert metrics.overall_scores(metrics.cell_counts(p)).first()["overall_accuracy"] == pytest.approx(0.7)


def test_scores_of_a_matrix(spark):
    row = metrics.overall_scores(cells(spark, [[50, 5], [10, 35]])).first()
    assert row["overall_accuracy"] == pytest.approx(0.85)
    assert row["f1_mean"] == pytest.approx(np.mean([100 / 115, 70 / 85]))
    assert row["kappa"] == pytest.approx((100 * 85 - 55 * 60 - 45 * 40) / (100**2 - 55 * 60 - 45 * 40))


def test_f1_per_class(spark):
    m = np.array([[30, 5, 2], [3, 40, 1], [2, 4, 25]])
    got = {r["class"]: r["f1"] for r in metrics.class_scores(cells(spark, m)).collect()}
    want = 2 * np.diag(m) / (m.sum(0) + m.sum(1))
    assert [got[i] for i in (1, 2, 3)] == pytest.approx(list(want))


def test_kappa_of_one_class_is_null(spark):
    row = metrics.overall_scores(metrics.cell_counts(pairs(spark, [1] * 4, [1] * 4))).first()
    assert row["overall_accuracy"] == 1 and row["kappa"] is None


def test_dense_confusion_ignores_what_has_no_cell(spark):
    p = pairs(spark, [1, 2, 2, 0], [1, 3, 2, 1])
    got = {(r[0], r[1]): r[2] for r in metrics.confusion_dense(metrics.cell_counts(p)).collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 1}


def test_absent_class_scores_zero(spark):
    got = {r["class"]: r for r in metrics.class_scores(cells(spark, [[3, 0], [2, 0]])).collect()}
    assert got[2]["precision"] == 0 and got[2]["recall"] == 0 and got[2]["f1"] == 0


def brute_auc(score, truth):
    pos, neg = score[truth], score[~truth]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def test_auc_with_ties_and_a_hot_score(spark):
    rng = np.random.RandomState(0)
    score = np.where(rng.uniform(size=900) < 0.4, 0.25, rng.uniform(size=900).round(2))
    truth = rng.uniform(size=900) < score
    df = spark.createDataFrame([(1, float(s), bool(t)) for s, t in zip(score, truth)], "class int, score double, positive boolean")
    assert metrics.auc(df).first()["auc"] == pytest.approx(brute_auc(score, truth))
    points = metrics.roc_points(df).orderBy(F.desc("threshold")).collect()
    assert points[-1]["fpr"] == 1 and points[-1]["tpr"] == 1
    assert all(a["tpr"] <= b["tpr"] for a, b in zip(points, points[1:]))


def test_weights_and_strategies(spark):
    df = labels(spark, {0: 900, 1: 100})
    got = {r["label"]: r["weight"] for r in balance.class_weights(df).collect()}
    assert got[0] == pytest.approx(0.5556, abs=1e-4) and got[1] == pytest.approx(5.0)
    row = balance.imbalance(df).select("ratio", balance.recommend_strategy(F.col("ratio")).alias("s")).first()
    assert row["ratio"] == 9 and row["s"] == "smote"


@pytest.mark.parametrize("counts,ratio,strategy", [
    ({1: 300, 2: 100}, 3, "class_weights"), ({1: 50, 2: 50}, 1, "none"), ({4: 10}, 1, "none")])
def test_strategy_by_ratio(spark, counts, ratio, strategy):
    row = balance.imbalance(labels(spark, counts)).select("ratio", balance.recommend_strategy(F.col("ratio")).alias("s")).first()
    assert (row["ratio"], row["s"]) == (ratio, strategy)


def test_weight_orders_and_errors(spark):
    df = labels(spark, {0: 50, 1: 30, 2: 20})
    w = {r["label"]: r["weight"] for r in balance.class_weights(df).collect()}
    assert w[2] > w[1] > w[0]
    total = balance.normalize_weights(balance.class_weights(df)).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(3)
    with pytest.raises(ValueError):
        balance.class_weights(df, "custom")
    with pytest.raises(ValueError):
        balance.class_weights(df, "other")
    zero = balance.normalize_weights(balance.class_weights(df, "custom", {0: 0.0, 1: 0.0}))
    assert {r["weight"] for r in zero.collect()} == {1.0}


def test_attach_weights_beyond_the_broadcast_limit(spark):
    from bandloom.functions import sizing

    df = labels(spark, {1: 40, 2: 10}).withColumn("i", F.monotonically_increasing_id())
    w = balance.class_weights(df)
    small = sizing.lookup_join(df, w, ["label"]).groupBy("label").agg(F.sum("weight")).collect()
    large = sizing.lookup_join(df, w, ["label"], limit=1).groupBy("label").agg(F.sum("weight")).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large))


def test_confidence_statistics_match_numpy(spark):
    rng = np.random.RandomState(1)
    v = np.concatenate([rng.uniform(0, 100, 700), np.full(300, 42.0)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(-1.0,)] * 5, "confidence double")
    got = confidence.confidence_statistics(confidence.unit_confidence(df)).first()
    u = v / 100
    assert got["total_pixels"] == 1000
    for name, want in (("mean", u.mean()), ("std", u.std()), ("median", np.median(u)), ("p25", np.percentile(u, 25)),
                       ("p75", np.percentile(u, 75)), ("low_pct", (u < 0.5).mean() * 100)):
        assert got[name] == pytest.approx(want)
    bins = confidence.confidence_histogram(confidence.unit_confidence(df)).orderBy("bin").collect()
    assert [b["n"] for b in bins] == list(np.histogram(u, bins=np.linspace(0, 1, 21))[0])
    assert [b["level"] for b in bins] == ["low"] * 10 + ["medium"] * 6 + ["high"] * 4
