"""Boosting, random thresholds and path attributions against plain versions in numpy."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from helpers import blobs, samples
from pyspark.sql import functions as F

from bandloom.operators import boosting, explain, extra_trees, learners, trees
from bandloom.sources import models


def noisy(spark, n=240, d=4, classes=3, seed=2):
    rng = np.random.RandomState(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = 1 + (np.argmax(x[:, :classes] + rng.normal(scale=0.6, size=(n, classes)), axis=1))
    return samples(spark, x, y), x, y


def plain_boosting(x, y, edges, s):
    """The same objective, grown node by node on whole arrays."""
    n, outputs = len(x), y.max() + 1
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1)
    f, losses = np.zeros((n, outputs)), []
    for _ in range(s.rounds):
        p = boosting.softmax(f)
        losses.append(-np.log(p[np.arange(n), y]).mean())
        step = np.zeros_like(f)
        for k in range(outputs):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
            worth = lambda m, g=g, h=h: g[m].sum() ** 2 / (h[m].sum() + s.leaf_l2) / 2 if m.any() else 0.0
            nodes = [np.ones(n, bool)]
            for _ in range(s.depth):
                def gain(m, b, c, worth=worth):
                    return worth(m & (bins[:, b] <= c)) + worth(m & (bins[:, b] > c)) - worth(m)

                cuts = [(b, c) for b in range(x.shape[1]) for c in range(len(edges[b]))]
                def allowed(m, b, c, h=h):
                    a, o = m & (bins[:, b] <= c), m & (bins[:, b] > c)
                    return a.sum() >= s.min_rows and o.sum() >= s.min_rows and h[a].sum() >= s.min_hessian and h[o].sum() >= s.min_hessian

                grown = []
                if s.symmetric:
                    live = [m for m in nodes if m.any()]
                    best = max(cuts, key=lambda bc: (round(sum(gain(m, *bc) for m in live), 9), -bc[0], -bc[1]))
                    if sum(gain(m, *best) for m in live) <= s.min_gain:
                        break
                    for m in nodes:
                        grown += [m & (bins[:, best[0]] <= best[1]), m & (bins[:, best[0]] > best[1])]
                else:
                    for m in nodes:
                        fits = [bc for bc in cuts if m.sum() >= s.split_rows and allowed(m, *bc) and gain(m, *bc) > s.min_gain]
                        if not fits:
                            step[m, k] = -g[m].sum() / (h[m].sum() + s.leaf_l2)
                            continue
                        b, c = max(fits, key=lambda bc: (round(gain(m, *bc), 9), -bc[0], -bc[1]))
                        grown += [m & (bins[:, b] <= c), m & (bins[:, b] > c)]
                nodes = grown
            for m in nodes:
                if m.any():
                    step[m, k] = -g[m].sum() / (h[m].sum() + s.leaf_l2)
        f += s.rate * step
    losses.append(-np.log(boosting.softmax(f)[np.arange(n), y]).mean())
    return f, losses


@pytest.mark.parametrize("options", [
    {"depth": 1}, {"depth": 3, "leaf_l2": 0.5}, {"depth": 2, "min_gain": 0.8, "min_hessian": 2.0}, {"depth": 3, "min_rows": 9, "split_rows": 40, "leaf_l2": 0.0},
    {"depth": 2, "symmetric": True, "leaf_l2": 3.0}, {"depth": 3, "symmetric": True},
])
def test_boosting_equals_a_plain_version(spark, options):
    df, x, y = noisy(spark)
    s = boosting.BoostSettings(rounds=3, rate=0.4, bins=8, binning="width", **options)
    model = boosting.fit_boosted(df, F.col("label") - 1, 4, 3, s)
    f, losses = plain_boosting(x, y - 1, boosting.bin_edges(df, 4, 8, "width"), s)
    assert np.allclose(model.margins(x), f, atol=1e-9) and np.allclose(model.losses, losses, atol=1e-9)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))


def test_boosting_parameters_have_effect(spark):
    df, _, _ = noisy(spark)
    base = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3}
    loss = lambda code, **p: learners.fit(code, df, p, seed=1).losses[-1]
    plain = loss("XGB", **base)
    for extra in ({"reg_lambda": 9.0}, {"gamma": 3.0}, {"min_child_weight": 12}, {"subsample": 0.5}, {"colsample_bytree": 0.3}):
        assert loss("XGB", **base, **extra) != plain, extra
    shape = {"iterations": 2, "depth": 2, "learning_rate": 0.3}
    assert loss("CB", **shape, l2_leaf_reg=1) < loss("CB", **shape, l2_leaf_reg=9)
    assert loss("GBC", **base, min_samples_leaf=60) > loss("GBC", **base)


def test_scores_written_between_rounds(spark, monkeypatch):
    df, x, _ = noisy(spark, 120)
    s = boosting.BoostSettings(rounds=5, depth=2, bins=8, row_share=0.7, band_share=0.5, seed=3)
    whole = boosting.fit_boosted(df, F.col("label") - 1, 4, 3, s)
    monkeypatch.setattr(boosting, "PENDING_ROUNDS", 2)
    monkeypatch.setattr(boosting, "TASK_CELLS", 100)
    parts = boosting.fit_boosted(df.repartition(7), F.col("label") - 1, 4, 3, s)
    assert np.allclose(whole.margins(x), parts.margins(x), atol=1e-9) and np.allclose(whole.losses, parts.losses)


def test_weights_count_like_repeats(spark):
    df, x, _ = noisy(spark, 90)
    twice = df.withColumn("weight", F.when(F.col("label") == 1, 2.0).otherwise(1.0))
    copies = df.unionByName(df.filter("label = 1"))
    options = {"rounds": 2, "depth": 2, "binning": "width", "bins": 8}
    a, b = (boosting.fit_boosted(d, F.col("label") - 1, 4, 3, **options) for d in (twice, copies))
    assert np.allclose(a.margins(x), b.margins(x))


def test_random_thresholds_equal_a_plain_tree(spark):
    df, x, y = noisy(spark)
    model = extra_trees.fit_extra_trees(df, F.col("label") - 1, 4, 3, trees=3, depth=3, max_features=2, min_leaf=4, seed=5)
    for t, tree in enumerate(model):
        stack = [(0, np.ones(len(x), bool), 0)]
        while stack:
            node, m, level = stack.pop()
            share = np.bincount(y[m] - 1, minlength=3) / m.sum()
            assert np.allclose(tree.value[node], share) and tree.cover[node] == m.sum()
            best = None
            for b in extra_trees.candidate_bands(4, 2, 5, t, node):
                lo, hi = x[m, b].min(), x[m, b].max()
                cut = lo + extra_trees.uniform(5, t, node, b) * (hi - lo)
                left, right = m & (x[:, b] <= cut), m & (x[:, b] > cut)
                if min(left.sum(), right.sum()) >= 4:
                    purity = sum((np.bincount(y[side] - 1, minlength=3) ** 2).sum() / side.sum() for side in (left, right))
                    if best is None or purity > best[0] + 1e-9:
                        best = (purity, b, cut, left, right)
            if level == 3 or best is None or share.max() == 1:
                assert tree.band[node] == trees.LEAF
                continue
            assert tree.band[node] == best[1] and tree.threshold[node] == pytest.approx(best[2], abs=1e-12)
            stack += [(tree.left[node], best[3], level + 1), (tree.right[node], best[4], level + 1)]


def test_random_thresholds_do_not_depend_on_layout(spark, monkeypatch):
    df, x, _ = noisy(spark, 150)
    shape = {"n_estimators": 2, "max_depth": 3}
    one = learners.fit("ET", df, shape, seed=9)
    monkeypatch.setattr(extra_trees, "TASK_CELLS", 60)
    two = learners.fit("ET", df.repartition(5), shape, seed=9)
    assert np.allclose(one.scores(x), two.scores(x))
    other = learners.fit("ET", df, shape, seed=10)
    assert not np.allclose(one.scores(x), other.scores(x))


def coalition_values(grown, x, outputs, scale):
    """Shapley values from all coalitions; outside bands take both sides by cover."""
    d = len(x)

    def worth(tree, node, inside):
        if tree.band[node] < 0:
            return tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if tree.band[node] in inside:
            return worth(tree, a if x[tree.band[node]] <= tree.threshold[node] else b, inside)
        return (tree.cover[a] * worth(tree, a, inside) + tree.cover[b] * worth(tree, b, inside)) / tree.cover[node]

    total = {s: scale * sum(worth(t, 0, s) for t in grown) for n in range(d + 1) for s in map(frozenset, combinations(range(d), n))}
    out = np.zeros((outputs, d))
    for s, v in total.items():
        for b in set(range(d)) - s:
            out[:, b] += factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (total[s | {b}] - v)
    return out


@pytest.mark.parametrize("code,params", [("ET", {"n_estimators": 3, "max_depth": 6}), ("RF", {"n_estimators": 3, "max_depth": 5}),
                                         ("XGB", {"n_estimators": 2, "max_depth": 3}), ("CB", {"iterations": 2, "depth": 3})])
def test_paths_equal_coalitions(spark, code, params):
    df, x, _ = noisy(spark, 200, 8, 3)
    fitted = learners.fit(code, df, params, seed=4)
    rows = explain.path_values(fitted, df.filter("sample_id < 5")).collect()
    assert len(rows) == 5 * 3 * 8
    if code == "RF":
        grown, scale = trees.forest_trees(spark, fitted.model), 1 / 3
    elif fitted.boosted:
        grown, scale = None, None
    else:
        grown, scale = fitted.trees, 1 / 3
    for i in range(5):
        if grown is None:
            expected = np.vstack([coalition_values(fitted.trees[k::3], x[i], 1, fitted.rate) for k in range(3)])
        else:
            expected = coalition_values(grown, x[i], 3, scale)
        got = np.zeros((3, 8))
        for r in rows:
            if r["sample_id"] == i:
                got[r["class"] - 1, r["band"] - 1] = r["value"]
        assert np.allclose(got, expected, atol=1e-9)


def test_paths_on_many_bands(spark):
    df, x, _ = noisy(spark, 150, 64, 3)
    fitted = learners.fit("ET", df, {"n_estimators": 5, "max_depth": 12, "max_features": None}, seed=4)
    base = np.mean([t.value[0] for t in fitted.trees], axis=0)
    scores = fitted.scores(x)
    for r in explain.path_values(fitted, df).groupBy("sample_id", "class").agg(F.sum("value").alias("v")).collect():
        assert r["v"] == pytest.approx(scores[r["sample_id"], r["class"] - 1] - base[r["class"] - 1], abs=1e-9)


def test_not_a_number_goes_right(spark):
    df, _, _ = noisy(spark, 120)
    gaps = df.withColumn("bands", F.transform("bands", lambda v, i: F.when((i == 0) & (F.col("sample_id") % 5 == 0), float("nan")).otherwise(v)))
    for code, params in (("XGB", {"n_estimators": 2}), ("ET", {"n_estimators": 2, "max_depth": 3})):
        fitted = learners.fit(code, gaps, params)
        tree = fitted.trees[0]
        row = np.full((1, 4), np.nan)
        node = 0
        while tree.band[node] >= 0:
            node = tree.right[node]
        assert tree.leaf(row)[0] == node
        values = explain.path_values(fitted, gaps).groupBy("sample_id", "class").agg(F.sum("value").alias("v"))
        assert values.filter("isnan(v)").count() == 0


@pytest.mark.parametrize("code,params", [("XGB", {"n_estimators": 2}), ("ET", {"n_estimators": 3, "max_depth": 4})])
def test_saved_trees_predict_alike(spark, tmp_path, code, params):
    df, _, _ = noisy(spark, 100)
    fitted = learners.fit(code, df, params)
    models.save_model(spark, fitted, None, str(tmp_path / "m"))
    back = models.load_model(spark, str(tmp_path / "m")).fitted
    both = fitted.predict(df, ["sample_id"], True).exceptAll(back.predict(df, ["sample_id"], True))
    assert both.count() == 0 and back.losses == fitted.losses


def test_one_class_and_constant_bands(spark):
    x, _ = blobs(2, 10, 2)
    df = samples(spark, np.ones_like(x), np.ones(len(x), dtype=int))
    for code in ("XGB", "CB", "GBC", "ET"):
        rows = learners.fit(code, df, {"iterations": 2} if code == "CB" else {"n_estimators": 2}).predict(df, ["label"]).collect()
        assert {(r["class"], r["confidence"]) for r in rows} == {(1, 1.0)}


@pytest.mark.parametrize("how", explain.AGGREGATES)
def test_importance_by_paths_shuffles_one_row_per_sample(spark, monkeypatch, how):
    df, _, _ = noisy(spark, 120, 4, 3)
    twice = df.unionByName(df.filter("sample_id < 9").withColumn("bands", F.transform("bands", lambda v: v + 1)))
    fitted = learners.fit("XGB", df, {"n_estimators": 2, "max_depth": 2}, seed=1)
    want = {r.band: r.importance for r in explain.aggregate_attributions(explain.path_values(fitted, twice), how).collect()}
    short = explain.shapley_importance(fitted, twice, how, method="paths")
    assert {r.band: r.importance for r in short.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 4
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    # What is summed per sample has not been written out per class and band.
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("MapInArrow") and "posexplode" not in plan
    monkeypatch.setattr(explain, "WIDE_SUMS", 1)
    wide = explain.shapley_importance(fitted, twice, how, method="paths")
    assert {r.band: r.importance for r in wide.collect()} == pytest.approx(want, abs=1e-12)
    assert explain.shapley_importance(fitted, df.filter("sample_id < 0"), how, method="paths").collect() == []
