import numpy as np
import pytest
from helpers import blobs, samples
from pyspark.sql import functions as F

from bandloom.operators import bayes, explain, folds, gaussian, learners, neighbors, oversample, prepare, tuning
from bandloom.sources import models


def moments_of(x, y):
    return {c: (x[y == c].mean(0), np.cov(x[y == c].T, bias=True)) for c in np.unique(y)}


@pytest.mark.parametrize("d", [3, 14])
def test_moments_match_numpy_in_both_forms(spark, d):
    x, y = blobs(3, 40, d, gap=2.0)
    want = moments_of(x, y)
    for r in gaussian.moments(samples(spark, x, y).repartition(5), d).collect():
        mean, m2 = gaussian.unpack(r["n"], np.array(r["s"]), np.array(r["ss"]))
        assert np.allclose(mean, want[r["label"]][0]) and np.allclose(m2 / r["n"], want[r["label"]][1])


def test_large_offsets_stay_exact(spark):
    x, y = blobs(2, 50, 2, gap=3.0)
    model = gaussian.fit_gaussian(samples(spark, x + 1e8, y), 2, center=True)
    assert np.allclose(model.cov, [moments_of(x, y)[c][1] for c in (1, 2)], atol=1e-6)


@pytest.mark.parametrize("d", [2, 20])
def test_predictions_match_the_closed_form(spark, d):
    x, y = blobs(3, 60, d, gap=1.0)
    tau = 0.3
    model = gaussian.fit_gaussian(samples(spark, x, y), d, tau=tau)
    assert gaussian.fits_columns(model) == (d == 2)
    k = []
    for c, (mean, cov) in moments_of(x, y).items():
        full = cov + tau * np.eye(d)
        delta = x - mean
        k.append((delta @ np.linalg.inv(full) * delta).sum(1) + np.linalg.slogdet(full)[1] - 2 * np.log(1 / 3))
    k = np.array(k).T
    p = np.exp(-k / 2 + k.min(1, keepdims=True) / 2)
    p /= p.sum(1, keepdims=True)
    got = gaussian.predict(samples(spark, x, y), model, ["sample_id"], probability=True).orderBy("sample_id").collect()
    assert [r["class"] for r in got] == list(k.argmin(1) + 1)
    assert np.allclose([r["probability"] for r in got], p)
    assert np.allclose([r["confidence"] for r in got], p.max(1))


@pytest.mark.parametrize("kind", gaussian.SHRINKAGES)
@pytest.mark.parametrize("target", gaussian.TARGETS)
def test_regularised_fits_are_finite(spark, kind, target):
    x, y = blobs(2, 12, 5, gap=1.0)
    x[:, 4] = x[:, 0] + 1e-8
    model = gaussian.fit_gaussian(samples(spark, x, y), 5, reg_type=kind, target=target)
    inv, const = model.inverses()
    assert np.isfinite(inv).all() and np.isfinite(const).all()
    assert (np.diff(model.eigval, axis=1) <= 1e-12).all()
    for row in gaussian.covariance_diagnostics(model):
        assert row["condition_number"] >= 1 and row["effective_rank"] <= 5
        assert sum(row["explained"]) == pytest.approx(1, abs=1e-6)


def test_bad_settings_and_bad_values(spark):
    x, y = blobs(2, 10, 2)
    with pytest.raises(ValueError):
        gaussian.fit_gaussian(samples(spark, x, y), 2, reg_type="other")
    x[3, 1] = np.nan
    with pytest.raises(ValueError, match="NaN"):
        gaussian.fit_gaussian(samples(spark, x, y), 2)
    fixed = prepare.impute_nonfinite(samples(spark, x, y))
    assert gaussian.fit_gaussian(fixed, 2).d == 2


def test_few_samples_warn(spark):
    with pytest.warns(UserWarning, match="samples for 2 bands"):
        gaussian.fit_gaussian(samples(spark, [[0, 0], [1, 0], [5, 5], [6, 5]], [1, 1, 2, 2]), 2)


def test_merged_batches_equal_one_batch(spark):
    x, y = blobs(3, 100, 5, gap=3.0)
    order = np.random.RandomState(1).permutation(len(x))
    tables = [gaussian.moments(samples(spark, x[i], y[i]), 5) for i in np.array_split(order, 10)]
    one = gaussian.fit_from_moments(gaussian.moments(samples(spark, x, y), 5), 5)
    left = gaussian.fit_from_moments(gaussian.merge_moments(*tables), 5)
    right = gaussian.fit_from_moments(gaussian.merge_moments(gaussian.merge_moments(*tables[:4]), gaussian.merge_moments(*tables[4:])), 5)
    for other in (left, right):
        assert np.allclose(one.mean, other.mean) and np.allclose(one.cov, other.cov, atol=1e-9)
        assert np.allclose(one.prior, other.prior)


def test_priors_after_an_update(spark):
    a = samples(spark, np.zeros((20, 3)), [1] * 10 + [2] * 10)
    b = samples(spark, np.ones((25, 3)), [1] * 5 + [2] * 20)
    model = gaussian.fit_from_moments(gaussian.merge_moments(gaussian.moments(a, 3), gaussian.moments(b, 3)), 3)
    assert np.allclose(model.prior, [15 / 45, 30 / 45])


def test_single_sample_class_gets_a_fixed_variance(spark):
    with pytest.warns(UserWarning):
        model = gaussian.fit_from_moments(gaussian.moments(samples(spark, [[1, 2], [3, 4], [5, 7], [5, 1]], [1, 2, 2, 2]), 2), 2)
    assert np.allclose(model.cov[0], 1e-6 * np.eye(2))


def test_importance_finds_the_band_that_separates(spark):
    x, y = blobs(3, 50, 4, gap=0.0)
    x[:, 2] += 6 * y
    model = gaussian.fit_gaussian(samples(spark, x, y), 4)
    shares = dict(gaussian.feature_importance(model, "discriminative"))
    assert max(shares, key=shares.get) == 3 and sum(shares.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        gaussian.feature_importance(model, "other")


def test_tuned_tau_is_the_best_of_the_grid(spark):
    x, y = blobs(2, 40, 12, gap=0.8)
    scores = gaussian.tune_tau(samples(spark, x, y), [0.0, 0.1, 10.0], folds=3, d=12)
    rows = {r["tau"]: r["accuracy"] for r in scores.collect()}
    assert set(rows) == {0.0, 0.1, 10.0} and rows[gaussian.best_tau(scores)] == max(rows.values())


def test_bic_prefers_the_generating_ridge(spark):
    x, y = blobs(2, 80, 3)
    model = gaussian.fit_gaussian(samples(spark, x, y), 3)
    low = gaussian.bic(samples(spark, x, y), model, 0.0).first()["bic"]
    assert np.isfinite(low) and low < gaussian.bic(samples(spark, x, y), model, 50.0).first()["bic"]


def test_wide_bic_equals_the_sum_of_columns(spark):
    x, y = blobs(4, 60, 20)
    df = samples(spark, x, y)
    model = gaussian.fit_gaussian(df, 20, tau=0.1)
    assert not gaussian.fits_columns(model)
    own = gaussian.own_discriminant(df, model).agg(F.sum("k")).first()[0]
    inv, const = model.inverses()
    k = gaussian.discriminants(x, model.mean, inv, const)
    assert own == pytest.approx(k[np.arange(len(y)), y - 1].sum())


def brute(q, r, k):
    dist = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    return [sorted(zip(row, range(len(r))))[:k] for row in dist]


def test_blocked_neighbours_equal_brute_force_with_copies(spark, monkeypatch):
    """A third of both sides are copies of one vector, and blocks are tiny."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 25)
    rng = np.random.RandomState(0)
    r = np.where((np.arange(180) % 3 == 0)[:, None], 0.5, rng.uniform(size=(180, 5)))
    q = np.where((np.arange(90) % 3 == 0)[:, None], 0.5, rng.uniform(size=(90, 5)))
    want = brute(q, r, 7)
    for limit in (1, 10**6):
        got = neighbors.knn_join(samples(spark, q, [1] * 90), samples(spark, r, np.arange(180) % 4 + 1), 7, 5, limit=limit)
        rows = {x["sample_id"]: x["neighbors"] for x in got.collect()}
        assert len(rows) == 90
        for i, near in enumerate(want):
            assert [e["ref_id"] for e in rows[i]] == [j for _, j in near]
            assert np.allclose([e["distance"] for e in rows[i]], [d for d, _ in near])


def test_neighbours_of_many_references_take_bounded_memory():
    import tracemalloc

    rng = np.random.RandomState(1)
    r = np.concatenate([rng.normal(size=(200_000, 2)), np.full((3, 2), 9.0), [[np.nan, 0.0]]])
    q = np.concatenate([rng.normal(size=(256, 2)), np.full((1, 2), 9.0), [[0.0, np.inf]]])
    tracemalloc.start()
    found = neighbors.closest(q, r, np.arange(len(r))[::-1], 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # one block against all references alone takes 400 MB
    assert found[256][0].tolist() == [200_002, 200_001, 200_000] and len(found[257][0]) == 0
    for i in (0, 100, 255):
        away = ((r[:-1] - q[i]) ** 2).sum(1)
        assert found[i][0].tolist() == np.argsort(away)[:3].tolist() and np.allclose(found[i][1] ** 2, np.sort(away)[:3])


def test_queries_reach_many_blocks_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 5)
    monkeypatch.setattr(neighbors, "SENT_ROWS", 11)
    rng = np.random.RandomState(3)
    q, r = rng.uniform(size=(40, 12)), rng.uniform(size=(120, 12))
    got = neighbors.knn_join(samples(spark, q, [1] * 40), samples(spark, r, [1] * 120), 4, 12, limit=1)
    rows = {x["sample_id"]: [e["ref_id"] for e in x["neighbors"]] for x in got.collect()}
    assert rows == {i: [j for _, j in near] for i, near in enumerate(brute(q, r, 4))}


def test_cells_share_blocks(spark, monkeypatch):
    """Small cells that lie close together are searched as one block, so a query is not sent to each of them."""
    sent, cut = [], neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbors, "cut_lineage", lambda df, name: sent.append((name, out := cut(df, name))) or out)
    rng = np.random.RandomState(4)
    q, r = rng.uniform(size=(50, 12)), rng.uniform(size=(240, 12))
    got = neighbors.knn_join(samples(spark, q, [1] * 50), samples(spark, r, [1] * 240), 3, 12, limit=1)
    rows = {x["sample_id"]: [e["ref_id"] for e in x["neighbors"]] for x in got.collect()}
    assert rows == {i: [j for _, j in near] for i, near in enumerate(brute(q, r, 3))}
    assert dict(sent)["queries"].count() <= 50 * 12  # 46 cells, of which a query reaches nearly all


def test_vote_ties_go_to_the_smallest_class(spark):
    refs = samples(spark, [[0.0], [1.0], [1.0], [5.0]], [3, 2, 3, 2])
    got = neighbors.knn_predict(samples(spark, [[0.9]], [0]), refs, 4, 1, classes=[2, 3]).first()
    assert got["class"] == 2 and list(got["probability"]) == [0.5, 0.5]
    near = neighbors.knn_predict(samples(spark, [[0.1]], [0]), refs, 4, 1, weights="distance").first()
    assert near["class"] == 3


def test_naive_bayes_matches_numpy(spark):
    x, y = blobs(3, 40, 6, gap=0.7)
    model = bayes.fit_naive_bayes(samples(spark, x, y), 6, 1e-3)
    eps = 1e-3 * x.var(0).max()
    k = np.array([np.log(x[y == c].var(0) + eps).sum() + ((x - x[y == c].mean(0)) ** 2 / (x[y == c].var(0) + eps)).sum(1) for c in (1, 2, 3)]).T
    for probability in (False, True):
        got = bayes.predict(samples(spark, x, y), model, ["sample_id"], probability).orderBy("sample_id").collect()
        assert [r["class"] for r in got] == list(k.argmin(1) + 1)


SMALL = {"RF": {"n_estimators": 10, "max_depth": 4}, "ET": {"n_estimators": 10, "max_depth": 4},
         "XGB": {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3}, "CB": {"iterations": 3, "depth": 2},
         "GBC": {"n_estimators": 3, "max_depth": 2}, "MLP": {"hidden_layer_sizes": (8,), "max_iter": 60},
         "LR": {"max_iter": 30}, "SVM": {"gamma": "scale"}, "KNN": {"n_neighbors": 3}, "GMM": {}, "NB": {}}


@pytest.mark.parametrize("code", sorted(learners.LEARNERS))
def test_every_classifier_learns_sparse_codes_and_survives_saving(spark, tmp_path, code):
    x, y = blobs(3, 30, 4, codes=[1, 3, 5])
    df = samples(spark, x, y)
    fitted = learners.fit(code, df, SMALL[code], seed=1)
    assert fitted.classes == [1, 3, 5]
    got = fitted.predict(df, ["sample_id", "label"], probability=True).orderBy("sample_id").collect()
    assert np.mean([r["class"] == r["label"] for r in got]) >= 0.9
    assert {r["class"] for r in got} <= {1, 3, 5}
    p = np.array([r["probability"] for r in got])
    assert p.shape == (90, 3) and np.allclose(p.sum(1), 1)
    scaler = prepare.fit_scaler(df)
    models.save_model(spark, fitted, scaler, str(tmp_path / code))
    back = models.load_model(spark, str(tmp_path / code))
    assert back.scaler == scaler and back.fitted.code == code
    again = back.fitted.predict(df, ["sample_id"]).orderBy("sample_id").collect()
    assert [r["class"] for r in again] == [r["class"] for r in got]


def test_broken_models_are_refused(spark, tmp_path):
    with pytest.raises(models.InvalidModel):
        models.load_model(spark, str(tmp_path / "nothing"))
    path = str(tmp_path / "odd")
    spark.createDataFrame([('{"code": "GMM"}',)], "value string").write.text(f"{path}/metadata")
    spark.createDataFrame([], "band int, lo double, hi double").write.parquet(f"{path}/scaler")
    with pytest.raises(models.InvalidModel, match="lacks"):
        models.load_model(spark, path)


def test_weights_are_used_or_refused(spark):
    x, y = blobs(2, 40, 2, gap=1.0)
    df = samples(spark, x, y)
    heavy = learners.fit("LR", learners.with_class_weights("LR", df, "custom", {1: 1.0, 2: 50.0}))
    plain = learners.fit("LR", df)
    twos = lambda m: m.predict(df, []).filter("class = 2").count()
    assert twos(heavy) > twos(plain)
    with pytest.raises(ValueError):
        learners.with_class_weights("KNN", df)
    for code in ("GMM", "NB"):
        assert twos(learners.fit(code, learners.with_class_weights(code, df, "custom", {1: 1.0, 2: 50.0}))) > twos(learners.fit(code, df))
    assert learners.weight_parameters("XGB", {1: 2.0, 2: 3.0}) == {"scale_pos_weight": 1.5}
    assert learners.weight_parameters("XGB", {1: 2.0, 2: 3.0, 3: 1.0}) == {}
    assert learners.weight_parameters("GMM", {1: 2.0}) == {}


def test_unknown_codes_and_registration(spark):
    with pytest.raises(ValueError):
        learners.fit("ABC", None)
    learners.register("MINE", lambda code, df, params, seed: learners.bayes_learner("NB", df, {}, seed), "Mine")
    try:
        x, y = blobs(2, 10, 2)
        assert learners.fit("MINE", samples(spark, x, y)).classes == [1, 2]
    finally:
        learners.LEARNERS.pop("MINE")
        learners.CODES.pop("MINE")


def test_grids():
    assert learners.default_grid("RF", 9) == {"n_estimators": [100], "max_features": [1, 4, 7]}
    assert len(tuning.combinations(learners.default_grid("CB", 4))) == 54
    assert learners.fast_grid("SVM", learners.default_grid("SVM", 4)) == {"gamma": [0.25, 4.0], "C": [0.1, 100.0]}
    assert learners.fast_grid("ET", learners.default_grid("ET", 4))["n_estimators"] == [50]
    for code in ("RF", "SVM", "MLP", "LR", "NB", "KNN", "XGB", "CB", "ET", "GBC"):
        a, b = tuning.draw_trials(code, 5, 3), tuning.draw_trials(code, 5, 3)
        assert a == b and len(a) == 5


def test_grid_search_takes_the_first_best(spark):
    x, y = blobs(2, 20, 2)
    found = tuning.grid_search("NB", samples(spark, x, y), {"var_smoothing": [1e-9, 1e-6]}, folds=2)
    assert found.best["place"] == 0 and found.best["mean"] == 1.0
    assert found.summary()["n_trials"] == 2


@pytest.mark.parametrize("counts,want", [
    ({1: 90, 2: 10}, {1: 90, 2: 90}), ({1: 100, 2: 30, 3: 20}, {1: 100, 2: 100, 3: 100}), ({1: 100, 2: 3}, {1: 100, 2: 100})])
def test_smote_fills_every_class(spark, counts, want):
    rng = np.random.RandomState(0)
    y = [c for c, n in counts.items() for _ in range(n)]
    df = samples(spark, rng.uniform(size=(len(y), 3)), y)
    both = oversample.smote(df, seed=2)
    assert {r["label"]: r["count"] for r in both.groupBy("label").count().collect()} == want
    assert both.select("sample_id").distinct().count() == both.count()
    made = both.filter("synthetic").collect()
    assert all(0 <= v <= 1 for r in made for v in r["bands"])


def test_many_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(oversample, "COPIES_PER_TASK", 7)
    seeds = spark.createDataFrame([(1, 30), (2, 7), (3, 1)], "sample_id bigint, _copies bigint")
    got = oversample.spread_copies(seeds, 30)
    assert {(r[0], r[1]) for r in got.collect()} == {(1, i) for i in range(1, 31)} | {(2, i) for i in range(1, 8)} | {(3, 1)}


def test_smote_targets():
    counts = {1: 50, 2: 20, 3: 20, 4: 50}
    for strategy, want in {
        "auto": {1: 50, 2: 50, 3: 50, 4: 50}, "not majority": {1: 50, 2: 50, 3: 50, 4: 50}, "all": {1: 50, 2: 50, 3: 50, 4: 50},
        "minority": {1: 50, 2: 50, 3: 20, 4: 50}, "not minority": {1: 50, 2: 20, 3: 50, 4: 50},
    }.items():
        assert oversample.class_targets(counts, strategy) == want
    assert oversample.class_targets(counts, {2: 33, 1: 50}) == {1: 50, 2: 33, 3: 20, 4: 50}
    for wrong in ("most", {2: 19}, {9: 4}):
        with pytest.raises(ValueError):
            oversample.class_targets(counts, wrong)


def test_smote_to_given_counts(spark):
    x = np.random.RandomState(0).uniform(size=(60, 2))
    both = oversample.smote(samples(spark, x, [1] * 40 + [2] * 12 + [3] * 8), seed=2, strategy={2: 30, 3: 9})
    assert {r["label"]: r["count"] for r in both.groupBy("label").count().collect()} == {1: 40, 2: 30, 3: 9}


@pytest.mark.parametrize("code, d, grid", [("GMM", 2, {"tau": [0.0, 0.5, 50.0], "reg_type": ["ridge", "oas"]}), ("GMM", 6, {"tau": [0.0, 50.0]}),
                                           ("NB", 3, {"var_smoothing": [1e-9, 0.9]}), ("NB", 30, {"var_smoothing": [1e-9, 0.9]})])
def test_trials_share_the_fit_of_a_fold(spark, monkeypatch, code, d, grid):
    fits, one, many = [], gaussian.fit_gaussian, bayes.fit_smoothed
    monkeypatch.setattr(gaussian, "fit_gaussian", lambda *a, **b: fits.append(1) or one(*a, **b))
    monkeypatch.setattr(bayes, "fit_smoothed", lambda *a, **b: fits.append(1) or many(*a, **b))
    x, y = blobs(3, 30, d, gap=0.6)
    folded = folds.stratified_kfold(samples(spark, x, y), 2).persist()
    for scoring in tuning.SCORES:
        fits.clear()
        found = tuning.grid_search(code, folded, grid, 2, scoring=scoring)
        assert len(fits) == 2 * len(grid.get("reg_type", [1]))
        for h in found.history:
            assert h["scores"] == pytest.approx(tuning.fold_scores(code, tuning.number_sides(folded), h["params"], scoring, 0), abs=1e-12)
    folded.unpersist()


def test_search_resamples_training_sides_alone(spark):
    x = np.random.RandomState(0).normal(size=(60, 2))
    df = samples(spark, x, [1] * 48 + [2] * 12).withColumn("fold", (F.col("sample_id") % 3).cast("int"))
    seen = []

    def resample(side):
        seen.append({r.label: r["count"] for r in side.groupBy("label").count().collect()})
        return oversample.smote(side, seed=1).drop("synthetic")

    found = tuning.grid_search("NB", df, {"var_smoothing": [1e-9, 1e-3]}, 3, resample=resample)
    assert seen == [{1: 32, 2: 8}] * 3
    model = learners.fit("NB", oversample.smote(df.filter("fold <> 1").drop("fold"), seed=1).drop("synthetic"), {"var_smoothing": 1e-9}, 0)
    assert found.history[0]["scores"][1] == tuning.score(model.predict(df.filter("fold = 1"), ["label"]))


def test_rows_with_other_band_counts_are_refused(spark):
    x, y = blobs(2, 20, 3)
    model = gaussian.fit_gaussian(samples(spark, x, y))
    with pytest.raises(Exception, match="3 bands expected, found 4"):
        gaussian.predict(samples(spark, np.ones((2, 4)), [1, 2]), model).collect()


def test_smote_only_if_needed(spark):
    even = samples(spark, np.zeros((20, 2)), [1] * 10 + [2] * 10)
    assert oversample.smote_if_needed(even) == (even, False)
    lone = samples(spark, np.zeros((11, 2)), [1] * 10 + [2])
    with pytest.raises(ValueError):
        oversample.smote(lone)


def test_bands_far_from_zero_keep_their_variance(spark):
    x = np.random.RandomState(2).normal(scale=np.sqrt(2), size=(400, 3)) + 1e8
    model = gaussian.fit_gaussian(samples(spark, x, np.ones(400, int)))
    assert np.allclose(model.cov[0], np.cov(x.T, bias=True), atol=1e-6) or np.allclose(model.cov[0], np.cov(x.T), atol=1e-6)


class Recorded(learners.Fitted):
    """Two classes; the first one's probability is a product of the two bands. Keeps what it was asked."""

    code, classes, d = "TEST", [1, 2], 2

    def __init__(self):
        self.asked = []

    def predict(self, df, keep, probability=False):
        self.asked.append(df)
        p = F.col("bands")[0] * F.col("bands")[1]
        return df.select(*keep, F.lit(1).alias("class"), p.alias("confidence"), F.array(p, 1 - p).alias("probability"))


@pytest.mark.parametrize("wide", [64, 0])
def test_attributions_mix_rows_where_they_lie(spark, monkeypatch, wide):
    monkeypatch.setattr(explain, "WIDE_SUMS", wide)
    rng = np.random.RandomState(4)
    x = rng.uniform(size=(30, 2))
    df = samples(spark, [*x, x[7]], [1] * 31).repartition(6).withColumn("sample_id", F.least("sample_id", F.when(F.col("sample_id") == 30, 7).otherwise(99)))
    model, ground = Recorded(), samples(spark, x[:5], [1] * 5)
    got = {(r["sample_id"], r["class"], r["band"]): r["value"] for r in explain.shapley_values(model, df, ground).collect()}
    for i in range(30):
        a, b, mean = x[i, 0], x[i, 1], (x[:5, 0] * x[:5, 1]).mean()
        first = (a * x[:5, 1].mean() - mean + a * b - b * x[:5, 0].mean()) / 2
        assert got[i, 1, 1] == pytest.approx(first) and got[i, 2, 1] == pytest.approx(-first)
        assert got[i, 1, 2] == pytest.approx(a * b - mean - first)
    assert len(got) == 30 * 4
    # 31 samples with 5 background rows for two coalitions and one row for the full one.
    mixed = model.asked[-1]
    assert mixed.count() == 31 * (2 * 5 + 1)


class ByRows(learners.Fitted):
    """A model that can only predict tables."""

    def __init__(self, model):
        self.model, self.code, self.classes, self.d = model, model.code, model.classes, model.d

    def predict(self, df, keep, probability=False):
        return self.model.predict(df, keep, probability)


@pytest.mark.parametrize("wide", [64, 0])
@pytest.mark.parametrize("code, d, options", [
    ("GMM", 2, {}), ("GMM", 4, {}), ("NB", 3, {}), ("ET", 3, {"n_estimators": 2, "max_depth": 2}), ("GBC", 2, {"n_estimators": 1, "max_depth": 2}),
    ("MLP", 2, {"max_iter": 5, "alpha": 1e-4})])
def test_attributions_inside_tasks_equal_mixed_rows(spark, monkeypatch, wide, code, d, options):
    monkeypatch.setattr(explain, "WIDE_SUMS", wide)
    monkeypatch.setattr(explain, "MIXED_ROWS", 40)
    monkeypatch.setattr(gaussian, "MIXED_CELLS", 150)
    x, y = blobs(3, 20, d, gap=1.0)
    x[:, 0] = np.round(x[:, 0])
    model = learners.fit(code, samples(spark, x, y), options)
    odd = [*x, x[3] + 1, x[4] * 1e6]
    if code != "MLP":
        odd.append([np.nan, *x[5, 1:]])
    df = samples(spark, odd, [1] * len(odd)).withColumn("sample_id", F.when(F.col("sample_id") == 60, 3).otherwise(F.col("sample_id")))
    small = code == "GMM" and d == 2
    if small:
        # A row without bands, one band of which is missing, and one that is infinite.
        df = df.union(spark.createDataFrame([(90, 1, None), (91, 1, [1.0, None]), (92, 1, [float("inf"), 0.0])], df.schema))
    take = lambda m: {(r["sample_id"], r["class"], r["band"]): r["value"] for r in explain.shapley_values(m, df, samples(spark, x[:7], y[:7])).collect()}
    got, want = take(model), take(ByRows(model))
    assert got == pytest.approx(want, abs=1e-9, nan_ok=True) and len(got) == (61 + (code != "MLP") + 3 * small) * 3 * d


@pytest.mark.parametrize("how", explain.AGGREGATES)
def test_importance_by_coalitions_writes_no_mixed_rows(spark, how):
    x, y = blobs(2, 20, 2, gap=1.0)
    df = samples(spark, [*x, x[1] + 1], [*y, 1]).withColumn("sample_id", F.when(F.col("sample_id") == 40, 1).otherwise(F.col("sample_id")))
    model = learners.fit("GMM", df)
    want = {r.band: r.importance for r in explain.aggregate_attributions(explain.shapley_values(ByRows(model), df, seed=2), how).collect()}
    short = explain.shapley_importance(model, df, how, seed=2)
    assert {r.band: r.importance for r in short.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 2
    assert "cid" not in short._jdf.queryExecution().analyzed().toString()
    with pytest.raises(Exception, match="2 bands expected, found 3"):
        explain.shapley_importance(model, samples(spark, [[1, 2, 3]], [1]), how, background=df).collect()
