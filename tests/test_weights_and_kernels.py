"""Sample weights of Gaussian models, networks by Adam, kernels without a distance: against plain numpy."""

import numpy as np
import pytest
from helpers import blobs, samples
from pyspark.sql import functions as F

from bandloom.operators import bayes, gaussian, kernels, learners, perceptron, tuning
from bandloom.sources import models


def weighted(spark, d, seed=4, n=120, scale=1.0, offset=0.0):
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(n, d)) * scale + offset
    y, w = 1 + np.arange(n) % 3, np.where(np.arange(n) % 7 == 0, 0.0, rng.uniform(0.2, 3, n))
    rows = [(i, int(c), [float(v) for v in r], float(g)) for i, (r, c, g) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "sample_id bigint, label int, bands array<double>, weight double"), x, y, w


@pytest.mark.parametrize("d,offset", [(3, 0.0), (3, 1e7), (13, 5.0)])
def test_weighted_gaussian_equals_numpy(spark, d, offset):
    df, x, y, w = weighted(spark, d, offset=offset)
    model = gaussian.fit_gaussian(df)
    for c in (1, 2, 3):
        m = y == c
        assert np.isclose(model.prior[c - 1], w[m].sum() / w.sum())
        assert np.allclose(model.mean[c - 1], np.average(x[m], axis=0, weights=w[m]))
        assert np.allclose(model.cov[c - 1], np.cov(x[m].T, aweights=w[m], bias=True), atol=1e-6)
    # Merged parts equal the whole; the shrinkage counts effective samples.
    parts = [gaussian.weighted_moments(df.filter(F.col("sample_id") % 3 == i), d) for i in range(3)]
    merged = {r["label"]: r for r in gaussian.merge_weighted_moments(*parts).collect()}
    for r in gaussian.weighted_moments(df, d).collect():
        got = merged[r["label"]]
        assert got["n"] == r["n"] == ((y == r["label"]) & (w > 0)).sum()
        assert np.allclose([got["w"], got["w2"], *got["s"], *got["ss"]], [r["w"], r["w2"], *r["s"], *r["ss"]])
    if not offset:
        shrunk = gaussian.fit_gaussian(df, reg_type="oas", target="spherical")
        m = y == 1
        want = gaussian.shrink(np.cov(x[m].T, aweights=w[m], bias=True), w[m].sum() ** 2 / (w[m] ** 2).sum(), "oas", "spherical")
        assert np.allclose(shrunk.cov[0], want)


def test_weights_of_one_change_nothing_and_odd_weights_are_refused(spark):
    df, x, y, _ = weighted(spark, 3)
    ones, plain = gaussian.fit_gaussian(df.withColumn("weight", F.lit(1.0))), gaussian.fit_gaussian(df.drop("weight"))
    assert np.allclose(ones.cov, plain.cov) and list(ones.n) == list(plain.n)
    a, b = bayes.fit_naive_bayes(df.withColumn("weight", F.lit(2.0))), bayes.fit_naive_bayes(df.drop("weight"))
    assert np.allclose(a.mean, b.mean) and np.allclose(a.var, b.var) and np.allclose(a.prior, b.prior)
    for odd in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="weights"):
            gaussian.fit_gaussian(df.withColumn("weight", F.lit(odd)))


def test_weighted_naive_bayes_equals_numpy(spark):
    df, x, y, w = weighted(spark, 4, offset=1e6)
    model = bayes.fit_naive_bayes(df, var_smoothing=0.0)
    for c in (1, 2, 3):
        m = y == c
        mean = np.average(x[m], axis=0, weights=w[m])
        assert np.allclose(model.mean[c - 1], mean)
        assert np.allclose(model.var[c - 1], np.average((x[m] - mean) ** 2, axis=0, weights=w[m]), atol=1e-6)
    assert np.allclose(model.prior, [w[y == c].sum() / w.sum() for c in (1, 2, 3)])


@pytest.mark.parametrize("activation", perceptron.ACTIVATIONS)
def test_gradients_equal_differences(activation):
    rng = np.random.RandomState(1)
    net = perceptron.fresh_network([3, 4, 5, 2], activation, 0)
    x, y, w = rng.normal(size=(9, 3)), rng.randint(0, 2, 9), rng.uniform(0, 2, 9)
    got, at, step = net.gradient(x, y, w), net.flat(), 1e-6
    for i in range(len(at)):
        move = np.zeros(len(at))
        move[i] = step
        rise = net.moved(at + move).gradient(x, y, w)[-2] - net.moved(at - move).gradient(x, y, w)[-2]
        assert abs(rise / (2 * step) - got[i]) < 1e-5
    assert np.isclose(got[-1], w.sum())


def test_networks_learn_and_heed_their_settings(spark, tmp_path):
    x, y = blobs(3, 40, 4, gap=3.0, codes=[2, 4, 7])
    df = samples(spark, (x - x.mean(0)) / x.std(0), y)
    fit = lambda **p: learners.fit("MLP", df, {"hidden_layer_sizes": (6,), "max_iter": 12, "learning_rate_init": 0.05, **p}, seed=3)
    base = fit()
    assert base.losses[-1] < 0.5 * base.losses[0] and base.classes == [2, 4, 7]
    got = base.predict(df, ["sample_id", "label"], probability=True).collect()
    assert np.mean([r["class"] == r["label"] for r in got]) > 0.9 and np.allclose([sum(r["probability"]) for r in got], 1)
    assert not np.allclose(base.network.flat(), fit(learning_rate_init=0.005).network.flat())
    assert np.abs(fit(alpha=50.0).network.weights[0]).sum() < np.abs(base.network.weights[0]).sum()
    assert np.allclose(base.network.flat(), fit().network.flat())
    assert len(fit(tol=10.0, max_iter=40).losses) == 1 + perceptron.PATIENCE
    # Another layout of the rows sums in another order only; several batches an epoch learn as well.
    spread = learners.fit("MLP", df.repartition(7), {"hidden_layer_sizes": (6,), "max_iter": 12, "learning_rate_init": 0.05}, seed=3)
    assert np.allclose(spread.network.flat(), base.network.flat(), atol=1e-9)
    assert fit(batch_size=40, max_iter=5).losses[-1] < base.losses[4]
    models.save_model(spark, base, None, str(tmp_path / "net"))
    back = models.load_model(spark, str(tmp_path / "net")).fitted
    assert np.array_equal(back.network.flat(), base.network.flat()) and back.losses == base.losses


def test_network_weights_act_as_copies_and_bad_input_is_refused(spark):
    x, y = blobs(2, 15, 3, gap=1.0)
    df = samples(spark, x, y)
    params = {"hidden_layer_sizes": (3,), "max_iter": 3, "learning_rate_init": 0.1, "alpha": 0.0}
    heavy = df.withColumn("weight", F.when(F.col("label") == 2, 3.0).otherwise(1.0))
    copied = df.unionByName(df.filter("label = 2")).unionByName(df.filter("label = 2"))
    assert np.allclose(learners.fit("MLP", heavy, params).network.flat(), learners.fit("MLP", copied, params).network.flat())
    empty = df.filter("label > 9")
    with pytest.raises(ValueError, match="no labelled"):
        perceptron.fit_perceptron(empty, F.lit(0), 3, 2)
    with pytest.raises(ValueError, match="weight 0"):
        learners.fit("MLP", df.withColumn("weight", F.lit(0.0)), params)
    with pytest.raises(ValueError, match="not finite"):
        learners.fit("MLP", df.withColumn("bands", F.transform("bands", lambda v: F.lit(float("nan")))), params)
    with pytest.raises(ValueError, match="activation"):
        learners.fit("MLP", df, {**params, "activation": "step"})
    with pytest.raises(ValueError, match="solver"):
        learners.fit("MLP", df, {"solver": "newton"})


def test_a_stalled_rate_falls(spark):
    x, y = blobs(2, 10, 2)
    params = {"hidden_layer_sizes": (2,), "learning_rate": "adaptive", "tol": 10.0, "max_iter": 60}
    # After the first epoch nothing improves enough: 0.001 falls five times below the least rate, every second epoch.
    assert len(learners.fit("MLP", samples(spark, x, y), params).losses) == 1 + 2 * 5


@pytest.mark.parametrize("kernel,degree,coef0", [("poly", 3, 0.0), ("poly", 2, 1.0)])
def test_polynomials_are_met_exactly(spark, kernel, degree, coef0):
    x = np.random.RandomState(0).normal(size=(300, 3))
    df = samples(spark, x, np.ones(300, int))
    made, error = kernels.landmark_map(df, kernel, 0.5, degree, coef0, seed=1)
    assert error < 1e-8
    z = np.array([r["bands"] for r in made(df).orderBy("sample_id").collect()])
    assert np.allclose(z @ z.T, (0.5 * x @ x.T + coef0) ** degree, atol=1e-6)


def test_sigmoid_error_falls_with_landmarks_and_copies_take_no_places(spark):
    x = np.random.RandomState(0).normal(size=(400, 6))
    df = samples(spark, np.concatenate([x, np.repeat(x[:1], 500, axis=0)]), np.ones(900, int))
    few, many = (kernels.landmark_map(df, "sigmoid", 0.05, seed=1, size=m)[1] for m in (3, 64))
    assert many < few and many < 0.2
    assert len(np.unique(kernels.landmark_map(df, "sigmoid", 0.05)[0].landmarks, axis=0)) == kernels.LANDMARKS
    again = kernels.landmark_map(df.repartition(5), "sigmoid", 0.05)[0].landmarks
    assert np.array_equal(again, kernels.landmark_map(df, "sigmoid", 0.05)[0].landmarks)


def test_kernels_decide_what_a_machine_can_tell_apart(spark, tmp_path):
    rng = np.random.RandomState(3)
    x = rng.uniform(-1, 1, size=(240, 2))
    df = samples(spark, x, 1 + (x[:, 0] * x[:, 1] > 0))
    share = lambda m: np.mean([r["class"] == r["label"] for r in m.predict(df, ["label"]).collect()])
    even = learners.fit("SVM", df, {"kernel": "poly", "degree": 2, "gamma": 1.0, "C": 100.0})
    odd = learners.fit("SVM", df, {"kernel": "poly", "degree": 1, "gamma": 1.0, "C": 100.0})
    assert share(even) > 0.95 and share(odd) < 0.8 and even.extras["kernel_error"] < 1e-8
    bent = learners.fit("SVM", df, {"kernel": "sigmoid", "gamma": 0.5})
    for fitted, name in ((even, "even"), (bent, "bent")):
        models.save_model(spark, fitted, None, str(tmp_path / name))
        back = models.load_model(spark, str(tmp_path / name)).fitted
        rows = lambda m: [tuple(r) for r in m.predict(df, ["sample_id"]).orderBy("sample_id").collect()]
        assert rows(back) == rows(fitted) and back.extras == fitted.extras
    with pytest.raises(ValueError, match="kernel"):
        learners.fit("SVM", df, {"kernel": "spline"})


def test_drawn_trials_name_settings_that_act(spark):
    x, y = blobs(2, 12, 2)
    df = samples(spark, x, y)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        for code in ("SVM", "MLP"):
            for trial in tuning.draw_trials(code, 2, 5):
                learners.fit(code, df, {**trial, **({"max_iter": 2} if code == "MLP" else {})})
