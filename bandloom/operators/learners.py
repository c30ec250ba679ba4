"""One registry of classifiers: fit on samples, predict on pixels.

Samples have `bands` and `label` (any codes), pixels have `bands`. Every fitted
classifier gives `class`, `confidence` and, on request, `probability` in the
order of its sorted classes.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from dataclasses import fields as dataclass_fields
from functools import partial, reduce
from typing import Any

import numpy as np
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions.matrix import field as arrow_field
from bandloom.functions.matrix import map_matrix
from bandloom.operators import bayes, boosting, extra_trees, gaussian, kernels, neighbors, perceptron, trees
from bandloom.operators.labels import sorted_classes
from bandloom.operators.prepare import band_count

CODES = {row[0]: row[1] for row in fv.CLASSIFIERS}
TUNABLE = {row[0] for row in fv.CLASSIFIERS if row[3]}
WEIGHTED = {row[0] for row in fv.CLASSIFIERS if row[5]}
# Classifiers that have no setting for class weights but whose sums take a weight per sample.
SAMPLE_WEIGHTED = WEIGHTED | {"GMM", "NB", "MLP"}
# The deepest tree Spark grows; a forest's default is DEFAULT_DEPTH.
MAX_DEPTH = 30
DEFAULT_DEPTH = 10
FOURIER_FEATURES = 128


class Fitted:
    """A trained classifier.

    Where a task can predict by itself, `scorer()` gives a function of a matrix of band
    vectors that returns class probabilities, and `mixer()` one as `gaussian.mixer`.
    """

    code: str
    classes: list[int]
    d: int

    def predict(self, df: DataFrame, keep: Sequence[str], probability: bool = False) -> DataFrame:
        raise NotImplementedError

    def mixer(self):
        return partial(gaussian.mean_scores, self.scorer())


def checked(code: str) -> str:
    if code not in CODES:
        raise ValueError(f"unknown classifier {code!r}; use one of {', '.join(CODES)}")
    return code


def classifier_table(spark) -> DataFrame:
    """Code, name and abilities of every classifier."""
    return spark.createDataFrame(
        fv.CLASSIFIERS,
        "code string, name string, probability boolean, tunable boolean, attributable boolean, class_weights boolean",
    )


@dataclass
class GaussianFitted(Fitted):
    model: gaussian.GaussianModel
    code: str = "GMM"

    @property
    def classes(self):
        return list(self.model.classes)

    @property
    def d(self):
        return self.model.d

    def predict(self, df, keep, probability=False):
        return gaussian.predict(df, self.model, keep, probability=probability)

    def scorer(self):
        return gaussian.scorer(self.model)

    def mixer(self):
        return gaussian.mixer(self.model)


@dataclass
class BayesFitted(Fitted):
    model: bayes.NaiveBayesModel
    code: str = "NB"

    @property
    def classes(self):
        return list(self.model.classes)

    @property
    def d(self):
        return self.model.d

    def predict(self, df, keep, probability=False):
        return bayes.predict(df, self.model, keep, probability=probability)

    def scorer(self):
        return lambda x: gaussian.posterior(bayes.deviances(x, self.model))


@dataclass
class NeighborFitted(Fitted):
    """The reference samples are the model."""

    refs: DataFrame
    k: int
    weights: str
    classes: list[int]
    d: int
    code: str = "KNN"

    def predict(self, df, keep, probability=False):
        return neighbors.knn_predict(df, self.refs, self.k, self.d, keep, self.weights, self.classes if probability else None)


@dataclass
class SparkFitted(Fitted):
    """A Spark ML model over the vector of bands and 0-based class codes."""

    code: str
    model: Any
    classes: list[int]
    d: int
    project: Callable[[DataFrame], DataFrame] | None = None
    calibrator: Any = None
    margin: bool = False
    extras: dict = field(default_factory=dict)

    def predict(self, df, keep, probability=False):
        # Names the model adds may collide with columns to keep, so those travel as one struct.
        held = df.select(F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_")).alias("_keep"), "bands")
        ready = self.project(held) if self.project else held
        scored = self.model.transform(ready.withColumn("features", array_to_vector("bands")))
        code = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int") + 1)
        if self.calibrator is not None:
            scored = scored.withColumnRenamed("prediction", "_hard").drop("probability")
            scored = self.calibrator.transform(scored.withColumnRenamed("rawPrediction", "margins"))
            p = vector_to_array("probability")
            code = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("_hard").cast("int") + 1)
        elif self.margin:
            odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
            total = F.aggregate(odds, F.lit(0.0), lambda a, v: a + v)
            p = F.transform(odds, lambda v: F.coalesce(F.try_divide(v, total), F.lit(1.0 / len(self.classes))))
        else:
            p = vector_to_array("probability")
        out = scored.select("_keep", code.alias("class"), p.alias("_p"))
        at = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("class")).cast("int")
        cols = [F.col("_keep")[c].alias(c) for c in keep] + ["class", F.element_at("_p", at).alias("confidence")]
        if probability:
            cols.append(F.col("_p").alias("probability"))
        return out.select(*cols)


@dataclass
class TreesFitted(Fitted):
    """Trees of this package: class shares to be averaged, or margins of one class after the other to be added."""

    code: str
    trees: list[trees.Tree]
    classes: list[int]
    d: int
    boosted: bool = False
    rate: float = 1.0
    losses: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of a forest, margins of a boosted model."""
        out = np.zeros((len(x), len(self.classes)))
        for t, tree in enumerate(self.trees):
            if self.boosted:
                out[:, t % len(self.classes)] += self.rate * tree.value[tree.leaf(x), 0]
            else:
                out += tree.value[tree.leaf(x)] / len(self.trees)
        return out

    def scorer(self):
        return (lambda x: boosting.softmax(self.scores(x))) if self.boosted else self.scores

    def predict(self, df, keep, probability=False):
        shared = df.sparkSession.sparkContext.broadcast(self)
        codes = np.array(self.classes, dtype=np.int32)

        def compute(x, _):
            p = shared.value.scorer()(x)
            best = p.argmax(axis=1)
            made = [codes[best], p[np.arange(len(p)), best]]
            return [*made, p] if probability else made

        fields = [arrow_field("class", "int"), arrow_field("confidence", "double")]
        return map_matrix(df, self.d, keep, fields + [arrow_field("probability", "array<double>")] * probability, compute)

    def paths(self) -> trees.Paths:
        """The leaf table whose outputs are the scores."""
        if not self.boosted:
            return trees.leaf_paths(self.trees, 1 / len(self.trees))
        spread = []
        for t, tree in enumerate(self.trees):
            value = np.zeros((len(tree.band), len(self.classes)))
            value[:, t % len(self.classes)] = tree.value[:, 0]
            spread.append(replace(tree, value=value))
        return trees.leaf_paths(spread, self.rate)


@dataclass
class PerceptronFitted(Fitted):
    """A network trained by this package and the loss of its epochs."""

    network: perceptron.Network
    classes: list[int]
    losses: list[float] = field(default_factory=list)
    code: str = "MLP"

    @property
    def d(self):
        return self.network.sizes[0]

    def scorer(self):
        return self.network.probabilities

    def predict(self, df, keep, probability=False):
        shared, codes = df.sparkSession.sparkContext.broadcast(self.network), np.array(self.classes, dtype=np.int32)

        def compute(x, _):
            p = shared.value.probabilities(x)
            best = p.argmax(axis=1)
            return [codes[best], p[np.arange(len(p)), best], *([p] if probability else [])]

        fields = [arrow_field("class", "int"), arrow_field("confidence", "double")]
        return map_matrix(df, self.d, keep, fields + [arrow_field("probability", "array<double>")] * probability, compute)


def code_column(classes: Sequence[int]) -> Column:
    """Position of the label among the sorted classes, as Spark ML wants it."""
    return (F.array_position(F.array(*[F.lit(int(c)) for c in classes]), F.col("label")) - 1).cast("double")


def training_frame(df: DataFrame, classes: Sequence[int]) -> DataFrame:
    weight = ["weight"] if "weight" in df.columns else []
    return df.select("bands", *weight, code_column(classes).alias("code")).withColumn("features", array_to_vector("bands"))


def unsupported(code: str, params: dict, known: Sequence[str]) -> None:
    for name in params:
        if name not in known:
            warnings.warn(f"{code}: parameter {name!r} has no counterpart and is ignored", stacklevel=3)


def depth_of(asked) -> int:
    """A tree depth, refused where Spark's trees cannot grow that deep."""
    depth = DEFAULT_DEPTH if asked is None else int(asked)
    if depth > MAX_DEPTH:
        raise ValueError(f"trees grow to depth {MAX_DEPTH} at most, {depth} was asked for")
    return depth


def forest(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    unsupported(code, params, ["n_estimators", "max_depth", "min_samples_leaf", "max_features"])
    classes, d = sorted_classes(df), band_count(df)
    share = params.get("max_features", "sqrt")
    strategy = "all" if share is None else str(share)
    leaf = max(int(params.get("min_samples_leaf", 1)), 1)
    estimator = RandomForestClassifier(
        labelCol="code", numTrees=int(params.get("n_estimators", 100)), maxDepth=depth_of(params.get("max_depth", DEFAULT_DEPTH)),
        featureSubsetStrategy=strategy, minInstancesPerNode=leaf, seed=seed, maxMemoryInMB=512,
    )
    return SparkFitted(code, fit_weighted(estimator, df, classes), classes, d)


def randomised_forest(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    """Extra trees: all rows, random thresholds."""
    unsupported(code, params, ["n_estimators", "max_depth", "min_samples_leaf", "min_samples_split", "max_features"])
    classes, d = sorted_classes(df), band_count(df)
    grown = extra_trees.fit_extra_trees(
        df.filter(F.col("label").isNotNull()), code_column(classes), d, len(classes), int(params.get("n_estimators", 100)),
        depth_of(params.get("max_depth", DEFAULT_DEPTH)), params.get("max_features", "sqrt"), max(int(params.get("min_samples_leaf", 1)), 1),
        int(params.get("min_samples_split", 2)), seed)
    return TreesFitted(code, grown, classes, d)


def fit_weighted(estimator, df: DataFrame, classes: Sequence[int]):
    if "weight" in df.columns:
        estimator = estimator.setWeightCol("weight")
    return estimator.fit(training_frame(df, classes))


# Parameters of the boosting codes and the settings they stand for, with the defaults of each code.
BOOST_PARAMETERS = {
    "XGB": {"n_estimators": "rounds", "max_depth": "depth", "learning_rate": "rate", "subsample": "row_share", "colsample_bytree": "band_share",
            "gamma": "min_gain", "min_child_weight": "min_hessian", "reg_lambda": "leaf_l2"},
    "CB": {"iterations": "rounds", "depth": "depth", "learning_rate": "rate", "l2_leaf_reg": "leaf_l2"},
    "GBC": {"n_estimators": "rounds", "max_depth": "depth", "learning_rate": "rate", "subsample": "row_share", "min_samples_split": "split_rows",
            "min_samples_leaf": "min_rows"},
}
BOOST_DEFAULTS = {"XGB": {"min_hessian": 1.0}, "CB": {"leaf_l2": 3.0, "symmetric": True}, "GBC": {"leaf_l2": 0.0}}


def booster(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    """Softmax boosting with second-order leaves; CB grows symmetric trees. `bins` and `binning` may be set for all codes."""
    names = {**BOOST_PARAMETERS[code], "bins": "bins", "binning": "binning"}
    unsupported(code, {k: v for k, v in params.items() if k != "loss_function"}, list(names))
    options = {**BOOST_DEFAULTS[code], **{names[k]: v for k, v in params.items() if k in names}}
    options["depth"] = depth_of(options.get("depth", 3))
    kinds = {f.name: type(f.default) for f in dataclass_fields(boosting.BoostSettings)}
    settings = boosting.BoostSettings(**{k: kinds[k](v) for k, v in options.items()}, seed=seed)
    classes, d = sorted_classes(df), band_count(df)
    model = boosting.fit_boosted(df.filter(F.col("label").isNotNull()), code_column(classes), d, len(classes), settings)
    return TreesFitted(code, [tree for round_ in model.trees for tree in round_], classes, d, True, model.rate, model.losses)


def fit_rest(estimator, df: DataFrame, classes: Sequence[int]):
    rest = OneVsRest(classifier=estimator, labelCol="code", parallelism=4)
    if "weight" in df.columns:
        rest = rest.setWeightCol("weight")
    return rest.fit(training_frame(df, classes))


def fourier(gamma: float, d: int, seed: int, size: int = FOURIER_FEATURES) -> Callable[[DataFrame], DataFrame]:
    """Random Fourier features of a radial kernel (Rahimi and Recht 2007)."""
    rng = np.random.RandomState(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(d, size))
    phase = rng.uniform(0, 2 * np.pi, size)

    def project(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != "bands"]
        made = map_matrix(df, d, rest, [arrow_field("_z", "array<double>")],
                          lambda x, _: [np.sqrt(2 / size) * np.cos(x @ w + phase)])
        return made.withColumnRenamed("_z", "bands")

    return project


def kernel_width(df: DataFrame, d: int, gamma) -> float:
    """`scale` is 1/(d * variance of all band values), `auto` is 1/d."""
    if gamma == "auto":
        return 1.0 / d
    if gamma == "scale":
        b = F.col("bands")
        row = df.agg(*[F.avg(b[i]) for i in range(d)], *[F.avg(b[i] * b[i]) for i in range(d)]).collect()[0]
        mean, square = np.mean(row[:d]), np.mean(row[d:])
        return 1.0 / (d * max(square - mean**2, 1e-12))
    return float(gamma)


def machine_features(code: str, df: DataFrame, d: int, params: dict, seed: int) -> tuple[Callable[[DataFrame], DataFrame], dict]:
    """The feature map of the kernel asked for, and what is needed to make it again."""
    kernel = params.get("kernel", "rbf")
    if kernel not in ("rbf", *kernels.KERNELS):
        raise ValueError(f"{code}: unknown kernel {kernel!r}, use rbf or one of {', '.join(kernels.KERNELS)}")
    gamma = params.get("gamma_value") if params.get("gamma_type") == "float" else params.get("gamma", "scale")
    width = kernel_width(df, d, gamma)
    if kernel == "rbf":
        return fourier(width, d, seed), {"gamma": width, "seed": seed}
    made, error = kernels.landmark_map(df, kernel, width, params.get("degree", 3), params.get("coef0", 0.0), seed)
    return made, {"kernel": kernel, "gamma": width, "degree": made.degree, "coef0": made.coef0, "kernel_error": error,
                  "landmarks": made.landmarks.tolist()}


def remade_features(extras: dict, d: int) -> Callable[[DataFrame], DataFrame]:
    """The map that `machine_features` described."""
    if "kernel" not in extras:
        return fourier(extras["gamma"], d, extras["seed"])
    return kernels.LandmarkMap(extras["kernel"], extras["gamma"], extras["degree"], extras["coef0"], np.array(extras["landmarks"]))


def kernel_machine(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    """Support vector machine with a kernel, by a linear one on the kernel's features: random
    Fourier features of the radial kernel, landmark features of the polynomial and sigmoid one.
    Probabilities come from a logistic fit on the margins."""
    unsupported(code, params, ["C", "gamma", "kernel", "gamma_type", "gamma_value", "degree", "coef0"])
    classes, d = sorted_classes(df), band_count(df)
    n = df.count()
    project, extras = machine_features(code, df, d, params, seed)
    wide = project(df.select("bands", "label", *(["weight"] if "weight" in df.columns else [])))
    machine = LinearSVC(labelCol="code", regParam=1.0 / (float(params.get("C", 1.0)) * max(n, 1)), maxIter=50)
    if len(classes) == 2:
        model = fit_weighted(machine, wide, classes)
    else:
        model = fit_rest(machine, wide, classes)
    margins = model.transform(training_frame(wide, classes)).select("code", F.col("rawPrediction").alias("margins"))
    calibrator = LogisticRegression(featuresCol="margins", labelCol="code", family="multinomial", maxIter=50,
                                    regParam=1e-6).fit(margins)
    return SparkFitted(code, model, classes, d, project=project, calibrator=calibrator, extras=extras)


def logistic(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    unsupported(code, params, ["C", "penalty", "max_iter"])
    classes, d = sorted_classes(df), band_count(df)
    penalty = params.get("penalty", "l2")
    strength = 0.0 if penalty is None else 1.0 / (float(params.get("C", 1.0)) * max(df.count(), 1))
    mix = {"l1": 1.0, "elasticnet": 0.5}.get(penalty, 0.0)
    estimator = LogisticRegression(
        labelCol="code", family="multinomial", regParam=strength, elasticNetParam=mix, maxIter=int(params.get("max_iter", 1000)))
    return SparkFitted(code, fit_weighted(estimator, df, classes), classes, d)


# Settings of the stochastic solver and the arguments they stand for.
ADAM_PARAMETERS = {"activation": "activation", "alpha": "alpha", "learning_rate_init": "rate", "learning_rate": "schedule",
                   "batch_size": "batch_size", "tol": "tol", "start": "start"}


def perceptron_learner(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    """Adam wherever one of its settings or a `weight` is given, or `solver` asks for it; else
    L-BFGS on logistic units, which has no step size."""
    unsupported(code, params, ["hidden_layer_sizes", "n_layers", "max_iter", "solver", *ADAM_PARAMETERS])
    stochastic = "weight" in df.columns or any(name in params for name in ADAM_PARAMETERS)
    solver = params.get("solver", "adam" if stochastic else "lbfgs")
    if solver not in ("adam", "lbfgs"):
        raise ValueError(f"{code}: unknown solver {solver!r}, use adam or lbfgs")
    classes, d = sorted_classes(df), band_count(df)
    hidden, turns = [int(v) for v in params.get("hidden_layer_sizes", (50,))], int(params.get("max_iter", 500))
    if solver == "adam":
        options = {ADAM_PARAMETERS[k]: v for k, v in params.items() if k in ADAM_PARAMETERS}
        network, losses = perceptron.fit_perceptron(
            df.filter(F.col("label").isNotNull()), code_column(classes), d, len(classes), hidden, epochs=turns, seed=seed, **options)
        return PerceptronFitted(network, classes, losses, code)
    if stochastic:
        warnings.warn(f"{code}: L-BFGS takes no step size, activation, penalty or weights; they are ignored", stacklevel=3)
    estimator = MultilayerPerceptronClassifier(
        labelCol="code", layers=[d, *hidden, len(classes)], maxIter=turns, seed=seed, blockSize=256)
    return SparkFitted(code, estimator.fit(training_frame(df.drop("weight"), classes)), classes, d)


def gaussian_learner(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    unsupported(code, params, ["tau", "reg_type", "target", "min_eigenvalue", "center"])
    return GaussianFitted(gaussian.fit_gaussian(df, **params))


def bayes_learner(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    unsupported(code, params, ["var_smoothing"])
    return BayesFitted(bayes.fit_naive_bayes(df, var_smoothing=float(params.get("var_smoothing", 1e-9))))


def neighbor_learner(code: str, df: DataFrame, params: dict, seed: int) -> Fitted:
    unsupported(code, params, ["n_neighbors", "weights", "algorithm", "leaf_size"])
    labelled = df.filter(F.col("label").isNotNull()).select("sample_id", "label", "bands")
    return NeighborFitted(labelled, int(params.get("n_neighbors", 5)), params.get("weights", "uniform"),
                          sorted_classes(labelled), band_count(labelled))


LEARNERS: dict[str, Callable[[str, DataFrame, dict, int], Fitted]] = {
    "GMM": gaussian_learner,
    "RF": forest,
    "SVM": kernel_machine,
    "KNN": neighbor_learner,
    "XGB": booster,
    "CB": booster,
    "ET": randomised_forest,
    "GBC": booster,
    "LR": logistic,
    "NB": bayes_learner,
    "MLP": perceptron_learner,
}


def register(code: str, learner: Callable[[str, DataFrame, dict, int], Fitted], name: str | None = None) -> None:
    """Add a classifier of one's own under a new code."""
    LEARNERS[code] = learner
    CODES[code] = name or code


def fit(code: str, df: DataFrame, params: dict | None = None, seed: int = 0) -> Fitted:
    """Train a classifier. A `weight` column is used where the classifier takes one."""
    checked(code)
    if "weight" in df.columns and code not in SAMPLE_WEIGHTED:
        raise ValueError(f"{CODES[code]} takes no sample weights")
    return LEARNERS[code](code, df, dict(params or {}), seed)


# Settings that act after the sums over the samples were taken.
LATE_SETTINGS = {"GMM": ("tau", "min_eigenvalue"), "NB": ("var_smoothing",)}
_OWN = {"GMM": gaussian_learner, "NB": bayes_learner}


def fits_together(code: str) -> bool:
    """Whether classifiers of this code that differ in late settings take one fit."""
    return code in _OWN and LEARNERS.get(code) is _OWN[code]


def fit_trials(code: str, df: DataFrame, trials: Sequence[dict], seed: int = 0) -> list[Fitted]:
    """One classifier per trial, as `fit` gives them; trials that differ in late settings only share the passes over the samples."""
    checked(code)
    if not fits_together(code):
        return [fit(code, df, t, seed) for t in trials]
    if code == "NB":
        for t in trials:
            unsupported(code, t, ["var_smoothing"])
        return [BayesFitted(m) for m in bayes.fit_smoothed(df, [float(t.get("var_smoothing", 1e-9)) for t in trials])]
    out, shared = [], []
    for t in trials:
        early = {k: v for k, v in t.items() if k not in LATE_SETTINGS[code]}
        late = {k: float(v) for k, v in t.items() if k in LATE_SETTINGS[code]}
        model = next((m for e, m in shared if e == early), None)
        if model is None:
            model = fit(code, df, early, seed).model
            shared.append((early, model))
        out.append(GaussianFitted(replace(model, **late)))
    return out


def predict_each(fitted: Sequence[Fitted], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Columns in `keep`, the place of a classifier in `fitted` as `trial`, and its class.

    Gaussian and Bayes models meet the rows in one pass: as columns one after the other
    where all are small enough, as matrices where none is.
    """
    small = [isinstance(f, (GaussianFitted, BayesFitted)) and (
        gaussian if isinstance(f, GaussianFitted) else bayes).fits_columns(f.model) for f in fitted]
    if all(small):
        out, names = df, [f"_class{i}" for i in range(len(fitted))]
        for i, f in enumerate(fitted):
            out = f.predict(out, [*keep, *names[:i], "bands"]).withColumnRenamed("class", names[i]).drop("confidence")
        return out.select(*keep, F.posexplode(F.array(*names)).alias("trial", "class"))
    if not any(small) and all(isinstance(f, GaussianFitted) for f in fitted):
        solved = [(np.array(f.classes), f.model.mean, *f.model.inverses()) for f in fitted]
        pick = lambda x: [c[gaussian.discriminants(x, m, inv, const).argmin(axis=1)] for c, m, inv, const in solved]
    elif not any(small) and all(isinstance(f, BayesFitted) for f in fitted):
        models = [(np.array(f.classes), f.model) for f in fitted]
        pick = lambda x: [c[bayes.deviances(x, m).argmin(axis=1)] for c, m in models]
    else:
        every = [f.predict(df, keep).select(*keep, F.lit(i).alias("trial"), "class") for i, f in enumerate(fitted)]
        return reduce(DataFrame.unionByName, every)
    classes = map_matrix(df, fitted[0].d, keep, [arrow_field("_classes", "array<int>")], lambda x, _: [np.stack(pick(x), axis=1)])
    return classes.select(*keep, F.posexplode("_classes").alias("trial", "class"))


def with_class_weights(code: str, df: DataFrame, strategy: str = "balanced", custom: dict | None = None) -> DataFrame:
    """Samples with their class weight, for classifiers that use one."""
    from bandloom.operators.balance import attach_weights, class_weights

    checked(code)
    if code not in SAMPLE_WEIGHTED:
        raise ValueError(f"{CODES[code]} takes no class weights")
    return attach_weights(df, class_weights(df, strategy, custom))


def weight_parameters(code: str, weights: dict[int, float]) -> dict:
    """The weights as the setting a classifier knows; empty where it has none."""
    checked(code)
    if code == "XGB":
        if len(weights) != 2:
            return {}
        first, second = sorted(weights)
        return {"scale_pos_weight": weights[second] / weights[first]}
    return {"class_weight": dict(weights)} if code in {"RF", "SVM", "KNN", "ET", "GBC", "LR", "NB", "MLP"} else {}


def default_grid(code: str, d: int) -> dict[str, list]:
    """The values tried for a classifier unless the caller names others."""
    checked(code)
    if code in fv.FOREST_TREES:
        step = max(1, d // fv.FOREST_STEP_PARTS[code])
        return {"n_estimators": list(fv.FOREST_TREES[code]), "max_features": list(range(1, max(2, d), step))}
    return dict(fv.DEFAULT_GRIDS[code])


def fast_grid(code: str, grid: dict[str, list]) -> dict[str, list]:
    """First and last value of longer lists; forests keep the fewest trees."""
    if code == "MLP":
        return dict(fv.MLP_FAST_GRID)
    small = {k: (list(v) if len(v) <= 2 else [v[0], v[-1]]) for k, v in grid.items()}
    if code in fv.FOREST_TREES and "n_estimators" in small:
        small["n_estimators"] = [min(small["n_estimators"])]
    return small
