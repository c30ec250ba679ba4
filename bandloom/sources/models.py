"""Saving and loading of trained classifiers with their bounds."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    LinearSVCModel,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    OneVsRestModel,
    RandomForestClassificationModel,
)
from pyspark.sql import SparkSession

from bandloom.operators import bayes, gaussian, learners, perceptron, trees
from bandloom.operators.prepare import Scaler

PARTS = ("code", "classes", "d", "kind")
SPARK_KINDS = {
    c.__name__: c
    for c in (
        RandomForestClassificationModel, LogisticRegressionModel, LinearSVCModel,
        MultilayerPerceptronClassificationModel, OneVsRestModel,
    )
}


class InvalidModel(ValueError):
    """A folder that is not a saved classifier."""


@dataclass
class SavedModel:
    fitted: learners.Fitted
    scaler: Scaler | None


def save_model(spark: SparkSession, fitted: learners.Fitted, scaler: Scaler | None, path: str) -> None:
    """Metadata, bounds and parameters below `path`."""
    meta = {"code": fitted.code, "classes": list(fitted.classes), "d": fitted.d, "kind": type(fitted).__name__, "extra": {}}
    if isinstance(fitted, learners.GaussianFitted):
        m = fitted.model
        meta["extra"] = {"tau": m.tau, "min_eigenvalue": m.min_eigenvalue}
        rows = [
            (c, int(n), float(p), mu.tolist(), cov.ravel().tolist(), lam.tolist(), vec.ravel().tolist())
            for c, n, p, mu, cov, lam, vec in zip(m.classes, m.n, m.prior, m.mean, m.cov, m.eigval, m.eigvec)
        ]
        spark.createDataFrame(
            rows, "label int, n bigint, prior double, mean array<double>, cov array<double>, eigval array<double>, eigvec array<double>"
        ).write.mode("overwrite").parquet(f"{path}/parameters")
    elif isinstance(fitted, learners.BayesFitted):
        m = fitted.model
        rows = [(c, float(p), mu.tolist(), v.tolist()) for c, p, mu, v in zip(m.classes, m.prior, m.mean, m.var)]
        spark.createDataFrame(rows, "label int, prior double, mean array<double>, var array<double>").write.mode(
            "overwrite").parquet(f"{path}/parameters")
    elif isinstance(fitted, learners.NeighborFitted):
        meta["extra"] = {"k": fitted.k, "weights": fitted.weights}
        fitted.refs.write.mode("overwrite").parquet(f"{path}/parameters")
    elif isinstance(fitted, learners.TreesFitted):
        meta["extra"] = {"boosted": fitted.boosted, "rate": fitted.rate, "losses": fitted.losses}
        spark.createDataFrame(trees.tree_rows(fitted.trees), trees.TREE_TABLE).write.mode("overwrite").parquet(f"{path}/parameters")
    elif isinstance(fitted, learners.PerceptronFitted):
        net = fitted.network
        meta["extra"] = {"activation": net.activation, "losses": fitted.losses}
        rows = [(i, w.shape[0], w.ravel().tolist(), b.tolist()) for i, (w, b) in enumerate(zip(net.weights, net.biases))]
        spark.createDataFrame(rows, "layer int, inputs int, weights array<double>, biases array<double>").write.mode(
            "overwrite").parquet(f"{path}/parameters")
    else:
        meta["extra"] = {"model": type(fitted.model).__name__, "margin": fitted.margin, **fitted.extras,
                         "calibrated": fitted.calibrator is not None}
        fitted.model.write().overwrite().save(f"{path}/parameters")
        if fitted.calibrator is not None:
            fitted.calibrator.write().overwrite().save(f"{path}/calibrator")
    bounds = scaler.rows() if scaler else []
    spark.createDataFrame(bounds, "band int, lo double, hi double").coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> SavedModel:
    """Read a saved classifier; every part is checked before it is used."""
    try:
        text = spark.read.text(f"{path}/metadata").collect()
        meta = json.loads(text[0]["value"])
        bounds = spark.read.parquet(f"{path}/scaler").orderBy("band").collect()
    except Exception as error:
        raise InvalidModel(f"{path} holds no readable model: {error}") from error
    if not isinstance(meta, dict) or any(p not in meta for p in PARTS):
        raise InvalidModel(f"the metadata of {path} lacks a part of {', '.join(PARTS)}")
    if meta["code"] not in learners.CODES:
        raise InvalidModel(f"unknown classifier code {meta['code']!r}")
    if bounds and len(bounds) != meta["d"]:
        raise InvalidModel(f"{len(bounds)} bounds for {meta['d']} bands")
    scaler = Scaler(tuple(b["lo"] for b in bounds), tuple(b["hi"] for b in bounds)) if bounds else None
    return SavedModel(_read_fitted(spark, path, meta), scaler)


def _read_fitted(spark: SparkSession, path: str, meta: dict) -> learners.Fitted:
    d, extra, kind = meta["d"], meta["extra"], meta["kind"]
    where = f"{path}/parameters"
    if kind == "GaussianFitted":
        rows = spark.read.parquet(where).orderBy("label").collect()
        cube = lambda c: np.array([r[c] for r in rows]).reshape(len(rows), d, d)
        return learners.GaussianFitted(gaussian.GaussianModel(
            tuple(r["label"] for r in rows), np.array([r["n"] for r in rows]), np.array([r["prior"] for r in rows]),
            np.array([r["mean"] for r in rows]), cube("cov"), np.array([r["eigval"] for r in rows]), cube("eigvec"),
            extra["tau"], extra["min_eigenvalue"]))
    if kind == "BayesFitted":
        rows = spark.read.parquet(where).orderBy("label").collect()
        return learners.BayesFitted(bayes.NaiveBayesModel(
            tuple(r["label"] for r in rows), np.array([r["prior"] for r in rows]), np.array([r["mean"] for r in rows]),
            np.array([r["var"] for r in rows])))
    if kind == "NeighborFitted":
        return learners.NeighborFitted(spark.read.parquet(where), extra["k"], extra["weights"], meta["classes"], d)
    if kind == "TreesFitted":
        grown = trees.trees_of_rows(spark.read.parquet(where).collect())
        return learners.TreesFitted(meta["code"], grown, meta["classes"], d, extra["boosted"], extra["rate"], extra["losses"])
    if kind == "PerceptronFitted":
        rows = spark.read.parquet(where).orderBy("layer").collect()
        network = perceptron.Network(tuple(np.array(r["weights"]).reshape(r["inputs"], -1) for r in rows),
                                     tuple(np.array(r["biases"]) for r in rows), extra["activation"])
        return learners.PerceptronFitted(network, meta["classes"], extra["losses"], meta["code"])
    if kind != "SparkFitted" or extra.get("model") not in SPARK_KINDS:
        raise InvalidModel(f"unknown kind of model {kind!r}")
    fitted = learners.SparkFitted(meta["code"], SPARK_KINDS[extra["model"]].load(where), meta["classes"], d, margin=extra["margin"])
    if extra["calibrated"]:
        fitted.calibrator = LogisticRegressionModel.load(f"{path}/calibrator")
    if "gamma" in extra:
        fitted.extras = {k: v for k, v in extra.items() if k not in ("model", "margin", "calibrated")}
        fitted.project = learners.remade_features(fitted.extras, d)
    return fitted
