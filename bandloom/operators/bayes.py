"""Gaussian naive Bayes: one variance per class and band."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.matrix import BAYES_TERMS, field, map_matrix
from bandloom.functions.sizing import bounded_rows
from bandloom.operators.gaussian import band_means, posterior
from bandloom.operators.prepare import band_count


@dataclass(frozen=True)
class NaiveBayesModel:
    classes: tuple[int, ...]
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @property
    def d(self) -> int:
        return self.mean.shape[1]


def _plain_rows(df: DataFrame, d: int) -> DataFrame:
    b = F.col("bands")
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(b[i]) for i in range(d)]).alias("mean"),
        F.array(*[F.var_pop(b[i]) for i in range(d)]).alias("var"),
    )


def _weighted_rows(df: DataFrame, d: int) -> DataFrame:
    shift, w = band_means(df, d), F.col("weight")
    x = [F.col("bands")[i] - float(shift[i]) for i in range(d)]
    mean = [F.sum(w * v) / F.sum(w) for v in x]
    return df.filter(w > 0).groupBy("label").agg(
        F.sum(w).alias("n"),
        F.array(*[m + float(c) for m, c in zip(mean, shift)]).alias("mean"),
        F.array(*[F.greatest(F.sum(w * v * v) / F.sum(w) - m * m, F.lit(0.0)) for v, m in zip(x, mean)]).alias("var"),
    )


def fit_naive_bayes(df: DataFrame, d: int | None = None, var_smoothing: float = 1e-9) -> NaiveBayesModel:
    """Means and variances in one pass; every variance grows by a share of the
    largest variance any band has over all samples. Samples with a `weight` count that
    much (those of weight 0 not at all), on bands from which their mean is taken first."""
    return fit_smoothed(df, [var_smoothing], d)[0]


def fit_smoothed(df: DataFrame, shares: Sequence[float], d: int | None = None) -> list[NaiveBayesModel]:
    """A model for each share by which variances grow, all from the same pass."""
    d = d or band_count(df)
    labelled = df.filter(F.col("label").isNotNull())
    rows = _weighted_rows(labelled, d) if "weight" in df.columns else _plain_rows(labelled, d)
    rows = sorted(bounded_rows(rows), key=lambda r: r["label"])
    n = np.array([r["n"] for r in rows], dtype=float)
    mean, var = np.array([r["mean"] for r in rows]), np.array([r["var"] for r in rows])
    prior = n / n.sum()
    center = prior @ mean
    overall = prior @ (var + (mean - center) ** 2)
    return [NaiveBayesModel(tuple(int(r["label"]) for r in rows), prior, mean, var + share * overall.max()) for share in shares]


def deviance_columns(model: NaiveBayesModel) -> list[Column]:
    """-2 log joint likelihood per class, without the shared constant."""
    out = []
    for c in range(len(model.classes)):
        total = F.lit(float(np.log(model.var[c]).sum() - 2 * np.log(model.prior[c])))
        for i in range(model.d):
            gap = F.col("bands")[i] - float(model.mean[c, i])
            total = total + gap * gap / float(model.var[c, i])
        out.append(total)
    return out


def fits_columns(model: NaiveBayesModel) -> bool:
    return len(model.classes) * model.d <= BAYES_TERMS


def deviances(x: np.ndarray, model: NaiveBayesModel) -> np.ndarray:
    const = np.log(model.var).sum(axis=1) - 2 * np.log(model.prior)
    return np.stack([((x - m) ** 2 / v).sum(axis=1) + c for m, v, c in zip(model.mean, model.var, const)], axis=1)


def predict(df: DataFrame, model: NaiveBayesModel, keep: Sequence[str] | None = None, probability: bool = False) -> DataFrame:
    """Class and confidence, the smallest code winning ties."""
    keep = [c for c in df.columns if c != "bands"] if keep is None else list(keep)
    if fits_columns(model) and not probability:
        scored = df.select(*keep, F.array(*deviance_columns(model)).alias("_k")).withColumn("_best", F.array_min("_k"))
        total = None
        for i in range(len(model.classes)):
            power = F.exp((F.col("_best") - F.col("_k")[i]) / 2)
            total = power if total is None else total + power
        code = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("_k", F.col("_best")).cast("int"))
        return scored.select(*keep, code.alias("class"), (1.0 / total).alias("confidence"))
    codes = np.array(model.classes)

    def compute(x, _):
        k = deviances(x, model)
        p = posterior(k)
        best = k.argmin(axis=1)
        return [codes[best], p[np.arange(len(p)), best], *([p] if probability else [])]

    fields = [field("class", "int"), field("confidence", "double")]
    if probability:
        fields.append(field("probability", "array<double>"))
    return map_matrix(df, model.d, keep, fields, compute)
