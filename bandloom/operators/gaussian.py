"""Gaussian classifier: moments, shrinkage, prediction, tuning, diagnostics.

A fit is one pass that sums up n, x and x*x' per class. Those sums add, so
batches, folds and streams all reuse them, and no class is ever gathered.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions.matrix import GAUSSIAN_TERMS, field, map_matrix, matrix
from bandloom.functions.sizing import bounded_rows
from bandloom.operators.balance import whole
from bandloom.operators.prepare import band_count

# Bands up to which moments are written as column aggregates.
WIDE_BANDS = 10
# Scores of mixed rows that are held at a time; they stay in a core's cache.
MIXED_CELLS = 100_000
# Doubles a collected model may hold.
MODEL_DOUBLES = 50_000_000
SHRINKAGES = ("ridge", "ledoit_wolf", "oas", "empirical")
TARGETS = ("diagonal", "identity", "spherical")


def pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def band_means(df: DataFrame, d: int) -> tuple[float, ...]:
    """Mean of every band; subtracting it keeps sums of squares well conditioned."""
    row = df.agg(*[F.avg(F.col("bands")[i]) for i in range(d)]).collect()[0]
    return tuple(0.0 if v is None else float(v) for v in row)


def moment_columns(d: int, shift: Sequence[float] | None = None) -> list[Column]:
    """The aggregates of a moment table for few bands."""
    x = [F.col("bands")[i] - float(shift[i]) if shift else F.col("bands")[i] for i in range(d)]
    return [
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(v) for v in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs(d)]).alias("ss"),
    ]


def moments(df: DataFrame, d: int | None = None, by: Sequence[str] = ("label",), shift: Sequence[float] | None = None) -> DataFrame:
    """Per group: n, the sums of x and the upper triangle of the sums of x*x'.

    Few bands are summed by column aggregates. Many bands are summed per
    partition as matrices; partitions are then added position by position.
    """
    d = d or band_count(df)
    by = list(by)
    if d <= WIDE_BANDS:
        return df.groupBy(*by).agg(*moment_columns(d, shift))
    upper = np.triu_indices(d)
    offset = np.array(shift if shift else [0.0] * d)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def partial(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            x = matrix(batch, d) - offset
            keys = batch.select(by).to_pandas()
            for key, rows in keys.groupby(by, dropna=False, sort=False).indices.items():
                part = x[rows]
                entry = sums.setdefault(key if isinstance(key, tuple) else (key,), [0, np.zeros(d), np.zeros((d, d))])
                entry[0] += len(part)
                entry[1] += part.sum(axis=0)
                entry[2] += part.T @ part
        import pyarrow as pa

        out = [(*k, n, s.tolist(), ss[upper].tolist()) for k, (n, s, ss) in sums.items()]
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[*by, "n", "s", "ss"]), preserve_index=False)

    parts = df.select(*by, "bands").mapInArrow(partial, f"{schema}, n bigint, s array<double>, ss array<double>")
    return merge_moments(parts, by=by)


def weighted_moments(df: DataFrame, d: int | None = None, by: Sequence[str] = ("label",), shift: Sequence[float] | None = None) -> DataFrame:
    """Moments of samples with a `weight`: n rows, w and w2 (sums of the weights and their squares),
    and s and ss as weighted sums. Rows of weight 0 or without one do not count; a negative or
    infinite weight is refused when the table is used."""
    d = d or band_count(df)
    by = list(by)
    bad = F.col("weight").isNotNull() & ~F.col("weight").between(0.0, 1.7e308)
    checked = F.when(bad, F.raise_error(F.lit("weights must be finite and not negative"))).otherwise(F.col("weight").cast("double"))
    rows = df.withColumn("weight", checked).filter("weight > 0")
    w, x = F.col("weight"), [F.col("bands")[i] - float(shift[i] if shift else 0.0) for i in range(d)]
    if d <= WIDE_BANDS:
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"),
            F.array(*[F.sum(w * v) for v in x]).alias("s"), F.array(*[F.sum(w * x[i] * x[j]) for i, j in pairs(d)]).alias("ss"))
    # Bands of many are summed as matrices of rows that carry the root of their weight: x and the root itself.
    root = F.sqrt(w)
    lifted = rows.select(*by, w.alias("weight"), F.concat(F.transform(F.array(*x), lambda v: v * root), F.array(root, w)).alias("bands"))
    wide = moments(lifted, d + 2, by)
    at = {pair: i for i, pair in enumerate(pairs(d + 2))}
    take = lambda wanted: F.array(*[F.col("ss")[at[p]] for p in wanted])
    return wide.select(
        *by, "n", F.col("ss")[at[d, d]].alias("w"), F.col("ss")[at[d + 1, d + 1]].alias("w2"),
        take([(i, d) for i in range(d)]).alias("s"), take(pairs(d)).alias("ss"))


def merge_weighted_moments(*tables: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Weighted moment tables (same shift) added up."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    lead = F.array("w", "w2")
    merged = merge_moments(every.select(*by, "n", F.concat(lead, "s").alias("s"), "ss"), by=by)
    return merged.select(*by, "n", F.col("s")[0].alias("w"), F.col("s")[1].alias("w2"), F.slice("s", F.lit(3), F.size("s") - 2).alias("s"), "ss")


def merge_moments(*tables: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Moment tables (same shift) added up: the exact incremental update."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    by = list(by)
    head = F.size("s")
    cells = every.select(
        *by, head.alias("_d"), F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "ss")).alias("_p", "_v")
    )
    summed = cells.groupBy(*by, "_d", "_p").agg(F.sum("_v").alias("_v"))
    packed = summed.groupBy(*by, "_d").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda e: e["_v"]).alias("_a"))
    return packed.select(
        *by,
        F.get("_a", F.lit(0)).cast("bigint").alias("n"),
        F.slice("_a", F.lit(2), F.col("_d")).alias("s"),
        F.slice("_a", F.col("_d") + 2, F.size("_a") - F.col("_d") - 1).alias("ss"),
    )


def unpack(n: float, s: np.ndarray, ss: np.ndarray, shift=None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations (M2) from one moment row."""
    d = len(s)
    full = np.zeros((d, d))
    full[np.triu_indices(d)] = ss
    full = full + np.triu(full, 1).T
    mean = np.asarray(s) / n
    m2 = full - n * np.outer(mean, mean)
    return mean + (0.0 if shift is None else np.asarray(shift)), m2


def shrink(cov: np.ndarray, n: float, kind: str, target: str) -> np.ndarray:
    """Covariance pulled towards a simple target; ridge acts later, at prediction."""
    if kind not in SHRINKAGES:
        raise ValueError(f"unknown regularisation {kind!r}, use one of {', '.join(SHRINKAGES)}")
    if target not in TARGETS:
        raise ValueError(f"unknown shrinkage target {target!r}")
    if kind in ("ridge", "empirical"):
        return cov
    d = len(cov)
    mean_var = np.trace(cov) / d
    if kind == "ledoit_wolf":
        delta = float(((cov - mean_var * np.eye(d)) ** 2).sum())
        share = delta / (n - 1) / (delta + fv.TINY) if n > 1 else 1.0
    else:
        square, trace = float((cov * cov.T).sum()), float(np.trace(cov))
        below = (n + 1 - 2 / d) * (square - trace**2 / d)
        share = ((1 - 2 / d) * square + trace**2) / below if below > 0 else 1.0
    share = min(max(share, 0.0), 1.0)
    goal = np.diag(np.diag(cov)) if target == "diagonal" else np.eye(d) * mean_var
    return (1 - share) * cov + share * goal


@dataclass(frozen=True)
class GaussianModel:
    """Parameters per class, in label order."""

    classes: tuple[int, ...]
    n: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    eigval: np.ndarray
    eigvec: np.ndarray
    tau: float = 0.0
    min_eigenvalue: float = fv.MIN_EIGENVALUE

    @property
    def d(self) -> int:
        return self.mean.shape[1]

    def with_tau(self, tau: float) -> GaussianModel:
        return replace(self, tau=float(tau))

    def inverses(self, tau: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Inverse covariance and constant (logdet - 2 ln prior) of every class."""
        ridge = max(self.tau if tau is None else float(tau), 0.0)
        lam = np.maximum(self.eigval + ridge, self.min_eigenvalue)
        inv = np.einsum("cik,ck,cjk->cij", self.eigvec, 1.0 / lam, self.eigvec)
        return inv, np.log(lam).sum(axis=1) - 2.0 * np.log(self.prior)


def class_parameters(
    table: DataFrame, reg_type: str = "ridge", target: str = "diagonal", shift: Sequence[float] | None = None,
    label: str = "label",
) -> DataFrame:
    """The model table: moments turned into mean, covariance and eigenpairs.

    Works class by class on the moment rows, spread over the tasks. A table of weighted
    moments gives weighted parameters; its shrinkage counts (sum w)^2 / sum w^2 samples.
    """
    kind = table.schema[label].dataType.simpleString()

    def solve(frames):
        for pdf in frames:
            out = []
            for code, n, mass, many, total, s, ss in zip(*(pdf[c] for c in (label, "n", "mass", "many", "total", "s", "ss"))):
                mean, m2 = unpack(mass, np.asarray(s), np.asarray(ss), shift)
                cov = shrink(m2 / mass, many, reg_type, target)
                if np.isfinite(cov).all():
                    lam, vec = np.linalg.eigh(cov)
                else:
                    lam, vec = np.full(len(mean), np.nan), np.full((len(mean),) * 2, np.nan)
                out.append((code, n, mass / total, mean, m2.ravel(), cov.ravel(), lam[::-1].copy(), vec[:, ::-1].ravel()))
            yield pd.DataFrame(out, columns=[label, "n", "prior", "mean", "m2", "cov", "eigval", "eigvec"])

    arrays = ", ".join(f"{c} array<double>" for c in ("mean", "m2", "cov", "eigval", "eigvec"))
    weighted = "w" in table.columns
    mass = F.col("w" if weighted else "n").cast("double")
    many = mass * mass / F.col("w2") if weighted else mass
    with_total = table.select(label, "n", mass.alias("mass"), many.alias("many"), F.sum(mass).over(whole()).alias("total"), "s", "ss")
    return with_total.repartition(label).mapInPandas(solve, f"{label} {kind}, n bigint, prior double, {arrays}")


def collect_model(parameters: DataFrame, d: int, tau: float = 0.0, min_eigenvalue: float = fv.MIN_EIGENVALUE) -> GaussianModel:
    """A model table as driver-side parameters; its size is checked first."""
    rows = sorted(bounded_rows(parameters, max(1, MODEL_DOUBLES // (4 * d * d))), key=lambda r: r["label"])
    if not rows:
        raise ValueError("no labelled samples to fit")
    mean = np.array([r["mean"] for r in rows], dtype=float)
    if not np.isfinite(mean).all():
        raise ValueError("training samples hold NaN or infinite values")
    for r in rows:
        if r["n"] < d + 1:
            warnings.warn(f"class {r['label']} has {r['n']} samples for {d} bands", stacklevel=2)
    cube = lambda c: np.array([r[c] for r in rows]).reshape(len(rows), d, d)
    return GaussianModel(
        tuple(int(r["label"]) for r in rows),
        np.array([r["n"] for r in rows]),
        np.array([r["prior"] for r in rows]),
        mean,
        cube("cov"),
        np.array([r["eigval"] for r in rows]),
        cube("eigvec"),
        float(tau),
        float(min_eigenvalue),
    )


def fit_gaussian(
    df: DataFrame,
    d: int | None = None,
    reg_type: str = "ridge",
    target: str = "diagonal",
    tau: float = 0.0,
    min_eigenvalue: float = fv.MIN_EIGENVALUE,
    center: bool = True,
) -> GaussianModel:
    """Fit from samples. `center` first takes the band means, without which the squares of
    bands far from zero cancel; bands known to be scaled can do without that pass.
    Samples with a `weight` give weighted parameters."""
    if reg_type not in SHRINKAGES or target not in TARGETS:
        shrink(np.eye(1), 2, reg_type, target)
    d = d or band_count(df)
    shift = band_means(df, d) if center else None
    labelled = df.filter(F.col("label").isNotNull())
    table = (weighted_moments if "weight" in df.columns else moments)(labelled, d, shift=shift)
    return collect_model(class_parameters(table, reg_type, target, shift), d, tau, min_eigenvalue)


def fit_from_moments(table: DataFrame, d: int, tau: float = 0.0, shift: Sequence[float] | None = None) -> GaussianModel:
    """The model of an incremental fit: no shrinkage, a fixed variance for single samples."""
    model = collect_model(class_parameters(table, "empirical", shift=shift), d, tau)
    single = model.n == 1
    if not single.any():
        return model
    cov, lam, vec = model.cov.copy(), model.eigval.copy(), model.eigvec.copy()
    cov[single] = np.eye(d) * fv.SINGLE_SAMPLE_VARIANCE
    lam[single] = fv.SINGLE_SAMPLE_VARIANCE
    vec[single] = np.eye(d)
    return replace(model, cov=cov, eigval=lam, eigvec=vec)


def discriminant_columns(model: GaussianModel, tau: float | None = None, bands: str = "bands") -> list[Column]:
    """Mahalanobis distance plus constant of every class, as column expressions."""
    inv, const = model.inverses(tau)
    out = []
    for c in range(len(model.classes)):
        delta = [F.col(bands)[i] - float(model.mean[c, i]) for i in range(model.d)]
        total = F.lit(float(const[c]))
        for i, j in pairs(model.d):
            weight = float(inv[c, i, j]) * (1.0 if i == j else 2.0)
            total = total + delta[i] * delta[j] * weight
        out.append(total)
    return out


def discriminants(x: np.ndarray, mean: np.ndarray, inv: np.ndarray, const: np.ndarray) -> np.ndarray:
    k = np.empty((len(x), len(mean)))
    for c in range(len(mean)):
        delta = x - mean[c]
        k[:, c] = ((delta @ inv[c]) * delta).sum(axis=1) + const[c]
    return k


def posterior(k: np.ndarray) -> np.ndarray:
    """Softmax of -k/2 per row."""
    logits = np.clip(-0.5 * k, -fv_limit(), fv_limit())
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fv_limit() -> float:
    return float(np.log(np.finfo(np.float64).max))


def fits_columns(model: GaussianModel) -> bool:
    return len(model.classes) * model.d * (model.d + 1) // 2 <= GAUSSIAN_TERMS


def scorer(model: GaussianModel) -> Callable[[np.ndarray], np.ndarray]:
    """Class probabilities of a matrix, as `predict` gives them."""
    inv, const = model.inverses()
    if not fits_columns(model):
        return lambda x: posterior(discriminants(x, model.mean, inv, const))
    limit = fv_limit()
    # What is not a number counts as the largest, as Spark's functions take it.
    clip = lambda k: np.maximum(np.fmin(k * -0.5, limit), -limit)

    def score(x):
        with np.errstate(all="ignore"):
            k = discriminants(x, model.mean, inv, const)
            e = np.exp(clip(k) - clip(np.fmin.reduce(k, axis=1))[:, None])
            return e / e.sum(axis=1, keepdims=True)

    return score


def mixer(model: GaussianModel) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Mean class probabilities, (classes, rows), of every row of x over `others`, from which the bands
    that are not `members` come.

    The discriminant of a mixed row falls into a part of either row and the product of both,
    so a class costs one product of matrices for all pairs of rows.
    """
    inv, const = model.inverses()
    score, limit, outputs = scorer(model), fv_limit(), len(model.classes)

    def sides(x, members, others):
        """Per class two matrices whose product is -k/2."""
        inside, outside = np.flatnonzero(members), np.flatnonzero(~members)
        for mean, m, c in zip(model.mean, inv, const):
            own, rest = x[:, inside] - mean[inside], others[:, outside] - mean[outside]
            size = lambda v, at, m=m: ((v @ m[np.ix_(at, at)]) * v).sum(axis=1)
            left = np.column_stack([rest @ -m[np.ix_(outside, inside)], -0.5 * (size(rest, outside) + c), np.full(len(rest), -0.5)])
            yield left, np.vstack([own.T, np.ones(len(own)), size(own, inside)])

    def mix(x, members, others):
        with np.errstate(all="ignore"):
            left, right = map(np.stack, zip(*sides(x, members, others)))
            rows = min(len(x), max(1, MIXED_CELLS // (outputs * len(others))))
            held, highest = np.empty(outputs * len(others) * rows), np.empty(len(others) * rows)
            out = np.empty((outputs, len(x)))
            for i in range(0, len(x), rows):
                part = right[:, :, i : i + rows]
                n = part.shape[2]
                e, top = held[: outputs * len(others) * n].reshape(outputs, len(others), n), highest[: len(others) * n].reshape(len(others), n)
                np.matmul(left, part, out=e)
                e.max(axis=0, out=top)
                # Where a limit acts or bands are missing, row by row as in `predict`.
                if not (top.min() > -limit and top.max() < limit):
                    out[:, i : i + n] = mean_scores(score, x[i : i + n], members, others)
                    continue
                e -= top
                np.exp(e, out=e)
                e /= e.sum(axis=0, out=top)
                e.mean(axis=1, out=out[:, i : i + n])
            return out

    return mix


def mean_scores(score: Callable[[np.ndarray], np.ndarray], x: np.ndarray, members: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What `mixer` gives, of any scorer."""
    total = 0.0
    for other in others:
        total = total + score(np.where(members, x, other)).T
    return total / len(others)


def predict(
    df: DataFrame, model: GaussianModel, keep: Sequence[str] | None = None, tau: float | None = None,
    probability: bool = False,
) -> DataFrame:
    """Class and confidence of every row; class probabilities on request.

    Small models become column expressions inside code generation; larger ones
    run as matrix products on Arrow batches. Either way nothing is shuffled.
    """
    keep = [c for c in df.columns if c != "bands"] if keep is None else list(keep)
    if fits_columns(model):
        wrong = F.raise_error(F.concat(F.lit(f"{model.d} bands expected, found "), F.size("bands").cast("string")))
        checked = df.withColumn("bands", F.when(F.col("bands").isNull() | (F.size("bands") == model.d), F.col("bands")).otherwise(wrong))
        scored = checked.select(*keep, F.array(*discriminant_columns(model, tau)).alias("_k"))
        scored = scored.withColumn("_best", F.array_min("_k"))
        size = len(model.classes)
        limit = fv_limit()
        clip = lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v * -0.5))
        powers = [F.exp(clip(F.col("_k")[i]) - clip(F.col("_best"))) for i in range(size)]
        total = powers[0]
        for p in powers[1:]:
            total = total + p
        label = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("_k", F.col("_best")).cast("int"))
        scored = scored.withColumn("_total", total)
        out = [label.alias("class"), (1.0 / F.col("_total")).alias("confidence")]
        if probability:
            out.append(F.array(*[p / F.col("_total") for p in powers]).alias("probability"))
        return scored.select(*keep, *out)
    inv, const = model.inverses(tau)
    mean, codes = model.mean, np.array(model.classes)

    def compute(x, _):
        k = discriminants(x, mean, inv, const)
        p = posterior(k)
        best = k.argmin(axis=1)
        return [codes[best], p[np.arange(len(p)), best], *([p] if probability else [])]

    fields = [field("class", "int"), field("confidence", "double")]
    if probability:
        fields.append(field("probability", "array<double>"))
    return map_matrix(df, model.d, keep, fields, compute)


def own_discriminant(df: DataFrame, model: GaussianModel, tau: float | None = None) -> DataFrame:
    """The discriminant of every sample for its own class; unknown classes drop out."""
    known = df.filter(F.col("label").isin(*model.classes))
    if fits_columns(model):
        k = None
        for code, column in zip(model.classes, discriminant_columns(model, tau)):
            k = F.when(F.col("label") == code, column) if k is None else k.when(F.col("label") == code, column)
        return known.select("label", k.alias("k"))
    inv, const = model.inverses(tau)
    mean, codes = model.mean, np.array(model.classes)

    def compute(x, batch):
        at = np.searchsorted(codes, batch.column("label").to_numpy(zero_copy_only=False))
        delta = x - mean[at]
        return [np.einsum("ni,nij,nj->n", delta, inv[at], delta) + const[at]]

    return map_matrix(known, model.d, ["label"], [field("k", "double")], compute)


def bic(df: DataFrame, model: GaussianModel, tau: float | None = None) -> DataFrame:
    """One row: Bayesian information criterion, lower is better."""
    c, d = len(model.classes), model.d
    free = c * (d * (d + 3) / 2) + (c - 1)
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(1).alias("_one"))
    fit = own_discriminant(df, model, tau).agg(F.sum("k").alias("fit"), F.lit(1).alias("_one"))
    return fit.join(size, "_one").select((F.col("fit") + F.lit(float(free)) * F.log(F.col("rows").cast("double"))).alias("bic"))


def feature_importance(model: GaussianModel, method: str = "variance") -> list[tuple[int, float]]:
    """(band, share) with shares summing to 1."""
    w = model.prior[:, None]
    within = (w * np.einsum("cii->ci", model.cov)).sum(axis=0)
    if method == "variance":
        share = within / (within.sum() + fv.TINY)
    elif method == "discriminative":
        center = (w * model.mean).sum(axis=0) / model.prior.sum()
        ratio = (w * (model.mean - center) ** 2).sum(axis=0) / (within + fv.TINY)
        share = ratio / (ratio.sum() + fv.TINY)
    else:
        raise ValueError(f"unknown importance method {method!r}")
    return [(i + 1, float(v)) for i, v in enumerate(share)]


def covariance_diagnostics(model: GaussianModel) -> list[dict]:
    """Condition, extreme eigenvalues, rank and variance shares per class."""
    out = []
    for code, lam in zip(model.classes, model.eigval):
        out.append({
            "label": code,
            "condition_number": float(lam[0] / max(lam[-1], fv.CONDITION_FLOOR)),
            "min_eigenvalue": float(lam[-1]),
            "max_eigenvalue": float(lam[0]),
            "effective_rank": int((lam > model.min_eigenvalue).sum()),
            "explained": [float(v) for v in lam / (lam.sum() + fv.TINY)],
        })
    return out


def tune_tau(df: DataFrame, grid: Sequence[float], folds: int = 3, seed: int = 0, d: int | None = None,
             reg_type: str = "ridge", target: str = "diagonal", id_col: str = "sample_id") -> DataFrame:
    """(tau, accuracy): mean fold accuracy in percent for every ridge value.

    Moments are summed once per fold and class; the training moments of a fold
    are the total without it. Scoring goes over the samples once for all values
    and returns counts only.
    """
    from bandloom.operators.folds import stratified_kfold

    d = d or band_count(df)
    folded = stratified_kfold(df, folds, seed, id_col).select("fold", "label", "bands").persist(StorageLevel.MEMORY_AND_DISK)
    rows = bounded_rows(moments(folded, d, by=["fold", "label"]), max(1, MODEL_DOUBLES // (d * d)))
    parts = {f: fold_models([r for r in rows if r["fold"] != f], d, reg_type, target) for f in sorted({r["fold"] for r in rows})}
    taus = [float(t) for t in grid]
    solved = {f: (m.mean, [m.inverses(t) for t in taus], np.array(m.classes)) for f, m in parts.items()}

    def count(batches):
        hits: dict[tuple, list] = {}
        for batch in batches:
            x = matrix(batch, d)
            truth = batch.column("label").to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                at = fold == f
                mean, options, codes = solved[int(f)]
                for i, (inv, const) in enumerate(options):
                    best = codes[discriminants(x[at], mean, inv, const).argmin(axis=1)]
                    entry = hits.setdefault((int(f), i), [0, 0])
                    entry[0] += int((best == truth[at]).sum())
                    entry[1] += int(at.sum())
        import pyarrow as pa

        if hits:
            yield pa.RecordBatch.from_pydict({
                "fold": [k[0] for k in hits], "place": [k[1] for k in hits],
                "hits": [v[0] for v in hits.values()], "n": [v[1] for v in hits.values()],
            })

    counted = folded.mapInArrow(count, "fold bigint, place bigint, hits bigint, n bigint")
    per_fold = counted.groupBy("place", "fold").agg((100.0 * F.sum("hits") / F.sum("n")).alias("score"))
    scores = {r[0]: r[1] for r in per_fold.groupBy("place").agg(F.avg("score")).collect()}
    folded.unpersist()
    return df.sparkSession.createDataFrame(
        [(i, t, scores.get(i)) for i, t in enumerate(taus)], "place bigint, tau double, accuracy double")


def fold_models(rows, d: int, reg_type: str, target: str) -> GaussianModel:
    """A model from collected moment rows of several folds."""
    sums: dict[int, list] = {}
    for r in rows:
        entry = sums.setdefault(int(r["label"]), [0, np.zeros(d), np.zeros(d * (d + 1) // 2)])
        entry[0] += r["n"]
        entry[1] += np.asarray(r["s"])
        entry[2] += np.asarray(r["ss"])
    codes = sorted(sums)
    total = sum(sums[c][0] for c in codes)
    n = np.array([sums[c][0] for c in codes])
    mean, cov = [], []
    for c in codes:
        m, m2 = unpack(*sums[c])
        mean.append(m)
        cov.append(shrink(m2 / sums[c][0], int(sums[c][0]), reg_type, target))
    lam, vec = np.linalg.eigh(np.array(cov))
    return GaussianModel(tuple(codes), n, n / total, np.array(mean), np.array(cov), lam[:, ::-1], vec[:, :, ::-1])


def best_tau(scores: DataFrame) -> float:
    """The value with the best accuracy; the first of the grid wins ties."""
    return scores.orderBy(F.desc("accuracy"), "place").first()["tau"]
