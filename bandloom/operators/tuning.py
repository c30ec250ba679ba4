"""Parameter search, nested validation and learning curves."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions import ordering as od
from bandloom.operators import learners, metrics, neighbors
from bandloom.operators.folds import Sides, stratified_kfold
from bandloom.operators.labels import sorted_classes
from bandloom.session import cut_lineage

Resample = Callable[[DataFrame], DataFrame]

SCORES = ("accuracy", "f1_weighted", "f1_macro")


def score(predicted: DataFrame, scoring: str = "accuracy") -> float:
    """One number from (label, class) rows."""
    if scoring not in SCORES:
        raise ValueError(f"unknown score {scoring!r}")
    cells = metrics.cell_counts(predicted.withColumnRenamed("class", "prediction"))
    if scoring == "accuracy":
        value = metrics.overall_scores(cells).select("overall_accuracy")
    else:
        name = "weighted avg" if scoring == "f1_weighted" else "macro avg"
        value = metrics.average_scores(cells).filter(F.col("average") == name).select("f1")
    row = value.first()
    return float(row[0]) if row and row[0] is not None else 0.0


def trial_scores(fitted: Sequence[learners.Fitted], valid: DataFrame, scoring: str = "accuracy") -> list[float]:
    """`score` of several classifiers on one validation side, in one job."""
    if scoring not in SCORES:
        raise ValueError(f"unknown score {scoring!r}")
    predicted = learners.predict_each(fitted, valid, ["label"]).withColumnRenamed("class", "prediction")
    cells = metrics.cell_counts(predicted, ["trial"])
    if scoring == "accuracy":
        value = metrics.overall_scores(cells, ["trial"]).select("trial", "overall_accuracy")
    else:
        name = "weighted avg" if scoring == "f1_weighted" else "macro avg"
        value = metrics.average_scores(cells, ["trial"]).filter(F.col("average") == name).select("trial", "f1")
    found = {r[0]: float(r[1]) for r in value.collect() if r[1] is not None}
    return [found.get(i, 0.0) for i in range(len(fitted))]


def combinations(grid: dict[str, Iterable]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in product(*[list(grid[n]) for n in names])]


@dataclass
class Search:
    """Outcome of a search: rows (place, params, mean, std) and the best of them."""

    code: str
    history: list[dict] = field(default_factory=list)

    @property
    def best(self) -> dict:
        """The largest mean score; the first tried wins ties."""
        return max(self.history, key=lambda h: (h["mean"], -h["place"]))

    @property
    def best_params(self) -> dict:
        return self.best["params"]

    def table(self, spark) -> DataFrame:
        rows = [(h["place"], str(h["params"]), float(h["mean"]), float(h["std"])) for h in self.history]
        return spark.createDataFrame(rows, "place int, params string, mean_score double, std_score double")

    def summary(self) -> dict:
        done = [h for h in self.history if h.get("state", "complete") == "complete"]
        return {"n_trials": len(self.history), "best_value": self.best["mean"], "complete": len(done),
                "failed": len(self.history) - len(done)}


def number_sides(folded: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(training, validation) of every fold number."""
    numbers = [r[0] for r in folded.select("fold").distinct().orderBy("fold").collect()]
    return [(folded.filter(F.col("fold") != f).drop("fold"), folded.filter(F.col("fold") == f)) for f in numbers]


def fold_scores(code: str, pairs: Sequence[tuple[DataFrame, DataFrame]], params: dict, scoring: str, seed: int) -> list[float]:
    """Score of every validation side with its training side."""
    return [score(learners.fit(code, train, params, seed).predict(valid, ["label"]), scoring) for train, valid in pairs]


def neighbor_scores(pairs: Sequence[tuple[DataFrame, DataFrame]], trials: list[dict], scoring: str) -> list[list[float]]:
    """All neighbour counts from one lookup of the largest per fold."""
    largest = max(int(t.get("n_neighbors", 5)) for t in trials)
    out: list[list[float]] = [[] for _ in trials]
    for train, valid in pairs:
        found = neighbors.knn_join(valid, train, largest, keep=["label"]).persist()
        for i, t in enumerate(trials):
            near = F.slice("neighbors", F.lit(1), F.lit(int(t.get("n_neighbors", 5))))
            out[i].append(score(found.select("label", neighbors.vote(near, t.get("weights", "uniform")).alias("class")), scoring))
        found.unpersist()
    return out


def run_trials(
    code: str, df: DataFrame, trials: list[dict], folds: int, scoring: str, seed: int, parallelism: int, sides: Sides | None = None,
    resample: Resample | None = None,
) -> Search:
    """Every trial on the same folds: those in `fold`, spatial ones in `sides`, or random ones.

    `resample` changes the training side of a fold alone, once for all trials.

    Samples are kept in memory or on disk once; trials are independent jobs, a few of
    them at a time. Classifiers that are sums are fitted and scored once per fold for all
    trials.
    """
    if sides is not None:
        folded, pairs = sides.marked, [(sides.training(i), sides.validation(i)) for i in sides.iterations]
    else:
        folded = df if "fold" in df.columns else stratified_kfold(df, folds, seed)
    mine = not folded.is_cached
    if mine:
        folded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if sides is None:
            pairs = number_sides(folded)
        if resample is not None:
            pairs = [(cut_lineage(resample(train), "resampled"), valid) for train, valid in pairs]
        if code == "KNN":
            results = neighbor_scores(pairs, trials, scoring)
        elif learners.fits_together(code):
            with ThreadPoolExecutor(parallelism) as pool:
                by_fold = pool.map(lambda p: trial_scores(learners.fit_trials(code, p[0], trials, seed), p[1], scoring), pairs)
                results = [list(scores) for scores in zip(*by_fold)]
        else:
            with ThreadPoolExecutor(parallelism) as pool:
                results = list(pool.map(lambda t: fold_scores(code, pairs, t, scoring, seed), trials))
    finally:
        if mine:
            folded.unpersist()
    history = [
        {"place": i, "params": t, "mean": float(np.mean(s)), "std": float(np.std(s)), "scores": s, "state": "complete"}
        for i, (t, s) in enumerate(zip(trials, results))
    ]
    return Search(code, history)


def grid_search(
    code: str, df: DataFrame, grid: dict | None = None, folds: int = fv.DEFAULT_FOLDS, base: dict | None = None,
    scoring: str = "accuracy", seed: int = 0, fast: bool = False, parallelism: int = 2, sides: Sides | None = None,
    resample: Resample | None = None,
) -> Search:
    """Cross-validated scores of all combinations; `base` holds fixed parameters."""
    learners.checked(code)
    grid = grid or learners.default_grid(code, _d(df))
    if fast:
        grid = learners.fast_grid(code, grid)
    return run_trials(code, df, [{**(base or {}), **c} for c in combinations(grid)], folds, scoring, seed, parallelism, sides, resample)


def _d(df: DataFrame) -> int:
    from bandloom.operators.prepare import band_count

    return band_count(df)


def draw(space: tuple, rng: np.random.RandomState):
    kind = space[0]
    if kind == "choice":
        return space[1][rng.randint(len(space[1]))]
    if kind == "int":
        _, low, high, step = space
        return int(low + step * rng.randint((high - low) // step + 1))
    if kind == "log":
        return float(np.exp(rng.uniform(np.log(space[1]), np.log(space[2]))))
    return float(rng.uniform(space[1], space[2]))


def draw_trials(code: str, n: int, seed: int) -> list[dict]:
    """Random parameters of a classifier; layers and kernel widths depend on
    what was drawn before them."""
    if code not in fv.SEARCH_SPACES:
        raise ValueError(f"{code} has no search space")
    rng = np.random.RandomState(seed)
    trials = []
    for _ in range(n):
        space = fv.SEARCH_SPACES[code]
        trial = {name: draw(s, rng) for name, s in space.items()}
        if code == "MLP":
            layers = [draw(space["layer_size"], rng) for _ in range(trial.pop("n_layers"))]
            trial.pop("layer_size")
            trial["hidden_layer_sizes"] = tuple(layers)
        if code == "SVM":
            trial.pop("gamma" if trial["gamma_type"] == "float" else "gamma_value")
        trials.append(trial)
    return trials


def random_search(
    code: str, df: DataFrame, n_trials: int = fv.DEFAULT_TRIALS, folds: int = fv.DEFAULT_FOLDS, seed: int = 0,
    scoring: str = "f1_weighted", parallelism: int = 2, limits: dict | None = None, sides: Sides | None = None,
    resample: Resample | None = None,
) -> Search:
    """Scores of randomly drawn parameters; `limits` caps values such as tree counts."""
    trials = draw_trials(code, n_trials, seed)
    for t in trials:
        for name, top in (limits or {}).items():
            if name in t and t[name] is not None:
                t[name] = min(t[name], top)
    return run_trials(code, df, trials, folds, scoring, seed, parallelism, sides, resample)


def nested_cv(
    code: str, df: DataFrame, grid: dict | None = None, outer: int = 5, inner: int = 3, seed: int = 0,
    scoring: str = "accuracy",
) -> DataFrame:
    """(fold, score, best_params): search on every outer training side, score on
    the rows it never saw."""
    folded = stratified_kfold(df, outer, seed, out="outer").persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for f in [r[0] for r in folded.select("outer").distinct().orderBy("outer").collect()]:
            train, valid = folded.filter(F.col("outer") != f).drop("outer"), folded.filter(F.col("outer") == f)
            found = grid_search(code, train, grid, inner, scoring=scoring, seed=seed)
            model = learners.fit(code, train, found.best_params, seed)
            rows.append((int(f), score(model.predict(valid, ["label"]), scoring), str(found.best_params)))
    finally:
        folded.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, score double, best_params string")


def learning_curve(
    code: str, df: DataFrame, params: dict | None = None, sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)),
    folds: int = 5, seed: int = 0,
) -> DataFrame:
    """(share, train and validation score, mean and deviation over folds).

    Training takes the first part of a seeded shuffle of every other fold.
    """
    folded = stratified_kfold(df, folds, seed)
    ranked = od.hash_rank(folded, ["fold"], "sample_id", f"{seed}|curve", "_rank").persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        counts = {r[0]: r[1] for r in ranked.groupBy("fold").count().collect()}
        whole = len(sorted_classes(df))
        for share in sizes:
            train_scores, valid_scores = [], []
            for f in sorted(counts):
                limit = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(n * share))])
                part = ranked.filter((F.col("fold") != f) & (F.col("_rank") <= limit[F.col("fold")])).drop("fold", "_rank")
                if len(sorted_classes(part)) < min(2, whole):
                    continue
                model = learners.fit(code, part, params, seed)
                train_scores.append(score(model.predict(part, ["label"])))
                valid_scores.append(score(model.predict(ranked.filter(F.col("fold") == f), ["label"])))
            rows.append((float(share), *[float(g(s)) if s else None for s in (train_scores, valid_scores) for g in (np.mean, np.std)]))
    finally:
        ranked.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "share double, train_mean double, train_std double, valid_mean double, valid_std double")
