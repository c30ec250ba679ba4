"""The whole training job: samples in, model and assessment out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions.sizing import small_or_none
from bandloom.operators import balance, folds, learners, metrics, oversample, prepare, sampling, tuning
from bandloom.operators.learners import Fitted
from bandloom.operators.prepare import Scaler


CELL_ROWS = 1_000_000
STAND_ITERATIONS = 5


@dataclass
class TrainConfig:
    """Settings of a training run.

    split: a percentage of training rows, or `SLOO` / `STAND` to assess on
    spatial folds after training on everything. Unused where `train` is given a
    table of validation samples. A search under `SLOO` or `STAND` scores its trials on the
    same spatial folds, otherwise on random or polygon folds of the training side.
    use_smote: oversample the training side as `smote_strategy` says. A search
    oversamples the training side of each of its folds, so that no fold is scored on
    rows made from, or into, its training rows.
    min_train: for `SLOO`, the number (above 1) or share of a class that is held out
    per iteration instead of one sample.
    search_rows: at most about this many labelled rows take part in the parameter
    search, with folds, grid and trials as asked; all rows by default.
    fast_mode: asks for fewer rows, folds, trials and grid values on large or very
    uneven samples. Nothing is thinned unless it is asked for.
    max_iter: spatial iterations; by default as many as the smallest class has
    samples for `SLOO`, and STAND_ITERATIONS for `STAND`.
    """

    code: str = "GMM"
    split: float | str = 70
    seed: int = 0
    scale: bool = True
    params: dict = field(default_factory=dict)
    grid: dict | None = None
    search: str = "none"  # none, grid, random
    trials: int = fv.DEFAULT_TRIALS
    folds: int = fv.DEFAULT_FOLDS
    fast_mode: bool = False
    search_rows: int | None = None
    polygon_groups: bool = False
    use_smote: bool = False
    smote_strategy: str | Mapping[int, int] = "auto"
    class_weights: str | None = None
    distance: float | None = None
    max_iter: int | None = None
    min_train: float | None = None
    sloo: bool = False
    legacy_order: bool = False  # bounds and oversampling before the split, leaking into the test side


@dataclass
class TrainResult:
    fitted: Fitted
    scaler: Scaler | None
    params: dict
    cells: DataFrame | None
    fold_cells: DataFrame | None = None
    search: tuning.Search | None = None
    config: TrainConfig = field(default_factory=TrainConfig)

    def scores(self) -> DataFrame:
        """Accuracy, kappa and mean F1 of the assessment."""
        if self.cells is None:
            raise ValueError("all samples were used for training; nothing is left to assess")
        return metrics.overall_scores(self.cells)


def oversampled(train: DataFrame, config: TrainConfig) -> DataFrame:
    made, _ = oversample.smote_if_needed(train, seed=config.seed, strategy=config.smote_strategy)
    return made.drop("synthetic")


def weighted(train: DataFrame, config: TrainConfig) -> DataFrame:
    return learners.with_class_weights(config.code, train, config.class_weights) if config.class_weights else train


def prepare_training(train: DataFrame, config: TrainConfig) -> tuple[DataFrame, Scaler | None]:
    """Oversample or weight the training side, then scale it by its own bounds."""
    if config.use_smote:
        train = oversampled(train, config)
    scaler = prepare.fit_scaler(train) if config.scale else None
    if scaler:
        train = scaler.transform(train)
    return weighted(train, config), scaler


def spatial_sides(samples: DataFrame, config: TrainConfig) -> folds.Sides:
    """The iterations of `SLOO` or `STAND` over some samples."""
    if config.split == "SLOO":
        if config.distance is None:
            raise ValueError("spatial folds need a distance")
        # A number of held-out samples takes exactly so many; ties at the last distance are not added.
        return folds.sloo_sides(samples, config.distance, config.max_iter, config.seed, config.min_train)
    iterations = STAND_ITERATIONS if config.max_iter is None else config.max_iter
    return folds.stand_sides(samples, iterations, config.sloo, config.seed)


def choose_params(
    train: DataFrame, config: TrainConfig, sides: folds.Sides | None = None, resample: tuning.Resample | None = None
) -> tuple[dict, tuning.Search | None]:
    """Parameters as given or as found; `sides` are the spatial folds of `train`, `resample` what is done to training sides."""
    if config.search == "none":
        return dict(config.params), None
    policy = sampling.fast_mode_policy(train, config.fast_mode, config.folds, config.trials).first()
    rows, limit = train, min(policy["search_rows"], config.search_rows or policy["samples"])
    if policy["samples"] > limit:
        rows = sampling.stratified_subset(train, limit, config.seed)
        sides = None if sides is None else spatial_sides(rows, config)
    if config.polygon_groups and sides is None:
        folds.require_polygons(rows, policy["folds"])
        rows = folds.stratified_group_kfold(rows, policy["folds"], config.seed)
    if config.search == "random":
        found = tuning.random_search(config.code, rows, policy["trials"], policy["folds"], config.seed, sides=sides, resample=resample)
    else:
        d = prepare.band_count(rows)
        grid = config.grid or learners.default_grid(config.code, d)
        fast = policy["fast_mode"] and config.grid is None
        found = tuning.grid_search(config.code, rows, grid, policy["folds"], config.params, seed=config.seed, fast=fast, sides=sides, resample=resample)
    return found.best_params, found


def clean_samples(samples: DataFrame, code: str) -> DataFrame:
    clean = prepare.drop_nonfinite_labels(prepare.labelled_pixels(samples))
    return prepare.impute_nonfinite(clean) if code != "GMM" else clean


def train(samples: DataFrame, config: TrainConfig | None = None, validation: DataFrame | None = None, **settings: Any) -> TrainResult:
    """Clean, split, balance, scale, tune, fit and assess.

    `samples` has sample_id, bands and label, plus polygon_id for polygon folds,
    stand_id for STAND and x, y for SLOO. With `validation`, a table of other
    samples (label, bands), all of `samples` trains and those are assessed, scaled by
    the bounds of the training samples; classes that only they have count as errors.
    """
    config = config or TrainConfig(**settings)
    learners.checked(config.code)
    clean = clean_samples(samples, config.code)
    spatial = config.split in ("SLOO", "STAND")
    if spatial and validation is not None:
        raise ValueError("a validation table and spatial folds assess in different ways; give one of them")
    percent = 100.0 if spatial or validation is not None else float(config.split)
    # Counting, splitting, scaling, fitting and scoring each pass over the samples, and
    # labelled pixels lie in few tiles: even them out once, then keep them.
    kept = [clean.repartition("sample_id").persist(StorageLevel.MEMORY_AND_DISK)]
    clean = kept[0]
    scaler = None
    try:
        if config.legacy_order:
            prepared, scaler = prepare_training(clean, config)
            marked = sampling.split_pixels(prepared, percent, config.seed)
            fit_side = marked.filter("role = 'train'").drop("role")
        else:
            marked = sampling.split_pixels(clean, percent, config.seed)
            train_side = marked.filter("role = 'train'").drop("role")
            fit_side, scaler = prepare_training(train_side, config)
        if validation is not None:
            test = clean_samples(validation, config.code)
        else:
            test = marked.filter("role = 'test'").drop("role")
        if scaler and (validation is not None or not config.legacy_order):
            test = scaler.transform(test)
        if spatial or config.search != "none" or config.use_smote:
            kept.append(fit_side.persist(StorageLevel.MEMORY_AND_DISK))
        sides = spatial_sides(fit_side, config) if spatial else None
        if sides:
            sides.marked = sides.marked.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(sides.marked)
        if config.use_smote and config.search != "none" and not config.legacy_order:
            plain = scaler.transform(train_side) if scaler else train_side
            plain_sides = spatial_sides(plain, config) if spatial else None
            params, search = choose_params(plain, config, plain_sides, lambda side: weighted(oversampled(side, config), config))
        else:
            params, search = choose_params(fit_side, config, sides)
        fitted = learners.fit(config.code, fit_side, params, config.seed)
        cells = fold_cells = None
        if spatial:
            fold_cells = assess_folds(sides, config, params)
            cells = fold_cells.groupBy("label", "prediction").agg(F.sum("n").alias("n"))
        elif percent < 100 or validation is not None:
            predicted = fitted.predict(test, ["label"]).withColumnRenamed("class", "prediction")
            counted = metrics.cell_counts(predicted)
            # Few cells: held here, so that reading them does not predict again.
            local = small_or_none(counted, CELL_ROWS)
            cells = counted if local is None else local
    finally:
        if config.code != "KNN":
            for table in kept:
                table.unpersist()
    return TrainResult(fitted, scaler, params, cells, fold_cells, search, config)


def assess_folds(sides: folds.Sides, config: TrainConfig, params: dict) -> DataFrame:
    """(iter, label, prediction, n): one model per spatial fold, scored on what it left out."""
    out = None
    for i in sides.iterations:
        model = learners.fit(config.code, sides.training(i), params, config.seed)
        predicted = model.predict(sides.validation(i), ["label"]).withColumnRenamed("class", "prediction")
        part = metrics.cell_counts(predicted).withColumn("iter", F.lit(i))
        out = part if out is None else out.unionByName(part)
    # The cells are few; kept so that later reads do not train again.
    rows = out.collect()
    return out.sparkSession.createDataFrame(rows, out.schema)
