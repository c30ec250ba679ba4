"""Attribution of predictions to bands, for any classifier."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import factorial, prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions import ordering as od
from bandloom.functions.matrix import field, map_matrix
from bandloom.operators import gaussian, trees
from bandloom.operators.learners import Fitted, GaussianFitted, SparkFitted, TreesFitted

# Exact values need 2^bands coalitions; beyond this, ask for random orders.
EXACT_BANDS = 16
# Sums of a sample (classes times bands) that are kept in one row.
WIDE_SUMS = 64
# Rows a task mixes at a time, whatever the size of its batches.
MIXED_ROWS = 10_000
AGGREGATES = ("mean_abs", "mean", "max_abs")


def coalitions(d: int, permutations: int | None = None, seed: int = 0) -> list[tuple[int, list[bool], list[float]]]:
    """(id, members, weight per band): a band's attribution is the weighted sum
    of the coalition values. Exact unless a number of random orders is asked for."""
    table: dict[tuple, np.ndarray] = {}
    if permutations is None:
        if d > EXACT_BANDS:
            raise ValueError(f"exact values of {d} bands need 2^{d} coalitions; name a number of permutations")
        for size in range(d + 1):
            for members in combinations(range(d), size):
                mask = tuple(i in members for i in range(d))
                joins = factorial(size - 1) * factorial(d - size) / factorial(d) if size else 0.0
                leaves = factorial(size) * factorial(d - size - 1) / factorial(d) if size < d else 0.0
                table[mask] = np.array([joins if m else -leaves for m in mask])
    else:
        rng = np.random.RandomState(seed)
        for _ in range(permutations):
            order = rng.permutation(d)
            mask = [False] * d
            for step in range(d + 1):
                weight = table.setdefault(tuple(mask), np.zeros(d))
                if step < d:
                    weight[order[step]] -= 1.0 / permutations
                if step:
                    weight[order[step - 1]] += 1.0 / permutations
                if step < d:
                    mask[order[step]] = True
    return [(i, list(m), [float(v) for v in w]) for i, (m, w) in enumerate(table.items())]


def draw_table(df: DataFrame, limit: int | None, seed: int) -> DataFrame:
    """At most `limit` rows in seeded order, all rows without a limit."""
    if limit is None:
        return df.select("sample_id", "bands")
    rows = df.select("sample_id", "bands", od.seeded_hash(seed, "sample_id").alias("_h")).orderBy("_h").limit(limit)
    return rows.drop("_h")


def mixed_values(model: Fitted, x: np.ndarray, table, others: np.ndarray) -> np.ndarray:
    """Attributions of the rows of `x`, band by band for one class after the other.

    The value of a coalition is the mean score of a row over `others`, from which the bands outside come.
    """
    n, d = x.shape
    score, mix, out = model.scorer(), model.mixer(), np.zeros((len(model.classes), d, n))
    places = [np.unique(x[:, i], return_inverse=True) for i in range(d)]
    for _, members, weights in table:
        members = np.array(members)
        inside = np.flatnonzero(members)
        if len(inside) == d:
            p = score(x).T
        elif not len(inside):
            p = score(others).mean(axis=0)[:, None]
        elif 2 * prod(len(places[i][0]) for i in inside) <= n:
            # Few different values: rows that agree in the bands of the coalition are scored once.
            code = np.ravel_multi_index([places[i][1] for i in inside], [len(places[i][0]) for i in inside])
            _, first, back = np.unique(code, return_index=True, return_inverse=True)
            p = mix(x[first], members, others)[:, back]
        else:
            p = mix(x, members, others)
        for i in np.flatnonzero(weights):
            out[:, i] += weights[i] * p
    return out.reshape(-1, n).T


def mixed_in_tasks(model: Fitted, picked: DataFrame, table, ground: list) -> DataFrame:
    """(sample_id, values) of every row, mixed and scored inside tasks, so no mixed row is written out."""
    d = model.d
    shared = picked.sparkSession.sparkContext.broadcast((model, table, np.array(ground, dtype=np.float64)))

    def compute(x, _):
        model, *rest = shared.value
        return [np.concatenate([mixed_values(model, x[i : i + MIXED_ROWS], *rest) for i in range(0, len(x), MIXED_ROWS)])]

    # As in `predict`: small Gaussian models take a row without bands as one whose bands are missing, others refuse it.
    lenient = isinstance(model, GaussianFitted) and gaussian.fits_columns(model.model)
    missing = F.array_repeat(F.lit(float("nan")), d) if lenient else F.col("bands")
    wrong = F.raise_error(F.concat(F.lit(f"{d} bands expected, found "), F.size("bands").cast("string")))
    bands = F.when(F.size("bands") == d, F.col("bands")).when(F.col("bands").isNull(), missing).otherwise(wrong)
    return map_matrix(picked.withColumn("bands", bands), d, ["sample_id"], [field("values", "array<double>")], compute)


def sample_values(
    model: Fitted, samples: DataFrame, background: DataFrame | None = None, sample_limit: int | None = None,
    background_limit: int = fv.SHAP_BACKGROUND, permutations: int | None = None, seed: int = 0,
) -> DataFrame:
    """Shapley values of class probabilities, as (sample_id, values) with the value of class j
    and band i at j * bands + i, or (sample_id, class, band, value) beyond WIDE_SUMS.

    Models with a scorer mix and score rows inside tasks. For others all mixed rows go through
    the model in one job, where they lie; what is shuffled are the weighted sums, one row per
    sample. The empty coalition is the same for all samples and the full one for all
    background rows, so these are predicted once.
    """
    spark, d, outputs = samples.sparkSession, model.d, len(model.classes)
    table = coalitions(d, permutations, seed)
    ground = [list(r["bands"]) for r in draw_table(background if background is not None else samples, background_limit, f"{seed}|ground").collect()]
    picked = draw_table(samples, sample_limit, seed)
    # Large tables are read in many parts already.
    if picked.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        picked = picked.repartition("sample_id")
    codes = F.array(*[F.lit(v) for v in model.classes])
    wide, cells = d * outputs <= WIDE_SUMS, range(d * outputs)
    if ground and hasattr(model, "scorer"):
        rows = mixed_in_tasks(model, picked, table, ground)
        # Rows that repeat an id count as one.
        if wide:
            sums = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("values")[i]).alias(f"_{i}") for i in cells])
            return sums.select("sample_id", F.array(*[F.col(f"_{i}") / F.col("_n") for i in cells]).alias("values"))
        long = rows.select("sample_id", F.posexplode("values").alias("at", "v")).groupBy("sample_id", "at").agg(F.avg("v").alias("value"))
        return long.select("sample_id", F.get(codes, F.floor(F.col("at") / d).cast("int")).alias("class"), (F.col("at") % d + 1).alias("band"), "value")
    full, empty = (next(i for i, members, _ in table if set(members) == {m}) for m in (True, False))
    spots = spark.createDataFrame(table, "cid int, members array<boolean>, weights array<double>")
    others = spark.createDataFrame(list(enumerate(ground)), "bid int, other array<double>")
    base = model.predict(others.select("bid", F.col("other").alias("bands")), ["bid"], probability=True).select("probability").collect()
    base = np.mean([r["probability"] for r in base], axis=0) if base else np.zeros(outputs)
    spread = (
        picked.withColumn("cid", F.explode(F.sequence(F.lit(0), F.lit(len(table) - 1))))
        .filter(F.col("cid") != empty)
        .withColumn("bid", F.explode(F.when(F.col("cid") == full, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(max(len(ground) - 1, 0))))))
        .join(F.broadcast(spots), "cid")
        .join(F.broadcast(others), "bid")
    )
    mixed = F.transform("bands", lambda v, i: F.when(F.get("members", i), v).otherwise(F.get("other", i)))
    scored = model.predict(spread.select("sample_id", "cid", mixed.alias("bands")), ["sample_id", "cid"], probability=True)
    share = F.when(F.col("cid") == full, 1.0).otherwise(1.0 / max(len(ground), 1))
    scored = scored.join(F.broadcast(spots.select("cid", "weights")), "cid")
    # Rows that repeat an id count as one.
    copies = F.sum(F.when(F.col("cid") == full, 1).otherwise(0))
    if wide:
        sums = scored.groupBy("sample_id").agg(
            copies.alias("_n"), *[F.sum(share * F.col("weights")[at % d] * F.col("probability")[at // d]).alias(f"_{at}") for at in cells])
        return sums.select("sample_id", F.array(*[
            F.col(f"_{at}") / F.col("_n") + float(table[empty][2][at % d] * base[at // d]) for at in cells]).alias("values"))
    long = scored.select("sample_id", "cid", "weights", F.posexplode("probability").alias("j", "p")).select(
        "sample_id", "cid", "j", "p", F.posexplode("weights").alias("i", "w"))
    values = long.groupBy("sample_id", "j", "i").agg((F.sum(share * F.col("w") * F.col("p")) / copies).alias("v"))
    start, first = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (base, table[empty][2]))
    return values.select(
        "sample_id", F.get(codes, F.col("j")).alias("class"), (F.col("i") + 1).alias("band"),
        (F.col("v") + F.get(first, F.col("i")) * F.get(start, F.col("j"))).alias("value"))


def shapley_values(model: Fitted, samples: DataFrame, *args, **options) -> DataFrame:
    """(sample_id, class, band, value): the Shapley values of `sample_values`, which takes the same options.

    Bands inside a coalition come from the sample, the others from at most
    `background_limit` rows of `background` (by default of the samples), the bound on what every
    task holds. All samples are explained unless `sample_limit` is given.
    """
    found = sample_values(model, samples, *args, **options)
    if "values" not in found.columns:
        return found
    cells = F.array(*[
        F.struct(F.lit(code).alias("class"), F.lit(i + 1).alias("band"), F.col("values")[j * model.d + i].alias("value"))
        for j, code in enumerate(model.classes) for i in range(model.d)])
    return found.select("sample_id", F.explode(cells).alias("e")).select("sample_id", "e.*")


def has_paths(model: Fitted) -> bool:
    return isinstance(model, TreesFitted) or (isinstance(model, SparkFitted) and model.code == "RF")


def path_values(model: Fitted, samples: DataFrame, sample_limit: int | None = None, seed: int = 0) -> DataFrame:
    """(sample_id, class, band, value): exact attributions of a tree model for any number of bands.

    Forests are explained in class probabilities, boosted trees in margins. Bands outside
    a coalition follow both sides of a split in the shares of the training rows, so no
    background rows are needed; the work grows with the leaves, not with 2^bands.
    """
    return trees.attribute(draw_table(samples, sample_limit, seed), model_paths(model, samples), model.d, model.classes)


def model_paths(model: Fitted, samples: DataFrame) -> trees.Paths:
    """The leaf table of a tree model."""
    if not has_paths(model):
        raise ValueError(f"{model.code} has no tree paths")
    if isinstance(model, TreesFitted):
        return model.paths()
    grown = trees.forest_trees(samples.sparkSession, model.model)
    return trees.leaf_paths(grown, 1 / len(grown))


def path_importance(model: Fitted, samples: DataFrame, how: str = "mean_abs", sample_limit: int | None = None, seed: int = 0) -> DataFrame:
    """(band, importance) as `aggregate_attributions` makes it of `path_values`.

    Classes are averaged where a row lies, so one row per sample is shuffled, not one per class and band.
    """
    checked_aggregate(how)
    d, outputs = model.d, len(model.classes)
    if d * outputs > WIDE_SUMS:
        return aggregate_attributions(path_values(model, samples, sample_limit, seed), how)
    rows = trees.attributed(draw_table(samples, sample_limit, seed), model_paths(model, samples), d, outputs)
    # Rows that repeat an id count as one.
    per_sample = rows.select("sample_id", *over_classes("values", d, outputs, how)).groupBy("sample_id").agg(
        *[F.avg(f"_{i}").alias(f"_{i}") for i in range(d)])
    return over_samples(per_sample, d, how)


def over_classes(values: str, d: int, outputs: int, how: str) -> list[Column]:
    """Per band the mean over classes, of sizes unless the aggregate is `mean`."""
    sized = (lambda c: c) if how == "mean" else F.abs
    return [
        (sum((sized(F.col(values)[j * d + i]) for j in range(1, outputs)), sized(F.col(values)[i])) / outputs).alias(f"_{i}") for i in range(d)]


def over_samples(per_sample: DataFrame, d: int, how: str) -> DataFrame:
    """(band, importance) of one row per sample with a column per band."""
    over = F.max if how == "max_abs" else F.avg
    sums = per_sample.agg(F.count(F.lit(1)).alias("_n"), *[over(f"_{i}").alias(f"_{i}") for i in range(d)]).filter("_n > 0")
    cells = F.array(*[F.struct(F.lit(i + 1).alias("band"), F.col(f"_{i}").alias("_i")) for i in range(d)])
    return shares(sums.select(F.explode(cells).alias("e")).select("e.*"))


def checked_aggregate(how: str) -> None:
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}, use one of {', '.join(AGGREGATES)}")


def aggregate_attributions(values: DataFrame, how: str = "mean_abs") -> DataFrame:
    """(band, importance): over classes, then over samples, scaled to sum 1."""
    checked_aggregate(how)
    v = F.col("value") if how == "mean" else F.abs("value")
    per_sample = values.groupBy("sample_id", "band").agg(F.avg(v).alias("_v"))
    joined = per_sample.groupBy("band").agg((F.max("_v") if how == "max_abs" else F.avg("_v")).alias("_i"))
    return shares(joined)


def shares(joined: DataFrame) -> DataFrame:
    """(band, importance) of (band, _i), scaled to sum 1."""
    from bandloom.operators.balance import whole

    total = F.sum("_i").over(whole())
    return joined.select("band", F.when(total > 0, F.col("_i") / total).otherwise(F.col("_i")).alias("importance"))


def shapley_importance(model: Fitted, samples: DataFrame, how: str = "mean_abs", method: str | None = None, **options) -> DataFrame:
    """Band importance; `method` is `paths` (tree models), `coalitions`, or by default paths where there are any."""
    if method is None:
        method = "paths" if has_paths(model) and not options.keys() - {"sample_limit", "seed"} else "coalitions"
    if method not in ("paths", "coalitions"):
        raise ValueError(f"unknown method {method!r}")
    if method == "paths":
        return path_importance(model, samples, how, **options)
    checked_aggregate(how)
    found = sample_values(model, samples, **options)
    if "values" not in found.columns:
        return aggregate_attributions(found, how)
    return over_samples(found.select(*over_classes("values", model.d, len(model.classes), how)), model.d, how)


def rank_features(importance: DataFrame) -> DataFrame:
    """Bands by importance, the largest first."""
    return importance.orderBy(F.desc("importance"), "band")


def importance_map(pixels: DataFrame, importance: list[tuple[int, float]]) -> DataFrame:
    """One constant layer per band: importance in percent at every pixel."""
    layers = F.array(*[F.struct(F.lit(int(b)).alias("band"), F.lit(float(v) * 100).alias("importance")) for b, v in importance])
    return pixels.select("raster_id", "row", "col", F.explode(layers).alias("l")).select("raster_id", "row", "col", "l.*")
