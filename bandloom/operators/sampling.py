"""Train/test splits, subsets, draws and the policy of the fast mode."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions import ordering as od
from bandloom.operators.balance import count_map, imbalance


def split_pixels(df: DataFrame, percent: float, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """Mark every labelled sample `train` or `test`, class by class.

    A class of n gives floor(n * (percent / 100)) training rows. From 100 percent
    on all rows train and nothing is left to assess. Label 0 is not a class.
    """
    labelled = df.filter(F.col("label").isNotNull() & (F.col("label") > 0))
    if percent >= 100:
        return labelled.withColumn("role", F.lit("train"))

    def quota(counts: dict) -> dict:
        return {c: int(n * (percent / 100.0)) for c, n in counts.items()}

    return with_roles(labelled, quota, seed, id_col)


def with_roles(df: DataFrame, quota: dict | Callable[[dict], dict], seed: int, id_col: str, key: str = "label") -> DataFrame:
    marked = od.take_per_key(df, key, quota, id_col, seed, "_first")
    return marked.withColumn("role", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def training_size(size: float | int, n: int) -> int:
    """Rows meant by a share (half-even rounding) or an absolute count."""
    if isinstance(size, float):
        if not 0.0 < size < 1.0:
            raise ValueError(f"a share must lie between 0 and 1, got {size}")
        rows = round(size * n)
    else:
        rows = int(size)
    if not 0 < rows < n:
        raise ValueError(f"a side must hold between 1 and {n - 1} rows, got {size}")
    return rows


def allocate_training(counts: dict, n_train: int) -> dict:
    """Training rows per class by largest remainder, both sides never empty.

    Surplus goes to the largest remainders (ties: larger label first), a deficit
    is taken from the smallest (ties: smaller label first); what is still open is
    moved class by class in label order.
    """
    total = sum(counts.values())
    exact = {c: Fraction(n * n_train, total) for c, n in counts.items()}
    # Remainders are compared as doubles, the way the expected count is computed.
    rest = {c: (n * n_train) / total - int((n * n_train) / total) for c, n in counts.items()}
    given = {c: max(1, min(counts[c] - 1, int(exact[c]))) for c in counts}
    open_rows = n_train - sum(given.values())
    step = 1 if open_rows > 0 else -1

    def room(c) -> int:
        return counts[c] - 1 - given[c] if step > 0 else given[c] - 1

    for c in sorted(counts, key=lambda c: (rest[c], c), reverse=step > 0):
        if open_rows and room(c) > 0:
            given[c] += step
            open_rows -= step
    for c in sorted(counts):
        moved = min(abs(open_rows), max(room(c), 0))
        given[c] += step * moved
        open_rows -= step * moved
    if open_rows:
        raise ValueError("the requested sizes leave no room to keep every class on both sides")
    return given


def split_features(df: DataFrame, size: float | int, seed: int = 0, id_col: str = "fid", key: str = "class") -> DataFrame:
    """Stratified split of training polygons into `train` and `test`."""

    def quota(counts: dict) -> dict:
        n = sum(counts.values())
        if n < 2:
            raise ValueError("at least two features are needed to split")
        n_train = training_size(size, n)
        if len(counts) < 2:
            raise ValueError("at least two classes are needed for a stratified split")
        if min(counts.values()) < 2:
            raise ValueError("the least populated class has fewer than 2 features")
        if min(n_train, n - n_train) < len(counts):
            raise ValueError("a side is too small to hold every class")
        return allocate_training(counts, n_train)

    return with_roles(df.filter(F.col(key).isNotNull()), quota, seed, id_col, key)


def subset_targets(counts: dict, limit: int) -> dict:
    """Rows per class of a subset: proportional (half-even), at least one each.

    An overflow is trimmed from the largest targets, a deficit filled from the
    largest classes; equal sizes are taken in label order.
    """
    total = sum(counts.values())
    if total <= limit:
        return dict(counts)
    target = {c: max(1, min(n, round(n / total * limit))) for c, n in sorted(counts.items())}
    excess = sum(target.values()) - limit
    for c in sorted(target, key=lambda c: (-target[c], c)):
        cut = max(0, min(target[c] - 1, excess))
        target[c] -= cut
        excess -= cut
    missing = max(0, limit - sum(target.values()))
    for c in sorted(counts, key=lambda c: (-counts[c], c)):
        add = min(counts[c] - target[c], missing)
        target[c] += add
        missing -= add
    return target


def stratified_subset(df: DataFrame, limit: int = fv.FAST_SUBSET, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """At most `limit` rows with the class mix kept; the feature of the fast mode."""
    counts = count_map(df)
    if sum(counts.values()) <= limit:
        return df
    return od.take_per_key(df, "label", subset_targets(counts, limit), id_col, seed, "_in").filter("_in").drop("_in")


def draw_rows(df: DataFrame, n: int, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """`n` random rows with replacement, numbered by `draw`."""
    keyed = df.withColumn("_all", F.lit(1))
    total = df.count()
    number = od.hash_uint(od.seeded_hash(f"{seed}|draw", F.col("draw"))) % F.lit(max(total, 1)) + 1
    draws = df.sparkSession.range(n if total else 0).select(
        F.lit(1).alias("_all"), F.col("id").alias("draw")
    ).select("_all", "draw", number.alias("rank"))
    return od.rows_at_ranks(keyed, "_all", draws, id_col, seed).drop("_all")


def fast_mode_policy(samples: DataFrame, enabled: bool = True, folds: int = fv.DEFAULT_FOLDS, trials: int = fv.DEFAULT_TRIALS) -> DataFrame:
    """One row: is the fast mode active, and the folds, rows and trials it leaves."""
    base = imbalance(samples)
    ratio = F.col("max_class").cast("double") / F.greatest("min_class", F.lit(1))
    heavy = (F.col("samples") > fv.FAST_SAMPLES) | (ratio > fv.FAST_RATIO) | (F.col("min_class") < fv.FAST_MIN_CLASS)
    active = F.lit(enabled) & heavy
    k = F.when(active, F.least(F.lit(folds), F.lit(fv.FAST_FOLDS))).otherwise(F.lit(folds)).cast("bigint")
    lowered = F.when(F.col("min_class") < k, F.greatest(F.lit(2), F.col("min_class"))).otherwise(k)
    return base.select(
        "samples",
        "min_class",
        ratio.alias("ratio"),
        active.alias("fast_mode"),
        lowered.cast("bigint").alias("folds"),
        F.when(active, F.least("samples", F.lit(fv.FAST_SUBSET))).otherwise(F.col("samples")).alias("search_rows"),
        F.when(active, F.lit(min(trials, fv.FAST_TRIALS))).otherwise(F.lit(trials)).cast("bigint").alias("trials"),
    )
