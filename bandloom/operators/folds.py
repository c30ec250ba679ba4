"""Validation folds: stratified, by polygon, by stand, by distance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions import ordering as od
from bandloom.functions.sizing import bounded_rows, lookup_join
from bandloom.operators.balance import class_counts, count_map
from bandloom.operators.spatial import farthest, within_buffer
from bandloom.session import cut_lineage


class TooFewPolygons(ValueError):
    """A class has fewer polygons than folds need."""


def stratified_kfold(df: DataFrame, k: int, seed: int = 0, id_col: str = "sample_id", out: str = "fold") -> DataFrame:
    """Fold number 0..k-1, even within every class.

    k is lowered to the smallest class, but not below 2.
    """
    smallest = min(count_map(df).values())
    k = max(2, smallest) if smallest < k else k
    ranked = od.hash_rank(df, ["label"], id_col, seed, "_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def polygons_per_class(polygons: DataFrame, class_field: str = "class") -> DataFrame:
    """Features per class, skipping empty labels."""
    text = F.col(class_field).cast("string")
    kept = polygons.filter(text.isNotNull() & (text != ""))
    return kept.groupBy(class_field).agg(F.count(F.lit(1)).alias("n"))


def polygon_coverage(samples: DataFrame, minimum: int) -> DataFrame:
    """(label, polygons) of classes with fewer than `minimum` distinct polygons."""
    return (
        samples.groupBy("label").agg(F.countDistinct("polygon_id").alias("polygons")).filter(F.col("polygons") < minimum)
    )


def require_polygons(samples: DataFrame, minimum: int) -> None:
    short = bounded_rows(polygon_coverage(samples, minimum))
    if short:
        named = ", ".join(f"{r['label']} ({r['polygons']})" for r in sorted(short))
        raise TooFewPolygons(f"classes with fewer than {minimum} polygons: {named}")


def group_folds(samples: DataFrame, k: int, seed: int = 0, group: str = "polygon_id") -> DataFrame:
    """(group, fold): whole polygons dealt to folds with the class mix kept.

    Polygons are sorted by their main class, then by size, and dealt back and
    forth, so every fold gets large and small polygons of every class.
    """
    per_class = samples.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
    per_group = per_class.groupBy(group).agg(
        F.sum("n").alias("size"), F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("main")
    )
    # Counted and ranked from here on, so that the samples are read once.
    per_group = cut_lineage(per_group, "groups")
    found = per_group.count()
    k = max(2, found) if found < k else k
    ranked = od.lead_rank(per_group, ["main"], "size", group, seed, "_rank")
    place = F.col("_rank") - 1
    turn, seat = F.floor(place / k), place % k
    fold = F.when(turn % 2 == 0, seat).otherwise(k - 1 - seat)
    return ranked.select(group, "main", "size", fold.cast("int").alias("fold"))


def stratified_group_kfold(samples: DataFrame, k: int, seed: int = 0, group: str = "polygon_id") -> DataFrame:
    """Samples with the fold of their polygon."""
    folds = cut_lineage(group_folds(samples, k, seed, group).select(group, "fold"), "folds")
    return lookup_join(samples, folds, [group], "inner")


def min_stands_per_class(samples: DataFrame) -> DataFrame:
    per_class = samples.groupBy("label").agg(F.countDistinct("stand_id").alias("stands"))
    return per_class.agg(F.min("stands").alias("min_stands"))


def draws_per_class(counts: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(label, iter, rank): one random rank of the class per iteration."""
    spread = counts.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    rank = od.hash_uint(od.seeded_hash(seed, F.col("iter"), F.col("label"))) % F.col("n") + 1
    return spread.select("label", "iter", rank.alias("rank"))


def sloo_held_out(samples: DataFrame, max_iter: int | None = None, seed: int = 0) -> DataFrame:
    """One held-out sample per iteration and class, drawn with replacement.

    As many iterations as the smallest class has samples unless `max_iter` is given.
    """
    counts = class_counts(samples)
    if max_iter is None:
        max_iter = min(count_map(samples).values())
    draws = draws_per_class(counts, max_iter, seed)
    return od.rows_at_ranks(samples, "label", draws, "sample_id", seed)


def sloo_strict(samples: DataFrame, max_iter: int | None) -> bool:
    """Training must be farther than the distance, not at it, when the number of
    iterations is the size of the smallest class."""
    return max_iter is None or max_iter == min(count_map(samples).values())


def sloo_folds(samples: DataFrame, distance: float, max_iter: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(held-out, excluded): the two small tables that define spatial folds.

    Training in iteration i for class c is class c without `excluded` of (i, c).
    """
    held = sloo_held_out(samples, max_iter, seed)
    return held, within_buffer(samples, held, distance, sloo_strict(samples, max_iter))


def sloo_sizes(samples: DataFrame, held: DataFrame, excluded: DataFrame) -> DataFrame:
    """Held-out sample and training size per iteration and class, by subtraction."""
    near = excluded.groupBy("iter", "label").agg(F.count(F.lit(1)).alias("_near"))
    sized = lookup_join(held.select("iter", "label", F.col("sample_id").alias("held_out")), class_counts(samples), ["label"])
    return sized.join(near, ["iter", "label"], "left").select(
        "iter", "label", "held_out", (F.col("n") - F.coalesce("_near", F.lit(0))).alias("n_train")
    )


def sloo_training(samples: DataFrame, excluded: DataFrame, iteration: int) -> DataFrame:
    """Training samples of one iteration: everything but its excluded rows."""
    gone = excluded.filter(F.col("iter") == iteration).select("label", "sample_id").distinct()
    return samples.join(gone, ["label", "sample_id"], "left_anti")


@dataclass
class Sides:
    """Training and validation side of every spatial iteration, without a row per sample and iteration.

    `marked` is the samples with the iterations that hold them out (`_held`), that
    leave them aside (`_aside`) and, where a share of the class moves over, their
    seeded rank (`_rank`). `moves` then has (iter, label, n, start, cut): in that
    iteration the ranks counted from `start` up to `cut` are held out as well.
    """

    marked: DataFrame
    iterations: list[int]
    moves: DataFrame | None = None

    def _split(self, iteration: int) -> tuple[DataFrame, Column, Column]:
        df, moved = self.marked, F.lit(False)
        if self.moves is not None:
            mine = self.moves.filter(F.col("iter") == iteration).select("label", *[F.col(c).alias(f"_{c}") for c in ("n", "start", "cut")])
            df = lookup_join(df, mine, ["label"])
            moved = F.coalesce(turned_rank(F.col("_rank"), F.col("_start"), F.col("_n")) <= F.col("_cut"), F.lit(False))
        held = F.array_contains("_held", F.lit(iteration))
        aside = F.array_contains("_aside", F.lit(iteration))
        return df, held | (moved & ~aside), aside

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in self.marked.columns if c not in ("_held", "_aside", "_rank")])

    def training(self, iteration: int) -> DataFrame:
        df, valid, aside = self._split(iteration)
        return self._plain(df.filter(~valid & ~aside))

    def validation(self, iteration: int) -> DataFrame:
        df, valid, _ = self._split(iteration)
        return self._plain(df.filter(valid))

    def sizes(self) -> DataFrame:
        """(iter, label, n_train, n_valid, valid_sum): sizes of both sides and the sum of the held-out ids, one pass for all iterations."""
        if self.moves is not None:
            raise ValueError("sizes are counted per iteration where a share of the class moves")
        touched = F.array_union("_held", "_aside")
        each = self.marked.select("label", "sample_id", "_held", F.explode(touched).alias("iter"))
        valid = F.array_contains("_held", F.col("iter"))
        near = each.groupBy("iter", "label").agg(
            F.count(F.lit(1)).alias("_gone"), F.count_if(valid).alias("n_valid"), F.sum(F.when(valid, F.col("sample_id"))).alias("valid_sum"))
        sized = lookup_join(near, class_counts(self.marked), ["label"])
        return sized.select("iter", "label", (F.col("n") - F.col("_gone")).alias("n_train"), "n_valid", "valid_sum")


def turned_rank(rank: Column, start: Column, n: Column) -> Column:
    """Place of a rank 1..n when counting begins after `start` and goes round."""
    return F.pmod(rank - 1 - start, n) + 1


def marked_sides(samples: DataFrame, held: DataFrame, aside: DataFrame | None, on: Sequence[str]) -> DataFrame:
    """Samples with the sorted iterations of both tables as `_held` and `_aside`; `on` names the rows meant."""
    rows = held.select(*on, "iter", F.lit(True).alias("_valid"))
    if aside is not None:
        rows = rows.unionByName(aside.select(*on, "iter", F.lit(False).alias("_valid")))
    lists = rows.groupBy(*on).agg(
        F.sort_array(F.collect_set(F.when(F.col("_valid"), F.col("iter")))).alias("_held"),
        F.sort_array(F.collect_set(F.when(~F.col("_valid"), F.col("iter")))).alias("_aside"))
    none = F.array().cast("array<int>")
    joined = lookup_join(samples, lists, on)
    return joined.select(*samples.columns, *[F.coalesce(c, none).alias(c) for c in ("_held", "_aside")])


def moving_cuts(ranked: DataFrame, excluded: DataFrame, held: DataFrame, share: float, seed: int) -> DataFrame:
    """(iter, label, n, start, cut): up to which turned rank a share of the class moves over.

    int(share * n) - 1 samples beside the drawn one move, the first that are not
    excluded. With e(1) < e(2) < ... the turned ranks of the excluded samples, e(j) is
    among the first `quota` others exactly if e(j) - j < quota. Ranks are first
    counted in stretches, so that many excluded samples of one iteration are not
    ordered in one task.
    """
    counts = class_counts(ranked)
    start = od.hash_uint(od.seeded_hash(f"{seed}|moved", "iter", "label")) % F.col("n")
    folds_ = lookup_join(held.select("iter", "label"), counts, ["label"], "inner").withColumn("start", start)
    folds_ = folds_.withColumn("_quota", F.greatest(F.lit(0), F.floor(F.lit(share) * F.col("n")).cast("bigint") - 1))
    near = excluded.join(ranked.select("label", "sample_id", "_rank"), ["label", "sample_id"])
    near = lookup_join(near, folds_, ["iter", "label"], "inner").withColumn("_e", turned_rank(F.col("_rank"), F.col("start"), F.col("n")))
    near = cut_lineage(near.withColumn("_part", F.floor((F.col("_e") - 1) * 1024 / F.col("n"))).select("iter", "label", "_part", "_e", "_quota"), "near")
    before = Window.partitionBy("iter", "label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = near.groupBy("iter", "label", "_part").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("iter", "label", "_part").orderBy("_e"))
    placed = near.withColumn("_j", inside).join(parts, ["iter", "label", "_part"])
    passed = placed.groupBy("iter", "label").agg(F.count_if(F.col("_e") - F.col("_before") - F.col("_j") < F.col("_quota")).alias("_passed"))
    joined = folds_.join(passed, ["iter", "label"], "left")
    cut = F.when(F.col("_quota") > 0, F.col("_quota") + F.coalesce("_passed", F.lit(0))).otherwise(0)
    return joined.select("iter", "label", "n", "start", cut.cast("bigint").alias("cut"))


def sloo_sides(
    samples: DataFrame, distance: float, max_iter: int | None = None, seed: int = 0, min_train: float | None = None, sloo: bool = True
) -> Sides:
    """Spatial iterations with the drawn sample, or a set in its place, held out per class.

    Without `min_train` the drawn sample is held out and what is too near is left
    aside. Above 1, the `min_train` samples of the class farthest from the drawn one
    are held out in its place; with `sloo` exactly so many, and the near ones are left
    aside, otherwise all at the last distance, and the rest of the class trains. From
    0 to 1 that share of the class is held out: the drawn sample and others taken at random
    from the training side. Samples without a position are never near or far.
    """
    held, excluded = sloo_folds(samples, distance, max_iter, seed)
    held, excluded = cut_lineage(held.select("iter", "label", "sample_id", "x", "y"), "held"), cut_lineage(excluded.distinct(), "excluded")
    iterations = [r[0] for r in held.select("iter").distinct().orderBy("iter").collect()]
    key = ["label", "sample_id"]
    if min_train is not None and min_train > 1:
        drawn = farthest(samples, held, int(min_train), seed, ties=not sloo)
        return Sides(marked_sides(samples, drawn, excluded if sloo else None, key), iterations)
    if min_train is None or min_train <= 0:
        return Sides(marked_sides(samples, held, excluded, key), iterations)
    ranked = od.hash_rank(samples, ["label"], "sample_id", seed, "_rank")
    slim = cut_lineage(ranked.select(*key, "_rank"), "ranks")
    moves = cut_lineage(moving_cuts(slim, excluded, held, min_train, seed), "moves")
    return Sides(marked_sides(ranked, held, excluded, key), iterations, moves)


def stand_sides(samples: DataFrame, max_iter: int | None = None, sloo: bool = True, seed: int = 0) -> Sides:
    """Iterations that hold out whole stands of every class."""
    held = cut_lineage(stand_folds(samples, max_iter, sloo, seed=seed), "stands")
    iterations = [r[0] for r in held.select("iter").distinct().orderBy("iter").collect()]
    return Sides(marked_sides(samples, held, None, ["label", "stand_id"]), iterations)


def stand_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label", "stand_id").agg(F.count(F.lit(1)).alias("n"))


def stand_folds(
    samples: DataFrame, max_iter: int | None = None, sloo: bool = True, split: float = 0.5, seed: int = 0
) -> DataFrame:
    """(iter, label, stand_id, n) of the held-out stands of every iteration.

    With `sloo` one stand per class is held out, otherwise the stands after the
    first int(stands * split) of a shuffle. The other stands of the class train.
    """
    stands = stand_counts(samples)
    if max_iter is None:
        max_iter = min_stands_per_class(samples).collect()[0][0]
    if sloo:
        per_class = stands.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        draws = draws_per_class(per_class, max_iter, seed)
        return od.rows_at_ranks(stands, "label", draws, "stand_id", seed).select("iter", "label", "stand_id", "n")
    sizes = {r[0]: r[1] for r in bounded_rows(stands.groupBy("label").agg(F.count(F.lit(1))))}
    spread = stands.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(max_iter - 1))))
    spread = spread.withColumn("_fold", F.concat_ws("|", "iter", "label")).withColumn(
        "_id", F.concat_ws("|", "iter", "stand_id")
    )
    quota = {f"{i}|{c}": int(m * split) for i in range(max_iter) for c, m in sizes.items()}
    marked = od.take_per_key(spread, "_fold", quota, "_id", seed, "_train")
    return marked.filter(~F.col("_train")).select("iter", "label", "stand_id", "n")


def stand_fold_sizes(samples: DataFrame, held: DataFrame) -> DataFrame:
    """Training and held-out samples per iteration and class, by subtraction."""
    out = held.groupBy("iter", "label").agg(F.sum("n").alias("n_valid"))
    sized = lookup_join(out, class_counts(samples), ["label"])
    return sized.select("iter", "label", (F.col("n") - F.col("n_valid")).alias("n_train"), "n_valid")
