"""Confusion tables and the scores computed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions.ordering import running_sums
from bandloom.functions.sizing import lookup_join

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def cell_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(label, prediction, n) of the cells that occur; partial counts do the work."""
    pairs = df.filter(F.col("label").isNotNull() & F.col("prediction").isNotNull())
    return pairs.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_universe(cells: DataFrame) -> DataFrame:
    """Sorted distinct codes of reference and prediction together."""
    return cells.select(F.col("label").alias("class")).union(cells.select("prediction")).distinct()


def confusion_dense(cells: DataFrame) -> DataFrame:
    """All cells 1..C by 1..C with C the largest reference class; absent cells are 0.

    Predictions beyond C and label 0 have no cell and are left out.
    """
    size = cells.agg(F.max("label").cast("int").alias("_c")).filter("_c >= 1")
    grid = size.select(F.explode(F.sequence(F.lit(1), "_c")).alias("label"), "_c").select(
        "label", F.explode(F.sequence(F.lit(1), "_c")).alias("prediction")
    )
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_union(cells: DataFrame) -> DataFrame:
    """All cells over the sorted union of reference and predicted codes."""
    codes = class_universe(cells).agg(F.sort_array(F.collect_set("class")).alias("_codes"))
    grid = codes.select(F.explode("_codes").alias("label"), "_codes").select(
        "label", F.explode("_codes").alias("prediction")
    )
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(cells: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row per reference class and one column per predicted class, for export."""
    wide = cells.groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(f"`{c}`", F.lit(0)).alias(f"p{c}") for c in classes])


def margins(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: row sum, column sum and diagonal of a confusion table."""
    by = list(by)
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("r"), F.lit(0).cast("bigint").alias("c"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("d")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("r"), F.col("n").alias("c"),
                         F.lit(0).cast("bigint").alias("d")),
            )
        ).alias("s"),
    )
    return sides.groupBy(*by, F.col("s.class").alias("class")).agg(
        F.sum("s.r").alias("support"), F.sum("s.c").alias("predicted"), F.sum("s.d").alias("hits")
    )


def overall_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Overall accuracy, kappa and the mean F1 of a confusion table.

    Kappa is NULL when one class holds everything. The mean F1 is NULL when a
    class of the table has neither reference nor predicted rows.
    """
    m = margins(cells, by)
    f1 = F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted"))
    sums = m.groupBy(*by).agg(
        F.sum("support").cast("double").alias("n"),
        F.sum("hits").cast("double").alias("d"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("rc"),
        F.when(F.count(F.lit(1)) == F.count(f1), F.avg(f1)).alias("f1_mean"),
    )
    return sums.select(
        *by,
        F.col("n").cast("bigint").alias("n"),
        F.try_divide(F.col("d"), F.col("n")).alias("overall_accuracy"),
        F.try_divide(F.col("n") * F.col("d") - F.col("rc"), F.col("n") * F.col("n") - F.col("rc")).alias("kappa"),
        "f1_mean",
    )


def class_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    scored = margins(cells, by).select(
        *by, "class", ratio("hits", "predicted").alias("precision"), ratio("hits", "support").alias("recall"),
        "support", "predicted", "hits",
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0)))


def average_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro, weighted and micro averages of the class scores, one row each."""
    c = class_scores(cells, by)
    agg = c.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
          for m in ("precision", "recall", "f1")],
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("micro"),
        F.sum("support").alias("support"),
    )
    row = lambda name, p, r, f: F.struct(
        F.lit(name).alias("average"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"))
    return agg.select(*by, F.explode(F.array(
        row("macro avg", "macro_precision", "macro_recall", "macro_f1"),
        row("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"),
        row("micro avg", "micro", "micro", "micro"),
    )).alias("a"), "support").select(*by, "a.*", "support")


def classification_report(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per-class rows, then the macro and weighted average rows."""
    per_class = class_scores(cells).select(F.col("class"), "precision", "recall", "f1", "support")
    if names is not None:
        per_class = lookup_join(per_class, names, ["class"])
    else:
        per_class = per_class.withColumn("name", F.lit(None).cast("string"))
    rows = per_class.select(
        F.coalesce("name", F.col("class").cast("string")).alias("row"), "precision", "recall", "f1", "support"
    )
    averages = average_scores(cells).filter(F.col("average") != "micro avg").withColumnRenamed("average", "row")
    return rows.unionByName(averages)


def normalized_confusion(cells: DataFrame) -> DataFrame:
    """Each cell as a share of its reference class."""
    total = F.sum("n").over(Window.partitionBy("label").rowsBetween(*ALL))
    return cells.withColumn("share", F.try_divide(F.col("n").cast("double"), total))


def one_vs_rest(df: DataFrame, classes: Sequence[int], probability: str = "probability") -> DataFrame:
    """(class, score, positive) pairs: every class against the others."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("class"), F.element_at(probability, i + 1).alias("score"),
                 (F.col("label") == c).alias("positive"))
        for i, c in enumerate(classes)
    ])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, the input of ROC and AUC."""
    return scored.groupBy("class", "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )


def roc_points(scored: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score, per class.

    Scores are summed up first, so ties give one point; the running sums work on
    score ranges and never sort a whole class in one task.
    """
    counts = score_counts(scored).withColumn("_desc", -F.col("score"))
    run = running_sums(counts, ["class"], "_desc", ["pos", "neg"])
    totals = counts.groupBy("class").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    joined = lookup_join(run, totals, ["class"])
    return joined.select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("q")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("p")).alias("tpr"),
        "pos", "neg", "cum_pos", "cum_neg", "p", "q",
    )


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve per class by trapezoids; NULL when one side is empty."""
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return roc_points(scored).groupBy("class").agg(
        F.try_divide(area, F.max("p").cast("double") * F.max("q")).alias("auc"), F.max("p").alias("support")
    )


def multiclass_auc(scored: DataFrame) -> DataFrame:
    """One-vs-rest AUC averaged: macro, weighted by support, micro over all pairs."""
    per_class = auc(scored)
    micro = auc(scored.withColumn("class", F.lit(0))).select(F.col("auc").alias("micro"))
    means = per_class.agg(
        F.avg("auc").alias("macro"),
        F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("weighted"),
    )
    rows = means.select(F.explode(F.array(
        F.struct(F.lit("macro").alias("average"), F.col("macro").alias("auc")),
        F.struct(F.lit("weighted").alias("average"), F.col("weighted").alias("auc")),
    )).alias("a")).select("a.*")
    return rows.unionByName(micro.select(F.lit("micro").alias("average"), F.col("micro").alias("auc")))


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count(F.lit(1)).alias("folds")
    )


def recode_cells(cells: DataFrame, levels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A confusion table at another label level; `levels` maps class to level."""
    coarse = cells
    for side in ("label", "prediction"):
        renamed = levels.select(F.col("class").alias(side), F.col("level").alias(f"_{side}"))
        coarse = lookup_join(coarse, renamed, [side])
    return coarse.groupBy(*by, F.col("_label").alias("label"), F.col("_prediction").alias("prediction")).agg(
        F.sum("n").alias("n")
    )


def result_insights(cells: DataFrame, split_mode: str) -> DataFrame:
    """One row: accuracy band, balance band, risk flags and support insights."""
    per = class_scores(cells).agg(
        F.avg("f1").alias("f1_macro"), F.min("support").alias("min_support"), F.max("support").alias("max_support"),
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
    )
    acc, gap = F.col("accuracy"), F.abs(F.col("accuracy") - F.col("f1_macro")) * 100
    ratio = F.try_divide(F.col("max_support").cast("double"), F.col("min_support"))
    random_split = F.lit(split_mode == "RANDOM_SPLIT")
    return per.select(
        "accuracy", "f1_macro", "min_support", "max_support",
        F.when(acc >= fv.ACCURACY_EXCELLENT, "excellent").when(acc >= fv.ACCURACY_GOOD, "good")
        .when(acc >= fv.ACCURACY_MEDIUM, "medium").when(acc >= fv.ACCURACY_FAIR, "fair")
        .otherwise("poor").alias("accuracy_band"),
        F.when(gap < fv.BALANCE_CLOSE, "balanced").when(gap < fv.BALANCE_MODERATE, "moderate imbalance")
        .otherwise("significant imbalance").alias("balance_band"),
        F.array_compact(F.array(
            F.when(random_split, F.lit("spatial_leakage_risk")),
            F.when(acc < fv.LOW_ACCURACY, F.lit("low_overall_accuracy")),
            F.when(F.col("min_support") < fv.LOW_SUPPORT, F.lit("low_minority_support")),
        )).alias("risk_flags"),
        F.when((F.col("min_support") == 0) | (ratio > fv.SUPPORT_RATIO_SEVERE), "severe")
        .when(ratio > fv.SUPPORT_RATIO_MODERATE, "moderate").otherwise("none").alias("support_imbalance"),
    )
