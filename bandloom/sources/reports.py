"""Report tables of a run, written and read back."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions.sizing import bounded_rows
from bandloom.operators import metrics

# Cells of a confusion matrix that may be written as one text file.
MATRIX_CELLS = 4_000_000


def matrix_lines(cells: DataFrame, names: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """(numeric, labelled, classes): one text line per reference class, in order."""
    dense = metrics.confusion_union(cells)
    classes = sorted(r[0] for r in bounded_rows(metrics.class_universe(cells)))
    if len(classes) ** 2 > MATRIX_CELLS:
        raise ValueError("too many classes for a matrix file; use the long confusion table")
    rows = dense.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("prediction", "n"))).alias("r"))
    text = F.concat_ws(",", F.transform("r", lambda e: e["n"].cast("string")))
    label = {c: (names or {}).get(c, str(c)) for c in classes}
    table = F.create_map(*[F.lit(v) for c in classes for v in (c, label[c])])
    numeric = rows.select(F.col("label").cast("bigint").alias("place"), text.alias("value"))
    labelled = rows.select(F.col("label").cast("bigint").alias("place"), F.concat(table[F.col("label")], F.lit(","), text).alias("value"))
    head = cells.sparkSession.createDataFrame([(-1, "true/pred," + ",".join(label[c] for c in classes))], "place bigint, value string")
    return numeric, labelled.unionByName(head), classes


def write_text(lines: DataFrame, path: str) -> None:
    """Small ordered text: one file."""
    lines.orderBy("place").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    text = json.dumps(document, indent=2, default=str)
    write_text(spark.createDataFrame(list(enumerate(text.split("\n"))), "place bigint, value string"), path)


def run_summary(cells: DataFrame) -> dict[str, Any]:
    """Scores of a run as a plain document."""
    overall = metrics.overall_scores(cells).first()
    averages = {r["average"]: r for r in metrics.average_scores(cells).collect()}
    per = sorted(bounded_rows(metrics.class_scores(cells)), key=lambda r: r["class"])
    return {
        "accuracy": averages["micro avg"]["f1"],
        "f1_macro": averages["macro avg"]["f1"],
        "f1_weighted": averages["weighted avg"]["f1"],
        "f1_micro": averages["micro avg"]["f1"],
        "overall_accuracy_conf": overall["overall_accuracy"],
        "kappa": overall["kappa"],
        "f1_mean_conf": overall["f1_mean"],
        "classes": [r["class"] for r in per],
        "precision_per_class": [r["precision"] for r in per],
        "recall_per_class": [r["recall"] for r in per],
        "f1_per_class": [r["f1"] for r in per],
        "support_per_class": [r["support"] for r in per],
    }


def write_report_tables(cells: DataFrame, path: str, config: dict[str, Any], names: dict[int, str] | None = None) -> list[str]:
    """Matrices, class scores, metrics, configuration, manifest and trust card."""
    spark = cells.sparkSession
    numeric, labelled, classes = matrix_lines(cells, names)
    summary = run_summary(cells)
    write_text(numeric, f"{path}/confusion_matrix_numeric.csv")
    write_text(labelled, f"{path}/confusion_matrix_labeled.csv")
    rows = [(-1, "class_value,class_name,precision,recall,f1,support")] + [
        (i, f"{c},{(names or {}).get(c, c)},{p:.6f},{r:.6f},{f:.6f},{s}")
        for i, (c, p, r, f, s) in enumerate(zip(summary["classes"], summary["precision_per_class"],
                                                summary["recall_per_class"], summary["f1_per_class"], summary["support_per_class"]))
    ]
    write_text(spark.createDataFrame(rows, "place bigint, value string"), f"{path}/per_class_metrics.csv")
    insight = metrics.result_insights(cells, config.get("split_mode", "")).first()
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    artifacts = {
        "run_config": "run_config.json",
        "metrics_json": "metrics.json",
        "confusion_matrix_numeric_csv": "confusion_matrix_numeric.csv",
        "confusion_matrix_labeled_csv": "confusion_matrix_labeled.csv",
        "per_class_metrics_csv": "per_class_metrics.csv",
    }
    write_document(spark, f"{path}/metrics.json", summary)
    write_document(spark, f"{path}/run_config.json", config)
    write_document(spark, f"{path}/run_manifest.json", {
        "schema_version": 1, "generated_at": now, "run": config, "artifacts": artifacts,
        "metrics": {k: summary[k] for k in ("accuracy", "f1_macro", "f1_weighted", "f1_micro", "overall_accuracy_conf", "f1_mean_conf")},
    })
    write_document(spark, f"{path}/trust_card.json", {
        "schema_version": 1, "generated_at": now,
        "validation": {"mode": config.get("split_mode", ""), "split_config": config.get("split_config", "")},
        "quality": {k: summary[k] for k in ("accuracy", "f1_macro", "overall_accuracy_conf")},
        "risk_flags": list(insight["risk_flags"]), "accuracy_band": insight["accuracy_band"],
        "balance_band": insight["balance_band"],
    })
    return [*artifacts.values(), "run_manifest.json", "trust_card.json"]


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, value) lines of all files of a report."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("artifact"), "value")


def load_confusion_reports(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, label, prediction, n) of labelled matrices; unreadable counts are 0.

    Every line knows its file, and the header of a file is one line, so files are
    matched with their header by name and never read whole by one task.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.input_file_name().alias("file"), F.split("value", ",").alias("cells"))
    digits = lambda v: F.regexp_replace(F.trim(v), r"\.", "").rlike("^[0-9]+$")
    first = F.lower(F.trim(F.col("cells")[0]))
    facts = first.contains("overall accuracy") | (first == "oa") | first.contains("kappa")
    head_mark = first.startswith("true/pred") | (first == "")
    heads = lines.filter((F.size("cells") > 2) & ~facts & head_mark & F.exists(F.slice("cells", F.lit(2), F.size("cells")), digits)).select(
        "file", F.slice("cells", F.lit(2), F.size("cells")).alias("head"))
    rows = lines.filter((F.size("cells") >= 2) & ~facts & ~head_mark & F.trim(F.col("cells")[0]).rlike("[0-9]"))
    joined = rows.join(heads, "file")
    values = joined.select(
        "file", F.trim(F.col("cells")[0]).alias("label"), "head", F.posexplode(F.slice("cells", F.lit(2), F.size("head"))).alias("at", "v"))
    return values.select(
        "file", "label",
        F.trim(F.get("head", F.col("at"))).alias("prediction"),
        F.coalesce(F.floor(F.trim("v").try_cast("double")).cast("bigint"), F.lit(0).cast("bigint")).alias("n"))


def load_report_scores(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, metric, value) of the accuracy and kappa lines in reports."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.input_file_name().alias("file"), F.split("value", ",").alias("cells"))
    first = F.lower(F.trim(F.col("cells")[0]))
    name = F.when(first.contains("overall accuracy") | (first == "oa"), "Overall Accuracy").when(
        first.contains("kappa"), "Kappa Coefficient")
    value = F.get("cells", F.lit(1)).try_cast("double")
    return lines.select("file", name.alias("metric"), value.alias("value")).filter("metric is not null and value is not null")
