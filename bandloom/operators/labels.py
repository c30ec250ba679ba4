"""Codes 0..C-1 for arbitrary class codes, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.sizing import bounded_rows, lookup_join


def label_codes(df: DataFrame) -> DataFrame:
    """(label, code): position of each class in sorted order."""
    classes = df.filter(F.col("label").isNotNull()).select("label").distinct()
    return classes.withColumn("code", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))


def sorted_classes(df: DataFrame) -> list[int]:
    classes = df.filter(F.col("label").isNotNull()).select("label").distinct()
    return sorted(int(r[0]) for r in bounded_rows(classes))


def encode_labels(df: DataFrame, codes: DataFrame) -> DataFrame:
    return lookup_join(df, codes, ["label"])


def decode_labels(df: DataFrame, codes: DataFrame, column: str = "code") -> DataFrame:
    back = codes.select(F.col("code").alias(column), F.col("label").alias("decoded"))
    return lookup_join(df, back, [column])
