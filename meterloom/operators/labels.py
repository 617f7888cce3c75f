"""Label tables: clicks, one-hot form, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_labels(clicks: DataFrame) -> DataFrame:
    """``img, label`` pairs clicked an odd number of times: a click toggles the pair."""
    counted = clicks.groupBy("img", "label").agg(F.count(F.lit(1)).alias("_c"))
    return counted.filter(F.col("_c") % 2 == 1).drop("_c")


def one_hot_labels(labels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per labelled image with a 0/1 column per class."""
    flags = [F.max((F.col("label") == c).cast("int")).alias(c) for c in classes]
    return labels.groupBy("img").agg(*flags)


def write_by_label(items: DataFrame, path: str) -> None:
    """Items with a ``label`` column, one folder per label.

    Adaptive execution deals a frequent label to as many tasks as its size asks for.
    """
    items.hint("rebalance", "label").write.partitionBy("label").parquet(path)


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row ``n, tp, fp, fn, tn, accuracy, precision, recall`` for 0/1 columns."""
    hit = lambda l, p: F.count_if((F.col(label) == l) & (F.col(pred) == p))
    counts = df.agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    ratio = lambda top, bottom: F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, F.col("n")))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
    )


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
