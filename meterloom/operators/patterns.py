"""Label-pure clusters as patterns, nearest-pattern votes, and a linear classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.kernels import dtw
from meterloom.session import cut


def cluster_label_counts(df: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Per cluster its top label (ties to the smallest), that label's share and the support."""
    counts = df.groupBy(*keys, "cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by("label", F.struct("n", -F.col("label")))
    return counts.groupBy(*keys, "cluster").agg(
        top.alias("label"), (F.max("n") / F.sum("n")).alias("confidence"), F.sum("n").alias("support")
    )


def cluster_centers(df: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean vector of each cluster."""
    cells = df.select(*keys, "cluster", F.posexplode("values").alias("pos", "v"))
    means = cells.groupBy(*keys, "cluster", "pos").agg(F.avg("v").alias("m"))
    pairs = F.sort_array(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(*keys, "cluster").agg(F.transform(pairs, lambda p: p["m"]).alias("centroid"))


def valuable_patterns(df: DataFrame, min_confidence: float = 0.75, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Clusters purer than ``min_confidence``, with centroid: ``keys, cluster, label, confidence, support, centroid``."""
    pure = cluster_label_counts(df, keys).filter(F.col("confidence") > min_confidence)
    return pure.join(cluster_centers(df, keys), [*keys, "cluster"])


def label_lookup(df: DataFrame, patterns: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Label of each row's cluster, null when the cluster is no pattern."""
    known = patterns.select(*keys, "cluster", F.col("label").alias("pred"))
    return df.join(known, [*keys, "cluster"], "left")


def item_centre_pairs(items: DataFrame, centers: DataFrame, item: Sequence[str] = ("item",), keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Every item with every centre of its keys. Keys are few, so items are salted and centres (one row per cluster) repeated per salt."""
    salts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*item), F.lit(salts)))
    copied = centers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copied, [*keys, "_salt"]).drop("_salt")


def nearest_pattern(test: DataFrame, centers: DataFrame, patterns: DataFrame, item: Sequence[str] = ("item",), keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Per item and feature the DTW-nearest centre and its label: ``item, keys, cluster, dist, pred``.

    All centres compete, but only those in ``patterns`` carry a label.
    """
    pairs = item_centre_pairs(test.select(*item, *keys, "values"), centers.select(*keys, "cluster", "centroid"), item, keys)
    measured = pairs.select(*item, *keys, "cluster", dtw("values", "centroid").alias("dist"))
    best = measured.groupBy(*item, *keys).agg(F.min(F.struct("dist", "cluster")).alias("_b"))
    found = best.select(*item, *keys, "_b.cluster", "_b.dist")
    return label_lookup(found, patterns, keys)


def vote_label(preds: DataFrame, item: Sequence[str] = ("item",)) -> DataFrame:
    """Most frequent non-null ``pred`` per item, ties to the smallest, none is -1: ``item, vote``."""
    counts = preds.groupBy(*item, "pred").agg(F.count("pred").alias("n"))
    best = F.max_by(F.col("pred"), F.when(F.col("pred").isNotNull(), F.struct("n", -F.col("pred"))))
    return counts.groupBy(*item).agg(F.coalesce(best, F.lit(-1)).alias("vote"))


def pattern_accuracy(votes: DataFrame) -> DataFrame:
    """One row: share of items whose ``vote`` is their ``label``."""
    return votes.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("vote") == F.col("label")).cast("int")).alias("accuracy"))


def feature_accuracy(preds: DataFrame, max_dist: float = 0.75, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Per feature, accuracy of labelled predictions closer than ``max_dist``; rows carry ``label``."""
    close = preds.filter(F.col("pred").isNotNull() & (F.col("dist") < max_dist))
    return close.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"))


def linear_svm(train: DataFrame, test: DataFrame, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """Linear support-vector classifier on ``values, label``; adds ``pred`` to ``test``.

    The regularisation 1/(C n) matches a cost of C per training row.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    # written first: the count and every optimiser pass read it
    rows = cut(train.select("values", "label")).withColumn("_v", array_to_vector("values")).withColumn("_y", F.col("label").cast("double"))
    n = max(1, rows.count())
    model = LinearSVC(featuresCol="_v", labelCol="_y", predictionCol="_p", regParam=1.0 / (c * n), maxIter=max_iter).fit(rows)
    scored = model.transform(test.withColumn("_v", array_to_vector("values")))
    return scored.withColumn("pred", F.col("_p").cast("int")).drop("_v", "_p", "rawPrediction")
