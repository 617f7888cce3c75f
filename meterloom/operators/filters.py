"""Filters: each keeps or drops whole meters through a per-meter aggregate, or rows by predicate.

Semi- and anti-joins carry no broadcast hint: Spark broadcasts the id side only
under its own size threshold and otherwise shuffles with skew handling.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.errors import UserNotFoundError
from meterloom.functions.seeded import digest
from meterloom.operators.resample import resample


def select_user(df: DataFrame, user_id) -> DataFrame:
    rows = df.filter(F.col("id") == F.lit(user_id))
    if rows.isEmpty():
        raise UserNotFoundError(user_id)
    return rows


def select_random_user(df: DataFrame, seed=0, key=("id", "date")) -> DataFrame:
    """All rows of the meter that owns the row with the smallest seeded digest."""
    winner = df.select("id", digest(seed, *key).alias("_d")).orderBy("_d", "id").limit(1)
    return df.join(winner.select("id"), "id", "left_semi")


def filter_date(df: DataFrame, start=None, end=None) -> DataFrame:
    """Strictly after ``start`` and strictly before ``end``; the bare column lets the scan prune."""
    if start is not None:
        df = df.filter(F.col("date") > F.lit(start))
    if end is not None:
        df = df.filter(F.col("date") < F.lit(end))
    return df


def in_users(df: DataFrame, users: DataFrame | Iterable, col: str = "id") -> DataFrame:
    """Rows whose id appears in a table column or in a literal list."""
    if isinstance(users, DataFrame):
        kind = df.schema["id"].dataType
        ids = users.select(F.col(col).try_cast(kind).alias("id"))
        return df.join(ids, "id", "left_semi")
    return df.filter(F.col("id").isin(list(users)))


def not_in_users(df: DataFrame, users: DataFrame, col: str = "id") -> DataFrame:
    kind = df.schema["id"].dataType
    return df.join(users.select(F.col(col).try_cast(kind).alias("id")), "id", "left_anti")


def _keep_meters(df: DataFrame, per_meter: DataFrame, condition: Column) -> DataFrame:
    return df.join(per_meter.filter(condition).select("id"), "id", "left_semi")


def _share(df: DataFrame, freq, hit: Column, share: float) -> DataFrame:
    part = resample(df, freq).groupBy("id").agg(F.avg(hit.cast("int")).alias("part"))
    return _keep_meters(df, part, F.col("part") > share)


def share_above(df: DataFrame, share: float, freq, threshold: float) -> DataFrame:
    """Meters with more than ``share`` of their buckets above ``threshold``; gap buckets count as 0."""
    return _share(df, freq, F.col("usage") > threshold, share)


def share_below(df: DataFrame, share: float, freq, threshold: float) -> DataFrame:
    return _share(df, freq, F.col("usage") < threshold, share)


def day_night(df: DataFrame, day_mean_above=None, night_mean_above=None, day_mean_below=None, night_mean_below=None) -> DataFrame:
    """Bounds on mean usage in hours 6 to 17 and in the remaining hours, all strict, all required."""
    day = F.hour("date").between(6, 17)
    means = df.groupBy("id").agg(
        F.avg(F.when(day, F.col("usage"))).alias("day"), F.avg(F.when(~day, F.col("usage"))).alias("night")
    )
    condition = F.lit(True)
    for name, low, high in (("day", day_mean_above, day_mean_below), ("night", night_mean_above, night_mean_below)):
        if low is not None:
            condition = condition & (F.col(name) > low)
        if high is not None:
            condition = condition & (F.col(name) < high)
    return _keep_meters(df, means, condition)


def _level(df: DataFrame, freq) -> DataFrame:
    if freq is None:  # without a frequency the level is the meter's total
        return df.groupBy("id").agg(F.coalesce(F.sum("usage"), F.lit(0.0)).alias("level"))
    return resample(df, freq).groupBy("id").agg(F.avg("usage").alias("level"))


def mean_below(df: DataFrame, threshold: float, freq=None) -> DataFrame:
    return _keep_meters(df, _level(df, freq), F.col("level") < threshold)


def mean_above(df: DataFrame, threshold: float, freq=None) -> DataFrame:
    return _keep_meters(df, _level(df, freq), F.col("level") > threshold)


def align_start(df: DataFrame) -> DataFrame:
    """Rows on or after the latest first date of any meter; the bound is a scalar subquery."""
    latest = df.groupBy("id").agg(F.min("date").alias("d")).agg(F.max("d"))
    return df.filter(F.col("date") >= latest.scalar())


def enough_points(df: DataFrame) -> DataFrame:
    """Meters with at least the average number of rows."""
    counts = df.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return _keep_meters(df, counts, F.col("c") >= counts.agg(F.avg("c")).scalar())


def after_known_date(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Flag rows of listed meters after their known date (``dates``: ``id, date``)."""
    known = dates.select("id", F.col("date").alias("_known"))
    return df.join(known, "id").withColumn("after", F.col("date") > F.col("_known")).drop("_known")


def nonzero_label(df: DataFrame) -> DataFrame:
    return df.filter("label <> 0")
