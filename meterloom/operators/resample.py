"""Resampling and per-meter aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.calendar import DAY_SECONDS, seconds
from meterloom.operators.ordered import RowOrder, deal, positions

MERGE = {"sum": F.sum, "any": F.bool_or, "max": F.max, "min": F.min}


WINDOWS = 1 << 19  # buckets that one task of frequent_windows cuts into windows
GROUPS = 4  # groups of meters to a task, so that tasks are of like size


def resample(df: DataFrame, freq="1H", aggs: dict[str, str] | None = None, fill: bool = True, keys: tuple[str, ...] = ("id",), parts: int | None = None) -> DataFrame:
    """Aggregate each meter into buckets of ``freq``; gaps between its ends appear as 0.

    Buckets start at midnight of the meter's own first day.  Returns
    ``id, idx, date, <aggs>`` with ``idx`` the 0-based bucket number.  Readings
    are first reduced to the largest bucket that divides both the day and
    ``freq``: that step combines map-side and spreads by (id, bucket), so the
    steps keyed by ``id`` only see rows bounded by the calendar.  ``keys`` are the
    columns that tell meters apart; with ``parts`` those steps are dealt by the
    first of them to so many tasks, which adaptive execution does not merge.
    """
    aggs = aggs or {"usage": "sum"}
    step = seconds(freq)
    base = math.gcd(step, DAY_SECONDS)
    start = (F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / base) * base).alias("_b")
    # a reading without a time belongs to no bucket
    fine = df.filter(F.col("date").isNotNull()).groupBy(*keys, start).agg(*[MERGE[how](c).alias(c) for c, how in aggs.items()])
    if parts is not None:
        fine = fine.repartition(parts, keys[0])
    per_meter = Window.partitionBy(*keys)
    # a bucket dividing the day needs no anchor of its own
    anchor = F.lit(0) if base == step else F.floor(F.min("_b").over(per_meter) / DAY_SECONDS) * DAY_SECONDS
    coarse = fine.withColumn("_a", anchor.cast("long")).withColumn("_k", F.floor((F.col("_b") - F.col("_a")) / step))
    if base != step:
        coarse = coarse.groupBy(*keys, "_a", "_k").agg(*[MERGE[how](c).alias(c) for c, how in aggs.items()])
    nxt = F.lead("_k").over(per_meter.orderBy("_k"))
    out = coarse.withColumn("_i", F.col("_k") - F.min("_k").over(per_meter)).withColumn("_to", nxt - F.col("_k"))
    if fill:
        out = out.withColumn("_gap", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_to", F.lit(1)) - 1)))
    else:
        out = out.withColumn("_gap", F.lit(0).cast("long"))

    def value(c: str, how: str) -> Column:
        empty = F.lit(False) if how == "any" else F.lit(0.0) if how == "sum" else F.lit(None)
        return F.when(F.col("_gap") == 0, F.coalesce(F.col(c), empty)).otherwise(empty).alias(c)

    return out.select(
        *keys,
        (F.col("_i") + F.col("_gap")).alias("idx"),
        F.timestamp_seconds(F.col("_a") + (F.col("_k") + F.col("_gap")) * step).alias("date"),
        *[value(c, how) for c, how in aggs.items()],
    )


def multi_resample(df: DataFrame, freqs=("1H", "1D", "7D")) -> DataFrame:
    """The same meters at several frequencies, told apart by ``freq``.

    All frequencies start from one shared aggregate to their common bucket, so
    the readings are scanned and shuffled once.
    """
    common = reduce(math.gcd, [seconds(f) for f in freqs], DAY_SECONDS)
    start = (F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / common) * common).alias("_b")
    # a reading without a time belongs to no bucket
    fine = df.filter(F.col("date").isNotNull()).groupBy("id", start).agg(F.sum("usage").alias("usage"))
    fine = fine.select("id", F.timestamp_seconds("_b").alias("date"), "usage")
    parts = [resample(fine, f).withColumn("freq", F.lit(f)) for f in freqs]
    return reduce(DataFrame.unionByName, parts)


def hour_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("id", F.hour("date").alias("hour")).agg(F.avg("usage").alias("usage"))


def fleet_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(F.avg("usage").alias("usage"))


def weekly_features(df: DataFrame, freq="7D") -> DataFrame:
    """Mean, max, min, sample deviation and median of each meter's buckets; undefined is 0."""
    buckets = resample(df, freq)
    return buckets.groupBy("id").agg(
        F.coalesce(F.avg("usage"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max("usage"), F.lit(0.0)).alias("max"),
        F.coalesce(F.min("usage"), F.lit(0.0)).alias("min"),
        F.coalesce(F.stddev_samp("usage"), F.lit(0.0)).alias("std"),
        F.coalesce(F.median("usage"), F.lit(0.0)).alias("median"),
    )


def first_dates(df: DataFrame) -> DataFrame:
    """First date and row count of each meter."""
    return df.groupBy("id").agg(F.min("date").alias("first_date"), F.count(F.lit(1)).alias("rows"))


def column_stats(df: DataFrame, col: str = "usage") -> DataFrame:
    return df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))


def frequent_windows(df: DataFrame, freq="1D", length: int = 7, decimals: int = 1, top: int = 10) -> DataFrame:
    """The most frequent windows of day-to-day differences over all meters.

    Returns ``v0..v{length-1}, n``; equal counts are ordered by the values.
    Meters are dealt into groups, whose number grows with the buckets of all
    meters: a task counts the windows of a few groups, then those of its share of
    the windows, so its memory does not grow with the input.
    """
    at = F.unix_seconds(F.col("date").cast("timestamp"))
    spans = df.groupBy("id").agg((F.max(at) - F.min(at)).alias("s"))
    total = spans.agg(F.sum(F.floor(F.col("s") / seconds(freq)) + 1)).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // WINDOWS))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(GROUPS * parts)))
    days = resample(dealt, freq, keys=("_part", "id"), parts=parts)
    w = Window.partitionBy("_part", "id").orderBy("idx")
    diff = days.withColumn("d", F.bround(F.col("usage") - F.lag("usage").over(w), decimals)).filter("idx > 0")
    names = [f"v{i}" for i in range(length)]
    windows = diff.select(
        "_part",
        # adding 0.0 turns a negative zero into the plain one
        *[(F.lead("d", i).over(w) + F.lit(0.0)).alias(n) for i, n in enumerate(names)]
    ).filter(F.col(names[-1]).isNotNull())
    # counted where they are: a frequent window leaves a group once
    counted = windows.groupBy("_part", *names).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.repartition(parts, *names).groupBy(*names).agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), *names).limit(top)


def segment_means(df: DataFrame, modulus: int = 7, order: RowOrder = RowOrder()) -> DataFrame:
    """First differences grouped by position modulo ``modulus``: mean and sample variance."""
    from meterloom.operators.windows import lag_diff

    df, order, _ = deal(df, order)
    numbered = positions(lag_diff(df, 1, order), order)
    return numbered.groupBy("id", ((F.col("pos") - 1) % modulus).alias("segment")).agg(
        F.avg("usage").alias("mean"), F.var_samp("usage").alias("var")
    )
