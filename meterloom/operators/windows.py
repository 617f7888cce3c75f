"""Lag differences, sliding windows, segments, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.ordered import SERIES, RowOrder, deal, lagged, positions, running_sum, undealt
from meterloom.session import cut


def lag_diff(df: DataFrame, k: int = 1, order: RowOrder = RowOrder()) -> DataFrame:
    """Usage minus usage k rows earlier; rows without a difference are dropped."""
    return (
        lagged(df, {"_prev": "usage"}, k, order)
        .withColumn("usage", F.col("usage") - F.col("_prev"))
        .drop("_prev")
        .filter("usage IS NOT NULL")
    )


def rolling_band(series: DataFrame, window: int, std: float) -> DataFrame:
    """Add mean, upper and lower band of the previous ``window`` buckets of a resampled series."""
    w = Window.partitionBy("id").orderBy("idx").rowsBetween(-window, -1)
    full = F.col("idx") >= window
    mean, dev = F.avg("usage").over(w), F.stddev_samp("usage").over(w)
    return (
        series.withColumn("mean", F.when(full, mean))
        .withColumn("_dev", F.when(full, dev))
        .withColumn("upper", F.col("mean") + F.col("_dev") * std)
        .withColumn("lower", F.col("mean") - F.col("_dev") * std)
        .drop("_dev")
    )


def sliding_windows(series: DataFrame, length: int, col: str = "usage") -> DataFrame:
    """Every run of ``length`` consecutive rows as ``id, idx, values`` (``idx`` 0-based, dense).

    A meter is cut into position blocks, each with the first rows of the next
    block as overlap, so one long series still spreads over many tasks.
    """
    block = max(4096, 4 * length)
    own = F.floor(F.col("idx") / block)
    homes = F.when((F.col("idx") % block < length - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    w = Window.partitionBy("id", "_block").orderBy("idx").rowsBetween(0, length - 1)
    spread = series.select("id", "idx", F.col(col).alias("_v"), F.explode(homes).alias("_block"))
    return (
        spread.withColumn("values", F.collect_list("_v").over(w))
        .filter((F.floor(F.col("idx") / block) == F.col("_block")) & (F.size("values") == length))
        .select("id", "idx", "values")
    )


def _collected(value: Column, at: Column) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(at.alias("at"), value.alias("value"))))
    return F.transform(pairs, lambda p: p["value"])


def segments(df: DataFrame, length: int, order: RowOrder = RowOrder(), extra: Sequence[Column] = ()) -> DataFrame:
    """Non-overlapping blocks of ``length`` rows by position, complete ones only: ``id, segment, values``."""
    numbered = positions(df, order).withColumn("segment", F.floor((F.col("pos") - 1) / length))
    return (
        numbered.groupBy("id", "segment")
        .agg(_collected(F.col("usage"), F.col("pos")).alias("values"), F.count("usage").alias("_c"), *extra)
        .filter(F.col("_c") == length)
        .drop("_c")
    )


def _feature_rows(blocks: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per feature from blocks that hold ``rows ARRAY<STRUCT<at, f0, ...>>``."""
    def column_of(name: str) -> Column:
        return F.transform("rows", lambda r: r[name])

    per_feature = F.array(*[column_of(c) for c in features])
    return blocks.select(*keep, F.posexplode(per_feature).alias("feature", "values"))


def _blocks(df: DataFrame, length: int, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col("order").alias("at"), *features)))
    return (
        df.withColumn("segment", F.floor(F.col("order") / length))
        .groupBy(*keys, "segment")
        .agg(rows.alias("rows"), F.count("label").alias("_c"))
        .filter(F.col("_c") == length)
    )


def label_runs(df: DataFrame, order: RowOrder = RowOrder(("id",), ("order",))) -> DataFrame:
    """Add ``run``: the 1-based number of the maximal stretch of equal labels in row order."""
    df, order, own = deal(df, order)
    seen = lagged(df, {"_prev": "label"}, 1, order, seen="_has")
    starts = F.when(F.col("_has") & (F.col("label") == F.col("_prev")), 0).otherwise(1)
    return undealt(running_sum(seen.withColumn("_start", starts).drop("_prev", "_has"), "_start", "run", order).drop("_start"), own)


def run_segments(df: DataFrame, length: int, features: Sequence[str], drop_label=None) -> DataFrame:
    """Blocks by ``order div length`` inside each label run, complete ones only.

    ``id, run, segment, label, feature, values``; all features travel through
    one shuffle and become rows afterwards.
    """
    runs = label_runs(df)
    if drop_label is not None:
        runs = runs.filter(F.col("label") != F.lit(drop_label))
    keys = ("id", "run", "label")
    return _feature_rows(_blocks(runs, length, features, keys), features, (*keys, "segment"))


def label_segments(df: DataFrame, length: int, features: Sequence[str]) -> DataFrame:
    """Blocks by ``order div length`` inside each (id, label), complete ones only."""
    keys = ("id", "label")
    return _feature_rows(_blocks(df, length, features, keys), features, (*keys, "segment"))


def round_values(col, decimals: int) -> Column:
    """Half-even rounding of a number or of every element of an array."""
    return F.bround(col, decimals)


def segment_label(df: DataFrame, length: int = 30, order: RowOrder = SERIES, full: int = 30) -> DataFrame:
    """Blocks with ``label`` 1 iff some but fewer than ``full`` of their days are anomalous."""
    blocks = segments(df, length, order, extra=[F.sum(F.col("anomaly").cast("int")).alias("_a")])
    label = F.when((F.col("_a") > 0) & (F.col("_a") < full), 1).otherwise(0)
    return blocks.withColumn("label", label).drop("_a")


def segment_to_row(blocks: DataFrame, length: int = 30, keep: Sequence[str] = ("id", "segment", "label")) -> DataFrame:
    """One column per position of the block: ``v0 .. v{length-1}``."""
    return blocks.select(*keep, *[F.col("values")[i].alias(f"v{i}") for i in range(length)])


def day_grid(df: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """``id, day, h0..h23``; the first reading of an hour wins."""
    at = F.col(by[0]) if len(by) == 1 else F.struct(*by)  # a plain column keeps the hash aggregate
    hour = F.hour("date")
    cells = [F.min_by(F.when(hour == h, F.col("usage")), F.when(hour == h, at)).alias(f"h{h}") for h in range(24)]
    return df.groupBy("id", F.to_date("date").alias("day")).agg(*cells)


def _rescale(x: Column, low: Column, high: Column, lo: float, hi: float) -> Column:
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (x - low) / span * F.lit(float(hi - lo)) + F.lit(float(lo))


def minmax_by_series(df: DataFrame, lo: float = 0.0, hi: float = 1.0, col: str = "usage", keys: Sequence[str] = ("id",), bounded: bool = False) -> DataFrame:
    """Scale each meter to [lo, hi]; a constant meter becomes lo.

    The range is a map-side combined aggregate joined back, not a window over
    all rows of the meter.  For ``bounded`` series (resampled ones) the window
    is used: it reads its input once.
    """
    if bounded:
        w = Window.partitionBy(*keys)
        ranged = df.withColumn("_min", F.min(col).over(w)).withColumn("_max", F.max(col).over(w))
    else:
        ranged = df.join(df.groupBy(*keys).agg(F.min(col).alias("_min"), F.max(col).alias("_max")), list(keys))
    return ranged.withColumn(col, _rescale(F.col(col), F.col("_min"), F.col("_max"), lo, hi)).drop("_min", "_max")


def position_ranges(df: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Per key, the minimum and maximum at each vector position, as two arrays."""
    cells = df.select(*keys, F.posexplode("values").alias("pos", "v"))
    ends = cells.groupBy(*keys, "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return ends.groupBy(*keys).agg(
        _collected(F.col("lo"), F.col("pos")).alias("_los"), _collected(F.col("hi"), F.col("pos")).alias("_his")
    )


def minmax_by_position(df: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("feature",), lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Scale each vector position by the training ranges, unclipped.

    ``ranges`` holds one row per key; Spark broadcasts it when it is small.
    """
    if keys:
        joined, los, his = df.join(ranges, list(keys)), F.col("_los"), F.col("_his")
    else:
        both = ranges.select(F.struct("_los", "_his")).scalar()
        joined, los, his = df.withColumn("_both", both), F.col("_both")["_los"], F.col("_both")["_his"]
    scaled = F.transform("values", lambda x, i: _rescale(x, los[i], his[i], lo, hi))
    return joined.withColumn("values", scaled).drop("_los", "_his", "_both")


def standard_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column (0 deviation reads as 1)."""
    aggs = []
    for c in cols:
        dev = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"_m_{c}"), F.when(dev == 0, F.lit(1.0)).otherwise(dev).alias(f"_s_{c}")]
    return df.agg(*aggs)


def standardize(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """z-scores with the mean and population deviation of ``stats`` (by default of ``df``)."""
    if stats is None:
        df = cut(df)  # read twice: for the statistics and for the scores
        stats = standard_stats(df, cols)
    fitted = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumns({c: (F.col(c) - fitted[f"_m_{c}"]) / fitted[f"_s_{c}"] for c in cols})
