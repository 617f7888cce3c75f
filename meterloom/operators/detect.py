"""Rolling-band detection of sustained high (mining) and low (theft) usage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions import kernels
from meterloom.functions.calendar import date_to_jalali, seconds
from meterloom.operators.resample import resample
from meterloom.operators.windows import rolling_band
from meterloom.session import cut, spread

SCORED = 4096  # windows scored at once


@dataclass(frozen=True)
class DetectionParam:
    freq: str | int = "1D"
    window: int = 40
    std: float = 2.5
    m: int = 14
    n: float = 10

    def __post_init__(self):
        if self.n <= 0:
            raise ValueError("n must be positive: with n = 0 every run would last forever")


def band_breaches(series: DataFrame, param: DetectionParam = DetectionParam()) -> DataFrame:
    """Buckets of a resampled series outside the band of the previous ``window`` buckets."""
    band = rolling_band(series, param.window, param.std)
    return band.withColumn(
        "kind", F.when(F.col("usage") > F.col("upper"), "mining").when(F.col("usage") < F.col("lower"), "theft")
    ).filter("kind IS NOT NULL")


def _confirmed(series: DataFrame, param: DetectionParam, floor: float) -> DataFrame:
    """Add ``event``: the kind of a breach confirmed by at least n of the next m buckets, else null."""
    ahead = F.collect_list("usage").over(Window.partitionBy("id").orderBy("idx").rowsBetween(1, param.m))
    band = rolling_band(series, param.window, param.std).withColumn("_next", ahead if param.m > 0 else F.array().cast("array<double>"))
    above = F.size(F.filter("_next", lambda x: (x > F.col("upper")) & (x > floor)))
    below = F.size(F.filter("_next", lambda x: x < F.col("lower")))
    event = F.when((F.col("usage") > F.col("upper")) & (above >= param.n), "mining").when(
        (F.col("usage") < F.col("lower")) & (below >= param.n), "theft"
    )
    return band.withColumn("event", event).drop("_next")


def first_events(series: DataFrame, param: DetectionParam = DetectionParam(), floor: float = 20.0) -> DataFrame:
    """First confirmed breach per meter: ``id, idx, date, event``.

    Exact without scanning: before a meter's first event every bucket is usable
    and every position is visited.
    """
    hits = _confirmed(series, param, floor).filter("event IS NOT NULL")
    first = F.min(F.struct("idx", "date", "event")).alias("_f")
    return hits.groupBy("id").agg(first).select("id", "_f.idx", "_f.date", "_f.event")


def _scan(values: Column, param: DetectionParam, floor: float) -> Column:
    args = (param.window, param.std, param.m, param.n, floor)

    @F.pandas_udf("array<int>")
    def codes(usage: pd.Series) -> pd.Series:
        return usage.map(lambda u: kernels.scan_events(np.asarray(u, dtype=float), *args).astype(np.int32))

    # non-deterministic only so that a filter on the result does not evaluate it twice
    return codes.asNondeterministic()(values)


def scan(series: DataFrame, param: DetectionParam, floor: float = 20.0, step: int | None = None, keep_all: bool = False, flagged_only: bool = False) -> DataFrame:
    """Flag the buckets of a resampled series: ``id, idx, date, usage, mining, theft, to_use``.

    Meters without a first event cannot have flags, so only the others reach
    Python (all of them with ``keep_all``); ``flagged_only`` then drops meters
    that stayed without a flag.  One array per meter, bounded by the calendar.
    """
    step = step or seconds(param.freq)
    w = Window.partitionBy("id")
    marked = _confirmed(series, param, floor).withColumn("_any", F.max(F.col("event").isNotNull()).over(w))
    if not keep_all:
        marked = marked.filter("_any")
    per_meter = marked.groupBy("id").agg(
        F.min("date").alias("_t0"),
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "usage"))), lambda p: p["usage"]).alias("_u"),
    )
    flagged = per_meter.withColumn("_c", _scan(F.col("_u"), param, floor))
    if flagged_only:
        flagged = flagged.filter(F.exists("_c", lambda c: c.bitwiseAND(F.lit(kernels.MINING | kernels.THEFT)) != 0))
    rows = flagged.select("id", "_t0", F.posexplode(F.arrays_zip("_u", "_c")).alias("_i", "_r"))
    code = F.col("_r")["_c"]
    return rows.select(
        "id",
        F.col("_i").cast("long").alias("idx"),
        F.timestamp_seconds(F.unix_seconds("_t0") + F.col("_i").cast("long") * step).alias("date"),
        F.col("_r")["_u"].alias("usage"),
        (code.bitwiseAND(F.lit(kernels.MINING)) != 0).alias("mining"),
        (code.bitwiseAND(F.lit(kernels.THEFT)) != 0).alias("theft"),
        (code.bitwiseAND(F.lit(kernels.UNUSABLE)) == 0).alias("to_use"),
    )


def detect(df: DataFrame, param: DetectionParam = DetectionParam(), floor: float = 20.0) -> DataFrame:
    """Flagged buckets of every meter that has any flag, from raw readings."""
    return scan(resample(df, param.freq), param, floor, flagged_only=True)


def suspect_rows(flags: DataFrame) -> DataFrame:
    """The whole flagged series of meters with at least one flag (one pass: a series is bounded by the calendar)."""
    any_flag = F.max(F.col("mining") | F.col("theft")).over(Window.partitionBy("id"))
    return flags.withColumn("_any", any_flag).filter("_any").drop("_any")


def verdicts(flags: DataFrame) -> DataFrame:
    """``id, mining, theft``: one row per meter and kind, so a meter with both has two."""
    found = flags.groupBy("id").agg(F.bool_or("mining").alias("_m"), F.bool_or("theft").alias("_t"))
    kind = lambda mining: F.struct(F.lit(mining).alias("mining"), F.lit(not mining).alias("theft"))
    kinds = F.array_compact(F.array(F.when(F.col("_m"), kind(True)), F.when(F.col("_t"), kind(False))))
    return found.select("id", F.explode(kinds).alias("_k")).select("id", "_k.mining", "_k.theft")


def plot_points(flags: DataFrame, user_id, kind: str) -> DataFrame:
    """One meter's series with its flagged points and Jalali labels; empty unless ``kind`` occurs."""
    series = flags.filter(F.col("id") == F.lit(user_id))
    occurs = series.agg(F.coalesce(F.bool_or(kind), F.lit(False))).scalar()
    points = series.filter(occurs).withColumn("point", F.when(F.col(kind), F.col("usage")))
    return date_to_jalali(points, "date").select("id", "date", "jalali", "usage", "point")


PROFILE_TILE = 1024  # windows per side of one tile


def matrix_profile(series: DataFrame, m: int = 4) -> DataFrame:
    """``id, idx, nearest, distance`` for each length-m window of a resampled series.

    A series is cut into slices of ``PROFILE_TILE`` windows and every pair of
    its slices is one tile, measured for both sides: a long series spreads
    over all tasks. The least distance wins, of equal ones the smaller position.
    Windows with unknown values, or without another outside their zone, give no row.
    """
    from meterloom.operators.distance import series_arrays

    id_type = series.schema["id"].dataType
    last = F.floor((F.size("values") - m) / PROFILE_TILE).cast("int")
    piece = lambda i: F.slice("values", F.col(i) * PROFILE_TILE + 1, F.lit(PROFILE_TILE + m - 1))
    pairs = (
        series_arrays(series).filter(F.size("values") >= m)
        .select("id", "values", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
        .select("id", "values", "_i", F.explode(F.sequence("_i", "_last")).alias("_j"))
    )
    tiles = spread(pairs.select("id", "_i", "_j", piece("_i").alias("_a"), F.when(F.col("_i") != F.col("_j"), piece("_j")).alias("_b")), "id", "_i", "_j")

    def measure(batches):
        for batch in batches:
            ids, idx, nearest, distance = [], [], [], []
            for key, i, j, a, b in batch.itertuples(index=False):
                a = np.asarray(a, dtype=float)
                b = a if i == j else np.asarray(b, dtype=float)
                to_a, near_a, to_b, near_b = kernels.profile_tile(a, b, m, i * PROFILE_TILE, j * PROFILE_TILE)
                sides = [(i, to_a, near_a)] if i == j else [(i, to_a, near_a), (j, to_b, near_b)]
                for block, gap, near in sides:
                    known = np.flatnonzero(np.isfinite(gap))
                    ids.append(np.full(len(known), key, dtype=object))
                    idx.append(block * PROFILE_TILE + known)
                    nearest.append(near[known])
                    distance.append(gap[known])
            if ids:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("id", "idx", "nearest", "distance"), (ids, idx, nearest, distance))})

    found = tiles.mapInPandas(measure, T.StructType([
        T.StructField("id", id_type), T.StructField("idx", T.LongType()), T.StructField("nearest", T.LongType()), T.StructField("distance", T.DoubleType()),
    ]))
    best = found.groupBy("id", "idx").agg(F.min(F.struct("distance", "nearest")).alias("_b"))
    return best.select("id", "idx", "_b.nearest", "_b.distance")


def reconstruction_error(series: DataFrame, length: int = 168, components: int = 4, train_share: float = 0.5) -> DataFrame:
    """Mean absolute error of PCA-reconstructed windows, flagged above the largest training error.

    Windows of the first ``train_share`` of each meter train the model, the
    rest are judged: ``id, idx, train, error, anomaly``. The model is PCA, a
    linear stand-in for an autoencoder.

    Training forms no window: a window covariance consists of stretches of the
    series' products at each lag (``kernels.lag_products``), summed per task to
    one length x length matrix and added by Spark. Scoring slides over each
    meter's array in blocks. Without training windows every error is null.
    """
    from meterloom.operators.distance import series_arrays

    arrays = cut(spread(series_arrays(series).filter(F.size("values") >= length)))  # read to train and to judge

    level = F.aggregate("values", F.lit(0.0), lambda total, x: total + x) / F.size("values")
    shift = arrays.agg(F.avg(level).alias("m")).first()["m"] or 0.0  # keeps the products small far from the origin

    def trained(n: int) -> int:
        return int(np.floor((n - length + 1) * train_share))

    def gather(batches):
        n, total, outer = 0, np.zeros(length), np.zeros((length, length))
        for batch in batches:
            for values in batch["values"]:
                u = np.asarray(values, dtype=float)
                t = trained(len(u))
                if t:
                    one, two = kernels.lag_products(u - shift, length, t)
                    n, total, outer = n + t, total + one, outer + two
        yield pd.DataFrame({"pos": np.arange(length + 1), "n": n, "row": list(np.vstack([outer, total]))})

    rows = arrays.mapInPandas(gather, "pos int, n long, row array<double>").select("pos", "n", F.posexplode("row").alias("col", "v"))
    sums = rows.groupBy("pos", "col").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # (length + 1) x length
    table, n = np.zeros((length + 1, length)), 0
    for r in sums:
        table[r["pos"], r["col"]], n = r["v"], r["n"]
    centre = table[length] / n if n else np.full(length, np.nan)
    spreads = table[:length] / n - np.outer(centre, centre) if n else np.zeros((length, length))
    basis = np.linalg.eigh(spreads)[1][:, ::-1][:, :components]  # length x components

    def judge(batches):
        for batch in batches:
            for key, values in batch[["id", "values"]].itertuples(index=False):
                frames = np.lib.stride_tricks.sliding_window_view(np.asarray(values, dtype=float), length)
                for s in range(0, len(frames), SCORED):
                    x = frames[s : s + SCORED] - shift - centre
                    error = np.abs(x - x @ basis @ basis.T).mean(axis=1)
                    at = np.arange(s, s + len(x))
                    yield pd.DataFrame({"id": [key] * len(x), "idx": at, "train": at < trained(len(values)), "error": error})

    scored = cut(arrays.mapInPandas(judge, T.StructType([
        T.StructField("id", series.schema["id"].dataType), T.StructField("idx", T.LongType()),
        T.StructField("train", T.BooleanType()), T.StructField("error", T.DoubleType()),
    ])))  # four narrow columns
    limit = scored.filter("train").agg(F.max("error")).scalar()
    return scored.withColumn("anomaly", ~F.col("train") & (F.col("error") > limit))


def class_score(verdict: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``score``: the share of labelled meters judged right.

    ``verdict`` is ``id, mining, theft`` (any number of rows per meter), absent
    meters count as unflagged; ``labels`` is ``id, normal, mining, theft``.
    A normal meter is right unless both kinds were found.
    """
    return judged(verdict, labels).agg(F.avg(F.col("right").cast("int")).alias("score"))


def judged(verdict: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    found = verdict.groupBy(*keys, "id").agg(F.bool_or("mining").alias("_m"), F.bool_or("theft").alias("_t"))
    joined = labels.join(found, [*keys, "id"], "left").na.fill(False, ["_m", "_t"])
    right = (
        F.when(F.col("normal") != 0, ~(F.col("_m") & F.col("_t")))
        .when(F.col("mining") != 0, F.col("_m"))
        .when(F.col("theft") != 0, F.col("_t"))
        .otherwise(F.col("_m") | F.col("_t"))
    )
    return joined.withColumn("right", right)


def seeded_params(count: int, seed: int = 0) -> list[DetectionParam]:
    """``count`` parameter sets drawn from the search ranges, always the same for a seed."""
    rng = np.random.default_rng(seed)
    # fixed values: freq 1-7 days, window 10-50, std 1-5, m 0-30, n 0.5-1
    return [
        DetectionParam(
            int(rng.integers(1, 8)), int(rng.integers(10, 51)), float(rng.uniform(1, 5)),
            int(rng.integers(0, 31)), float(rng.uniform(0.5, 1)),
        )
        for _ in range(count)
    ]


def param_search(df: DataFrame, labels: DataFrame, clusters: DataFrame, params: Sequence[DetectionParam], floor: float = 20.0) -> DataFrame:
    """Best parameter set per user cluster by 1 - score: ``cluster, param, freq, window, std, m, n, error``.

    ``clusters`` is ``cluster, id``.  All parameter sets run in one job: each
    meter's array is paired with every set of its frequency.
    """
    spark = df.sparkSession
    rows = [(i, int(p.freq), p.window, float(p.std), p.m, float(p.n)) for i, p in enumerate(params)]
    table = spark.createDataFrame(rows, "param int, freq int, window int, std double, m int, n double")
    members = clusters.join(labels, "id")
    useful = df.join(members.select("id").distinct(), "id", "left_semi")
    from meterloom.operators.distance import series_arrays

    arrays = [
        series_arrays(resample(useful, f)).withColumn("freq", F.lit(f)) for f in sorted({p.freq for p in params})
    ]
    stacked = arrays[0]
    for part in arrays[1:]:
        stacked = stacked.unionByName(part)

    @F.pandas_udf("int")
    def kinds(u: pd.Series, window: pd.Series, std: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        found = [
            int(np.bitwise_or.reduce(kernels.scan_events(np.asarray(x, dtype=float), w, s, a, b, floor), initial=0))
            for x, w, s, a, b in zip(u, window, std, m, n)
        ]
        return pd.Series(found)

    tried = stacked.join(F.broadcast(table), "freq")  # the table is the caller's list
    found = tried.select("param", "id", kinds("values", "window", "std", "m", "n").alias("_k")).select(
        "param", "id",
        (F.col("_k").bitwiseAND(F.lit(kernels.MINING)) != 0).alias("mining"),
        (F.col("_k").bitwiseAND(F.lit(kernels.THEFT)) != 0).alias("theft"),
    )
    wanted = members.withColumn("param", F.explode(F.sequence(F.lit(0), F.lit(len(params) - 1))))
    scores = judged(found, wanted, ["param"]).groupBy("cluster", "param").agg(
        (F.lit(1.0) - F.avg(F.col("right").cast("int"))).alias("error")
    )
    best = scores.groupBy("cluster").agg(F.min(F.struct("error", "param")).alias("_b"))
    return best.select("cluster", "_b.param", "_b.error").join(F.broadcast(table), "param")
