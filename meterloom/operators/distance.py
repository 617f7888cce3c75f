"""DTW distances between series.

Two forms.  ``dtw_within`` finds every pair closer than a radius through an
index of cells, chunks and envelopes, and scales with its output; identical
series are joined once, as one representative.  ``dtw_matrix`` is the full
n-squared matrix, dealt out in tiles of equal size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import kernels
from meterloom.functions.kernels import dtw
from meterloom.operators.ordered import SERIES
from meterloom.operators.resample import resample
from meterloom.operators.windows import minmax_by_series, segments
from meterloom.session import cut, spread

TILE = 128  # series per side of one tile of the matrix
CHUNK = 512  # series per side of one tile of near series
CROWD = 1024  # series of one cell above which its range divides it further
PAIR_VALUES = 1 << 22  # values of both sides measured at once
LENGTHS = 16  # of the longest array, so many kinds of lengths are told apart
PIECES = 8  # pieces of a series with an envelope each


def series_arrays(series: DataFrame, col: str = "usage", keys: Sequence[str] = ("id",)) -> DataFrame:
    """One array per meter, ordered by ``idx``."""
    pairs = F.sort_array(F.collect_list(F.struct("idx", F.col(col).alias("v"))))
    return series.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def series_dataset(series: DataFrame) -> DataFrame:
    """One array per meter, padded with null to the longest series."""
    arrays = series_arrays(series)
    longest = series.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").cast("int")).scalar()
    padding = F.array_repeat(F.lit(None).cast("double"), longest - F.size("values"))
    return arrays.withColumn("values", F.concat("values", padding))


def _measured(values, a: np.ndarray, b: np.ndarray, kernel) -> np.ndarray:
    """``kernel`` on the arrays at places ``a`` and ``b``; arrays of about one length are padded and stacked once, not once per pair."""
    n = np.array([0 if v is None else len(v) for v in values], dtype=int)
    kind = -(-n // max(1, n.max(initial=0) // LENGTHS))
    place, stacked = np.zeros(len(n), dtype=int), {}
    for size in np.unique(kind[n > 0]):
        own = np.flatnonzero(kind == size)
        place[own] = np.arange(len(own))
        stacked[size] = kernels.padded([values[i] for i in own])[0].astype(getattr(values[own[0]], "dtype", float), copy=False)
    out = np.full(len(a), np.nan)
    both = kind[a] * (kind.max(initial=0) + 1) + kind[b]
    for each in np.unique(both):
        rows = np.flatnonzero(both == each)
        x, y = kind[a[rows[0]]], kind[b[rows[0]]]
        if not x or not y:
            continue
        step = max(1, PAIR_VALUES // (stacked[x].shape[1] + stacked[y].shape[1]))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            p, q = a[part], b[part]
            out[part] = kernel(stacked[x][place[p]], stacked[y][place[q]], n[p], n[q])
    return out


def _tiles(df: DataFrame, keys: list[str]):
    """Pairs of blocks of about ``TILE`` series of one key: the rows of each tile, and a kernel for one tile.

    Series are hashed to blocks, so tiles spread over all tasks and an array is
    shipped once per block, not once per pair.
    """
    df = cut(df)  # read for the count and for the tiles
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-largest // TILE), min(-(-largest // 16), math.isqrt(4 * least)))  # few series still use every core
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = (
        df.select(*keys, "id", "values", own.alias("_b"))
        .withColumn("_o", other)
        .withColumn("_i", F.least("_b", "_o"))
        .withColumn("_j", F.greatest("_b", "_o"))
    )
    tiles = spread(tiles, *keys, "_i", "_j")  # bytes say little about the work in a tile

    def measured(pdf: pd.DataFrame):
        """Places of both ends of every pair, their distances, and the places of the two sides."""
        owner = pdf["_b"].to_numpy()
        left = np.flatnonzero(owner == pdf["_i"].iloc[0])
        right = np.flatnonzero(owner == pdf["_j"].iloc[0])
        if pdf["_i"].iloc[0] == pdf["_j"].iloc[0]:
            p, q = np.triu_indices(len(left), 1)
        else:
            p, q = (g.ravel() for g in np.indices((len(left), len(right))))
        a, b = left[p], right[q]
        return a, b, _measured(pdf["values"].to_numpy(), a, b, kernels.dtw_pairs)

    return tiles, measured


def dtw_matrix(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full distance matrix as edges ``a < b`` of ``id, values``, per key: ``keys, a, b, dist``."""
    keys = list(keys)
    tiles, measured = _tiles(df, keys)
    kind = df.schema["id"].dataType.simpleString()
    head = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        a, b, dist = measured(pdf)
        out = pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "dist": dist})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "a", "b", "dist"]]

    return tiles.groupBy(*keys, "_i", "_j").applyInPandas(tile, f"{head}a {kind}, b {kind}, dist double")


def dtw_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full distance matrix as packed rows ``keys, node, others, dists``: a row per series and tile, not one per pair."""
    keys = list(keys)
    tiles, measured = _tiles(df, keys)
    kind = df.schema["id"].dataType.simpleString()
    head = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        a, b, dist = measured(pdf)
        ends, far = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(ends, kind="stable")
        nodes, starts = np.unique(ends[order], return_index=True)
        split = lambda v: pd.Series(np.split(v[order], starts[1:]) if len(nodes) else [], dtype=object)
        out = pd.DataFrame({"node": ids[nodes], "others": split(ids[far]), "dists": split(np.concatenate([dist, dist]))})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "node", "others", "dists"]]

    return tiles.groupBy(*keys, "_i", "_j").applyInPandas(tile, f"{head}node {kind}, others array<{kind}>, dists array<double>")


def copies(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each distinct array once: ``keys, values, id`` (the smallest) and ``copies``."""
    return df.groupBy(*keys, "values").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def representatives(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``id, rep`` for every row: which representative stands for it in ``dtw_within``."""
    reps = copies(df, keys).withColumnRenamed("id", "rep").drop("copies")
    return df.join(reps, [*keys, "values"]).select(*keys, "id", "rep")


def _envelopes(values: list) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of ``PIECES`` pieces of every array; a piece without a value of its own shows the next one."""
    at = np.arange(PIECES)
    los, his = np.empty((len(values), PIECES)), np.empty((len(values), PIECES))
    for i, v in enumerate(values):
        v = np.asarray(v, dtype=float)
        starts = at * len(v) // PIECES
        if len(v) >= PIECES:
            los[i], his[i] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        else:
            los[i] = his[i] = v[starts]
    return los, his


def _least_path(x: tuple, y: tuple) -> np.ndarray:
    """Lower bound of the squared distance of every pair but for its ends: each value of x lies, piece by piece in order, at least as far from y as its piece's envelope does from one of y's."""
    los, his, n = x
    weight = np.diff(np.arange(PIECES + 1) * n[:, None] // PIECES, axis=1).astype(float)
    first = (weight > 0).argmax(axis=1)
    weight[np.arange(len(n)), first] -= 1  # both ends are counted exactly elsewhere
    weight[:, -1] -= 1
    weight = np.maximum(weight, 0)
    best = np.zeros((len(n), PIECES))
    for p in range(PIECES):
        gap = np.maximum(0.0, np.maximum(los[:, p, None] - y[1], y[0] - his[:, p, None]))
        best = np.minimum.accumulate(best, axis=1) + weight[:, p, None] * gap * gap
    return best.min(axis=1)


def near_pairs(df: DataFrame, radius: float, keys: Sequence[str] = (), measure: bool = True) -> DataFrame:
    """``keys, a, b, dist``: pairs of ``id, values`` below the radius; without ``measure`` all pairs that no bound puts beyond it, ``dist`` null.

    Series fall into cells by their ends, crowded cells also by their range, and
    cells into chunks of ``CHUNK`` at most; pairs of chunks of neighbouring cells
    are tiles of equal size, however many series share a cell, and an array is
    shipped once per tile. A tile drops pairs by their ends and ranges, then by
    the envelopes of the pieces of longer arrays, and measures the rest, giving
    a pair up once it exceeds the radius.
    """
    keys = list(keys)
    v = F.col("values")
    rows = df.filter(F.size(v) > 0).select(*keys, "id", "values", v[0].alias("_f"), F.element_at(v, -1).alias("_l"), F.array_min(v).alias("_lo"), F.array_max(v).alias("_hi"))
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    place, deep = [*keys, "_x", "_y"], [*keys, "_x", "_y", "_u", "_v"]
    rows = rows.withColumn("_x", cell("_f")).withColumn("_y", cell("_l"))
    rows = cut(rows)
    crowded = rows.groupBy(*place).count().filter(F.col("count") > CROWD).select(*place, F.lit(True).alias("_crowded"))
    rows = rows.join(cut(crowded), place, "left")
    for name, end in (("_u", "_lo"), ("_v", "_hi")):
        rows = rows.withColumn(name, F.when(F.col("_crowded"), cell(end)).otherwise(F.lit(0)))
    rows = cut(rows.drop("_crowded"))
    ranges = [f(c).alias(f"{c}{f.__name__}") for c in ("_f", "_l", "_lo", "_hi") for f in (F.min, F.max)]
    size = min(CHUNK, max(64, rows.count() // 64))  # few series still make tiles for every core
    cells = cut(rows.groupBy(*deep).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_chunks"), *ranges))
    chunk = F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int").alias("_chunk")
    rows = rows.join(cells.select(*deep, "_chunks"), deep).select(*deep, chunk, "id", "values")
    here = F.struct("_x", "_y", "_u", "_v")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    own = [c for c in cells.columns if c not in keys]
    left = cells.select(*keys, here.alias("a"), *[F.col(c).alias(f"a{c}") for c in own], F.col("_x").alias("_i"), F.col("_y").alias("_j"))
    right = cells.select(*keys, here.alias("b"), *[F.col(c).alias(f"b{c}") for c in own], around("_x").alias("_i")).withColumn("_j", around("b_y"))
    apart = lambda c: F.greatest(F.col(f"a{c}min") - F.col(f"b{c}max"), F.col(f"b{c}min") - F.col(f"a{c}max")) >= radius
    near = left.join(right, [*keys, "_i", "_j"]).filter((F.col("a") <= F.col("b")) & ~(apart("_f") | apart("_l") | apart("_lo") | apart("_hi")))
    side = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_chunks") - 1))
    tiles = near.select(*keys, "a", "b", side("a").alias("_p"), "b_chunks").withColumn("_q", side("b")).filter((F.col("a") < F.col("b")) | (F.col("_p") <= F.col("_q")))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("c"), F.col("_p").alias("_chunk")), F.struct(F.lit(1).alias("side"), F.col("b").alias("c"), F.col("_q").alias("_chunk"))))
    same = (F.col("a") == F.col("b")) & (F.col("_p") == F.col("_q"))
    sides = tiles.select(*keys, F.struct("a", "b", "_p", "_q").alias("_tile"), same.alias("_same"), ends.alias("e")).filter(~(F.col("_same") & (F.col("e.side") == 1)))
    sides = sides.select(*keys, "_tile", "_same", F.col("e.side").alias("_side"), "e.c.*", F.col("e._chunk").alias("_chunk"))
    members = sides.join(rows, [*deep, "_chunk"]).select(*keys, F.xxhash64("_tile").alias("_tile_hash"), F.to_json("_tile").alias("_tile"), "_same", "_side", "id", "values")
    kind = df.schema["id"].dataType.simpleString()
    head = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    square = radius * radius * (1 + 1e-9)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, side, values = pdf["id"].to_numpy(), pdf["_side"].to_numpy(), pdf["values"].to_numpy()
        f, l, lo, hi = (np.array([g(v) for v in values], dtype=float) for g in (lambda v: v[0], lambda v: v[-1], np.min, np.max))
        n = np.array([len(v) for v in values])
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if pdf["_same"].iloc[0]:
            p, q = (p[i] for i in np.triu_indices(len(p), 1))
        else:
            p, q = (g.ravel() for g in np.meshgrid(p, q, indexing="ij"))
        ends = (f[p] - f[q]) ** 2 + np.where((n[p] > 1) | (n[q] > 1), (l[p] - l[q]) ** 2, 0.0)
        fit = (ends < square) & (np.abs(lo[p] - lo[q]) < radius) & (np.abs(hi[p] - hi[q]) < radius)
        p, q, ends = p[fit], q[fit], ends[fit]
        if n.max() > 4 * PIECES:  # shorter arrays are measured as fast as bounded
            los, his = _envelopes(values)
            for turn in (False, True):
                x, y = (q, p) if turn else (p, q)
                fit = ends + _least_path((los[x], his[x], n[x]), (los[y], his[y])) < square
                p, q, ends = p[fit], q[fit], ends[fit]
        dist = np.full(len(p), np.nan)
        if measure and len(p):
            below = lambda at, most: _measured(at, p, q, lambda x, y, nx, ny: kernels.dtw_pairs_below(x, y, most, nx, ny))
            near, wide, exact = kernels.rounded(values, radius) or (values, radius, True)
            dist = below(near, wide)
            fit = ~np.isnan(dist)
            p, q, dist = p[fit], q[fit], dist[fit]
            if not exact:  # few are left
                dist = below(values, radius)
                fit = ~np.isnan(dist)
                p, q, dist = p[fit], q[fit], dist[fit]
        out = pd.DataFrame({"a": np.minimum(ids[p], ids[q]), "b": np.maximum(ids[p], ids[q]), "dist": dist})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "a", "b", "dist"]]

    members = spread(members, *keys, "_tile_hash", "_tile")
    return members.groupBy(*keys, "_tile_hash", "_tile").applyInPandas(tile, f"{head}a {kind}, b {kind}, dist double")


def dtw_within(df: DataFrame, radius: float, keys: Sequence[str] = (), every: bool = False) -> DataFrame:
    """Every pair of distinct arrays at DTW distance below ``radius``: ``keys, a, b, dist`` with a < b.

    Exact copies are linked at distance 0 to the smallest of them, which alone
    pairs with other arrays (``near_pairs``): a copy has the links of its
    representative. With ``every`` all pairs of rows are listed, those of copies too.
    """
    keys = list(keys)
    df = cut(df)  # read for the representatives and for the copies
    if every:
        return _every_pair(df, radius, keys)
    pairs = near_pairs(copies(df, keys), radius, keys)
    same = representatives(df, keys).filter("id <> rep").select(*keys, F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("dist"))
    return pairs.unionByName(same)


def _every_pair(df: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """All pairs of rows below the radius: distinct arrays are measured once, then each pair of them is told to all their rows.

    Arrays are numbered, as their ids may repeat. The rows of one array are dealt
    into parts of about ``CROWD``, so no task forms all pairs of an array with many copies.
    """
    known = df.filter(F.size("values") > 0)
    arrays = cut(copies(known, keys).select(*keys, F.monotonically_increasing_id().alias("g"), "values", F.ceil(F.col("copies") / CROWD).cast("int").alias("parts"), "copies"))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int")
    rows = cut(known.join(arrays.drop("copies"), [*keys, "values"]).select("g", deal.alias("part"), "id"))
    near = near_pairs(arrays.select(*keys, F.col("g").alias("id"), "values"), radius, keys)
    near = near.unionByName(arrays.filter("copies > 1").select(*keys, F.col("g").alias("a"), F.col("g").alias("b"), F.lit(0.0).alias("dist")))
    part = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"_{c}") - 1))
    for c in ("a", "b"):
        near = near.join(arrays.select(F.col("g").alias(c), F.col("parts").alias(f"_{c}")), c)
    near = near.withColumn("_p", part("a")).withColumn("_q", part("b"))
    for c, p in (("a", "_p"), ("b", "_q")):
        near = near.join(rows.select(F.col("g").alias(c), F.col("part").alias(p), F.col("id").alias(f"{c}_id")), [c, p])
    # two arrays meet once, in either order; the rows of one array meet in both
    near = near.filter((F.col("a_id") < F.col("b_id")) | ((F.col("a") != F.col("b")) & (F.col("a_id") > F.col("b_id"))))
    return near.select(*keys, F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "dist")


def similar_pairs(df: DataFrame, k: int = 10, users: int = 100, freq="7D", seed=0) -> DataFrame:
    """The k closest pairs among ``users`` sampled meters, on sums per ``freq``."""
    from meterloom.operators.split import sample_users

    arrays = series_arrays(resample(sample_users(df, users, seed), freq))
    return dtw_matrix(arrays).orderBy("dist", "a", "b").limit(k)


def week_on_week_dtw(df: DataFrame) -> DataFrame:
    """DTW of each day to the same day a week later: ``id, week, day, usage`` scaled to 0-255 per meter and day.

    Only complete weeks of hours count; day 0 is the meter's first day.
    """
    weeks = segments(resample(df, "1H"), 168, SERIES)
    by_day = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.slice("values", d * 24 + 1, 24))
    days = weeks.select("id", "segment", F.posexplode(by_day).alias("day", "values"))
    nxt = F.lead("values").over(Window.partitionBy("id", "day").orderBy("segment"))
    paired = days.withColumn("_next", nxt).filter("_next IS NOT NULL")
    measured = paired.select("id", F.col("segment").alias("week"), "day", dtw("values", "_next").alias("usage"))
    return minmax_by_series(measured, 0, 255, keys=("id", "day"), bounded=True)
