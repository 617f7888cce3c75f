"""Image encodings as tables: ``id, image, row, pixels``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.ordered import SERIES, RowOrder, hash_rank, positions
from meterloom.operators.resample import resample
from meterloom.operators.windows import _collected, minmax_by_series, segments


def _gray(df: DataFrame, order: RowOrder, width: int, complete: int, height: int | None, half: bool = False) -> DataFrame:
    """Scale to 0-255, keep complete blocks, truncate, lay out ``width`` pixels a row."""
    placed = positions(minmax_by_series(df, 0, 255, bounded=order.bounded), order, "_p", "_n")
    at = F.col("_p") - 1
    last = F.floor(F.col("_n") / 2) if half else F.col("_n")
    whole = F.floor(last / complete) * complete  # an incomplete tail is dropped
    cells = placed.filter(at < whole).select(
        "id", at.alias("_at"), F.floor("usage").cast("int").alias("_px"), whole.alias("_w")
    )
    if height:
        cells = cells.filter(F.col("_at") < F.floor(F.col("_w") / (width * height)) * (width * height))
    rows = cells.groupBy("id", F.floor(F.col("_at") / width).alias("_row")).agg(_collected(F.col("_px"), F.col("_at")).alias("pixels"))
    image = F.floor(F.col("_row") / height) if height else F.lit(0).cast("long")
    row = F.col("_row") % height if height else F.col("_row")
    return rows.select("id", image.alias("image"), row.alias("row"), "pixels")


def gray_month_image(df: DataFrame, order: RowOrder = RowOrder()) -> DataFrame:
    """24 x 30 images of consecutive readings, from complete days of 24; surplus readings are dropped."""
    return _gray(df, order, 30, 24, 24)


def gray_week_image(df: DataFrame) -> DataFrame:
    """One image per meter: a row per complete week of hourly sums."""
    return _gray(resample(df, "1H"), SERIES, 168, 168, None)


def gray_half_image(df: DataFrame) -> DataFrame:
    """The same from the first half of the hours; a partial row is dropped."""
    return _gray(resample(df, "1H"), SERIES, 168, 168, None, half=True)


PIXELS = 1 << 19  # pixels sent on at once


def _matrix_image(blocks: DataFrame, encode) -> DataFrame:
    """``id, image, row, pixels`` from ``id, segment, values``; a few images stand in memory at a time, however many blocks there are."""
    kind = blocks.schema["id"].dataType.simpleString()
    place = blocks.schema["segment"].dataType.simpleString()

    def sent(ids, images: list[np.ndarray]) -> pa.RecordBatch:
        sides = np.array([len(m) for m in images])
        at = np.repeat(np.arange(len(sides)), sides)
        ends = np.concatenate([[0], np.cumsum(sides[at])]).astype(np.int32)
        pixels = pa.ListArray.from_arrays(ends, np.concatenate([m.ravel() for m in images]))
        rows = pa.array(np.concatenate([np.arange(n) for n in sides]), pa.int32())
        return pa.RecordBatch.from_arrays([ids[0].take(at), ids[1].take(at), rows, pixels], ["id", "image", "row", "pixels"])

    def run(batches):
        for batch in batches:
            values, images, done = batch["values"], [], []
            for i in range(len(batch)):
                if values[i].is_valid and len(values[i]):
                    known = values[i].values
                    images.append(np.ascontiguousarray(encode(np.asarray(known.to_numpy(zero_copy_only=False), dtype=float), known.is_null().to_numpy(zero_copy_only=False))))
                    done.append(i)
                if done and (i + 1 == len(batch) or sum(m.size for m in images) >= PIXELS):
                    yield sent([batch[c].take(pa.array(done)) for c in ("id", "segment")], images)
                    images, done = [], []

    rows = blocks.select("id", "segment", F.col("values").cast("array<double>").alias("values"))
    return rows.mapInArrow(run, f"id {kind}, image {place}, row int, pixels array<double>")


def gramian_field(blocks: DataFrame) -> DataFrame:
    """cos(phi_i + phi_j) of each block scaled to [-1, 1]; from ``id, segment, values``. Unknown values count as the lowest."""

    def encode(x, unknown):
        known = x[~unknown]
        low, high = (np.fmin.reduce(known), known.max()) if len(known) else (np.nan, np.nan)
        with np.errstate(invalid="ignore"):
            x = (x - low) / (1.0 if low == high or np.isnan(low) else high - low) * 2 - 1
        x = np.where(unknown, -1.0, np.where(np.isnan(x), 1.0, np.clip(x, -1.0, 1.0)))
        y = np.sqrt(1.0 - x * x)
        return np.multiply.outer(x, x) - np.multiply.outer(y, y)

    return _matrix_image(blocks, encode)


def markov_field(blocks: DataFrame, bins: int = 5) -> DataFrame:
    """Transition probability between the quantile bins of points i and j of each block."""

    def encode(x, _):
        edges = np.percentile(x, np.linspace(0, 100, bins + 1)[1:-1])
        q = np.searchsorted(edges, x, side="left")
        counts = np.zeros((bins, bins))
        np.add.at(counts, (q[:-1], q[1:]), 1)
        total = counts.sum(axis=1, keepdims=True)
        return (counts / np.where(total == 0, 1, total))[q[:, None], q[None, :]]

    return _matrix_image(blocks, encode)


def recurrence_plot(blocks: DataFrame, percentage: float = 20) -> DataFrame:
    """1 where two points of a block differ by less than the given percentile of all differences."""

    def encode(x, _):
        gap = np.abs(x[:, None] - x[None, :])
        return (gap < np.percentile(gap, percentage)).astype(float)

    return _matrix_image(blocks, encode)


def sampled_square_image(df: DataFrame, side: int = 64, order: RowOrder = RowOrder(), seed=0) -> DataFrame:
    """``side`` random chunks of ``side`` readings out of the first floor(sqrt(n)), in order, scaled to 0-255.

    Meters with fewer than ``side`` such chunks yield no image.
    """
    placed = positions(df, order, "_p", "_n").withColumn("segment", F.floor((F.col("_p") - 1) / side))
    root = F.floor(F.sqrt("_n"))
    chunks = (
        placed.filter((F.col("segment") < root) & (root >= side))
        .groupBy("id", "segment")
        .agg(_collected(F.col("usage"), F.col("_p")).alias("values"))
    )
    picked = hash_rank(chunks, ("id", "segment"), seed, ("id",), name="_r", total="_c").filter(F.col("_r") <= side)
    ends = picked.groupBy("id").agg(
        F.min(F.array_min("values")).alias("_lo"), F.max(F.array_max("values")).alias("_hi"), F.sort_array(F.collect_list("segment")).alias("_s")
    )
    span = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    pixels = F.transform("values", lambda x: F.bround((x - F.col("_lo")) / F.col("_span") * 255, 0).cast("int"))
    laid = picked.join(ends.withColumn("_span", span), "id").withColumn("row", F.array_position("_s", F.col("segment")) - 1)
    return laid.select("id", F.lit(0).cast("long").alias("image"), "row", pixels.alias("pixels"))
