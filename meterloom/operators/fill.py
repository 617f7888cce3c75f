"""Gap filling inside each meter."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.ordered import RowOrder, neighbours


class FillMode(Enum):
    NONE = "none"
    DROP = "drop"
    PREVIOUS = "previous"
    NEXT = "next"
    LINEAR = "linear"


def fill_none(df: DataFrame, order: RowOrder = RowOrder()) -> DataFrame:
    return df


def fill_drop(df: DataFrame, order: RowOrder = RowOrder()) -> DataFrame:
    return df.na.drop("any")


def _nearest(df: DataFrame, order: RowOrder, first: str, second: str) -> DataFrame:
    near = neighbours(df, "usage", order)
    return near.withColumn("usage", F.coalesce(F.col(first)["value"], F.col(second)["value"])).drop("pos", "prev", "next")


def fill_previous(df: DataFrame, order: RowOrder = RowOrder()) -> DataFrame:
    return _nearest(df, order, "prev", "next")


def fill_next(df: DataFrame, order: RowOrder = RowOrder()) -> DataFrame:
    return _nearest(df, order, "next", "prev")


def fill_linear(df: DataFrame, order: RowOrder = RowOrder(), decimals: int = 5) -> DataFrame:
    """Interpolate by row position; a trailing gap repeats the last value, a leading gap stays."""
    near = neighbours(df, "usage", order)
    p, n = F.col("prev"), F.col("next")
    slope = (n["value"] - p["value"]) / F.nullif(n["pos"] - p["pos"], F.lit(0))
    value = (
        F.when(F.col("usage").isNotNull(), F.col("usage"))
        .when(p.isNotNull() & n.isNotNull(), p["value"] + slope * (F.col("pos") - p["pos"]))
        .when(p.isNotNull(), p["value"])
    )
    return near.withColumn("usage", F.bround(value, decimals)).drop("pos", "prev", "next")


METHODS = {
    FillMode.NONE: fill_none,
    FillMode.DROP: fill_drop,
    FillMode.PREVIOUS: fill_previous,
    FillMode.NEXT: fill_next,
    FillMode.LINEAR: fill_linear,
}


def fill(df: DataFrame, mode: FillMode | str, order: RowOrder = RowOrder()) -> DataFrame:
    return METHODS[FillMode(mode)](df, order)
