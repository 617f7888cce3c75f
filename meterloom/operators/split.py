"""Seeded sampling, shuffling and splitting; the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.seeded import digest
from meterloom.operators.ordered import SERIES, RowOrder, hash_head, hash_rank, positions
from meterloom.session import cut


def _count(share: float, n) -> Column:
    """int(share * n), guarded against binary fractions such as 0.7 * 10."""
    return F.floor(F.lit(share) * n + F.lit(1e-9))


def _roof(share: float, n) -> Column:
    return F.ceil(n * F.lit(share) - F.lit(1e-9))


def sample_users(df: DataFrame, n: int, seed=0) -> DataFrame:
    """All rows of n meters drawn without replacement."""
    drawn = df.select("id").distinct().orderBy(digest(seed, "id"), "id").limit(n)
    return df.join(drawn, "id", "left_semi")


def sample_fraction(df: DataFrame, share: float, key: Sequence[str] = ("id",), seed=0) -> DataFrame:
    """Exactly int(share * n) rows without replacement; ``key`` identifies a row."""
    return hash_head(df, key, seed, lambda n: _count(share, n), name="_in").filter("_in").drop("_in")


def shuffle(df: DataFrame, key: Sequence[str] = ("id",), seed=0) -> DataFrame:
    """Add ``place``: the row's 1-based place in a random order."""
    return hash_rank(df, key, seed, name="place", total="_n").drop("_n")


def split_users(df: DataFrame, test_share: float = 0.25, seed=0) -> DataFrame:
    """Add ``test``: whole meters go to one side."""
    ids = cut(df.select("id").distinct())  # read three times below
    return df.join(hash_head(ids, ("id",), seed, lambda n: _roof(test_share, n), name="test"), "id")


def split_rows(df: DataFrame, test_share: float = 0.33, key: Sequence[str] = ("id",), seed=0, stratify: Sequence[str] = ()) -> DataFrame:
    """Add ``test``: a random share of rows (of every class, with ``stratify``), rounded up."""
    return hash_head(df, key, seed, lambda n: _roof(test_share, n), stratify, "test")


def split_stratified_tail(df: DataFrame, order: Sequence[str] = ("segment",), train_share: float = 0.7) -> DataFrame:
    """Add ``test``: per label the first share of blocks in order trains, the rest tests."""
    placed = positions(df, RowOrder(("label",), order), "_p", "_n")
    return placed.withColumn("test", F.col("_p") > _count(train_share, F.col("_n"))).drop("_p", "_n")


def split_half(windows: DataFrame, order: RowOrder = SERIES) -> DataFrame:
    """Add ``test``: the first half of each meter's windows trains, the second tests."""
    placed = positions(windows, order, "_p", "_n")
    return placed.withColumn("test", F.col("_p") > F.floor(F.col("_n") / 2)).drop("_p", "_n")


def undersample(df: DataFrame, ratio: int = 2, key: Sequence[str] = ("id",), seed=0) -> DataFrame:
    """All positives and ``ratio`` times as many random negatives."""
    positives = df.filter("label = 1").count()
    negatives = df.filter("label = 0")
    drawn = hash_head(negatives, key, seed, lambda n: F.least(n, F.lit(positives * ratio)), name="_in").filter("_in").drop("_in")
    return df.filter("label = 1").unionByName(drawn)
