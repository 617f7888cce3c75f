"""Seeded synthetic anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.seeded import between, integer, uniform
from meterloom.operators.ordered import RowOrder
from meterloom.operators.windows import segments

ATTACKS = 6


def reduce_random_interval(df: DataFrame, seed=0) -> DataFrame:
    """Scale one interval of each meter by a factor in [0.2, 0.5) and flag it ``anomaly``.

    The interval starts after the meter's first quarter, lasts at least 60 days
    and is clipped to the meter's end; both ends are included.
    """
    ends = df.groupBy("id").agg(
        F.unix_micros(F.min("date").cast("timestamp")).alias("_s"), F.unix_micros(F.max("date").cast("timestamp")).alias("_e")
    )
    quarter = F.col("_s") + (F.col("_e") - F.col("_s")) / 4
    rest = F.col("_e") - quarter
    sixty = 60 * 86400 * 1_000_000
    start = quarter + rest * uniform(seed, F.lit("start"), "id") * 0.5
    span = rest * uniform(seed, F.lit("span"), "id")
    stop = F.least(start + span + F.when(span < sixty, sixty).otherwise(0), F.col("_e").cast("double"))
    plan = ends.select("id", start.alias("_from"), stop.alias("_to"), between(0.2, 0.5, seed, F.lit("factor"), "id").alias("_f"))
    at = F.unix_micros(F.col("date").cast("timestamp"))
    joined = df.join(plan, "id").withColumn("anomaly", at.between(F.col("_from"), F.col("_to")))
    scaled = F.when(F.col("anomaly"), F.col("usage") * F.col("_f")).otherwise(F.col("usage"))
    return joined.withColumn("usage", scaled).drop("_from", "_to", "_f")


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def attack(kind: int, values, seed, *key) -> Column:
    """One of six tamperings of an array: 1 scale, 2 scale each, 3 mean, 4 scaled mean, 5 reverse, 6 zero."""
    values = values if isinstance(values, Column) else F.col(values)
    factor = between(0.2, 0.8, seed, F.lit("factor"), *key)
    # array_repeat evaluates its element once per array, a lambda once per element
    if kind == 1:
        return F.zip_with(values, F.array_repeat(factor, F.size(values)), lambda x, f: x * f)
    if kind == 2:
        return F.transform(values, lambda x, i: x * between(0.2, 0.8, seed, F.lit("each"), *key, i))
    if kind == 3:
        return F.array_repeat(_mean(values), F.size(values))
    if kind == 4:
        return F.array_repeat(_mean(values) * factor, F.size(values))
    if kind == 5:
        return F.reverse(values)
    if kind == 6:
        return F.transform(values, lambda x: F.lit(0.0))
    raise ValueError(f"attack {kind} does not exist")


def random_attack(values: Column, which: Column, seed, *key) -> Column:
    out = attack(ATTACKS, values, seed, *key)
    for kind in range(ATTACKS - 1, 0, -1):
        out = F.when(which == kind, attack(kind, values, seed, *key)).otherwise(out)
    return out


def attack_blocks(blocks: DataFrame, hours: int, p: float = 0.3, least: int = 48, seed=0) -> DataFrame:
    """With probability p tamper with a random slice of at least ``least`` values of each block; adds ``label``."""
    key = ("id", "segment")
    start = integer(0, hours - least, seed, F.lit("start"), *key)
    plan = (
        blocks.withColumn("_s", start)
        .withColumn("_l", integer(F.lit(least), F.lit(hours) - F.col("_s"), seed, F.lit("length"), *key))
        .withColumn("_k", integer(1, ATTACKS, seed, F.lit("kind"), *key))
        .withColumn("label", F.when(uniform(seed, F.lit("hit"), *key) < p, 1).otherwise(0))
    )
    # the slice is a column of its own, so each attack reads it once
    plan = plan.withColumn("_part", F.slice("values", F.col("_s") + 1, F.col("_l")))
    hit = F.concat(
        F.slice("values", F.lit(1), F.col("_s")),
        random_attack(F.col("_part"), F.col("_k"), seed, *key),
        F.slice("values", F.col("_s") + F.col("_l") + 1, F.lit(hours)),
    )
    return plan.withColumn("values", F.when(F.col("label") == 1, hit).otherwise(F.col("values"))).drop("_s", "_l", "_k", "_part")


def inject_attacks(df: DataFrame, days: int = 7, p: float = 0.3, seed=0, order: RowOrder = RowOrder()) -> DataFrame:
    """Cut each meter into blocks of ``days`` x 24 values and tamper with some: ``id, segment, values, label``."""
    return attack_blocks(segments(df, days * 24, order), days * 24, p, seed=seed)


def weekly_layout(blocks: DataFrame) -> DataFrame:
    """One row per block and position."""
    return blocks.select("id", "segment", "label", F.posexplode("values").alias("pos", "usage"))


def daily_layout(blocks: DataFrame, hours: int = 24) -> DataFrame:
    """One row per block and day, ``hours`` values wide."""
    days = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("values") / hours).cast("int") - 1), lambda d: F.slice("values", d * hours + 1, hours)
    )
    return blocks.select("id", "segment", "label", F.posexplode(days).alias("day", "values"))


def attack_windows(windows: DataFrame, p: float = 0.3, seed=0) -> DataFrame:
    """With probability p tamper with a whole window; adds ``label``."""
    key = ("id", "idx")
    label = F.when(uniform(seed, F.lit("hit"), *key) < p, 1).otherwise(0)
    which = integer(1, ATTACKS, seed, F.lit("kind"), *key)
    marked = windows.withColumn("label", label).withColumn("_k", which)
    hit = random_attack(F.col("values"), F.col("_k"), seed, *key)
    return marked.withColumn("values", F.when(F.col("label") == 1, hit).otherwise(F.col("values"))).drop("_k")
