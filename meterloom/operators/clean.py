"""Calendar and counter sniffing, normalisation of readings and billing cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.errors import HourlyDateError, MonthlyDateError, WrongDateFormatError
from meterloom.functions.calendar import jalali_to_date, jalali_to_timestamp
from meterloom.operators.ordered import RowOrder, lagged

GREGORIAN_YEARS = (1600, 2030)  # fixed values: exclusive year bounds per calendar
JALALI_YEARS = (1300, 1450)


def calendar_kind(df: DataFrame, col: str = "date", gregorian=GREGORIAN_YEARS, jalali=JALALI_YEARS) -> DataFrame:
    """One row ``first_year, last_year, calendar``; calendar is null when neither fits."""
    text = F.col(col).cast("string")
    ends = df.agg(F.min(text).alias("lo"), F.max(text).alias("hi")).select(
        F.substring("lo", 1, 4).try_cast("int").alias("first_year"),
        F.substring("hi", 1, 4).try_cast("int").alias("last_year"),
    )

    def inside(bounds):
        low, high = bounds
        return (
            (F.col("first_year") > low) & (F.col("first_year") < high)
            & (F.col("last_year") > low) & (F.col("last_year") < high)
        )

    kind = F.when(inside(gregorian), "gregorian").when(inside(jalali), "jalali")
    return ends.withColumn("calendar", kind)


def require_calendar(df: DataFrame, col: str = "date") -> str:
    kind = calendar_kind(df, col).first()["calendar"]
    if kind is None:
        raise WrongDateFormatError()
    return kind


def usage_kind(df: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """One row ``cumulative``: does every meter start at its minimum and end at its maximum?"""
    at = F.col(by[0]) if len(by) == 1 else F.struct(*by)  # a plain column keeps the hash aggregate
    meters = df.groupBy("id").agg(
        F.min_by("usage", at).alias("first"), F.max_by("usage", at).alias("last"),
        F.min("usage").alias("lo"), F.max("usage").alias("hi"),
    )
    grows = F.coalesce((F.col("first") == F.col("lo")) & (F.col("last") == F.col("hi")), F.lit(False))
    return meters.agg(F.bool_and(grows).alias("cumulative"))


def normalize_readings(df: DataFrame, calendar: str = "gregorian") -> DataFrame:
    """``id LONG, date TIMESTAMP, usage DOUBLE`` from raw columns; NaN becomes null."""
    if calendar == "jalali":
        date = jalali_to_timestamp(F.col("date").cast("string"))
    else:
        date = F.col("date").try_cast("timestamp")
    usage = F.col("usage").try_cast("double")
    return df.select(
        F.col("id").cast("long").alias("id"), date.alias("date"),
        F.when(~F.isnan(usage), usage).alias("usage"),
    )


def normalize_cycles(df: DataFrame, calendar: str = "gregorian") -> DataFrame:
    convert = jalali_to_date if calendar == "jalali" else (lambda c: c.try_cast("date"))
    return df.select(
        F.col("id").cast("long").alias("id"),
        *[convert(F.col(c).cast("string")).alias(c) for c in ("start_date", "end_date")],
        *[F.col(c).try_cast("double").alias(c) for c in ("low", "medium", "high")],
    )


def bad_rows(df: DataFrame, calendar: str = "gregorian", dates: Sequence[str] = ("date",), numbers: Sequence[str] = ("usage",)) -> DataFrame:
    """``id, column, text, reason`` for every raw value that normalisation cannot read; missing numbers are no fault, missing dates are."""
    convert = (jalali_to_timestamp if list(dates) == ["date"] else jalali_to_date) if calendar == "jalali" else (lambda c: c.try_cast("timestamp"))
    text = lambda c: F.col(c).cast("string")
    faults = [F.when(convert(text(c)).isNull(), F.struct(F.lit(c).alias("column"), text(c).alias("text"), F.when(text(c).isNull(), "missing date").otherwise("unreadable date").alias("reason"))) for c in dates]
    faults += [F.when(text(c).isNotNull() & text(c).try_cast("double").isNull(), F.struct(F.lit(c).alias("column"), text(c).alias("text"), F.lit("not a number").alias("reason"))) for c in numbers]
    return df.select("id", F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull())).alias("f")).select("id", "f.column", "f.text", "f.reason")


def require_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise the typed error if a date could not be read; one aggregate over the input."""
    broken = F.lit(False)
    for c in cols:
        broken = broken | F.col(c).isNull()
    if df.agg(F.bool_or(broken).alias("bad")).first()["bad"]:
        raise HourlyDateError() if list(cols) == ["date"] else MonthlyDateError()
    return df


def counter_to_usage(df: DataFrame) -> DataFrame:
    """Counter readings to interval usage: hourly maximum, then difference to the previous hour present.

    The first hour of a meter is dropped.  The window runs on hours, which the
    calendar bounds, not on raw readings.
    """
    hours = df.groupBy("id", F.date_trunc("hour", F.col("date")).alias("date")).agg(F.max("usage").alias("usage"))
    w = Window.partitionBy("id").orderBy("date")
    return (
        hours.withColumn("_rn", F.row_number().over(w))
        .withColumn("usage", F.col("usage") - F.lag("usage").over(w))
        .filter("_rn > 1")
        .drop("_rn")
    )


def cycle_days(df: DataFrame) -> DataFrame:
    return df.withColumn("days", F.datediff("end_date", "start_date"))


def drop_short_cycles(df: DataFrame) -> DataFrame:
    """Add ``days`` and remove every row of a meter that has a cycle shorter than one day."""
    measured = cycle_days(df)
    short = measured.filter("days < 1").select("id")
    return measured.join(short, "id", "left_anti")


def cycles_to_monthly(df: DataFrame) -> DataFrame:
    """Spread each cycle's usage evenly over its days and sum per month (labelled by its last day).

    A cycle yields one row per month it touches, never one per day; uncovered
    months between a meter's first start and last end are 0.
    """
    days = F.datediff("end_date", "start_date")
    daily = (F.col("low") + F.col("medium") + F.col("high")) / days
    month = F.expr("interval 1 month")
    touched = F.sequence(F.trunc("start_date", "month"), F.trunc(F.date_sub("end_date", 1), "month"), month)
    pieces = df.filter(days > 0).select("id", "start_date", "end_date", daily.alias("_v"), F.explode(touched).alias("_m"))
    covered = F.datediff(
        F.least("end_date", F.add_months("_m", 1)), F.greatest("start_date", "_m")
    )
    parts = pieces.select("id", "_m", (F.col("_v") * covered).alias("usage"))
    ends = df.groupBy("id").agg(F.min("start_date").alias("lo"), F.max("end_date").alias("hi"))
    spine = ends.select(
        "id", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), month)).alias("_m"), F.lit(0.0).alias("usage")
    )
    return parts.unionByName(spine).groupBy("id", F.last_day("_m").alias("date")).agg(F.sum("usage").alias("usage"))


def cycle_counters_to_usage(df: DataFrame, by: Sequence[str] = ("start_date",)) -> DataFrame:
    """Cumulative billing columns to per-cycle amounts; a meter's first cycle has none."""
    names = ("low", "medium", "high")
    prev = lagged(df, {f"_{c}": c for c in names}, 1, RowOrder(("id",), by))
    for c in names:
        prev = prev.withColumn(c, F.col(c) - F.col(f"_{c}"))
    return prev.drop(*[f"_{c}" for c in names])
