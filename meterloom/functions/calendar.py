"""Jalali calendar arithmetic on columns, and resampling frequencies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_SECONDS = 86400

# fixed values: seconds per unit of a frequency string
UNIT_SECONDS = {"S": 1, "T": 60, "MIN": 60, "H": 3600, "D": 86400, "W": 604800}


def seconds(freq) -> int:
    """``'1H'``, ``'7D'``, ``'30min'`` or a number of days, as seconds."""
    if isinstance(freq, (int, float)):
        return int(freq * DAY_SECONDS)
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not match or match.group(2).upper() not in UNIT_SECONDS:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(match.group(1) or 1) * UNIT_SECONDS[match.group(2).upper()]


def _piece(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def _jalali_day(text: Column) -> Column:
    year, month, day = _piece(text, 1, 4), _piece(text, 6, 2), _piece(text, 9, 2)
    day = F.when((month == 12) & (day == 30), 29).otherwise(day)
    last = F.when(month <= 6, 31).when(month <= 11, 30).otherwise(29)
    valid = month.between(1, 12) & day.between(1, last)
    cycle = year - 979
    elapsed = (
        cycle * 365
        + F.floor(cycle / 33) * 8
        + F.floor((F.pmod(cycle, F.lit(33)) + 3) / 4)
        + F.least(month - 1, F.lit(6)) * 31
        + F.greatest(month - 7, F.lit(0)) * 30
        + day
        - 1
    )
    return F.when(valid, F.date_add(F.lit("1600-01-01").cast("date"), (elapsed + 79).cast("int")))


def jalali_to_date(text) -> Column:
    """``Y-M-D`` text at fixed positions, any separator; null when unreadable.

    Day 30 of month 12 is read as day 29.
    """
    return _jalali_day(text if isinstance(text, Column) else F.col(text))


def jalali_to_timestamp(text) -> Column:
    """``Y-M-D h:m:s`` text at fixed positions; null when unreadable."""
    text = text if isinstance(text, Column) else F.col(text)
    hour, minute, second = _piece(text, 12, 2), _piece(text, 15, 2), _piece(text, 18, 2)
    valid = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    offset = hour * 3600 + minute * 60 + second
    midnight = F.unix_seconds(_jalali_day(text).cast("timestamp"))
    return F.when(valid, F.timestamp_seconds(midnight + offset))


def jalali_calendar(spark, first_year: int = 1300, last_year: int = 1449) -> DataFrame:
    """One row per Jalali day: ``day DATE, jalali STRING`` (``YYYY/MM/DD``).

    The size is fixed by the year bounds (about 55,000 rows), so it may be broadcast.
    """
    new_year = spark.range(first_year, last_year + 1).select(
        F.col("id").cast("int").alias("year"),
        jalali_to_date(F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("/01/01"))).alias("d0"),
        jalali_to_date(F.concat(F.lpad((F.col("id") + 1).cast("string"), 4, "0"), F.lit("/01/01"))).alias("d1"),
    )
    days = new_year.select("year", "d0", F.explode(F.sequence("d0", F.date_sub("d1", 1))).alias("day"))
    n = F.datediff("day", "d0")
    month = F.when(n < 186, F.floor(n / 31) + 1).otherwise(F.floor((n - 186) / 30) + 7)
    in_month = F.when(n < 186, n % 31 + 1).otherwise((n - 186) % 30 + 1)
    return days.select("day", F.format_string("%04d/%02d/%02d", "year", month, in_month).alias("jalali"))


def date_to_jalali(df: DataFrame, col: str = "date", name: str = "jalali") -> DataFrame:
    """Add the Jalali text of a Gregorian date or timestamp column."""
    days = jalali_calendar(df.sparkSession).withColumnRenamed("jalali", name)
    return (
        df.withColumn("_day", F.to_date(col))
        .join(F.broadcast(days), F.col("_day") == F.col("day"), "left")
        .drop("_day", "day")
    )
