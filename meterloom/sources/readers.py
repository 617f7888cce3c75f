"""Readers: declared schemas, no inference pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.errors import WrongColumnsError
from meterloom.operators.clean import (
    counter_to_usage, cycles_to_monthly, drop_short_cycles, normalize_cycles, normalize_readings,
    require_calendar, require_dates, usage_kind,
)


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every column as text; only the header is looked at."""
    return spark.read.option("header", True).csv(path)


def bounded(df: DataFrame, n: int, by=("id", "date")) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*by).limit(n)


def file_kind(columns) -> str:
    """``hourly`` for 3 columns, ``billing`` for 6, else the typed error."""
    if len(columns) == 3:
        return "hourly"
    if len(columns) == 6:
        return "billing"
    raise WrongColumnsError(columns)


def read_usage(spark: SparkSession, path: str, limit: int | None = None, calendar: str | None = None, cumulative: bool | None = None) -> DataFrame:
    """Clean readings ``id, date, usage`` from interval readings or billing cycles.

    Calendar and counter kind are sniffed by one aggregate each unless given.
    """
    raw = read_text_columns(spark, path)
    kind = file_kind(raw.columns)
    when = "date" if kind == "hourly" else "start_date"
    if limit is not None:
        raw = bounded(raw, limit, (F.col("id").cast("long"), when))
    calendar = calendar or require_calendar(raw, when)
    if kind == "billing":
        cycles = require_dates(normalize_cycles(raw, calendar), ["start_date", "end_date"])
        return cycles_to_monthly(drop_short_cycles(cycles))
    readings = require_dates(normalize_readings(raw, calendar), ["date"])
    if cumulative is None:
        cumulative = bool(usage_kind(readings).first()["cumulative"])
    return counter_to_usage(readings) if cumulative else readings


def decode_meter_code(df: DataFrame, first_day: str = "2009-01-01", minutes: int = 30) -> DataFrame:
    """``id, code, usage`` to readings: code DDDTT counts days from ``first_day`` and 1-based slots."""
    day, slot = F.floor(F.col("code") / 100), F.col("code") % 100
    start = F.unix_seconds(F.lit(first_day).cast("timestamp"))
    return df.select("id", F.timestamp_seconds(start + day * 86400 + (slot - 1) * (minutes * 60)).alias("date"), "usage")


def read_meter_text(spark: SparkSession, glob: str) -> DataFrame:
    """Headerless ``id code usage`` text, any number of files."""
    return decode_meter_code(spark.read.schema("id long, code int, usage double").option("sep", " ").csv(glob))


def read_per_meter_files(spark: SparkSession, glob: str, nested: bool = False) -> DataFrame:
    """Headerless ``date,time,usage`` files named after their meter (before the first dot) or in a folder ``id=...``.

    A glob is expanded on the driver; with ``nested``, all files below a folder are listed by tasks.
    """
    raw = spark.read.schema("day string, time string, usage double").option("recursiveFileLookup", nested).csv(glob)
    folder = F.regexp_extract("_metadata.file_path", "/id=([^/]+)/[^/]*$", 1)
    return raw.select(
        F.when(folder != "", folder).otherwise(F.split_part("_metadata.file_name", F.lit("."), F.lit(1))).alias("id"),
        F.to_timestamp(F.concat_ws(" ", "day", "time")).alias("date"), "usage",
    )


def read_labels(spark: SparkSession, path: str, classes=("normal", "mining", "theft", "unknown")) -> DataFrame:
    """Label table without unknown meters; ``img`` becomes ``id``."""
    schema = ", ".join(["img long", *[f"{c} int" for c in classes]])
    return known_labels(spark.read.schema(schema).option("header", True).csv(path))


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("unknown != 1").withColumnRenamed("img", "id")


def marked_images(labels: DataFrame) -> DataFrame:
    """Ids (text before the first dot) of rows with ``bad = 1``."""
    return labels.filter("bad = 1").select(F.split_part("img", F.lit("."), F.lit(1)).alias("id"))


def read_marked_images(spark: SparkSession, path: str) -> DataFrame:
    return marked_images(spark.read.schema("img string, bad int").option("header", True).csv(path))


def read_metric(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp timestamp, value double").option("header", True).csv(path)


def read_sequences(spark: SparkSession, path: str, features: int, with_id: bool = True) -> DataFrame:
    """Labelled rows ``id, order, label, f0..``; a file without id gets id 0."""
    cols = [f"f{i}" for i in range(features)]
    fields = [*(["id long"] if with_id else []), "`order` long", "label int", *[f"{c} double" for c in cols]]
    rows = spark.read.schema(", ".join(fields)).option("header", True).csv(path)
    rows = rows if with_id else rows.withColumn("id", F.lit(0).cast("long"))
    return rows.select("id", "order", "label", *cols)


def melt_features(rows: DataFrame) -> DataFrame:
    """Wide sequence rows to ``id, order, label, feature, value``."""
    cols = [c for c in rows.columns if c not in ("id", "order", "label")]
    return rows.unpivot(["id", "order", "label"], cols, "feature", "value").withColumn(
        "feature", F.substring("feature", 2, 10).cast("int")
    )


def explode_clusters(clusters: DataFrame) -> DataFrame:
    """``cluster, ids ARRAY`` to one row per member."""
    return clusters.select("cluster", F.explode("ids").alias("id"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return explode_clusters(spark.read.parquet(path))


def extract_users(df: DataFrame, ids, other: DataFrame) -> DataFrame:
    """Rows of a fixed id list together with the ids of another table."""
    kind = df.schema["id"].dataType
    fixed = df.sparkSession.createDataFrame([(i,) for i in ids], "id long").select(F.col("id").cast(kind))
    wanted = fixed.unionByName(other.select(F.col("id").cast(kind))).distinct()
    return df.join(wanted, "id", "left_semi")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of jpg, jpeg and png files; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).select("path")


def read_label_names(spark: SparkSession, path: str) -> DataFrame:
    """Class names, one per line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("label")).filter("label <> ''")
