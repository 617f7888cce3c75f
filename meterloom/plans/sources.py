"""Readers and writers: each query writes a driver table in the file form and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.operators.clean import bad_rows
from meterloom.operators.detect import detect, verdicts
from meterloom.operators.fill import fill
from meterloom.plans.analysis import SENSITIVE, scan_sql
from meterloom.plans.catalog import query
from meterloom.plans.cleaning import MONTHLY, MONTHLY_PARTS, R4, meter_codes
from meterloom.plans.tables import Tables, sql
from meterloom.session import shared_path
from meterloom.sources import readers, writers


def csv_of(t: Tables, df, name: str, sep: str = ",", header: bool = True) -> str:
    path = shared_path(t.spark, name)
    if header and sep == ",":
        writers.write_csv(df, path)
    else:
        df.write.option("sep", sep).option("header", header).csv(path)
    return path


@query("s1_read_usage", sql("SELECT id, date, usage FROM readings", "readings"))
def _(t: Tables):
    return readers.read_usage(t.spark, csv_of(t, t.readings.select("id", "date", "usage"), "readings"))


@query("s1_read_usage_counter", sql("""
    SELECT id, date, round(usage - prev, 4) AS usage FROM (
      SELECT id, date, usage, lag(usage) OVER (PARTITION BY id ORDER BY date) AS prev, row_number() OVER (PARTITION BY id ORDER BY date) AS rn
      FROM (SELECT id, date_trunc('hour', date) AS date, max(usage) AS usage FROM counters GROUP BY 1, 2)) WHERE rn > 1""", "counters"))
def _(t: Tables):
    return readers.read_usage(t.spark, csv_of(t, t.counters.select("id", "date", "usage"), "counters")).withColumn("usage", R4("usage"))


@query("s2_billing_dispatch", sql(MONTHLY, "cycles", **MONTHLY_PARTS))
def _(t: Tables):
    six = t.cycles.select("id", "start_date", "end_date", "low", "medium", "high")
    return readers.read_usage(t.spark, csv_of(t, six, "cycles")).withColumn("usage", R4("usage"))


@query("s3_bounded_read", sql("SELECT id, date, usage FROM readings ORDER BY id, date LIMIT 5000", "readings"))
def _(t: Tables):
    return readers.read_usage(t.spark, csv_of(t, t.readings.select("id", "date", "usage"), "readings"), limit=5000, cumulative=False)


@query("s4_read_meter_text", sql("""
    SELECT user_id AS id, date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 30 * 30 AS BIGINT)) AS date, value AS usage FROM events"""))
def _(t: Tables):
    return readers.read_meter_text(t.spark, csv_of(t, meter_codes(t), "meter-text", " ", False))


@query("s5_per_meter_files", sql("SELECT CAST(user_id AS VARCHAR) AS id, date_trunc('second', ts) AS date, value AS usage FROM events"))
def _(t: Tables):
    rows = t.events.select(F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss").alias("time"), F.col("value").alias("usage"))
    path = shared_path(t.spark, "meter-files")
    rows.repartition("id").write.partitionBy("id").csv(path)
    return readers.read_per_meter_files(t.spark, path, nested=True)


@query("s13_list_images", sql("SELECT DISTINCT CAST(quality AS VARCHAR) AS folder, 'jpg' AS kind FROM labels"))
def _(t: Tables):
    path = shared_path(t.spark, "images")
    rows = t.table("labels").select("quality", F.col("doc_id").cast("string"))
    rows.write.partitionBy("quality").option("extension", "jpg").csv(path)
    rows.write.mode("append").partitionBy("quality").csv(path)  # files of another kind beside them
    found = readers.list_images(t.spark, path)
    return found.select(F.regexp_extract("path", "quality=([^/]+)/", 1).alias("folder"), F.regexp_extract("path", "([a-z]+)$", 1).alias("kind")).distinct()


BROKEN = """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'no date' WHEN event_type = 'view' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,
    CASE WHEN event_type = 'click' THEN 'n/a' WHEN event_type = 'signup' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS usage FROM events"""


@query("d16_bad_rows", sql("""
    SELECT id, 'date' AS "column", date AS text, CASE WHEN date IS NULL THEN 'missing date' ELSE 'unreadable date' END AS reason FROM b WHERE try_cast(date AS TIMESTAMP) IS NULL
    UNION ALL SELECT id, 'usage', usage, 'not a number' FROM b WHERE usage IS NOT NULL AND try_cast(usage AS DOUBLE) IS NULL""", b=BROKEN))
def _(t: Tables):
    is_a = lambda kind: F.col("event_type") == kind
    date = F.when(is_a("error"), "no date").when(~is_a("view"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    usage = F.when(is_a("click"), "n/a").when(~is_a("signup"), F.col("event_id").cast("string"))
    return bad_rows(t.events.select(F.col("event_id").alias("id"), date.alias("date"), usage.alias("usage")))


@query("x6_file_to_verdicts", scan_sql("""
    SELECT DISTINCT id, true AS mining, false AS theft FROM flags WHERE mining UNION ALL SELECT DISTINCT id, false, true FROM flags WHERE theft""", "long_weeks", 10, 1.0, 6, 4))
def _(t: Tables):
    """Detection from end to end: file, reading, gap filling, scan, verdicts."""
    readings = readers.read_usage(t.spark, csv_of(t, t.series_long.select("id", "date", "usage"), "readings"), cumulative=False)
    return verdicts(detect(fill(readings, "next"), SENSITIVE))


LABELS = "SELECT doc_id AS img, quality AS normal, toxic AS mining, 0 AS theft, CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END AS unknown FROM labels"


@query("s6_read_labels", sql("SELECT img AS id, normal, mining, theft, unknown FROM l WHERE unknown <> 1", l=LABELS))
def _(t: Tables):
    table = t.table("labels")
    neither = ((F.col("quality") == 0) & (F.col("toxic") == 0)).cast("int")
    form = table.select(F.col("doc_id").alias("img"), F.col("quality").alias("normal"), F.col("toxic").alias("mining"), F.lit(0).alias("theft"), neither.alias("unknown"))
    return readers.read_labels(t.spark, csv_of(t, form, "labels"))


@query("s7_marked_images", sql("SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE toxic = 1"))
def _(t: Tables):
    form = t.table("labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".week.jpeg")).alias("img"), F.col("toxic").alias("bad"))
    return readers.read_marked_images(t.spark, csv_of(t, form, "marked"))


@query("s8_read_metric", sql("SELECT ts AS timestamp, value FROM events"))
def _(t: Tables):
    return readers.read_metric(t.spark, csv_of(t, t.events.select(F.col("ts").alias("timestamp"), "value"), "metric"))


@query("s9_read_sequences", sql("""
    SELECT id, ord AS "order", label, f AS feature, CASE f WHEN 0 THEN f0 ELSE f1 END AS value
    FROM sequences CROSS JOIN (SELECT unnest(range(2)) AS f)""", "sequences"))
def _(t: Tables):
    path = csv_of(t, t.sequences.select("id", "order", "label", "f0", "f1"), "sequences")
    return readers.melt_features(readers.read_sequences(t.spark, path, 2))


@query("s10_read_clusters", sql("SELECT CAST(region AS INT) AS cluster, s_suppkey AS id FROM supplier_region", "supplier_region"))
def _(t: Tables):
    # one list per cluster and hundred keys, so no list grows with the table
    lists = t.supplier_region.groupBy(F.col("region").cast("int").alias("cluster"), F.floor(F.col("s_suppkey") / 100).alias("_part")).agg(F.collect_list("s_suppkey").alias("ids"))
    path = shared_path(t.spark, "clusters")
    lists.select("cluster", "ids").write.parquet(path)
    return readers.read_clusters(t.spark, path)


@query("s11_write_csv", sql("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"))
def _(t: Tables):
    path = csv_of(t, t.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "orders")
    return t.spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").option("header", True).csv(path)


@query("s12_extract_users", sql("""
    SELECT id, date, usage FROM readings WHERE id IN (1, 2, 3) OR id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""", "readings"))
def _(t: Tables):
    other = t.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return readers.extract_users(t.readings, [1, 2, 3], other).select("id", "date", "usage")


@query("s14_read_label_names", sql("SELECT DISTINCT o_orderpriority AS label FROM orders"))
def _(t: Tables):
    path = shared_path(t.spark, "names")
    t.table("orders").select(F.col("o_orderpriority").alias("value")).distinct().write.text(path)
    return readers.read_label_names(t.spark, path)
