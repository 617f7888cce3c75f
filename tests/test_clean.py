from datetime import date, datetime

import pytest

from pyspark.sql import functions as F

from meterloom.errors import HourlyDateError, UserNotFoundError, WrongColumnsError, WrongDateFormatError
from meterloom.functions.calendar import date_to_jalali, jalali_to_date, seconds
from meterloom.operators import clean, filters
from meterloom.operators.fill import FillMode, fill
from meterloom.operators.ordered import RowOrder, lagged, neighbours, positions, running_sum
from meterloom.operators.resample import resample
from meterloom.operators.windows import minmax_by_series
from meterloom.sources import readers

READING = "id long, date timestamp, usage double"


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


def readings(spark, rows):
    return spark.createDataFrame(rows, READING)


def test_resample_fills_gaps_from_first_midnight(spark):
    df = readings(spark, [(1, at(3, 10), 2.0), (1, at(9, 23), 3.0), (1, at(20), 4.0)])
    got = [(r.idx, r.date, r.usage) for r in resample(df, "7D").orderBy("idx").collect()]
    assert got == [(0, at(3), 5.0), (1, at(10), 0.0), (2, at(17), 4.0)]


def test_resample_ignores_nulls_and_keeps_totals(spark):
    df = readings(spark, [(1, at(1, 1), None), (1, at(1, 5), 1.5), (1, at(2), None), (2, at(4), 1.0)])
    for freq in ("1H", "5H", "1D", "3D"):
        assert resample(df, freq).agg(F.sum("usage")).first()[0] == 2.5


def test_frequency_text():
    assert [seconds(f) for f in ("1H", "7D", "30min", 2)] == [3600, 604800, 1800, 172800]
    with pytest.raises(ValueError):
        seconds("1Q")


LINEAR = [None, 1.0, None, None, 4.0, None]


@pytest.mark.parametrize("mode, want", [
    (FillMode.LINEAR, [None, 1.0, 2.0, 3.0, 4.0, 4.0]), (FillMode.PREVIOUS, [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]),
    (FillMode.NEXT, [1.0, 1.0, 4.0, 4.0, 4.0, 4.0]), (FillMode.DROP, [1.0, 4.0]), (FillMode.NONE, LINEAR),
])
def test_fill(spark, mode, want):
    # two rows a day, so that gaps cross chunk borders; meter 2 is all null and stays so
    rows = [(1, at(1 + i // 2, 12 * (i % 2)), v) for i, v in enumerate(LINEAR)] + [(2, at(i + 1), None) for i in range(3)]
    got = fill(readings(spark, rows), mode).orderBy("id", "date").collect()
    assert [r.usage for r in got if r.id == 1] == want
    assert all(r.usage is None for r in got if r.id == 2)


def test_counter_takes_hourly_maximum_first(spark):
    df = readings(spark, [(1, at(1, 0), 10.0), (1, at(1, 1), 12.0), (1, at(1, 1, 30), 13.0), (1, at(1, 4), 20.0)])
    got = [(r.date, r.usage) for r in clean.counter_to_usage(df).orderBy("date").collect()]
    assert got == [(at(1, 1), 3.0), (at(1, 4), 7.0)]


@pytest.mark.parametrize("jalali, want", [
    ("1384/01/01", date(2005, 3, 21)), ("1398-01-01", date(2019, 3, 21)), ("1399/01/01", date(2020, 3, 20)),
    ("1400/01/01", date(2021, 3, 21)), ("1403/01/01", date(2024, 3, 20)), ("1404/01/01", date(2025, 3, 21)),
    ("1399/12/30", date(2021, 3, 19)), ("1400/13/01", None), ("oops", None),
])
def test_jalali(spark, jalali, want):
    assert spark.range(1).select(jalali_to_date(F.lit(jalali))).first()[0] == want


def test_jalali_round_trip(spark):
    days = spark.sql("select explode(sequence(date'1990-01-01', date'2030-12-31')) as date")
    back = date_to_jalali(days).withColumn("back", jalali_to_date("jalali"))
    off = F.when(F.substring("jalali", 6, 5) == "12/30", F.date_sub("date", 1)).otherwise(F.col("date"))
    assert back.filter(F.col("back") != off).count() == 0 and back.filter("back is null").count() == 0


def test_cycles(spark):
    cycle = "id long, start_date date, end_date date, low double, medium double, high double"
    df = spark.createDataFrame([
        (1, date(2024, 1, 30), date(2024, 2, 2), 1.0, 1.0, 1.0), (1, date(2024, 1, 31), date(2024, 2, 1), 5.0, 0.0, 0.0),
        (1, date(2024, 4, 1), date(2024, 4, 3), 2.0, 0.0, 0.0), (2, date(2024, 1, 1), date(2024, 1, 1), 1.0, 1.0, 1.0),
        (2, date(2024, 1, 1), date(2024, 1, 9), 1.0, 1.0, 1.0),
    ], cycle)
    got = clean.cycles_to_monthly(clean.drop_short_cycles(df)).orderBy("date").collect()
    assert [(r.id, r.date, r.usage) for r in got] == [
        (1, date(2024, 1, 31), 7.0), (1, date(2024, 2, 29), 1.0), (1, date(2024, 3, 31), 0.0), (1, date(2024, 4, 30), 2.0)]


def test_minmax_of_constant_is_lower_bound(spark):
    df = readings(spark, [(1, at(1), 7.0), (1, at(2), 7.0)])
    assert {r.usage for r in minmax_by_series(df, 2, 9).collect()} == {2.0}


def test_mean_below_without_frequency_is_total(spark):
    df = readings(spark, [(1, at(1), 3.0), (1, at(2), 3.0), (2, at(1), 5.0)])
    assert {r.id for r in filters.mean_below(df, 5.5).collect()} == {2}
    assert {r.id for r in filters.mean_below(df, 3.5, "1D").collect()} == {1}


def test_typed_errors(spark, tmp_path):
    df = readings(spark, [(1, at(1), 3.0)])
    with pytest.raises(UserNotFoundError):
        filters.select_user(df, 9)
    with pytest.raises(WrongColumnsError):
        readers.file_kind(["a", "b"])
    odd = spark.createDataFrame([("0900-01-01",)], "date string")
    with pytest.raises(WrongDateFormatError):
        clean.require_calendar(odd)
    path = str(tmp_path / "bad.csv")
    (tmp_path / "bad.csv").write_text("id,date,usage\n1,1399-01-01 00:00:00,2\n1,1399-77-01 00:00:00,2\n")
    with pytest.raises(HourlyDateError) as caught:
        readers.read_usage(spark, path)
    assert caught.value.persian


def test_read_jalali_readings(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,date,usage\n1,1399-01-01 00:00:00,2\n1,1399-01-01 01:00:00,1\n")
    got = readers.read_usage(spark, str(tmp_path / "r.csv")).orderBy("date").collect()
    assert [(r.id, r.date, r.usage) for r in got] == [(1, datetime(2020, 3, 20), 2.0), (1, datetime(2020, 3, 20, 1), 1.0)]


def test_per_meter_files_images_and_names(spark, tmp_path):
    (tmp_path / "77.one.csv").write_text("2024-01-01,00:30:00,1.5\n")
    (tmp_path / "78.csv").write_text("2024-01-02,00:00:00,2.5\n")
    got = readers.read_per_meter_files(spark, str(tmp_path / "*.csv")).orderBy("id").collect()
    assert [(r.id, r.date, r.usage) for r in got] == [("77", at(1, 0, 30), 1.5), ("78", at(2), 2.5)]
    pictures = tmp_path / "pictures"
    pictures.mkdir()
    for name in ("a.JPG", "b.png", "c.txt", "d.jpeg"):
        (pictures / name).write_bytes(b"x")
    assert {r.path.rsplit("/", 1)[1] for r in readers.list_images(spark, str(pictures)).collect()} == {"a.JPG", "b.png", "d.jpeg"}
    (tmp_path / "names.txt").write_text("normal\n\n theft \n")
    assert [r.label for r in readers.read_label_names(spark, str(tmp_path / "names.txt")).collect()] == ["normal", "theft"]


@pytest.fixture
def many_chunks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_hot_meter_gives_the_same_order_results(spark, many_chunks):
    """One meter holds most rows; results over chunks equal a plain window's."""
    from pyspark.sql import Window

    from meterloom.operators.ordered import CHUNK, deal

    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, 1).when(F.col("id") % 40 > 1, F.col("id") % 40).cast("long").alias("id"),
        F.timestamp_seconds(F.col("id") * 700).alias("date"),
        F.when(F.col("id") % 7 > 1, (F.col("id") * 37 % 101).cast("double")).alias("usage"),
    )
    w = Window.partitionBy("id").orderBy("date")
    plain = rows.select(
        "*", F.row_number().over(w).alias("pos0"), F.lag("usage", 5).over(w).alias("lag0"),
        F.sum("usage").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum0"),
        F.last("usage", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("prev0"),
        F.first("usage", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next0"),
    )
    dealt, order, _ = deal(plain, RowOrder())
    assert dealt.filter("id = 1").select(CHUNK).distinct().count() > 2
    got = lagged(running_sum(neighbours(dealt, "usage", order), "usage", "sum1", order), {"lag1": "usage"}, 5, order)
    wrong = got.filter(
        "pos <> pos0 OR NOT lag1 <=> lag0 OR abs(sum1 - coalesce(sum0, 0)) > 1e-6 OR NOT prev.value <=> prev0 OR NOT next.value <=> next0")
    assert got.count() == 6000 and wrong.count() == 0
    assert positions(rows, RowOrder(), "p", "n").filter("p = n").count() == rows.select("id").distinct().count()
    long_lag = lagged(rows, {"before": "usage"}, 900, seen="has")
    assert long_lag.filter("has").count() == 4000 - 900 and long_lag.columns == [*rows.columns, "before", "has"]


@pytest.mark.parametrize("kind", ["stray", "equal", "null"])
def test_chunks_are_even(spark, many_chunks, kind):
    """One stray date, all times equal, or no times at all: no chunk holds twice the even share."""
    from meterloom.operators.ordered import CHUNK, deal

    at = {"stray": F.when(F.col("id") == 0, F.lit(0)).otherwise(F.col("id") + 1_700_000_000), "equal": F.lit(5), "null": F.lit(None).cast("long")}[kind]
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("id"), F.timestamp_seconds(at).alias("date"), F.rand(1).alias("usage"))
    sizes = [r["count"] for r in deal(rows, RowOrder())[0].groupBy(CHUNK).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert positions(rows).agg(F.max("pos")).first()[0] == 20_000


def test_bad_dates_are_reported_and_raised(spark, tmp_path):
    from meterloom.operators.clean import bad_rows
    from meterloom.operators.resample import resample

    (tmp_path / "r.csv").write_text("id,date,usage\n1,2024-01-01 00:00:00,1\n1,2024-01-0x,2\n1,2024-01-03 00:00:00,many\n")
    with pytest.raises(HourlyDateError):
        readers.read_usage(spark, str(tmp_path / "r.csv"))
    raw = readers.read_text_columns(spark, str(tmp_path / "r.csv"))
    assert sorted(map(tuple, bad_rows(raw).collect())) == [("1", "date", "2024-01-0x", "unreadable date"), ("1", "usage", "many", "not a number")]
    known = spark.sql("SELECT 1L AS id, TIMESTAMP'2024-01-01' AS date, 2.0D AS usage UNION ALL SELECT 1L, NULL, 7.0D")
    assert [tuple(r)[1:2] + (r["usage"],) for r in resample(known, "1D").collect()] == [(0, 2.0)]


def test_per_meter_files_of_a_folder_are_listed_by_tasks(spark, tmp_path):
    for i in range(40):  # more folders than the driver lists itself
        (tmp_path / f"id={i}" / "more").mkdir(parents=True)
        (tmp_path / f"id={i}" / "a.csv").write_text(f"2024-01-01,00:30:00,{i}.5\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "id=3" / "more" / "m7.2024.csv").write_text("2024-01-02,01:00:00,7.5\n")
    df = readers.read_per_meter_files(spark, str(tmp_path), nested=True)
    assert df.columns == ["id", "date", "usage"]
    assert sorted((r.id, r.usage) for r in df.collect()) == sorted([*((str(i), i + 0.5) for i in range(40)), ("m7", 7.5)])
    (tmp_path / "none").mkdir()
    assert readers.read_per_meter_files(spark, str(tmp_path / "none"), nested=True).count() == 0
    assert readers.read_per_meter_files(spark, str(tmp_path / "*" / "*.csv")).count() == 40
