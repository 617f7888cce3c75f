"""Date and usage normalisation, filters, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions.calendar import date_to_jalali, jalali_to_date, jalali_to_timestamp
from meterloom.operators import clean, fill, filters, resample as rs, windows as w
from meterloom.operators.ordered import RowOrder, positions
from meterloom.plans.catalog import query
from meterloom.plans.tables import BY_SEQ, Tables, resample_sql, sql, uniform_sql, digest_sql

R4 = lambda c: F.round(c, 4)


# ------------------------------------------------------------ normalisation

@query("d1_calendar_kind", sql("""
    SELECT min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year,
    CASE WHEN min(year(o_orderdate)) > 1600 AND max(year(o_orderdate)) < 2030 THEN 'gregorian' END AS calendar FROM orders"""))
def _(t: Tables):
    return clean.calendar_kind(t.order_days)


@query("d1_calendar_kind_jalali", sql("""
    SELECT CAST(substr(min(jalali), 1, 4) AS INT) AS first_year, CAST(substr(max(jalali), 1, 4) AS INT) AS last_year,
    'jalali' AS calendar FROM jalali_orders""", "jalali_orders"))
def _(t: Tables):
    return clean.calendar_kind(date_to_jalali(t.order_days), "jalali")


USAGE_KIND = """SELECT bool_and(first = lo AND last = hi) AS cumulative FROM
    (SELECT arg_min(usage, date) AS first, arg_max(usage, date) AS last, min(usage) AS lo, max(usage) AS hi FROM {} GROUP BY id)"""


@query("d2_usage_kind", sql(USAGE_KIND.format("readings"), "readings"))
def _(t: Tables):
    return clean.usage_kind(t.readings)


@query("d2_usage_kind_counter", sql(USAGE_KIND.format("counters"), "counters"))
def _(t: Tables):
    return clean.usage_kind(t.counters)


@query("d3_jalali_to_date", sql("""
    SELECT id, jalali, CASE WHEN substr(jalali, 6) = '12/30' THEN day - 1 ELSE day END AS day,
    CASE WHEN substr(jalali, 6) = '12/30' THEN day - 1 ELSE day END + INTERVAL '5 hours 6 minutes 7 seconds' AS stamp
    FROM jalali_orders""", "jalali_orders"))
def _(t: Tables):
    text = date_to_jalali(t.order_days).select("id", "jalali")
    stamp = jalali_to_timestamp(F.concat("jalali", F.lit(" 05:06:07")))
    return text.select("id", "jalali", jalali_to_date("jalali").alias("day"), stamp.alias("stamp"))


@query("d4_date_to_jalali", sql("SELECT id, date, jalali FROM jalali_orders", "jalali_orders"))
def _(t: Tables):
    return date_to_jalali(t.order_days)


@query("d5_normalize_readings", sql("SELECT id, date, usage FROM readings ORDER BY id, date", "readings"))
def _(t: Tables):
    raw = t.readings.select("id", F.col("date").cast("string").alias("date"), F.col("usage").cast("string").alias("usage"))
    return clean.normalize_readings(raw).orderBy("id", "date")


@query("d6_counter_to_usage", sql("""
    SELECT id, date, round(usage - prev, 4) AS usage FROM (
      SELECT id, date, usage, lag(usage) OVER (PARTITION BY id ORDER BY date) AS prev, row_number() OVER (PARTITION BY id ORDER BY date) AS rn
      FROM (SELECT id, date_trunc('hour', date) AS date, max(usage) AS usage FROM counters GROUP BY 1, 2)) WHERE rn > 1""", "counters"))
def _(t: Tables):
    return clean.counter_to_usage(t.counters).withColumn("usage", R4("usage"))


@query("d7_cycle_days", sql("""
    SELECT id, start_date, end_date, end_date - start_date AS days, seq FROM cycles
    WHERE id NOT IN (SELECT id FROM cycles WHERE end_date - start_date < 1)""", "cycles"))
def _(t: Tables):
    return clean.drop_short_cycles(t.cycles).select("id", "start_date", "end_date", "days", "seq")


MONTHLY = """
    SELECT m.id, last_day(m.month) AS date, round(coalesce(sum(v), 0), 4) AS usage FROM months m LEFT JOIN
      (SELECT id, date_trunc('month', day) AS month, v FROM days) d ON m.id = d.id AND m.month = d.month
    GROUP BY 1, 2"""
MONTHLY_PARTS = {
    "good": "SELECT * FROM cycles WHERE id NOT IN (SELECT id FROM cycles WHERE end_date - start_date < 1)",
    "days": """SELECT id, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day,
        (low + medium + high) / (end_date - start_date) AS v FROM good""",
    "months": """SELECT id, unnest(generate_series(date_trunc('month', CAST(min(start_date) AS TIMESTAMP)), date_trunc('month', CAST(max(end_date) AS TIMESTAMP)), INTERVAL 1 MONTH)) AS month
        FROM good GROUP BY id""",
}


@query("d8_cycles_to_monthly", sql(MONTHLY, "cycles", **MONTHLY_PARTS))
def _(t: Tables):
    return clean.cycles_to_monthly(clean.drop_short_cycles(t.cycles)).withColumn("usage", R4("usage"))


@query("d9_cycle_counters", sql("SELECT id, seq, " + ", ".join(
    f"round({c} - lag({c}) OVER (PARTITION BY id ORDER BY start_date, seq, high, low, medium), 4) AS {c}" for c in ("low", "medium", "high")) + " FROM cycles", "cycles"))
def _(t: Tables):
    out = clean.cycle_counters_to_usage(t.cycles, ("start_date", "seq", "high", "low", "medium"))
    return out.select("id", "seq", *[R4(c).alias(c) for c in ("low", "medium", "high")])


@query("d10_fill_none", sql("SELECT id, date, usage, seq FROM readings_gap", "readings_gap"))
def _(t: Tables):
    return fill.fill(t.readings_gap, "none", BY_SEQ)


@query("d11_fill_drop", sql("SELECT id, date, usage, seq FROM readings_gap WHERE usage IS NOT NULL", "readings_gap"))
def _(t: Tables):
    return fill.fill(t.readings_gap, "drop", BY_SEQ)


WIN = "(PARTITION BY id ORDER BY date, seq, usage ROWS BETWEEN {})"
BACK, AHEAD = WIN.format("UNBOUNDED PRECEDING AND CURRENT ROW"), WIN.format("CURRENT ROW AND UNBOUNDED FOLLOWING")


@query("d12_fill_previous", sql(f"""
    SELECT id, date, seq, coalesce(last_value(usage IGNORE NULLS) OVER {BACK}, first_value(usage IGNORE NULLS) OVER {AHEAD}) AS usage
    FROM readings_gap""", "readings_gap"))
def _(t: Tables):
    return fill.fill(t.readings_gap, "previous", BY_SEQ).select("id", "date", "seq", "usage")


@query("d13_fill_next", sql(f"""
    SELECT id, date, seq, coalesce(first_value(usage IGNORE NULLS) OVER {AHEAD}, last_value(usage IGNORE NULLS) OVER {BACK}) AS usage
    FROM readings_gap""", "readings_gap"))
def _(t: Tables):
    return fill.fill(t.readings_gap, "next", BY_SEQ).select("id", "date", "seq", "usage")


@query("d14_fill_linear", sql(f"""
    SELECT id, date, seq, round(CASE WHEN usage IS NOT NULL THEN usage WHEN p IS NULL THEN NULL WHEN n IS NULL THEN p
      ELSE p + (n - p) * (i - pi) / (ni - pi) END, 4) AS usage
    FROM (SELECT id, date, seq, usage, i,
      last_value(usage IGNORE NULLS) OVER {BACK} AS p, last_value(k IGNORE NULLS) OVER {BACK} AS pi,
      first_value(usage IGNORE NULLS) OVER {AHEAD} AS n, first_value(k IGNORE NULLS) OVER {AHEAD} AS ni
      FROM (SELECT *, CASE WHEN usage IS NOT NULL THEN i END AS k FROM
        (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date, seq, usage) AS i FROM readings_gap)))""", "readings_gap"))
def _(t: Tables):
    return fill.fill(t.readings_gap, "linear", BY_SEQ).select("id", "date", "seq", R4("usage").alias("usage"))


# ------------------------------------------------------------------ filters

@query("f1_select_user", sql("SELECT id, date, usage FROM readings WHERE id = 7", "readings"))
def _(t: Tables):
    return filters.select_user(t.readings, 7).select("id", "date", "usage")


@query("f2_random_user", sql(f"""
    SELECT id, date, usage FROM readings WHERE id = (SELECT id FROM readings ORDER BY {digest_sql(11, 'id', 'seq')}, id LIMIT 1)""", "readings"))
def _(t: Tables):
    return filters.select_random_user(t.readings, 11, ("id", "seq")).select("id", "date", "usage")


@query("f3_filter_date", sql("""
    SELECT id, date, usage FROM readings WHERE date > TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-01-20'""", "readings"))
def _(t: Tables):
    return filters.filter_date(t.readings, "2024-01-05", "2024-01-20").select("id", "date", "usage")


def _kept(condition: str) -> str:
    return f"SELECT id, date, usage FROM readings WHERE id IN (SELECT id FROM b GROUP BY id HAVING {condition})"


DAY_CTE = {"b": resample_sql("readings", 86400)}


@query("f4_share_above", sql(_kept("avg(CAST(usage > 80 AS INT)) > 0.5"), "readings", **DAY_CTE))
def _(t: Tables):
    return filters.share_above(t.readings, 0.5, "1D", 80).select("id", "date", "usage")


@query("f5_share_below", sql(_kept("avg(CAST(usage < 80 AS INT)) > 0.5"), "readings", **DAY_CTE))
def _(t: Tables):
    return filters.share_below(t.readings, 0.5, "1D", 80).select("id", "date", "usage")


@query("f6_day_night", sql("""
    SELECT id, date, usage FROM readings WHERE id IN (SELECT id FROM readings GROUP BY id
      HAVING avg(usage) FILTER (WHERE hour(date) BETWEEN 6 AND 17) > 15 AND avg(usage) FILTER (WHERE hour(date) NOT BETWEEN 6 AND 17) > 10
        AND avg(usage) FILTER (WHERE hour(date) BETWEEN 6 AND 17) < 60 AND avg(usage) FILTER (WHERE hour(date) NOT BETWEEN 6 AND 17) < 55)""", "readings"))
def _(t: Tables):
    return filters.day_night(t.readings, 15, 10, 60, 55).select("id", "date", "usage")


@query("f7_mean_below", sql(_kept("avg(usage) < 110"), "readings", **DAY_CTE))
def _(t: Tables):
    return filters.mean_below(t.readings, 110, "1D").select("id", "date", "usage")


@query("f7_total_below", sql("SELECT id, date, usage FROM readings WHERE id IN (SELECT id FROM readings GROUP BY id HAVING sum(usage) < 3300)", "readings"))
def _(t: Tables):
    return filters.mean_below(t.readings, 3300).select("id", "date", "usage")


@query("f8_mean_above", sql(_kept("avg(usage) > 110"), "readings", **DAY_CTE))
def _(t: Tables):
    return filters.mean_above(t.readings, 110, "1D").select("id", "date", "usage")


@query("f9_align_start", sql("""
    SELECT id, date, usage FROM readings WHERE date >= (SELECT max(d) FROM (SELECT min(date) AS d FROM readings GROUP BY id))""", "readings"))
def _(t: Tables):
    return filters.align_start(t.readings).select("id", "date", "usage")


@query("f10_enough_points", sql("SELECT id, date, usage FROM readings WHERE id IN (SELECT id FROM c WHERE c >= (SELECT avg(c) FROM c))",
    "readings", c="SELECT id, count(*) AS c FROM readings GROUP BY id"))
def _(t: Tables):
    return filters.enough_points(t.readings).select("id", "date", "usage")


@query("f11_in_users", sql("SELECT id, date, usage FROM readings WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "readings"))
def _(t: Tables):
    users = t.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("img"))
    return filters.in_users(t.readings, users, "img").select("id", "date", "usage")


@query("f12_after_known_date", sql("""
    SELECT r.id, r.date, r.usage, r.date > k.d AS after FROM readings r JOIN
      (SELECT user_id AS id, min(ts) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1) k ON r.id = k.id""", "readings"))
def _(t: Tables):
    known = t.events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("date"))
    return filters.after_known_date(t.readings, known).select("id", "date", "usage", "after")


@query("f13_nonzero_label", sql("SELECT vec_id AS id, label FROM embeddings WHERE label <> 0"))
def _(t: Tables):
    return filters.nonzero_label(t.vectors).select("id", "label")


# -------------------------------------------------------- joins, sets, sorts

@query("j1_semi_join", sql("SELECT id, date, usage FROM series_long WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", "series_long"))
def _(t: Tables):
    rich = t.table("supplier").filter("s_acctbal > 0")
    return filters.in_users(t.series_long, rich, "s_suppkey").select("id", "date", "usage")


@query("j2_anti_join", sql("SELECT id, date, usage FROM series_long WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", "series_long"))
def _(t: Tables):
    rich = t.table("supplier").filter("s_acctbal > 0")
    return filters.not_in_users(t.series_long, rich, "s_suppkey").select("id", "date", "usage")


@query("u1_append", sql("""
    SELECT DISTINCT user_id AS id, true AS mining, false AS theft FROM events WHERE event_type = 'error'
    UNION ALL SELECT DISTINCT user_id, false, true FROM events WHERE event_type = 'signup'"""))
def _(t: Tables):
    id_ = F.col("user_id").alias("id")
    miners = t.events.filter("event_type = 'error'").select(id_).distinct().withColumn("mining", F.lit(True))
    thieves = t.events.filter("event_type = 'signup'").select(id_).distinct().withColumn("theft", F.lit(True))
    return miners.unionByName(thieves, allowMissingColumns=True).na.fill(False)


@query("o1_sort", sql("SELECT id, date, usage FROM series_long ORDER BY id, date, seq", "series_long"))
def _(t: Tables):
    return t.series_long.orderBy("id", "date", "seq").select("id", "date", "usage")


@query("o2_top_windows", sql("SELECT id, round(usage, 4) AS usage FROM long_weeks ORDER BY round(usage, 4) DESC, id, idx LIMIT 10", "long_weeks"))
def _(t: Tables):
    weeks = rs.resample(t.series_long, "7D").withColumn("usage", R4("usage"))
    return weeks.orderBy(F.desc("usage"), "id", "idx").limit(10).select("id", "usage")


@query("o3_distinct_ids", sql("SELECT DISTINCT id FROM readings", "readings"))
def _(t: Tables):
    return t.readings.select("id").distinct()


# ---------------------------------------------------------------- aggregates

for _name, _source, _freq, _step in (
    ("a1_resample_hour", "readings", "1H", 3600),
    ("a1_resample_week", "series_long", "7D", 604800),
    ("a1_resample_5h", "readings", "5H", 18000),
):
    def _build(t: Tables, source=_source, freq=_freq):
        return rs.resample(getattr(t, source), freq).withColumn("usage", R4("usage"))

    query(_name, sql("SELECT id, idx, date, round(usage, 4) AS usage FROM b", _source, b=resample_sql(_source, _step)))(_build)


@query("a2_hourly_rollup", sql("SELECT id, date, round(usage, 4) AS usage FROM b", half="""
    SELECT user_id AS id, date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 30 * 30 AS BIGINT)) AS date, value AS usage FROM events""",
    b=resample_sql("half", 3600)))
def _(t: Tables):
    from meterloom.sources.readers import decode_meter_code

    return rs.resample(decode_meter_code(meter_codes(t)), "1H").select("id", "date", R4("usage").alias("usage"))


def meter_codes(t: Tables):
    day = F.datediff("ts", F.lit("2009-01-01").cast("date"))
    slot = F.hour("ts") * 2 + F.floor(F.minute("ts") / 30) + 1
    return t.events.select(F.col("user_id").alias("id"), (day * 100 + slot).cast("int").alias("code"), F.col("value").alias("usage"))


@query("a3_multi_resample", sql("""
    SELECT id, date, round(usage, 4) AS usage, '1H' AS freq FROM b1 UNION ALL SELECT id, date, round(usage, 4), '1D' FROM b2
    UNION ALL SELECT id, date, round(usage, 4), '7D' FROM b3""", "readings",
    b1=resample_sql("readings", 3600), b2=resample_sql("readings", 86400), b3=resample_sql("readings", 604800)))
def _(t: Tables):
    return rs.multi_resample(t.readings).select("id", "date", R4("usage").alias("usage"), "freq")


@query("a4_hour_profile", sql("SELECT id, hour(date) AS hour, round(avg(usage), 4) AS usage FROM readings GROUP BY 1, 2", "readings"))
def _(t: Tables):
    return rs.hour_profile(t.readings).withColumn("usage", R4("usage"))


@query("a5_fleet_mean", sql("SELECT date, round(avg(usage), 4) AS usage FROM series_long GROUP BY 1", "series_long"))
def _(t: Tables):
    return rs.fleet_mean(t.series_long).withColumn("usage", R4("usage"))


@query("a6_any_aggregate", sql("SELECT b.id, b.date, round(b.usage, 4) AS usage, f.usage AS anomaly FROM b JOIN f ON b.id = f.id AND b.idx = f.idx",
    marked="SELECT user_id AS id, ts AS date, value AS usage, event_type = 'error' AS anomaly FROM events",
    b=resample_sql("marked", 86400), f=resample_sql("marked", 86400, "bool_or(s.anomaly)", "false")))
def _(t: Tables):
    marked = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("date"), F.col("value").alias("usage"), (F.col("event_type") == "error").alias("anomaly"))
    return rs.resample(marked, "1D", {"usage": "sum", "anomaly": "any"}).select("id", "date", R4("usage").alias("usage"), "anomaly")


@query("a7_weekly_features", sql("SELECT id, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("mean", "max", "min", "std", "median")) + " FROM week_features", "week_features"))
def _(t: Tables):
    return rs.weekly_features(t.series_long).select("id", *[R4(c).alias(c) for c in ("mean", "max", "min", "std", "median")])


@query("a8_first_dates", sql("SELECT id, min(date) AS first_date, count(*) AS rows FROM readings GROUP BY id", "readings"))
def _(t: Tables):
    return rs.first_dates(t.readings)


@query("a9_frequent_windows", sql(
    "SELECT v0, v1, v2, v3, v4, v5, v6, count(*) AS n FROM l WHERE v6 IS NOT NULL GROUP BY ALL ORDER BY n DESC, v0, v1, v2, v3, v4, v5, v6 LIMIT 10",
    "series_long", b=resample_sql("series_long", 86400),
    d="SELECT id, idx, round_even(usage - lag(usage) OVER (PARTITION BY id ORDER BY idx), 1) + 0.0 AS d FROM b QUALIFY idx > 0",
    l="SELECT " + ", ".join(f"lead(d, {i}) OVER (PARTITION BY id ORDER BY idx) AS v{i}" for i in range(7)) + " FROM d"))
def _(t: Tables):
    return rs.frequent_windows(t.series_long)


@query("a12_segment_means", sql("SELECT id, segment, round(avg(d), 6) AS mean, round(var_samp(d), 2) AS var FROM n GROUP BY 1, 2", "readings_gap",
    d="SELECT *, usage - lag(usage) OVER (PARTITION BY id ORDER BY date, seq, usage) AS d FROM readings_gap",
    n="SELECT id, d, (row_number() OVER (PARTITION BY id ORDER BY date, seq, usage) - 1) % 7 AS segment FROM d WHERE d IS NOT NULL"))
def _(t: Tables):
    return rs.segment_means(t.readings_gap, 7, BY_SEQ).select("id", "segment", F.round("mean", 6).alias("mean"), F.round("var", 2).alias("var"))


@query("a13_column_stats", sql("SELECT round(avg(usage), 4) AS mean, round(stddev_samp(usage), 4) AS std FROM readings", "readings"))
def _(t: Tables):
    return rs.column_stats(t.readings).select(R4("mean").alias("mean"), R4("std").alias("std"))


# ------------------------------------------------------------------- windows

for _k in (1, 7):
    def _build(t: Tables, k=_k):
        return w.lag_diff(t.readings, k, BY_SEQ).select("id", "date", "seq", R4("usage").alias("usage"))

    query(f"w1_lag_diff_{_k}", sql(f"""SELECT id, date, seq, round(d, 4) AS usage FROM
      (SELECT *, usage - lag(usage, {_k}) OVER (PARTITION BY id ORDER BY date, seq, usage) AS d FROM readings) WHERE d IS NOT NULL""", "readings"))(_build)


BAND = "(PARTITION BY id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
BAND_CTE = {"band": f"""SELECT *, CASE WHEN idx >= 20 THEN avg(usage) OVER {BAND} END AS mean,
    CASE WHEN idx >= 20 THEN avg(usage) OVER {BAND} + 2.5 * stddev_samp(usage) OVER {BAND} END AS upper,
    CASE WHEN idx >= 20 THEN avg(usage) OVER {BAND} - 2.5 * stddev_samp(usage) OVER {BAND} END AS lower FROM planted"""}


@query("w2_rolling_band", sql("SELECT id, idx, round(mean, 4) AS mean, round(upper, 4) AS upper, round(lower, 4) AS lower FROM band", "planted", **BAND_CTE))
def _(t: Tables):
    return w.rolling_band(t.planted, 20, 2.5).select("id", "idx", R4("mean").alias("mean"), R4("upper").alias("upper"), R4("lower").alias("lower"))


@query("w3_sliding_windows", sql("""
    SELECT id, idx, pos, round(usage, 4) AS usage FROM (
      SELECT b.id, b.idx, p.pos, lead(b.usage, CAST(p.pos AS INT)) OVER (PARTITION BY b.id, p.pos ORDER BY b.idx) AS usage,
        max(b.idx) OVER (PARTITION BY b.id) AS last FROM b CROSS JOIN (SELECT unnest(range(7)) AS pos) p) WHERE idx + 6 <= last""",
    "readings", b=resample_sql("readings", 86400)))
def _(t: Tables):
    days = w.sliding_windows(rs.resample(t.readings, "1D"), 7)
    return days.select("id", "idx", F.posexplode("values").alias("pos", "usage")).withColumn("usage", R4("usage"))


SEG_SQL = """SELECT id, (rn - 1) // {L} AS segment, (rn - 1) % {L} AS pos, usage FROM
    (SELECT id, usage, rn, count(usage) OVER (PARTITION BY id, (rn - 1) // {L}) AS c FROM
      (SELECT id, usage, row_number() OVER (PARTITION BY id ORDER BY date, seq, usage) AS rn FROM {src})) WHERE c = {L}"""


@query("w4_segments", sql(SEG_SQL.format(L=24, src="readings_gap"), "readings_gap"))
def _(t: Tables):
    blocks = w.segments(t.readings_gap, 24, BY_SEQ)
    return blocks.select("id", "segment", F.posexplode("values").alias("pos", "usage"))


@query("w4_segments_long", sql(SEG_SQL.format(L=30, src="series_long"), "series_long"))
def _(t: Tables):
    return w.segments(t.series_long, 30, BY_SEQ).select("id", "segment", F.posexplode("values").alias("pos", "usage"))


RUNS = """SELECT *, sum(CASE WHEN label = prev THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, lag(label) OVER (PARTITION BY id ORDER BY ord) AS prev FROM {src})"""
SHORT_SEQ = "SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS ord, label, f0, f1 FROM sequences"


def short_sequences(t: Tables):
    """Event sequences with a dense 0-based order per user."""
    numbered = positions(t.sequences, RowOrder(("id",), ("order",)))
    return numbered.select("id", (F.col("pos") - 1).alias("order"), "label", "f0", "f1")


@query("w5_run_segments", sql("""
    SELECT id, run, label, ord // 2 AS segment, ord % 2 AS pos, f AS feature, CASE f WHEN 0 THEN f0 ELSE f1 END AS value FROM
      (SELECT *, count(*) OVER (PARTITION BY id, run, ord // 2) AS c FROM r) CROSS JOIN (SELECT unnest(range(2)) AS f) WHERE c = 2 AND label <> 2""",
    "sequences", s=SHORT_SEQ, r=RUNS.format(src="s")))
def _(t: Tables):
    got = w.run_segments(short_sequences(t), 2, ["f0", "f1"], drop_label=2)
    return got.select("id", "run", "label", "segment", "feature", F.posexplode("values").alias("pos", "value"))


@query("w6_label_segments", sql("""
    SELECT id, label, ord // 2 AS segment, ord % 2 AS pos, f AS feature, CASE f WHEN 0 THEN f0 ELSE f1 END AS value FROM
      (SELECT *, count(*) OVER (PARTITION BY id, label, ord // 2) AS c FROM s) CROSS JOIN (SELECT unnest(range(2)) AS f) WHERE c = 2""",
    "sequences", s=SHORT_SEQ))
def _(t: Tables):
    got = w.label_segments(short_sequences(t), 2, ["f0", "f1"])
    return got.select("id", "label", "segment", "feature", F.posexplode("values").alias("pos", "value"))


@query("w7_round_values", sql("SELECT id, date, round_even(usage, 1) AS usage FROM readings", "readings"))
def _(t: Tables):
    return t.readings.select("id", "date", w.round_values("usage", 1).alias("usage"))


ANOMALY_DAYS = {
    "marked": "SELECT user_id AS id, ts AS date, value AS usage, event_type = 'error' AS anomaly FROM events",
    "du": resample_sql("marked", 86400), "df": resample_sql("marked", 86400, "bool_or(s.anomaly)", "false"),
    "days": "SELECT du.id, du.idx, du.usage, df.usage AS anomaly FROM du JOIN df ON du.id = df.id AND du.idx = df.idx",
}


def _anomaly_days(t: Tables):
    marked = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("date"), F.col("value").alias("usage"), (F.col("event_type") == "error").alias("anomaly"))
    return rs.resample(marked, "1D", {"usage": "sum", "anomaly": "any"})


@query("w8_segment_label", sql("""
    SELECT id, idx // 7 AS segment, CASE WHEN sum(CAST(anomaly AS INT)) > 0 AND sum(CAST(anomaly AS INT)) < 7 THEN 1 ELSE 0 END AS label
    FROM days GROUP BY 1, 2 HAVING count(usage) = 7""", **ANOMALY_DAYS))
def _(t: Tables):
    return w.segment_label(_anomaly_days(t), 7, full=7).select("id", "segment", "label")


@query("w9_segment_to_row", sql("""
    SELECT id, idx // 7 AS segment, CASE WHEN sum(CAST(anomaly AS INT)) > 0 AND sum(CAST(anomaly AS INT)) < 7 THEN 1 ELSE 0 END AS label, """
    + ", ".join(f"round(sum(CASE WHEN idx % 7 = {i} THEN usage END), 4) AS v{i}" for i in range(7))
    + " FROM days GROUP BY 1, 2 HAVING count(usage) = 7", **ANOMALY_DAYS))
def _(t: Tables):
    wide = w.segment_to_row(w.segment_label(_anomaly_days(t), 7, full=7), 7)
    return wide.select("id", "segment", "label", *[R4(f"v{i}").alias(f"v{i}") for i in range(7)])


@query("w10_day_grid", sql("SELECT id, CAST(date AS DATE) AS day, " + ", ".join(
    f"arg_min(usage, date) FILTER (WHERE hour(date) = {h}) AS h{h}" for h in range(24)) + " FROM readings GROUP BY 1, 2", "readings"))
def _(t: Tables):
    return w.day_grid(t.readings)


@query("w11_minmax_by_series", sql("""
    SELECT id, date, seq, round((usage - min(usage) OVER (PARTITION BY id)) / (max(usage) OVER (PARTITION BY id) - min(usage) OVER (PARTITION BY id)) * 255, 4) AS usage
    FROM readings""", "readings"))
def _(t: Tables):
    return w.minmax_by_series(t.readings, 0, 255).select("id", "date", "seq", R4("usage").alias("usage"))


@query("w12_minmax_by_position", sql("""
    SELECT item, feature, pos, round((v - lo) / (hi - lo), 4) AS value FROM
      (SELECT item, feature, pos, v, min(v) FILTER (WHERE label < 7) OVER (PARTITION BY feature, pos) AS lo, max(v) FILTER (WHERE label < 7) OVER (PARTITION BY feature, pos) AS hi
       FROM (SELECT item, label, feature, unnest(range(16)) AS pos, unnest(vals) AS v FROM parts))""", "parts"))
def _(t: Tables):
    ranges = w.position_ranges(t.parts.filter("label < 7"))
    scaled = w.minmax_by_position(t.parts, ranges)
    return scaled.select("item", "feature", F.posexplode("values").alias("pos", "value")).withColumn("value", R4("value"))


@query("w13_standardize", sql("SELECT id, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("mean", "max", "min", "std", "median")) + " FROM z_features", "z_features"))
def _(t: Tables):
    names = ["mean", "max", "min", "std", "median"]
    return w.standardize(rs.weekly_features(t.series_long), names).select("id", *[R4(c).alias(c) for c in names])
