"""Detection, injection, splits, labels and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.operators import detect as dt, images, inject, labels, spectral, split, windows as w
from meterloom.operators.ordered import SERIES
from meterloom.operators.resample import resample
from meterloom.plans.catalog import query
from meterloom.plans.cleaning import BAND_CTE, R4, SEG_SQL
from meterloom.plans.tables import BY_SEQ, Tables, digest_sql, resample_sql, sql, uniform_sql

PARAM = dt.DetectionParam("7D", 20, 2.5, 10, 8)

# ---------------------------------------------------------------- detection

def event_ctes(source: str, window: int = 20, std: float = 2.5, m: int = 10, n: int = 8) -> dict[str, str]:
    back = f"(PARTITION BY id ORDER BY idx ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return {
        "band": f"""SELECT *, CASE WHEN idx >= {window} THEN avg(usage) OVER {back} + {std} * stddev_samp(usage) OVER {back} END AS upper,
            CASE WHEN idx >= {window} THEN avg(usage) OVER {back} - {std} * stddev_samp(usage) OVER {back} END AS lower FROM {source}""",
        "ahead": f"SELECT *, list(usage) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {m} FOLLOWING) AS nxt FROM band",
        "hits": f"""SELECT id, idx, date, CASE
            WHEN usage > upper AND len(list_filter(nxt, lambda x: x > upper AND x > 20)) >= {n} THEN 'mining'
            WHEN usage < lower AND len(list_filter(nxt, lambda x: x < lower)) >= {n} THEN 'theft' END AS event FROM ahead""",
        "first_hits": "SELECT id, idx, date, event FROM hits WHERE event IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY idx) = 1",
    }


SENSITIVE = dt.DetectionParam("7D", 10, 1.0, 6, 4)


@query("x2_band_breaches", sql("""
    SELECT id, idx, date, CASE WHEN usage > upper THEN 'mining' ELSE 'theft' END AS kind FROM band WHERE usage > upper OR usage < lower""", "planted", **BAND_CTE))
def _(t: Tables):
    return dt.band_breaches(t.planted, PARAM).select("id", "idx", "date", "kind")


@query("x3_first_events", sql("SELECT id, idx, date, event FROM first_hits", "planted", **event_ctes("planted")))
def _(t: Tables):
    return dt.first_events(t.planted, PARAM)


@query("x3_first_events_long", sql("SELECT id, idx, date, event FROM first_hits", "long_weeks", **event_ctes("long_weeks", 10, 1.0, 6, 4)))
def _(t: Tables):
    return dt.first_events(resample(t.series_long, "7D"), SENSITIVE)


# the scan as a recursion: one row per visited position, carrying the excluded
# positions so far and the run confirmed there, if any
SCAN = """
    walk AS (
      SELECT id, u, {W} AS pos, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS bound, 0 AS origin, 0 AS step
      FROM lists
      UNION ALL
      SELECT id, u, CASE WHEN st > 1 THEN pos + {W} + st + 1 ELSE pos + 1 END,
        CASE WHEN st > 1 THEN list_concat(list_filter(gone, lambda p: NOT (p BETWEEN pos + 1 AND pos + st + {M} - 1)),
          list_filter(range(pos + 1, least(pos + st + {M}, len(u))), lambda p: NOT CASE k WHEN 'mining' THEN u[p + 1] < b ELSE u[p + 1] > b END)) ELSE gone END,
        CASE WHEN st > 1 THEN k END, b, pos, st
      FROM (
        SELECT *, CASE WHEN k IS NULL THEN 1 ELSE list_min(list_filter(range(1, len(u) - pos + 1),
            lambda s: len(list_filter(u[pos + s + 1 : pos + s + {M}], lambda x: CASE k WHEN 'mining' THEN x > b AND x > 20 ELSE x < b END)) < {N})) END AS st
        FROM (
          SELECT id, u, pos, gone, CASE WHEN u[pos + 1] > m + {S} * d THEN 'mining' WHEN u[pos + 1] < m - {S} * d THEN 'theft' END AS k,
            CASE WHEN u[pos + 1] > m + {S} * d THEN m + {S} * d ELSE m - {S} * d END AS b
          FROM (
            SELECT id, u, pos, gone, list_avg(base) AS m, list_aggregate(base, 'stddev_samp') AS d
            FROM (SELECT id, u, pos, gone,
                    list_transform(list_filter(range(pos - {W}, len(u)), lambda p: NOT list_contains(gone, p))[1:{W}], lambda p: u[p + 1]) AS base
                  FROM walk WHERE pos < len(u)))))
    ),
    flagged AS (
      SELECT id, p AS idx, kind, CASE kind WHEN 'mining' THEN u[p + 1] > bound ELSE u[p + 1] < bound END AS hit
      FROM (SELECT id, u, kind, bound, unnest(range(origin + 1, least(origin + step + {M}, len(u)))) AS p FROM walk WHERE kind IS NOT NULL)),
    flags AS (
      SELECT s.id, s.idx, s.date, s.usage, coalesce(bool_or(f.hit AND f.kind = 'mining'), false) AS mining,
        coalesce(bool_or(f.hit AND f.kind = 'theft'), false) AS theft
      FROM {SOURCE} s LEFT JOIN flagged f ON s.id = f.id AND s.idx = f.idx GROUP BY 1, 2, 3, 4)"""


def scan_sql(body: str, source: str, window: int = 20, std: float = 2.5, m: int = 10, n: int = 8) -> str:
    head = sql("", source, lists=f"SELECT id, list(usage ORDER BY idx) AS u FROM {source} GROUP BY id").rstrip()
    walk = SCAN
    for key, value in {"W": window, "S": std, "M": m, "N": n, "SOURCE": source}.items():
        walk = walk.replace("{" + key + "}", str(value))
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + "," + walk + " " + body


@query("x4_scan_planted", scan_sql("SELECT id, idx, date, round(usage, 4) AS usage, mining, theft FROM flags", "planted"))
def _(t: Tables):
    return dt.scan(t.planted, PARAM, keep_all=True).select("id", "idx", "date", R4("usage").alias("usage"), "mining", "theft")


@query("x4_detect", scan_sql("""
    SELECT id, idx, round(usage, 4) AS usage, mining, theft FROM flags WHERE id IN (SELECT id FROM flags WHERE mining OR theft)""", "long_weeks", 10, 1.0, 6, 4))
def _(t: Tables):
    return dt.detect(t.series_long, SENSITIVE).select("id", "idx", R4("usage").alias("usage"), "mining", "theft")


@query("x5_suspect_rows", scan_sql("SELECT id, idx, mining, theft FROM flags WHERE id IN (SELECT id FROM flags WHERE mining OR theft)", "planted"))
def _(t: Tables):
    return dt.suspect_rows(dt.scan(t.planted, PARAM)).select("id", "idx", "mining", "theft")


@query("x6_verdicts", scan_sql("""
    SELECT DISTINCT id, true AS mining, false AS theft FROM flags WHERE mining UNION ALL SELECT DISTINCT id, false, true FROM flags WHERE theft""", "planted"))
def _(t: Tables):
    return dt.verdicts(dt.scan(t.planted, PARAM))


@query("x7_plot_points", sql("""
    SELECT id, date, jalali, usage, CASE WHEN theft THEN usage END AS point FROM r JOIN jalali_days ON day = CAST(date AS DATE)
    WHERE id = 7 AND (SELECT bool_or(theft) FROM r WHERE id = 7)""", "jalali_starts",
    jalali_days="""SELECT day, printf('%04d/%02d/%02d', y, CASE WHEN n < 186 THEN n // 31 + 1 ELSE (n - 186) // 30 + 7 END,
        CASE WHEN n < 186 THEN n % 31 + 1 ELSE (n - 186) % 30 + 1 END) AS jalali
      FROM (SELECT y, unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS stamp, CAST(stamp AS DATE) AS day, CAST(stamp AS DATE) - d0 AS n FROM jalali_starts WHERE d1 IS NOT NULL)""",
    r="SELECT user_id AS id, ts AS date, value AS usage, event_type = 'error' AS theft FROM events"))
def _(t: Tables):
    flags = t.events.select(
        F.col("user_id").alias("id"), F.col("ts").alias("date"), F.col("value").alias("usage"),
        F.lit(False).alias("mining"), (F.col("event_type") == "error").alias("theft"),
    )
    return dt.plot_points(flags, 7, "theft")


PROFILE = """
    SELECT p.id, p.idx, round(sqrt(min(greatest(CASE WHEN p.s = 0 AND q.s = 0 THEN 0 WHEN p.s = 0 OR q.s = 0 THEN 4 ELSE
        pow((p.u0 - p.m) / p.s - (q.u0 - q.m) / q.s, 2) + pow((p.u1 - p.m) / p.s - (q.u1 - q.m) / q.s, 2)
        + pow((p.u2 - p.m) / p.s - (q.u2 - q.m) / q.s, 2) + pow((p.u3 - p.m) / p.s - (q.u3 - q.m) / q.s, 2) END, 0))), 3) AS distance
    FROM z p JOIN z q ON p.id = q.id AND abs(p.idx - q.idx) > 1 GROUP BY 1, 2"""
PROFILE_CTE = {
    "l": "SELECT id, idx, usage AS u0, " + ", ".join(f"lead(usage, {i}) OVER (PARTITION BY id ORDER BY idx) AS u{i}" for i in (1, 2, 3)) + " FROM weeks",
    "z": "SELECT *, (u0 + u1 + u2 + u3) / 4 AS m, list_aggregate([u0, u1, u2, u3], 'stddev_pop') AS s FROM l WHERE u3 IS NOT NULL",
}
REDUCED = f"""SELECT id, date, seq, CASE WHEN hit THEN usage * f ELSE usage END AS usage, hit AS anomaly FROM (
      SELECT s.id, s.date, s.seq, s.usage, epoch_us(s.date) BETWEEN lo AND least(lo + span + CASE WHEN span < 60 * 86400 * 1e6 THEN 60 * 86400 * 1e6 ELSE 0 END, e) AS hit, f
      FROM series_long s JOIN (
        SELECT id, e, f, q + (e - q) * {uniform_sql(5, "'start'", 'id')} * 0.5 AS lo, (e - q) * {uniform_sql(5, "'span'", 'id')} AS span FROM (
          SELECT id, CAST(epoch_us(max(date)) AS DOUBLE) AS e, epoch_us(min(date)) + (epoch_us(max(date)) - epoch_us(min(date))) / 4 AS q,
            0.2 + {uniform_sql(5, "'factor'", 'id')} * 0.3 AS f FROM series_long GROUP BY id)) p ON s.id = p.id)"""


@query("x8_matrix_profile", sql(PROFILE, "long_weeks", weeks="SELECT * FROM long_weeks", **PROFILE_CTE))
def _(t: Tables):
    profile = dt.matrix_profile(resample(t.series_long, "7D"), 4)
    return profile.select("id", "idx", F.round("distance", 3).alias("distance"))


@query("x8_matrix_profile_anomaly", sql(PROFILE, "series_long", reduced=REDUCED, weeks=resample_sql("reduced", 604800), **PROFILE_CTE))
def _(t: Tables):
    profile = dt.matrix_profile(resample(inject.reduce_random_interval(t.series_long, 5), "7D"), 4)
    return profile.select("id", "idx", F.round("distance", 3).alias("distance"))


@query("x9_reconstruction_error")
def _(t: Tables):
    scaled = w.minmax_by_series(resample(t.readings, "1H"), 0, 1, bounded=True)
    return dt.reconstruction_error(scaled, 168, 4)


JUDGED = "SELECT id, bool_or(mining) AS mining, bool_or(theft) AS theft FROM flags GROUP BY id"


@query("x10_class_score", scan_sql(f"SELECT round(avg(CAST(CASE WHEN id % 2 = 0 THEN mining ELSE theft END AS INT)), 4) AS score FROM ({JUDGED})", "planted"))
def _(t: Tables):
    return dt.class_score(dt.verdicts(dt.scan(t.planted, PARAM)), t.truth).select(R4("score").alias("score"))


@query("j6_label_join", scan_sql(f"SELECT id, mining, theft, CASE WHEN id % 2 = 0 THEN 'mining' ELSE 'theft' END AS truth, CASE WHEN id % 2 = 0 THEN mining ELSE theft END AS hit FROM ({JUDGED})", "planted"))
def _(t: Tables):
    rows = dt.judged(dt.verdicts(dt.scan(t.planted, PARAM)), t.truth)
    return rows.select("id", F.col("_m").alias("mining"), F.col("_t").alias("theft"), F.when(F.col("mining") != 0, "mining").otherwise("theft").alias("truth"), F.col("right").alias("hit"))


@query("x11_param_search")
def _(t: Tables):
    clusters = t.truth.select((F.col("id") % 2).cast("int").alias("cluster"), "id")
    return dt.param_search(t.planted.select("id", "date", "usage"), t.truth, clusters, dt.seeded_params(12, 3))


# ---------------------------------------------------------------- injection

@query("g1_reduce_interval", sql("SELECT id, seq, round(usage, 4) AS usage, anomaly FROM reduced", "series_long", reduced=REDUCED))
def _(t: Tables):
    got = inject.reduce_random_interval(t.series_long, 5)
    return got.select("id", "seq", R4("usage").alias("usage"), "anomaly")


ATTACK_SQL = {
    1: "list_transform(v, lambda x: x * {f})",
    2: "list_transform(v, lambda x, i: x * {each})",
    3: "list_transform(v, lambda x: list_avg(v))",
    4: "list_transform(v, lambda x: list_avg(v) * {f})",
    5: "list_reverse(v)",
    6: "list_transform(v, lambda x: CAST(0 AS DOUBLE))",
}


def attack_sql(kind: int, seed, key: list[str], v: str) -> str:
    f = f"(0.2 + {uniform_sql(seed, repr('factor'), *key)} * 0.6)"
    each = f"(0.2 + {uniform_sql(seed, repr('each'), *key, '(i - 1)')} * 0.6)"
    return ATTACK_SQL[kind].format(f=f, each=each).replace("(v", f"({v}")


for _kind in ATTACK_SQL:
    def _build(t: Tables, kind=_kind):
        hit = t.vectors.select("id", F.posexplode(inject.attack(kind, "values", 9, "id")).alias("pos", "value"))
        return hit.withColumn("value", F.round("value", 6))

    query(f"g{_kind + 1}_attack{_kind}", sql(f"""SELECT id, unnest(range(64)) AS pos, round(unnest(w), 6) AS value
        FROM (SELECT id, {attack_sql(_kind, 9, ['id'], 'vals')} AS w FROM vectors)""", "vectors"))(_build)


WEEK_BLOCKS = f"SELECT id, segment, list(usage ORDER BY pos) AS vals FROM ({SEG_SQL.format(L=168, src='series_long')}) GROUP BY 1, 2"
INJECT_CTE = {
    "blocks": WEEK_BLOCKS,
    "plan": f"""SELECT *, CAST(floor({uniform_sql(4, "'start'", 'id', 'segment')} * 121) AS INT) AS s,
        CAST(floor({uniform_sql(4, "'kind'", 'id', 'segment')} * 6) AS INT) + 1 AS k,
        CASE WHEN {uniform_sql(4, "'hit'", 'id', 'segment')} < 0.3 THEN 1 ELSE 0 END AS label FROM blocks""",
    "sized": f"""SELECT *, 48 + CAST(floor({uniform_sql(4, "'length'", 'id', 'segment')} * (168 - s - 48 + 1)) AS INT) AS n FROM plan""",
    "sliced": "SELECT *, vals[s + 1 : s + n] AS part FROM sized",
    "attacked": "SELECT id, segment, label, CASE WHEN label = 0 THEN vals ELSE list_concat(list_concat(vals[1 : s], CASE k "
    + " ".join(f"WHEN {k} THEN {attack_sql(k, 4, ['id', 'segment'], 'part')}" for k in ATTACK_SQL) + " END), vals[s + n + 1 : 168]) END AS vals FROM sliced",
}


@query("g8_inject_attacks", sql("SELECT id, segment, label, unnest(range(168)) AS pos, round(unnest(vals), 4) AS usage FROM attacked", "series_long", **INJECT_CTE))
def _(t: Tables):
    return inject.weekly_layout(inject.inject_attacks(t.series_long, 7, 0.3, 4, BY_SEQ)).withColumn("usage", R4("usage"))


@query("g9_daily_layout", sql("""
    SELECT id, segment, label, p // 24 AS day, round(sum(u), 3) AS total, round(sum(u * (p % 24 + 1)), 3) AS weighted, round(max(CASE WHEN p % 24 = 23 THEN u END), 4) AS last_hour
    FROM (SELECT id, segment, label, unnest(range(168)) AS p, unnest(vals) AS u FROM attacked) GROUP BY 1, 2, 3, 4""", "series_long", **INJECT_CTE))
def _(t: Tables):
    days = inject.daily_layout(inject.inject_attacks(t.series_long, 7, 0.3, 4, BY_SEQ))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return days.select("id", "segment", "label", "day", F.round(total, 3).alias("total"), row_weighted(3, "values").alias("weighted"), R4(F.element_at("values", 24)).alias("last_hour"))


@query("g10_attack_windows", sql(f"""
    SELECT id, idx, label, unnest(range(7)) AS pos, round(unnest(CASE WHEN label = 0 THEN vals ELSE CASE k {" ".join(f"WHEN {k} THEN {attack_sql(k, 6, ['id', 'idx'], 'vals')}" for k in ATTACK_SQL)} END END), 4) AS usage
    FROM marked WHERE len(vals) = 7""", "readings", b=resample_sql("readings", 86400),
    win="SELECT id, idx, list(usage) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS vals FROM b",
    marked=f"""SELECT *, CASE WHEN {uniform_sql(6, "'hit'", 'id', 'idx')} < 0.3 THEN 1 ELSE 0 END AS label,
        CAST(floor({uniform_sql(6, "'kind'", 'id', 'idx')} * 6) AS INT) + 1 AS k FROM win"""))
def _(t: Tables):
    hit = inject.attack_windows(w.sliding_windows(resample(t.readings, "1D"), 7), 0.3, 6)
    return hit.select("id", "idx", "label", F.posexplode("values").alias("pos", "usage")).withColumn("usage", R4("usage"))


# ------------------------------------------------------ sampling, splitting

@query("p1_sample_users", sql(f"""
    SELECT id, date, usage FROM readings WHERE id IN (SELECT id FROM (SELECT DISTINCT id FROM readings) ORDER BY {digest_sql(2, 'id')}, id LIMIT 100)""", "readings"))
def _(t: Tables):
    return split.sample_users(t.readings, 100, 2).select("id", "date", "usage")


def ranked_sql(seed, strata: str = "") -> str:
    over = f"PARTITION BY {strata} " if strata else ""
    whole = f"(PARTITION BY {strata})" if strata else "()"
    return f"SELECT id, label, row_number() OVER ({over}ORDER BY {digest_sql(seed, 'id')}, id) AS r, count(*) OVER {whole} AS n FROM vectors"


@query("p2_sample_fraction", sql(f"SELECT id FROM ({ranked_sql(3)}) WHERE r <= floor(0.1 * n + 1e-9)", "vectors"))
def _(t: Tables):
    return split.sample_fraction(t.vectors, 0.1, ("id",), 3).select("id")


@query("p3_shuffle", sql(f"SELECT id, r AS place FROM ({ranked_sql(4)})", "vectors"))
def _(t: Tables):
    return split.shuffle(t.vectors, ("id",), 4).select("id", "place")


@query("p4_split_users", sql(f"""
    SELECT s.id, s.date, s.usage, s.seq, r <= ceil(n * 0.25 - 1e-9) AS test FROM series_long s JOIN
      (SELECT id, row_number() OVER (ORDER BY {digest_sql(5, 'id')}, id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM series_long)) USING (id)""", "series_long"))
def _(t: Tables):
    return split.split_users(t.series_long, 0.25, 5)


@query("p5_split_rows", sql(f"SELECT id, r <= ceil(n * 0.33 - 1e-9) AS test FROM ({ranked_sql(6)})", "vectors"))
def _(t: Tables):
    return split.split_rows(t.vectors, 0.33, ("id",), 6).select("id", "test")


@query("p6_split_tail", sql("""
    SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) > floor(0.7 * count(*) OVER (PARTITION BY label) + 1e-9) AS test FROM vectors""", "vectors"))
def _(t: Tables):
    return split.split_stratified_tail(t.vectors, ("id",), 0.7).select("id", "label", "test")


@query("p7_split_half", sql("""
    SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY idx) > count(*) OVER (PARTITION BY id) // 2 AS test
    FROM b QUALIFY idx + 6 <= max(idx) OVER (PARTITION BY id)""".replace(
        "SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY idx) > count(*) OVER (PARTITION BY id) // 2 AS test",
        "SELECT id, idx, idx + 1 > (max(idx) OVER (PARTITION BY id) - 5) // 2 AS test"), "readings", b=resample_sql("readings", 86400)))
def _(t: Tables):
    return split.split_half(w.sliding_windows(resample(t.readings, "1D"), 7)).select("id", "idx", "test")


BINARY = "SELECT id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM vectors"


@query("p8_undersample", sql(f"""
    SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {digest_sql(8, 'id')}, id) <= ceil(count(*) OVER (PARTITION BY label) * 0.33 - 1e-9) AS test
    FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {digest_sql(7, 'id')}, id) AS r, sum(label) OVER () AS p FROM y) WHERE label = 1 OR r <= 2 * p""",
    "vectors", y=BINARY))
def _(t: Tables):
    balanced = split.undersample(binary(t), 2, ("id",), 7)
    return split.split_rows(balanced, 0.33, ("id",), 8, ("label",)).select("id", "label", "test")


def binary(t: Tables):
    return t.vectors.withColumn("label", (F.col("label") == 0).cast("int"))


# ------------------------------------------------------------------- labels

TOGGLED = "SELECT img, label FROM clicks GROUP BY img, label HAVING count(*) % 2 = 1"
CLASSES = ("click", "error", "purchase", "signup", "view")


@query("l1_assign_labels", sql(TOGGLED, "clicks"))
def _(t: Tables):
    return labels.assign_labels(t.clicks)


@query("l2_one_hot_labels", sql("SELECT img, " + ", ".join(f"max(CAST(label = '{c}' AS INT)) AS {c}" for c in CLASSES) + f" FROM ({TOGGLED}) GROUP BY img", "clicks"))
def _(t: Tables):
    return labels.one_hot_labels(labels.assign_labels(t.clicks), CLASSES)


@query("l3_write_by_label", sql("SELECT user_id AS img, event_id AS item, event_type AS label FROM events"))
def _(t: Tables):
    from meterloom.session import shared_path

    items = t.events.select(F.col("user_id").alias("img"), F.col("event_id").alias("item"), F.col("event_type").alias("label"))
    path = shared_path(t.spark, "by-label")
    labels.write_by_label(items, path)
    return t.spark.read.parquet(path)


# ------------------------------------------------------------------- images

SCALED = """SELECT id, rn, n, CAST(floor((usage - lo) / (hi - lo) * 255 + 0.0) AS INT) AS px FROM
    (SELECT id, usage, row_number() OVER (PARTITION BY id ORDER BY {by}) - 1 AS rn, count(*) OVER (PARTITION BY id) AS n,
      min(usage) OVER (PARTITION BY id) AS lo, max(usage) OVER (PARTITION BY id) AS hi FROM {src})"""


@query("e1_gray_month_image", sql("""
    SELECT id, rn // 720 AS image, rn % 720 // 30 AS row, rn % 30 AS col, px FROM s WHERE rn < n // 24 * 24 // 720 * 720""",
    "series_region", s=SCALED.format(src="series_region", by="date, seq, usage")))
def _(t: Tables):
    return images.gray_month_image(t.series_region, BY_SEQ).select("id", "image", "row", F.posexplode("pixels").alias("col", "px"))


@query("e2_gray_week_image", sql("SELECT id, 0 AS image, rn // 168 AS row, rn % 168 AS col, px FROM s WHERE rn < n // 168 * 168",
    "readings", b=resample_sql("readings", 3600), s=SCALED.format(src="b", by="idx")))
def _(t: Tables):
    return images.gray_week_image(t.readings).select("id", "image", "row", F.posexplode("pixels").alias("col", "px"))


@query("e3_gray_half_image", sql("SELECT id, 0 AS image, rn // 168 AS row, rn % 168 AS col, px FROM s WHERE rn < n // 2 // 168 * 168",
    "readings", b=resample_sql("readings", 3600), s=SCALED.format(src="b", by="idx")))
def _(t: Tables):
    return images.gray_half_image(t.readings).select("id", "image", "row", F.posexplode("pixels").alias("col", "px"))


BLOCK = f"SELECT id, segment, pos, usage FROM ({SEG_SQL.format(L=168, src='series_long')})"
row_total = lambda: F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 3)


def row_weighted(digits: int, col: str = "pixels"):
    """Sum weighted by 1-based position, so that a permuted row shows."""
    return F.round(F.aggregate(F.transform(col, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), digits)


def blocks168(t: Tables):
    return w.segments(t.series_long, 168, BY_SEQ)


@query("e4_gramian_field", sql("""
    SELECT p.id, p.segment AS image, p.pos AS row, round(sum(p.x * q.x - p.y * q.y), 3) AS total,
      round(sum((p.x * q.x - p.y * q.y) * (q.pos + 1)), 3) AS weighted FROM
      z p JOIN z q ON p.id = q.id AND p.segment = q.segment GROUP BY 1, 2, 3""", "series_long", blk=BLOCK,
    z="""SELECT id, segment, pos, x, sqrt(1 - x * x) AS y FROM (SELECT id, segment, pos, (usage - min(usage) OVER (PARTITION BY id, segment))
      / (max(usage) OVER (PARTITION BY id, segment) - min(usage) OVER (PARTITION BY id, segment)) * 2 - 1 AS x FROM blk)"""))
def _(t: Tables):
    return images.gramian_field(blocks168(t)).select("id", "image", "row", row_total().alias("total"), row_weighted(3).alias("weighted"))


@query("e5_markov_field", sql("""
    SELECT p.id, p.segment AS image, p.pos AS row, round(sum(coalesce(m.prob, 0)), 3) AS total, round(sum(coalesce(m.prob, 0) * (q.pos + 1)), 7) AS weighted FROM
      bins p JOIN bins q ON p.id = q.id AND p.segment = q.segment
      LEFT JOIN m ON m.id = p.id AND m.segment = p.segment AND m.q = p.q AND m.nxt = q.q GROUP BY 1, 2, 3""", "series_long", blk=BLOCK,
    edges="SELECT id, segment, " + ", ".join(f"quantile_cont(usage, {i / 5}) AS e{i}" for i in range(1, 5)) + " FROM blk GROUP BY 1, 2",
    bins="SELECT blk.id, blk.segment, pos, " + " + ".join(f"CAST(e{i} < usage AS INT)" for i in range(1, 5)) + " AS q FROM blk JOIN edges ON blk.id = edges.id AND blk.segment = edges.segment",
    steps="SELECT id, segment, q, lead(q) OVER (PARTITION BY id, segment ORDER BY pos) AS nxt FROM bins",
    m="SELECT id, segment, q, nxt, count(*) / sum(count(*)) OVER (PARTITION BY id, segment, q) AS prob FROM steps WHERE nxt IS NOT NULL GROUP BY 1, 2, 3, 4"))
def _(t: Tables):
    return images.markov_field(blocks168(t)).select("id", "image", "row", row_total().alias("total"), row_weighted(7).alias("weighted"))


@query("e6_recurrence_plot", sql("""
    SELECT id, segment AS image, pos AS row, round(sum(CAST(g < lim AS INT)), 3) AS total, round(sum(CAST(g < lim AS INT) * (col + 1)), 3) AS weighted FROM
      (SELECT gaps.id, gaps.segment, pos, col, g, lim FROM gaps JOIN (SELECT id, segment, quantile_cont(g, 0.2) AS lim FROM gaps GROUP BY 1, 2) l
        ON gaps.id = l.id AND gaps.segment = l.segment) GROUP BY 1, 2, 3""", "series_long", blk=BLOCK,
    gaps="SELECT p.id, p.segment, p.pos, q.pos AS col, abs(p.usage - q.usage) AS g FROM blk p JOIN blk q ON p.id = q.id AND p.segment = q.segment"))
def _(t: Tables):
    return images.recurrence_plot(blocks168(t)).select("id", "image", "row", row_total().alias("total"), row_weighted(3).alias("weighted"))


@query("e7_sampled_square", sql(f"""
    SELECT id, 0 AS image, dense_rank() OVER (PARTITION BY id ORDER BY segment) - 1 AS row, pos AS col,
      CAST(round_even((usage - lo) / (hi - lo) * 255, 0) AS INT) AS px FROM
      (SELECT *, min(usage) OVER (PARTITION BY id) AS lo, max(usage) OVER (PARTITION BY id) AS hi FROM c JOIN k USING (id, segment) WHERE r <= 64)""",
    "series_region",
    c="""SELECT id, (rn - 1) // 64 AS segment, (rn - 1) % 64 AS pos, usage FROM
      (SELECT id, usage, row_number() OVER (PARTITION BY id ORDER BY date, seq, usage) AS rn, count(*) OVER (PARTITION BY id) AS n FROM series_region)
      WHERE (rn - 1) // 64 < floor(sqrt(n)) AND floor(sqrt(n)) >= 64""",
    k=f"SELECT id, segment, row_number() OVER (PARTITION BY id ORDER BY {digest_sql(3, 'id', 'segment')}, id, segment) AS r FROM (SELECT DISTINCT id, segment FROM c)"))
def _(t: Tables):
    img = images.sampled_square_image(t.series_region, 64, BY_SEQ, 3)
    return img.select("id", "image", "row", F.posexplode("pixels").alias("col", "px"))


# ----------------------------------------------------------------- spectral

@query("w14_lowpass_fft", sql("""
    SELECT v.id, v.idx, round(sqrt(pow(sum(f.re * cos(2 * pi() * ((f.k * v.idx) % v.n) / v.n) - f.im * sin(2 * pi() * ((f.k * v.idx) % v.n) / v.n)), 2)
        + pow(sum(f.re * sin(2 * pi() * ((f.k * v.idx) % v.n) / v.n) + f.im * cos(2 * pi() * ((f.k * v.idx) % v.n) / v.n)), 2)) / v.n, 3) AS usage
    FROM v JOIN f ON v.id = f.id GROUP BY v.id, v.idx, v.n""", "long_weeks",
    v="SELECT id, idx, usage, count(*) OVER (PARTITION BY id) AS n FROM long_weeks",
    ks="SELECT id, n, unnest(range(n // 20)) AS k FROM (SELECT DISTINCT id, n FROM v)",
    f="""SELECT v.id, k, sum(usage * cos(2 * pi() * ((k * idx) % v.n) / v.n)) AS re, -sum(usage * sin(2 * pi() * ((k * idx) % v.n) / v.n)) AS im
      FROM v JOIN ks ON v.id = ks.id GROUP BY 1, 2"""))
def _(t: Tables):
    return spectral.lowpass_fft(resample(t.series_long, "7D")).withColumn("usage", F.round("usage", 3))


def dwt_ctes(levels: int = 4) -> dict[str, str]:
    from meterloom.functions.kernels import DB3

    taps = ", ".join(f"({j}, {h!r}::DOUBLE, {(-1 if j % 2 == 0 else 1) * DB3[5 - j]!r}::DOUBLE)" for j, h in enumerate(DB3))
    out = {"taps": f"SELECT * FROM (VALUES {taps}) AS v(j, low, high)",
           "s0": "SELECT id, idx, usage AS approx, count(*) OVER (PARTITION BY id) AS n FROM long_weeks"}
    for level in range(levels):
        out[f"o{level}"] = f"SELECT id, n, unnest(range((n + 5) // 2)) AS o FROM (SELECT DISTINCT id, n FROM s{level})"
        # positions beyond an end are mirrored back, the end itself repeated
        out[f"i{level}"] = f"""SELECT id, n, o, low, high, CASE WHEN 2 * o + 1 - j < 0 THEN j - 2 * o - 2
            WHEN 2 * o + 1 - j >= n THEN 2 * n - 2 - 2 * o + j ELSE 2 * o + 1 - j END AS idx FROM o{level} CROSS JOIN taps"""
        out[f"d{level}"] = f"""SELECT i.id, o AS idx, sum(low * approx) AS lo, sum(high * approx) AS hi
            FROM i{level} i JOIN s{level} s ON i.id = s.id AND i.idx = s.idx GROUP BY 1, 2"""
        out[f"s{level + 1}"] = f"SELECT id, idx, lo AS approx, count(*) OVER (PARTITION BY id) AS n FROM d{level}"
    return out


@query("w15_wavelet_dwt", sql(" UNION ALL ".join(
    f"SELECT id, {level} AS level, '{part}' AS part, idx AS pos, round({col}, 3) AS value FROM d{level}" for level in range(4) for part, col in (("approx", "lo"), ("detail", "hi"))),
    "long_weeks", **dwt_ctes()))
def _(t: Tables):
    return spectral.wavelet_dwt(resample(t.series_long, "7D")).withColumn("value", F.round("value", 3))


@query("w16_spectrogram", sql("""
    SELECT id, k / 256.0 AS f, CAST(128 + 224 * frame AS DOUBLE) AS t,
      round((pow(sum(x * cos(2 * pi() * ((k * pos) % 256) / 256)), 2) + pow(sum(x * sin(2 * pi() * ((k * pos) % 256) / 256)), 2))
        * CASE WHEN k BETWEEN 1 AND 127 THEN 2 ELSE 1 END / max(power), 2) AS power
    FROM tapered CROSS JOIN (SELECT unnest(range(129)) AS k) GROUP BY id, frame, k""", "readings", b=resample_sql("readings", 3600),
    frames="SELECT id, unnest(range((count(*) - 256) // 224 + 1)) AS frame FROM b GROUP BY id HAVING count(*) >= 256",
    cells="SELECT b.id, frame, idx - 224 * frame AS pos, usage - avg(usage) OVER (PARTITION BY b.id, frame) AS y FROM b JOIN frames ON b.id = frames.id AND idx BETWEEN 224 * frame AND 224 * frame + 255",
    weights="""SELECT pos, CASE WHEN least(pos, 256 - pos) < 32 THEN 0.5 * (1 - cos(2 * pi() * least(pos, 256 - pos) / 256 / 0.25)) ELSE 1 END AS w
      FROM (SELECT unnest(range(256)) AS pos)""",
    tapered="SELECT id, frame, cells.pos, y * w AS x, sum(w * w) OVER (PARTITION BY id, frame) AS power FROM cells JOIN weights ON cells.pos = weights.pos"))
def _(t: Tables):
    return spectral.spectrogram(resample(t.readings, "1H")).withColumn("power", F.round("power", 2))


# the wavelet vanishes (below e^-40) beyond 9 around its centre
@query("w17_scalogram", sql("""
    SELECT id, round(scale, 6) AS scale, CAST(t AS INT) AS t, round(sqrt(pow(sum(re * cos(turn) - im * sin(turn)), 2) + pow(sum(re * sin(turn) + im * cos(turn)), 2)) / max(size), 3) AS magnitude
    FROM (SELECT g.*, t, 2 * pi() * ((k * t) % size) / size AS turn FROM g JOIN ts ON g.n = ts.n) GROUP BY id, scale, t""", "long_weeks",
    v="SELECT id, idx, usage - avg(usage) OVER (PARTITION BY id) AS x, count(*) OVER (PARTITION BY id) AS n FROM long_weeks",
    sizes="""SELECT DISTINCT id, n, CAST(pow(2, ceil(log2(2 * n))) AS BIGINT) AS size, greatest(1, CAST(floor(log2(greatest(n, 4))) AS BIGINT) - 1) AS octaves FROM v""",
    ks="SELECT id, n, size, unnest(range(1, size // 2)) AS k FROM sizes",
    f="""SELECT v.id, k, sum(x * cos(2 * pi() * ((k * idx) % size) / size)) AS re, -sum(x * sin(2 * pi() * ((k * idx) % size) / size)) AS im
      FROM v JOIN ks ON v.id = ks.id GROUP BY 1, 2""",
    scales="SELECT id, n, size, pow(2, 1 + voice / 4.0) AS scale FROM (SELECT id, n, size, unnest(range(octaves * 4)) AS voice FROM sizes)",
    g="""SELECT s.id, n, size, scale, k, re * h AS re, im * h AS im FROM (
        SELECT s.id, s.n, s.size, scale, f.k, re, im, scale * 2 * pi() * f.k / s.size - 6 AS off, pow(pi(), -0.25) * exp(-0.5 * off * off) AS h
        FROM scales s JOIN f ON s.id = f.id) s WHERE abs(off) < 9""",
    ts="SELECT n, unnest(range(n)) AS t FROM (SELECT DISTINCT n FROM v)"))
def _(t: Tables):
    rows = spectral.scalogram(resample(t.series_long, "7D"))
    return rows.withColumn("scale", F.round("scale", 6)).withColumn("magnitude", F.round("magnitude", 3))
