"""Meter-shaped views over the driver's tables, in Spark and as SQL for the check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.operators.ordered import RowOrder, running_sum
from meterloom.operators.resample import resample
from meterloom.session import ship

BY_SEQ = RowOrder(("id",), ("date", "seq", "usage"))


@dataclass
class Tables:
    spark: SparkSession
    folder: str

    def __post_init__(self):
        if self.spark.conf.get("spark.sql.session.timeZone") != "UTC":
            self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(self.spark)

    def table(self, name: str) -> DataFrame:
        """A driver table; zone-less times are read as UTC instants in the scan, so filters on them push down."""
        path = f"{self.folder}/{name}.parquet"
        raw = self.spark.read.parquet(path)
        fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType) for f in raw.schema]
        return self.spark.read.schema(T.StructType(fields)).parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def readings(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("id"), F.col("ts").alias("date"), F.col("value").alias("usage"), F.col("event_id").alias("seq")
        )

    @cached_property
    def readings_gap(self) -> DataFrame:
        known = F.when(F.col("event_type") != "error", F.col("value"))
        return self.events.select(
            F.col("user_id").alias("id"), F.col("ts").alias("date"), known.alias("usage"), F.col("event_id").alias("seq")
        )

    @cached_property
    def counters(self) -> DataFrame:
        total = running_sum(self.readings, "usage", "total", BY_SEQ)
        return total.select("id", "date", F.col("total").alias("usage"), "seq")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def series_long(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_suppkey").alias("id"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("usage"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )

    @cached_property
    def supplier_region(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("region"))
        return self.table("supplier").join(nation, "s_nationkey").select("s_suppkey", "region")

    @cached_property
    def series_region(self) -> DataFrame:
        rows = self.series_long.join(self.supplier_region, F.col("id") == F.col("s_suppkey"))
        return rows.select(F.col("region").alias("id"), "date", "usage", "seq")

    @cached_property
    def planted(self) -> DataFrame:
        weekly = resample(self.series_region, "7D")
        factor = F.when(F.col("id") % 2 == 0, F.lit(4.0)).otherwise(F.lit(0.1))
        return weekly.withColumn("usage", F.when(F.col("idx").between(100, 139), F.col("usage") * factor).otherwise(F.col("usage")))

    @cached_property
    def truth(self) -> DataFrame:
        even = (F.col("id") % 2 == 0).cast("int")
        return self.planted.select("id").distinct().select("id", F.lit(0).alias("normal"), even.alias("mining"), (1 - even).alias("theft"))

    @cached_property
    def cycles(self) -> DataFrame:
        short = (F.col("l_suppkey") % 10 == 0) & (F.col("l_linenumber") == 1)
        days = F.when(short, 0).otherwise(F.col("l_quantity").cast("int"))
        start = F.to_date("l_shipdate")
        return self.lineitem.select(
            F.col("l_suppkey").alias("id"), start.alias("start_date"), F.date_add(start, days).alias("end_date"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("low"), (F.col("l_extendedprice") * F.col("l_tax")).alias("medium"),
            F.col("l_quantity").alias("high"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )

    @cached_property
    def order_days(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("values"))

    @cached_property
    def sequences(self) -> DataFrame:
        """Event rows as a labelled two-feature sequence per user."""
        return self.events.select(
            F.col("user_id").alias("id"), F.col("event_id").alias("order"), self.event_code.alias("label"),
            F.col("value").alias("f0"), F.get_json_object("props", "$.k").cast("double").alias("f1"),
        )

    @property
    def event_code(self):
        names = ("click", "error", "purchase", "signup", "view")
        code = F.lit(0)
        for i, name in enumerate(names, 1):
            code = F.when(F.col("event_type") == name, i).otherwise(code)
        return code

    @cached_property
    def parts(self) -> DataFrame:
        """Each vector as four features of 16 values, clustered by the place of the largest value."""
        pieces = F.array(*[F.slice("values", 16 * i + 1, 16) for i in range(4)])
        rows = self.vectors.select(F.col("id").alias("item"), "label", F.posexplode(pieces).alias("feature", "values"))
        return rows.withColumn("cluster", F.array_position("values", F.array_max("values")) - 1)

    @cached_property
    def clicks(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("img"), F.col("event_type").alias("label"))

    @cached_property
    def features(self) -> DataFrame:
        """Standardised weekly features of every supplier's series, with its region as cluster."""
        from meterloom.operators.resample import weekly_features
        from meterloom.operators.windows import standardize

        names = ["mean", "max", "min", "std", "median"]
        z = standardize(weekly_features(self.series_long), names)
        rows = z.select("id", F.array(*names).alias("features"))
        return rows.join(self.supplier_region, F.col("id") == F.col("s_suppkey")).select("id", "features", F.col("region").alias("cluster"))


def resample_sql(source: str, step: int, value: str = "sum(s.usage)", empty: str = "0") -> str:
    return f"""
  WITH a AS (SELECT id, date_trunc('day', min(date)) AS t0 FROM {source} GROUP BY id),
  b AS (SELECT s.id, a.t0, CAST(floor((epoch(s.date) - epoch(a.t0)) / {step}) AS BIGINT) AS k, {value} AS u
        FROM {source} s JOIN a USING (id) GROUP BY 1, 2, 3),
  r AS (SELECT id, t0, min(k) AS k0, max(k) AS k1 FROM b GROUP BY id, t0),
  g AS (SELECT id, t0, k0, unnest(generate_series(k0, k1)) AS k FROM r)
  SELECT g.id, g.k - g.k0 AS idx, g.t0 + to_seconds(g.k * {step}) AS date, coalesce(b.u, {empty}) AS usage
  FROM g LEFT JOIN b ON b.id = g.id AND b.k = g.k"""


CODE_SQL = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 0 END"

VIEWS = {
    "readings": "SELECT user_id AS id, ts AS date, value AS usage, event_id AS seq FROM events",
    "readings_gap": "SELECT user_id AS id, ts AS date, CASE WHEN event_type <> 'error' THEN value END AS usage, event_id AS seq FROM events",
    "counters": "SELECT id, date, sum(usage) OVER (PARTITION BY id ORDER BY date, seq, usage ROWS UNBOUNDED PRECEDING) AS usage, seq FROM readings",
    "series_long": "SELECT l_suppkey AS id, l_shipdate AS date, l_quantity AS usage, l_orderkey * 10 + l_linenumber AS seq FROM lineitem",
    "supplier_region": "SELECT s_suppkey, CAST(n_regionkey AS BIGINT) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "series_region": "SELECT region AS id, date, usage, seq FROM series_long JOIN supplier_region ON id = s_suppkey",
    "region_weeks": resample_sql("series_region", 604800),
    "planted": "SELECT id, idx, date, CASE WHEN idx BETWEEN 100 AND 139 THEN usage * CASE WHEN id % 2 = 0 THEN 4.0 ELSE 0.1 END ELSE usage END AS usage FROM region_weeks",
    "cycles": """SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS start_date,
        CAST(l_shipdate AS DATE) + CASE WHEN l_suppkey % 10 = 0 AND l_linenumber = 1 THEN 0 ELSE CAST(l_quantity AS INT) END AS end_date,
        l_extendedprice * l_discount AS low, l_extendedprice * l_tax AS medium, l_quantity AS high,
        l_orderkey * 10 + l_linenumber AS seq FROM lineitem""",
    "vectors": "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vals FROM embeddings",
    "sequences": f"SELECT user_id AS id, event_id AS ord, {CODE_SQL} AS label, value AS f0, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f1 FROM events",
    "parts0": "SELECT id AS item, label, unnest(range(4)) AS feature, vals FROM vectors",
    "parts1": "SELECT item, label, feature, vals[feature * 16 + 1 : feature * 16 + 16] AS vals FROM parts0",
    "parts": "SELECT *, list_position(vals, list_max(vals)) - 1 AS cluster FROM parts1",
    "clicks": "SELECT user_id AS img, event_type AS label FROM events",
    "long_weeks": resample_sql("series_long", 604800),
    "week_features": """SELECT id, coalesce(avg(usage), 0) AS mean, coalesce(max(usage), 0) AS max, coalesce(min(usage), 0) AS min,
        coalesce(stddev_samp(usage), 0) AS std, coalesce(median(usage), 0) AS median FROM long_weeks GROUP BY id""",
    "z_features": "SELECT id, " + ", ".join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}"
        for c in ("mean", "max", "min", "std", "median")) + " FROM week_features",
    "jalali_years": """SELECT y, DATE '1600-01-01' + CAST(365 * (y - 979) + 8 * ((y - 979) // 33) + (((y - 979) % 33) + 3) // 4 + 79 AS INT) AS d0
        FROM (SELECT unnest(range(1300, 1451)) AS y)""",
    "jalali_starts": "SELECT y, d0, lead(d0) OVER (ORDER BY y) AS d1 FROM jalali_years",
    "jalali_orders": """SELECT id, date, day, printf('%04d/%02d/%02d', y,
          CASE WHEN n < 186 THEN n // 31 + 1 ELSE (n - 186) // 30 + 7 END,
          CASE WHEN n < 186 THEN n % 31 + 1 ELSE (n - 186) % 30 + 1 END) AS jalali
        FROM (SELECT o_orderkey AS id, o_orderdate AS date, CAST(o_orderdate AS DATE) AS day, y, CAST(o_orderdate AS DATE) - d0 AS n
              FROM orders JOIN jalali_starts ON CAST(o_orderdate AS DATE) >= d0 AND CAST(o_orderdate AS DATE) < d1)""",
}

NEEDS = {
    "counters": ("readings",),
    "series_region": ("series_long", "supplier_region"),
    "region_weeks": ("series_region",),
    "planted": ("region_weeks",),
    "parts0": ("vectors",), "parts1": ("parts0",), "parts": ("parts1",),
    "long_weeks": ("series_long",), "week_features": ("long_weeks",), "z_features": ("week_features",),
    "jalali_starts": ("jalali_years",), "jalali_orders": ("jalali_starts",),
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the named views (and their inputs), then ``extra`` ones, as leading CTEs."""
    ordered: list[str] = []

    def add(name: str):
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def uniform_sql(seed, *key: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


def digest_sql(seed, *key: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"md5({text})"
