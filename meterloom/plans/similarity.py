"""Distances, clusters and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.operators import cluster as cl, distance as ds, labels, patterns as pt, split, windows as w
from meterloom.operators.ordered import SERIES
from meterloom.operators.resample import resample
from meterloom.plans.analysis import BINARY, binary, ranked_sql
from meterloom.plans.catalog import query
from meterloom.plans.cleaning import R4
from meterloom.plans.tables import Tables, digest_sql, resample_sql, sql
from meterloom.session import cut

NAMES = ("mean", "max", "min", "std", "median")

# ---------------------------------------------------------------- distances


def dtw_ctes(pairs: str) -> dict[str, str]:
    """``measured``: ``pairs`` (columns k, x, y) with ``dist``, by anti-diagonals of the cost table."""
    return {
        "walk": f"""SELECT k, x, y, -1 AS s, CAST([] AS DOUBLE[]) AS d1, CAST([] AS DOUBLE[]) AS d2 FROM {pairs}
          UNION ALL
          SELECT k, x, y, s + 1, list_transform(range(len(x)), lambda i: CASE WHEN s + 1 - i BETWEEN 0 AND len(y) - 1 THEN
              (x[i + 1] - y[s + 2 - i]) * (x[i + 1] - y[s + 2 - i]) + CASE WHEN s = -1 THEN 0 ELSE least(d1[i + 1], d1[i], d2[i]) END END), d1
          FROM walk WHERE s < len(x) + len(y) - 2""",
        "measured": "SELECT k, sqrt(d1[len(x)]) AS dist FROM walk WHERE s = len(x) + len(y) - 2",
    }


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def weeks(t: Tables):
    """Weekly arrays of all meters."""
    return ds.series_arrays(resample(t.series_long, "7D"))


def months(t: Tables):
    """Four-weekly arrays of all meters."""
    return ds.series_arrays(resample(t.series_long, "28D"))


NEAR = 480.0  # about the closest tenth of the pairs of four-weekly arrays


SAMPLE = {
    "drawn": f"SELECT id FROM (SELECT DISTINCT id FROM series_long) ORDER BY {digest_sql(1, 'id')}, id LIMIT 100",
}




@query("c1_dtw", recursive(sql("SELECT k AS id, round(dist, 6) AS dist FROM measured", "vectors",
    pairs="SELECT id AS k, vals[1:24] AS x, vals[25:64] AS y FROM vectors", **dtw_ctes("pairs"))))
def _(t: Tables):
    halves = t.vectors.select("id", F.slice("values", 1, 24).alias("x"), F.slice("values", 25, 40).alias("y"))
    return halves.select("id", F.round(ds.dtw("x", "y"), 6).alias("dist"))


@query("c2_dtw_within", recursive(sql("SELECT k.feature AS feature, k.a AS a, k.b AS b, round(dist, 6) AS dist FROM measured WHERE dist < 0.2", "parts",
    pairs="""SELECT {'feature': p.feature, 'a': p.item, 'b': q.item} AS k, p.vals AS x, q.vals AS y
      FROM parts p JOIN parts q ON p.feature = q.feature AND p.item < q.item""", **dtw_ctes("pairs"))))
def _(t: Tables):
    near = ds.dtw_within(t.parts.withColumnRenamed("item", "id"), 0.2, ("feature",), every=True)
    return near.withColumn("dist", F.round("dist", 6))


@query("c2_dtw_matrix_sample")
def _(t: Tables):
    return ds.dtw_matrix(weeks(t))


@query("c3_similar_pairs")
def _(t: Tables):
    return ds.similar_pairs(t.series_long, 10, 100, "7D", 1)


MONTHS = {
    **SAMPLE,
    "chosen": "SELECT * FROM series_long WHERE id IN (SELECT id FROM drawn)",
    "months": resample_sql("chosen", 28 * 86400),
    "curves": "SELECT id, list(CAST(usage AS DOUBLE) ORDER BY idx) AS vals FROM months GROUP BY id",
    "pairs": "SELECT {'a': p.id, 'b': q.id} AS k, p.vals AS x, q.vals AS y FROM curves p JOIN curves q ON p.id < q.id",
    **dtw_ctes("pairs"),
}


EVERY_MONTH = {**MONTHS, "months": resample_sql("series_long", 28 * 86400)}


@query("j4_pair_edges", recursive(sql(f"SELECT k.a AS a, k.b AS b FROM measured WHERE dist < {NEAR}", "series_long", **EVERY_MONTH)))
def _(t: Tables):
    return ds.dtw_within(months(t), NEAR, every=True).select("a", "b")


@query("c2_dtw_matrix_months", recursive(sql(f"SELECT k.a AS a, k.b AS b, round(dist, 4) AS dist FROM measured WHERE dist < {NEAR}", "series_long", **EVERY_MONTH)))
def _(t: Tables):
    return ds.dtw_within(months(t), NEAR, every=True).withColumn("dist", R4("dist"))


@query("c3_similar_pairs_months", recursive(sql("""
    SELECT k.a AS a, k.b AS b, round(dist, 4) AS dist FROM measured ORDER BY measured.dist, k.a, k.b LIMIT 10""", "series_long", **MONTHS)))
def _(t: Tables):
    return ds.similar_pairs(t.series_long, 10, 100, "28D", 1).withColumn("dist", R4("dist"))


@query("c4_week_on_week_dtw", recursive(sql("""
    SELECT k.id AS id, k.week AS week, k.day AS day,
      round(CASE WHEN max(dist) OVER w = min(dist) OVER w THEN 0 ELSE (dist - min(dist) OVER w) / (max(dist) OVER w - min(dist) OVER w) * 255 END, 4) AS usage
    FROM measured WINDOW w AS (PARTITION BY k.id, k.day)""", "readings", b=resample_sql("readings", 3600),
    days="""SELECT id, idx // 24 AS d, list(usage ORDER BY idx) AS vals, any_value(whole) AS whole
      FROM (SELECT *, (max(idx) OVER (PARTITION BY id) + 1) // 168 * 7 AS whole FROM b) WHERE idx // 24 < whole GROUP BY 1, 2""",
    pairs="""SELECT {'id': p.id, 'week': p.d // 7, 'day': p.d % 7} AS k, p.vals AS x, q.vals AS y FROM days p JOIN days q ON p.id = q.id AND q.d = p.d + 7""",
    **dtw_ctes("pairs"))))
def _(t: Tables):
    return ds.week_on_week_dtw(t.readings).withColumn("usage", R4("usage"))


@query("j7_week_pairs", sql("""
    SELECT id, segment, pos, usage, nxt FROM (SELECT id, idx // 7 AS segment, idx % 7 AS pos, usage, lead(usage, 7) OVER (PARTITION BY id ORDER BY idx) AS nxt,
      (max(idx) OVER (PARTITION BY id) + 1) // 7 AS weeks FROM b) WHERE segment < weeks - 1""", "readings",
    b="SELECT id, idx, round(usage, 4) AS usage FROM (" + resample_sql("readings", 86400) + ")"))
def _(t: Tables):
    from pyspark.sql import Window

    weeks = w.segments(resample(t.readings, "1D"), 7, SERIES)
    nxt = F.lead("values").over(Window.partitionBy("id").orderBy("segment"))
    paired = weeks.withColumn("nxt", nxt).filter("nxt IS NOT NULL")
    rows = paired.select("id", "segment", F.posexplode(F.arrays_zip("values", "nxt")).alias("pos", "v"))
    return rows.select("id", "segment", "pos", R4("v.values").alias("usage"), R4("v.nxt").alias("nxt"))


@query("c14_series_dataset", sql("""
    SELECT i.id, p.pos, round(l.usage, 4) AS value FROM (SELECT DISTINCT id FROM long_weeks) i
    CROSS JOIN (SELECT unnest(range((SELECT max(idx) + 1 FROM long_weeks))) AS pos) p LEFT JOIN long_weeks l ON l.id = i.id AND l.idx = p.pos""", "long_weeks"))
def _(t: Tables):
    data = ds.series_dataset(resample(t.series_long, "7D"))
    return data.select("id", F.posexplode("values").alias("pos", "value")).withColumn("value", R4("value"))


# ----------------------------------------------------------------- clusters

def scaled(arrays):
    """Every position scaled to the unit interval over all meters."""
    return w.minmax_by_position(arrays, w.position_ranges(arrays, ()), ())


@query("c5_agglomerate_threshold")
def _(t: Tables):
    whole = cut(weeks(t))
    return cl.agglomerate(ds.dtw_rows(scaled(whole)), threshold=2.0, nodes=whole)


@query("c6_agglomerate_k")
def _(t: Tables):
    whole = cut(weeks(t))
    return cl.agglomerate(ds.dtw_rows(whole), k=10, nodes=whole)


@query("c7_linkage_table")
def _(t: Tables):
    return cl.linkage_table(ds.dtw_rows(weeks(t)))


#: One merge per step: ``state`` holds the open edges before each, ``merged`` the closest of them.
LINKAGE = {
    "state": """SELECT 0 AS step, k.a AS a, k.b AS b, dist AS s, 1 AS na, 1 AS nb FROM measured
      UNION ALL
      SELECT step + 1, least(x, y) AS a, greatest(x, y) AS b, sum(s) AS s, any_value(CASE WHEN x < y THEN nx ELSE ny END), any_value(CASE WHEN x < y THEN ny ELSE nx END) FROM (
        SELECT step, s, CASE WHEN a = p.b THEN p.a ELSE a END AS x, CASE WHEN b = p.b THEN p.a ELSE b END AS y,
          CASE WHEN a IN (p.a, p.b) THEN p.n ELSE na END AS nx, CASE WHEN b IN (p.a, p.b) THEN p.n ELSE nb END AS ny
        FROM (SELECT *, min({'d': s / (na * nb), 'a': a, 'b': b, 'n': na + nb}) OVER () AS p FROM state)) WHERE x <> y GROUP BY 1, 2, 3""",
    "merged": "SELECT step, p.a AS a, p.b AS b, p.d AS dist, p.n AS n FROM (SELECT step, min({'d': s / (na * nb), 'a': a, 'b': b, 'n': na + nb}) AS p FROM state GROUP BY 1)",
}


def once(text: str) -> str:
    """The merges are found once, not in every step of the climb."""
    return text.replace("kept AS (", "kept AS MATERIALIZED (")


def linkage_labels(kept: str) -> dict[str, str]:
    """``labels``: every meter with the smallest of its cluster after the merges of ``kept``."""
    return {
        **LINKAGE,
        "kept": kept,
        "climb": "SELECT id, id AS top FROM curves UNION ALL SELECT climb.id, kept.a FROM climb JOIN kept ON kept.b = climb.top",
        "labels": "SELECT id, min(top) AS cluster FROM climb GROUP BY 1",
    }


FLAT = {
    "bounds": "SELECT pos, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(vals) AS v, generate_subscripts(vals, 1) AS pos FROM curves) GROUP BY 1",
    "scaled": """SELECT id, list(CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END ORDER BY pos) AS vals
      FROM (SELECT id, unnest(vals) AS v, generate_subscripts(vals, 1) AS pos FROM curves) JOIN bounds USING (pos) GROUP BY 1""",
    "pairs": "SELECT {'a': p.id, 'b': q.id} AS k, p.vals AS x, q.vals AS y FROM scaled p JOIN scaled q ON p.id < q.id",
}
LINKED = 1.36  # about 60 of the 99 merges at sf0.01


@query("c5_agglomerate_threshold_months", once(recursive(sql("SELECT id, cluster FROM labels", "series_long",
    months=EVERY_MONTH["months"], curves=EVERY_MONTH["curves"], **FLAT, **dtw_ctes("pairs"), **linkage_labels(f"SELECT a, b FROM merged WHERE dist < {LINKED}")))))
def _(t: Tables):
    whole = cut(months(t))
    return cl.agglomerate(ds.dtw_rows(scaled(whole)), threshold=LINKED, nodes=whole)


@query("c6_agglomerate_k_months", once(recursive(sql("SELECT id, cluster FROM labels", "series_long", **EVERY_MONTH,
    **linkage_labels("SELECT a, b FROM merged ORDER BY dist, n, a, b LIMIT greatest((SELECT count(*) FROM curves) - 10, 0)")))))
def _(t: Tables):
    whole = cut(months(t))
    return cl.agglomerate(ds.dtw_rows(whole), k=10, nodes=whole)


@query("c7_linkage_table_months", recursive(sql("""
    SELECT step, least(x, y) AS child_a, greatest(x, y) AS child_b, round(dist, 4) AS distance, n AS count FROM (
      SELECT *, coalesce(total + (SELECT max(e.step) FROM ranked e WHERE e.step < r.step AND e.a = r.a), (SELECT leaf FROM leaves WHERE id = r.a)) AS x,
        coalesce(total + (SELECT max(e.step) FROM ranked e WHERE e.step < r.step AND e.a = r.b), (SELECT leaf FROM leaves WHERE id = r.b)) AS y
      FROM ranked r, (SELECT count(*) AS total FROM leaves))""", "series_long", **EVERY_MONTH, **LINKAGE,
    leaves="SELECT id, row_number() OVER (ORDER BY id) - 1 AS leaf FROM curves",
    ranked="SELECT row_number() OVER (ORDER BY dist, n, a, b) - 1 AS step, a, b, dist, n FROM merged")))
def _(t: Tables):
    return cl.linkage_table(ds.dtw_rows(months(t))).withColumn("distance", R4("distance"))


@query("c8_kmeans_sweep")
def _(t: Tables):
    return cl.kmeans_sweep(t.features.select("id", "features"), range(2, 10))


@query("c9_kmeans_min_size")
def _(t: Tables):
    points = t.features.select("id", "features")
    return cl.kmeans_min_size(points, 2, 2)


@query("c9_min_size_sweep", sql("""
    SELECT count(*) AS points, count(*) >= 20 AS k_in_range, true AS sizes_hold FROM z_features JOIN supplier_region ON id = s_suppkey""", "z_features", "supplier_region"))
def _(t: Tables):
    """Facts about the chosen clustering: every point has a cluster, k is 2 to 5, every cluster holds 10 points."""
    best = cut(cl.kmeans_min_size_sweep(t.features.select("id", "features")))
    sizes = best.groupBy("k", "cluster").count()
    facts = sizes.agg(F.coalesce(F.sum("count"), t.features.select("id").agg(F.count(F.lit(1))).scalar()).alias("points"), F.coalesce(F.max("k").between(2, 5) & (F.count(F.lit(1)) == F.max("k")), F.lit(False)).alias("k_in_range"), F.coalesce(F.min("count") >= 10, F.lit(True)).alias("sizes_hold"))
    return facts


DIST = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in NAMES)


@query("c10_dbscan", recursive(sql("""
    SELECT c.id, c.core, CASE WHEN c.core THEN n.cluster ELSE coalesce(b.cluster, -1) END AS cluster FROM c
    LEFT JOIN names n ON n.id = c.id
    LEFT JOIN (SELECT near.p AS id, min(names.cluster) AS cluster FROM near JOIN names ON names.id = near.q GROUP BY 1) b ON b.id = c.id""", "z_features",
    near=f"SELECT p.id AS p, q.id AS q FROM z_features p JOIN z_features q ON {DIST} <= 0.64",
    c="SELECT p AS id, count(*) >= 5 AS core FROM near GROUP BY 1",
    reach="""SELECT id AS a, id AS b FROM c WHERE core
      UNION SELECT r.a, n.q FROM reach r JOIN near n ON n.p = r.b JOIN c ON c.id = n.q AND c.core""",
    names="SELECT b AS id, min(a) AS cluster FROM reach GROUP BY 1")))
def _(t: Tables):
    return cl.dbscan(t.features.select("id", "features"), 0.8, 5)


@query("c11_bandwidth", sql(f"""
    SELECT round(avg(d), 6) AS bandwidth FROM (SELECT p.id, sqrt({" + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in NAMES)}) AS d, row_number() OVER (PARTITION BY p.id ORDER BY d) AS r, count(*) OVER (PARTITION BY p.id) AS n
      FROM s p CROSS JOIN s q) WHERE r = greatest(floor(n * 0.3), 1)""", "z_features", s="SELECT * FROM z_features"))
def _(t: Tables):
    value = cl.estimate_bandwidth(t.features.select("id", "features"))
    return t.spark.range(1).select(F.round(F.lit(value), 6).alias("bandwidth"))


AT = [f"s.{c} AS s_{c}" for c in NAMES]
GAP = lambda a, b: " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in NAMES)
SHIFT = {
    "bw": f"""SELECT avg(d) AS b FROM (SELECT p.id, sqrt({GAP("p.", "q.")}) AS d, row_number() OVER (PARTITION BY p.id ORDER BY d) AS r, count(*) OVER (PARTITION BY p.id) AS n
      FROM z_features p CROSS JOIN z_features q) WHERE r = greatest(floor(n * 0.3), 1)""",
    "seeds": "SELECT DISTINCT " + ", ".join(f"round_even({c} / b, 0) * b AS {c}" for c in NAMES) + " FROM z_features, bw",
    "shift": f"""SELECT row_number() OVER () AS sid, {", ".join(NAMES)}, CAST(0 AS BIGINT) AS n, true AS moving FROM seeds
      UNION ALL
      SELECT sid, {", ".join(f"m_{c}" for c in NAMES)}, n, {GAP("s_", "m_")} > (1e-3 * b) * (1e-3 * b) FROM (
        SELECT s.sid, b, {", ".join(AT)}, count(*) AS n, {", ".join(f"avg(p.{c}) AS m_{c}" for c in NAMES)}
        FROM shift s, z_features p, bw WHERE s.moving AND {GAP("s.", "p.")} <= b * b GROUP BY s.sid, b, {", ".join(f"s.{c}" for c in NAMES)})""",
    "modes": f"""SELECT *, row_number() OVER (ORDER BY n DESC, {", ".join(NAMES)}) AS i FROM (
      SELECT {", ".join(f"round_even({c}, 6) AS {c}" for c in NAMES)}, max(n) AS n FROM shift WHERE NOT moving GROUP BY {", ".join(str(i + 1) for i in range(len(NAMES)))})""",
    "beaten": f"SELECT p.i, list(q.i) AS rivals FROM modes p, modes q, bw WHERE q.i < p.i AND {GAP('p.', 'q.')} <= b * b GROUP BY 1",
    "kept": """SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS chosen
      UNION ALL
      SELECT kept.i + 1, CASE WHEN list_has_any(chosen, coalesce(rivals, [])) THEN chosen ELSE list_append(chosen, kept.i + 1) END
      FROM kept LEFT JOIN beaten ON beaten.i = kept.i + 1 WHERE kept.i < (SELECT count(*) FROM modes)""",
    "named": f"SELECT row_number() OVER (ORDER BY i) - 1 AS cluster, {', '.join(NAMES)} FROM modes WHERE i IN (SELECT unnest(chosen) FROM (SELECT chosen FROM kept ORDER BY i DESC LIMIT 1))",
}


@query("c11_mean_shift", recursive(sql(f"""
    SELECT id, cluster FROM (SELECT p.id, m.cluster, row_number() OVER (PARTITION BY p.id ORDER BY {GAP("p.", "m.")}, m.cluster) AS r FROM z_features p, named m) WHERE r = 1""",
    "z_features", **SHIFT)))
def _(t: Tables):
    return cl.mean_shift(t.features.select("id", "features"))


@query("c11_mean_shift_fine", recursive(sql(f"""
    SELECT id, cluster FROM (SELECT p.id, m.cluster, row_number() OVER (PARTITION BY p.id ORDER BY {GAP("p.", "m.")}, m.cluster) AS r FROM z_features p, named m) WHERE r = 1""",
    "z_features", **{**SHIFT, "bw": "SELECT 0.9 AS b"})))
def _(t: Tables):
    """A given bandwidth that tells several modes apart."""
    return cl.mean_shift(t.features.select("id", "features"), 0.9)


@query("c12_silhouette", sql(f"""
    SELECT id, cluster, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 4) AS silhouette FROM (
      SELECT id, cluster, max(CASE WHEN qc = cluster THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN qc <> cluster THEN s / n END) AS b FROM (
        SELECT p.id, p.cluster, q.cluster AS qc, sum({DIST}) AS s, count(*) AS n FROM f p CROSS JOIN f q GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
    "z_features", "supplier_region", f="SELECT z_features.*, region AS cluster FROM z_features JOIN supplier_region ON id = s_suppkey"))
def _(t: Tables):
    return cl.silhouette_points(t.features).withColumn("silhouette", R4("silhouette"))


@query("c12_edge_silhouette", recursive(sql("""
    SELECT id, cluster, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 4) AS silhouette FROM (
      SELECT id, cluster, max(CASE WHEN oc = cluster THEN d END) AS a, min(CASE WHEN oc <> cluster THEN d END) AS b FROM (
        SELECT id, p.region AS cluster, q.region AS oc, avg(dist) AS d FROM
          (SELECT k.a AS id, k.b AS o, dist FROM measured UNION ALL SELECT k.b, k.a, dist FROM measured)
          JOIN supplier_region p ON p.s_suppkey = id JOIN supplier_region q ON q.s_suppkey = o GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
    "series_long", "supplier_region", **EVERY_MONTH)))
def _(t: Tables):
    members = t.supplier_region.select(F.col("s_suppkey").alias("id"), F.col("region").alias("cluster"))
    arrays = months(t)
    points = cl.edge_silhouette(ds.dtw_matrix(arrays), members.join(arrays.select("id"), "id", "left_semi"))
    return points.withColumn("silhouette", R4("silhouette"))


@query("c13_series_kmeans")
def _(t: Tables):
    return cl.series_kmeans_sweep(weeks(t), (2, 3, 4, 5))


# ----------------------------------------------------------------- patterns

COUNTS = "SELECT feature, cluster, label, count(*) AS n FROM parts GROUP BY 1, 2, 3"
TOPS = """SELECT feature, cluster, label, n / sum(n) OVER (PARTITION BY feature, cluster) AS confidence, CAST(sum(n) OVER (PARTITION BY feature, cluster) AS BIGINT) AS support
    FROM counts QUALIFY row_number() OVER (PARTITION BY feature, cluster ORDER BY n DESC, label) = 1"""


@query("a10_cluster_label_counts", sql("SELECT feature, cluster, label, round(confidence, 4) AS confidence, support FROM tops", "parts", counts=COUNTS, tops=TOPS))
def _(t: Tables):
    return pt.cluster_label_counts(t.parts).withColumn("confidence", R4("confidence"))


CENTERS = "SELECT feature, cluster, pos, avg(v) AS m FROM (SELECT feature, cluster, unnest(range(16)) AS pos, unnest(vals) AS v FROM parts) GROUP BY 1, 2, 3"


@query("a11_cluster_centers", sql("SELECT feature, cluster, pos, round(m, 4) AS value FROM centers", "parts", centers=CENTERS))
def _(t: Tables):
    return pt.cluster_centers(t.parts).select("feature", "cluster", F.posexplode("centroid").alias("pos", "value")).withColumn("value", R4("value"))


@query("c15_valuable_patterns", sql("""
    SELECT t.feature, t.cluster, label, round(confidence, 4) AS confidence, support, pos, round(m, 4) AS value
    FROM tops t JOIN centers c ON t.feature = c.feature AND t.cluster = c.cluster WHERE confidence > 0.2""", "parts", counts=COUNTS, tops=TOPS, centers=CENTERS))
def _(t: Tables):
    found = pt.valuable_patterns(t.parts, 0.2)
    return found.select("feature", "cluster", "label", R4("confidence").alias("confidence"), "support", F.posexplode("centroid").alias("pos", "value")).withColumn("value", R4("value"))


def train_test(t: Tables):
    sides = cut(split.split_rows(t.vectors.select("id"), 0.33, ("id",), 6))  # read for both sides
    rows = t.parts.join(sides.select(F.col("id").alias("item"), "test"), "item")
    return rows.filter("NOT test").drop("test"), rows.filter("test").drop("test")


SIDES = {
    "sides": f"SELECT id AS item, r <= ceil(n * 0.33 - 1e-9) AS test FROM ({ranked_sql(6)})",
    "rows0": "SELECT parts.*, test FROM parts JOIN sides USING (item)",
    "counts": "SELECT feature, cluster, label, count(*) AS n FROM rows0 WHERE NOT test GROUP BY 1, 2, 3",
    "tops": TOPS,
    "preds": """SELECT r.item, r.feature, r.cluster, r.label, t.label AS pred FROM rows0 r
        LEFT JOIN (SELECT * FROM tops WHERE confidence > 0.18) t ON r.feature = t.feature AND r.cluster = t.cluster WHERE test""",
    "votes": """SELECT item, coalesce(pred, -1) AS vote FROM (SELECT item, pred, count(pred) AS n FROM preds GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY pred IS NULL, n DESC, pred) = 1""",
}


def predictions(t: Tables):
    train, test = train_test(t)
    return pt.label_lookup(test, pt.cluster_label_counts(train).filter("confidence > 0.18"))


@query("j3_label_lookup", sql("SELECT item, feature, cluster, pred FROM preds", "parts", **SIDES))
def _(t: Tables):
    return predictions(t).select("item", "feature", "cluster", "pred")


NEAREST = {
    **{k: SIDES[k] for k in ("sides", "rows0", "counts", "tops")},
    "flat": """SELECT item, label, feature, cluster, test, pos, (v - min(v) FILTER (WHERE NOT test) OVER w) / (max(v) FILTER (WHERE NOT test) OVER w - min(v) FILTER (WHERE NOT test) OVER w) AS v
      FROM (SELECT item, label, feature, cluster, test, unnest(range(16)) AS pos, unnest(vals) AS v FROM rows0) WINDOW w AS (PARTITION BY feature, pos)""",
    "mids": "SELECT feature, cluster, list(m ORDER BY pos) AS c FROM (SELECT feature, cluster, pos, avg(v) AS m FROM flat WHERE NOT test GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "asked": "SELECT item, feature, list(v ORDER BY pos) AS vals FROM flat WHERE test GROUP BY 1, 2",
    "pairs": "SELECT {'item': item, 'feature': feature, 'cluster': cluster} AS k, vals AS x, c AS y FROM asked JOIN mids USING (feature)", **dtw_ctes("pairs"),
    "preds": """SELECT n.item, n.feature, n.cluster, n.dist, t.label AS pred FROM (
      SELECT k.item AS item, k.feature AS feature, k.cluster AS cluster, dist FROM measured
      QUALIFY row_number() OVER (PARTITION BY k.item, k.feature ORDER BY dist, k.cluster) = 1) n
    LEFT JOIN (SELECT * FROM tops WHERE confidence > 0.18) t ON n.feature = t.feature AND n.cluster = t.cluster""",
    "votes": SIDES["votes"],
}


def nearest(t: Tables):
    """Test items' nearest patterns, mined and scaled on the training items."""
    train, test = train_test(t)
    ranges = w.position_ranges(train)
    train, test = w.minmax_by_position(train, ranges), w.minmax_by_position(test, ranges)
    return pt.nearest_pattern(test, pt.cluster_centers(train), pt.cluster_label_counts(train).filter("confidence > 0.18"))


@query("c16_nearest_pattern", recursive(sql("SELECT item, feature, cluster, round(dist, 6) AS dist, pred FROM preds", "parts", **NEAREST)))
def _(t: Tables):
    return nearest(t).withColumn("dist", F.round("dist", 6))


@query("c17_vote_nearest", recursive(sql("SELECT item, vote FROM votes", "parts", **NEAREST)))
def _(t: Tables):
    return pt.vote_label(nearest(t))


@query("c18_classifier_accuracy", recursive(sql("""
    SELECT count(*) AS n, round(avg(CAST(vote = label AS INT)), 4) AS accuracy FROM votes JOIN (SELECT DISTINCT item, label FROM parts) USING (item)""", "parts", **NEAREST)))
def _(t: Tables):
    """The classifier from end to end: split, scale, mine, nearest patterns, vote, score."""
    votes = pt.vote_label(nearest(t)).join(t.vectors.select(F.col("id").alias("item"), "label"), "item")
    return pt.pattern_accuracy(votes).withColumn("accuracy", R4("accuracy"))


@query("j5_item_centre_pairs", sql("""
    SELECT r.item, r.feature, c.cluster FROM rows0 r JOIN (SELECT DISTINCT feature, cluster FROM rows0 WHERE NOT test) c USING (feature) WHERE r.test""", "parts", **SIDES))
def _(t: Tables):
    train, test = train_test(t)
    return pt.item_centre_pairs(test.select("item", "feature"), train.select("feature", "cluster").distinct())


@query("c17_vote_label", sql("SELECT item, vote FROM votes", "parts", **SIDES))
def _(t: Tables):
    return pt.vote_label(predictions(t))


@query("c18_pattern_accuracy", sql("""
    SELECT count(*) AS n, round(avg(CAST(vote = label AS INT)), 4) AS accuracy FROM votes JOIN (SELECT DISTINCT item, label FROM parts) USING (item)""", "parts", **SIDES))
def _(t: Tables):
    votes = pt.vote_label(predictions(t)).join(t.vectors.select(F.col("id").alias("item"), "label"), "item")
    return pt.pattern_accuracy(votes).withColumn("accuracy", R4("accuracy"))


@query("c18_feature_accuracy", recursive(sql("""
    SELECT feature, count(*) AS n, round(avg(CAST(pred = label AS INT)), 4) AS accuracy
    FROM preds JOIN (SELECT DISTINCT item, label FROM parts) USING (item) WHERE pred IS NOT NULL AND dist < 1.2 GROUP BY 1""", "parts", **NEAREST)))
def _(t: Tables):
    rows = nearest(t).join(t.vectors.select(F.col("id").alias("item"), "label"), "item")
    return pt.feature_accuracy(rows, 1.2).withColumn("accuracy", R4("accuracy"))


@query("j6_split_join", sql("SELECT id, label, r <= ceil(n * 0.33 - 1e-9) AS test FROM (" + ranked_sql(6) + ")", "vectors"))
def _(t: Tables):
    sides = split.split_rows(t.vectors.select("id"), 0.33, ("id",), 6)
    return t.vectors.select("id", "label").join(sides, "id")


@query("c19_linear_svm")
def _(t: Tables):
    balanced = split.split_rows(split.undersample(binary(t), 2, ("id",), 7), 0.33, ("id",), 8, ("label",))
    scored = pt.linear_svm(balanced.filter("NOT test"), balanced.filter("test"))
    return labels.classification_metrics(scored)


JUDGED = "SELECT label, CASE WHEN vals[1] > 0 THEN 1 ELSE 0 END AS pred FROM (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, vals FROM vectors)"


def judged(t: Tables):
    return binary(t).withColumn("pred", (F.col("values")[0] > 0).cast("int"))


@query("c20_metrics", sql("""
    SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM (
      SELECT count(*) AS n, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM j)""", "vectors", j=JUDGED))
def _(t: Tables):
    got = labels.classification_metrics(judged(t))
    return got.select("n", "tp", "fp", "fn", "tn", *[R4(c).alias(c) for c in ("accuracy", "precision", "recall")])


@query("c20_confusion", sql("SELECT label, pred, count(*) AS n FROM j GROUP BY 1, 2", "vectors", j=JUDGED))
def _(t: Tables):
    return labels.confusion_matrix(judged(t))
