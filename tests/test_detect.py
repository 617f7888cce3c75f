from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.functions import kernels
from meterloom.operators import detect as dt

PARAM = dt.DetectionParam("1D", 6, 2.0, 5, 3)


def plain_scan(u, window, std, m, n, floor):
    """Position by position, as the definition reads."""
    size = len(u)
    high, low, usable = [False] * size, [False] * size, [True] * size
    at = window
    while at < size:
        base = [u[i] for i in range(at - window, size) if usable[i]][:window]
        step = 1
        if len(base) > 1:
            mean, dev = np.mean(base), np.std(base, ddof=1)
            for flags, hit, over in (
                (high, lambda x: x > mean + std * dev and x > floor, lambda x: x - (mean + std * dev)),
                (low, lambda x: x < mean - std * dev, lambda x: (mean - std * dev) - x),
            ):
                if over(u[at]) > 0:
                    while sum(hit(x) for x in u[at + step : at + step + m]) >= n:
                        step += 1
                    if step > 1:
                        for i in range(at + 1, min(size, at + step + m)):
                            flags[i], usable[i] = over(u[i]) > 0, over(u[i]) < 0
                    break
        at += window + step + 1 if step > 1 else 1
    return np.array(high, bool) * 1 + np.array(low, bool) * 2 + ~np.array(usable, bool) * 4


def random_series(rng):
    u = rng.normal(100, 5, rng.integers(3, 120)).round(3)
    for _ in range(rng.integers(0, 4)):
        a = rng.integers(0, len(u))
        u[a : a + rng.integers(1, 30)] *= rng.choice([0.3, 3.0, 0.0])
    return u


def test_scan_equals_plain_scan():
    rng = np.random.default_rng(5)
    flagged = 0
    for _ in range(1500):
        u = random_series(rng)
        args = (int(rng.integers(2, 12)), float(rng.uniform(0.8, 3)), int(rng.integers(1, 10)), float(rng.uniform(0.5, 6)), 20.0)
        want = plain_scan(u, *args)
        flagged += want.any()
        assert (kernels.scan_events(u, *args) == want).all(), args
    assert flagged > 300


@pytest.mark.parametrize("u", [[5.0] * 30, [1.0, 2.0], [], [5.0, 6.0] * 4 + [90.0] * 20])
def test_scan_edges(u):
    args = (6, 2.0, 5, 3, 20.0)
    assert (kernels.scan_events(np.array(u), *args) == plain_scan(u, *args)).all()


def series(spark, curves):
    rows = [(i, k, datetime(2024, 1, 1) + timedelta(days=k), float(x)) for i, u in enumerate(curves) for k, x in enumerate(u)]
    return spark.createDataFrame(rows, "id long, idx long, date timestamp, usage double")


def test_prefilter_finds_exactly_the_flagged_meters(spark):
    rng = np.random.default_rng(7)
    curves = [random_series(rng) for _ in range(150)]
    df = series(spark, curves)
    flags = dt.scan(df, PARAM, keep_all=True)
    suspects = {r.id for r in flags.filter("mining OR theft").select("id").distinct().collect()}
    assert {r.id for r in dt.first_events(df, PARAM).collect()} == suspects and suspects
    short = dt.scan(df, PARAM)
    assert {r.id for r in short.select("id").distinct().collect()} == suspects
    assert {r.id for r in dt.suspect_rows(flags).select("id").distinct().collect()} == suspects


def test_meter_with_both_kinds_has_two_verdicts(spark):
    rng = np.random.default_rng(1)
    noise = lambda n, level: level + rng.normal(0, 1, n)
    curve = np.concatenate([noise(20, 100), noise(12, 300), noise(20, 100), noise(12, 5), noise(10, 100)])
    got = dt.verdicts(dt.scan(series(spark, [curve]), PARAM)).collect()
    assert sorted((r.mining, r.theft) for r in got) == [(False, True), (True, False)]


def test_plot_points_empty_without_kind(spark):
    flags = dt.scan(series(spark, [[5.0] * 30]), PARAM, keep_all=True)
    assert dt.plot_points(flags, 0, "mining").count() == 0


def test_class_score(spark):
    verdict = spark.createDataFrame([(1, True, False), (1, False, True), (2, True, False), (3, False, True), (5, True, False)], "id long, mining boolean, theft boolean")
    labels = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 0, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 0, 0, 0), (6, 1, 0, 0)], "id long, normal int, mining int, theft int")
    right = {r.id: r.right for r in dt.judged(verdict, labels).collect()}
    assert right == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True}
    assert dt.class_score(verdict, labels).first().score == 0.5


def test_param_search_prefers_working_parameters(spark):
    rng = np.random.default_rng(3)
    quiet = [rng.normal(100, 2, 120) for _ in range(4)]
    loud = [np.concatenate([rng.normal(100, 2, 60), rng.normal(300, 2, 60)]) for _ in range(4)]
    df = series(spark, quiet + loud).select("id", "date", "usage")
    labels = spark.range(8).select("id", (F.col("id") < 4).cast("int").alias("normal"), (F.col("id") >= 4).cast("int").alias("mining"), F.lit(0).alias("theft"))
    clusters = labels.select((F.col("id") % 2).cast("int").alias("cluster"), "id")
    params = [dt.DetectionParam(1, 100, 5.0, 3, 3), dt.DetectionParam(1, 20, 4.0, 5, 4)]
    got = dt.param_search(df, labels, clusters, params).collect()
    assert sorted((r.cluster, r.param, r.error) for r in got) == [(0, 1, 0.0), (1, 1, 0.0)]
    assert dt.seeded_params(5, 1) == dt.seeded_params(5, 1)
    with pytest.raises(ValueError):
        dt.DetectionParam(n=0)


def test_reconstruction_error_flags_what_training_never_saw(spark):
    t = np.arange(200)
    wave = np.sin(2 * np.pi * t / 12)
    wave[150:160] = 5.0
    got = dt.reconstruction_error(series(spark, [wave]), 24, 2).collect()
    assert len(got) == 177 and sum(r.train for r in got) == 88
    assert max(r.error for r in got if r.train) < 1e-6
    assert {r.anomaly for r in got if 140 < r.idx < 150} == {True} and not any(r.anomaly for r in got if r.train)


def test_lag_products_equal_formed_windows():
    rng = np.random.default_rng(4)
    for n, length, t in ((40, 7, 20), (9, 9, 1), (12, 1, 12), (30, 5, 26)):
        u = rng.normal(3, 2, n)
        x = np.lib.stride_tricks.sliding_window_view(u, length)[:t]
        total, outer = kernels.lag_products(u, length, t)
        assert np.allclose(total, x.sum(axis=0)) and np.allclose(outer, x.T @ x)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_reconstruction_equals_pca_on_formed_windows(spark, offset):
    rng = np.random.default_rng(5)
    curves = [offset + np.cumsum(rng.normal(size=n)) for n in (60, 35, 12, 11, 80)]  # of 12: one window, of 11: none
    length, k = 12, 3
    forms = [np.lib.stride_tricks.sliding_window_view(u, length) if len(u) >= length else np.empty((0, length)) for u in curves]
    train = np.concatenate([f[: len(f) // 2] for f in forms])
    basis = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)[2][:k].T
    want = {}
    for i, f in enumerate(forms):
        x = f - train.mean(axis=0)
        for j, e in enumerate(np.abs(x - x @ basis @ basis.T).mean(axis=1)):
            want[i, j] = (e, j < len(f) // 2)
    limit = max(e for e, t in want.values() if t)
    got = {(r.id, r.idx): r for r in dt.reconstruction_error(series(spark, curves), length, k).collect()}
    assert got.keys() == want.keys()
    for at, (e, t) in want.items():
        assert got[at].error == pytest.approx(e, rel=1e-6, abs=1e-6) and got[at].train == t
        assert got[at].anomaly == (not t and e > limit)


def test_reconstruction_without_training_windows(spark):
    rows = dt.reconstruction_error(series(spark, [np.arange(12.0)]), 12, 2).collect()
    assert [(r.idx, r.train, r.error is None or np.isnan(r.error)) for r in rows] == [(0, False, True)]
    assert dt.reconstruction_error(series(spark, [np.arange(5.0)]), 12, 2).count() == 0


def test_matrix_profile_in_tiles_equals_whole_series(spark, monkeypatch):
    rng = np.random.default_rng(6)
    curves = [rng.normal(size=95), np.round(rng.normal(size=61)), np.zeros(20), rng.normal(size=5), rng.normal(size=3)]
    curves[0][40:44] = np.nan
    want = {}
    for i, u in enumerate(curves):
        for j, (d, near) in enumerate(zip(*kernels.matrix_profile(u, 4))):
            if near >= 0:
                want[i, j] = d
    for size in (10, 1000):
        monkeypatch.setattr(dt, "PROFILE_TILE", size)
        got = {(r.id, r.idx): r for r in dt.matrix_profile(series(spark, curves), 4).collect()}
        assert got.keys() == want.keys() and not {k for k in got if k[0] == 0} & {(0, j) for j in range(37, 44)}
        for (i, j), d in want.items():
            assert got[i, j].distance == pytest.approx(d, abs=1e-6) and abs(got[i, j].nearest - j) > 1
            there = got[i, j].nearest
            unit = lambda x: (x - x.mean()) / (x.std() or 1)
            a, b = curves[i][j : j + 4], curves[i][there : there + 4]
            if a.std() and b.std():
                assert np.sqrt(((unit(a) - unit(b)) ** 2).sum()) == pytest.approx(d, abs=1e-6)


def test_long_series_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(dt, "PROFILE_TILE", 100)
    u = np.random.default_rng(7).normal(size=1500)
    profile = dt.matrix_profile(series(spark, [u]), 8)
    got = {r.idx: r.distance for r in profile.collect()}
    assert np.allclose([got[i] for i in range(1493)], kernels.matrix_profile(u, 8)[0], atol=1e-6)
    assert "RepartitionByExpression" in profile._jdf.queryExecution().analyzed().toString()


def test_matrix_profile_matches_definition():
    rng = np.random.default_rng(2)
    u = np.concatenate([rng.normal(size=30), np.zeros(12), rng.normal(size=20), np.ones(9)])
    m = 5
    dist, near = kernels.matrix_profile(u, m)
    n = len(u) - m + 1
    for i in range(n):
        best = np.inf
        for j in range(n):
            if abs(i - j) <= 2:
                continue
            a, b = u[i : i + m], u[j : j + m]
            if a.std() == 0 or b.std() == 0:
                d = 0.0 if a.std() == b.std() else m**0.5
            else:
                d = np.linalg.norm((a - a.mean()) / a.std() - (b - b.mean()) / b.std())
            best = min(best, d)
        assert abs(best - dist[i]) < 1e-5
