import collections
import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from meterloom.functions import kernels
from meterloom.operators import images, inject, labels, resample, spectral, split, windows as w


def series(spark, curves):
    rows = [(i, k, float(x)) for i, u in enumerate(curves) for k, x in enumerate(u)]
    return spark.createDataFrame(rows, "id long, idx long, usage double")


def test_wavelet_step_keeps_energy_and_inverts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    low, high = kernels.dwt_step(x)
    assert len(low) == (40 + 5) // 2
    taps = np.array(kernels.DB3)
    assert abs(taps.sum() - 2**0.5) < 1e-9 and abs((taps**2).sum() - 1) < 1e-9
    # synthesis with the time-reversed filters returns the inner samples
    back = np.zeros(2 * len(low) + 4)
    detail = taps[::-1] * np.where(np.arange(6) % 2 == 0, -1.0, 1.0)
    for k in range(len(low)):
        back[2 * k : 2 * k + 6] += low[k] * taps[::-1] + high[k] * detail[::-1]
    assert np.allclose(back[4 : 4 + 40], x)
    assert np.allclose(kernels.dwt_step(np.arange(60.0) * 2 + 1)[1][3:-3], 0, atol=1e-9)


def test_wavelet_rows(spark):
    got = spectral.wavelet_dwt(series(spark, [np.arange(50.0)]), 3).groupBy("level", "part").count().collect()
    assert {(r.level, r.part): r["count"] for r in got} == {(l, p): n for l, n in enumerate((27, 16, 10)) for p in ("approx", "detail")}


def test_spectrogram_peaks_at_the_signal(spark):
    t = np.arange(1000)
    got = spectral.spectrogram(series(spark, [np.sin(2 * np.pi * t / 8), np.sin(2 * np.pi * t[:100] / 4)]))
    peaks = got.groupBy("id").agg(F.max_by("f", "power").alias("f")).collect()
    assert {r.id: r.f for r in peaks} == {0: 0.125, 1: 0.25}
    f, times, power = kernels.spectrogram(np.sin(t / 3.0))
    assert len(f) == 129 and times.tolist() == [128 + 224 * i for i in range(4)]
    # white noise of unit variance has mean density 2 over the one-sided band
    noise = np.random.default_rng(0).normal(size=200000)
    assert abs(kernels.spectrogram(noise)[2][1:-1].mean() - 2) < 0.05


def test_scalogram_peaks_at_the_scale_of_the_period(spark):
    t = np.arange(512)
    got = spectral.scalogram(series(spark, [np.sin(2 * np.pi * t / 16)]), 8).filter("t between 200 and 300")
    best = got.groupBy("scale").agg(F.avg("magnitude").alias("m")).orderBy(F.desc("m")).first().scale
    assert abs(best - 6 * 16 / (2 * np.pi)) < 2


def test_lowpass(spark):
    u = np.random.default_rng(1).normal(10, 2, 100)
    got = [r.usage for r in spectral.lowpass_fft(series(spark, [u])).orderBy("idx").collect()]
    spectrum = np.array([(u * np.exp(-2j * np.pi * k * np.arange(100) / 100)).sum() for k in range(5)])
    want = [abs((spectrum * np.exp(2j * np.pi * np.arange(5) * i / 100)).sum()) / 100 for i in range(100)]
    assert np.allclose(got, want)


def test_sliding_windows_across_blocks(spark):
    u = np.arange(9000.0)
    got = w.sliding_windows(series(spark, [u, u[:3]]), 5)
    bad = got.filter(F.expr("values[0] <> idx OR values[4] <> idx + 4"))
    assert got.count() == 8996 and bad.count() == 0


def test_segment_label(spark):
    def days(hit, total=30):
        return [(k, float(k), k < hit) for k in range(total)]

    rows = [(i, *r) for i, hit in enumerate((0, 1, 29, 30)) for r in days(hit)] + [(4, *r) for r in days(3, 29)]
    df = spark.createDataFrame(rows, "id long, idx long, usage double, anomaly boolean")
    got = w.segment_label(df)
    assert {r.id: r.label for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 0}
    assert w.segment_to_row(got).columns == ["id", "segment", "label", *[f"v{i}" for i in range(30)]]


def test_attacks_stay_inside_the_slice(spark):
    hours = 168
    df = series(spark, [np.arange(1.0, hours * 40 + 1)])
    blocks = w.segments(df, hours, w.RowOrder(("id",), ("idx",)))
    got = inject.attack_blocks(blocks, hours, 0.5, seed=3).join(blocks.withColumnRenamed("values", "clean"), ["id", "segment"]).collect()
    hit = [r for r in got if r.label == 1]
    assert len(got) == 40 and 5 < len(hit) < 35
    assert all(r.values == r.clean for r in got if r.label == 0)
    assert all(len(r.values) == hours and sum(a != b for a, b in zip(r.values, r.clean)) >= 47 for r in hit)


def test_attack_kinds(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 6.0])], "id long, v array<double>")
    got = df.select(*[inject.attack(k, "v", 1, "id").alias(f"k{k}") for k in range(1, 7)]).first()
    ratio = np.array(got.k1) / [1, 2, 6]
    assert np.allclose(ratio, ratio[0]) and 0.2 <= ratio[0] < 0.8
    assert len({round(x, 6) for x in np.array(got.k2) / [1, 2, 6]}) == 3
    assert got.k3 == [3.0] * 3 and len(set(got.k4)) == 1 and 0.6 <= got.k4[0] < 2.4
    assert got.k5 == [6.0, 2.0, 1.0] and got.k6 == [0.0] * 3


def test_label_clicks(spark):
    clicks = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("b", "x"), ("b", "x")], "img string, label string")
    kept = labels.assign_labels(clicks)
    assert sorted((r.img, r.label) for r in kept.collect()) == [("b", "x"), ("b", "y")]
    assert [tuple(r) for r in labels.one_hot_labels(kept, ["x", "y", "z"]).collect()] == [("b", 1, 1, 0)]


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    first = split.split_rows(df, 0.33, ("id",), 1, ("label",))
    again = split.split_rows(df.repartition(7), 0.33, ("id",), 1, ("label",))
    assert {r.label: r.n for r in first.filter("test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 297, 1: 33}
    assert first.exceptAll(again).count() == 0
    assert split.sample_fraction(df, 0.1).count() == 100
    assert sorted(r.place for r in split.shuffle(df).collect()) == list(range(1, 1001))
    assert split.undersample(df, 2).groupBy("label").count().orderBy("label").collect() == [(0, 200), (1, 100)]


def test_short_series_make_no_square_image(spark):
    df = series(spark, [np.arange(20.0), np.arange(10.0)]).withColumnRenamed("idx", "date")
    got = images.sampled_square_image(df, 4, w.RowOrder(("id",), ("date",)))
    rows = got.orderBy("row").collect()
    assert {r.id for r in rows} == {0} and len(rows) == 4
    assert [x for r in rows for x in r.pixels] == [round(i / 15 * 255) for i in range(16)]


def test_matrix_images_a_few_at_a_time(spark):
    """Blocks of mixed lengths, null and empty ones: every image whole, and no task holds the images of a whole batch."""
    import numpy as np

    from meterloom.operators import images

    rng = np.random.default_rng(5)
    rows = [(i, i % 2, None if i == 3 else rng.normal(size=i % 7 * 40).tolist()) for i in range(40)]
    blocks = spark.createDataFrame(rows, "id long, segment long, values array<double>")
    for build, encode in (
        (images.gramian_field, lambda x: np.cos(np.add.outer(x, x))),
        (images.recurrence_plot, lambda x: np.abs(x[:, None] - x) < np.percentile(np.abs(x[:, None] - x), 20)),
        (images.markov_field, None),
    ):
        image = build(blocks)
        plan = image._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
        got = {}
        for r in image.collect():
            got.setdefault((r["id"], r["image"]), {})[r["row"]] = r["pixels"]
        assert set(got) == {(i, s) for i, s, v in rows if v}
        for i, s, v in rows:
            if v and encode:
                x = np.array(v)
                x = np.arccos(np.clip((x - x.min()) / (x.max() - x.min()) * 2 - 1, -1, 1)) if build is images.gramian_field else x
                assert np.allclose(np.array([got[i, s][k] for k in range(len(v))], dtype=float), encode(x))


def test_frequent_windows_are_dealt_by_the_buckets_of_all_meters(spark, monkeypatch):
    rng = np.random.default_rng(41)
    start = dt.datetime(2024, 1, 1)
    rows, want = [], collections.Counter()
    for i in [*range(20), None]:
        days = sorted(rng.choice(60, 30, replace=False).tolist())
        usage = rng.integers(0, 2, 30).tolist()
        rows += [(i, start + dt.timedelta(days=d), float(u)) for d, u in zip(days, usage)]
        full = [0.0] * (days[-1] - days[0] + 1)
        for d, u in zip(days, usage):
            full[d - days[0]] = float(u)
        steps = [b - a + 0.0 for a, b in zip(full, full[1:])]
        want.update(tuple(steps[j : j + 7]) for j in range(len(steps) - 6))
    df = spark.createDataFrame([*rows, (1, None, 5.0)], "id long, date timestamp, usage double")
    monkeypatch.setattr(resample, "WINDOWS", 30, raising=False)
    got = resample.frequent_windows(df)
    found = re.findall(r"hashpartitioning\(\S.*?, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().toString())
    assert found and min(map(int, found)) > 8 and spark.conf.get("spark.sql.shuffle.partitions") == "8"  # grows with the input
    assert [(tuple(r)[:7], r.n) for r in got.collect()] == sorted(want.items(), key=lambda v: (-v[1], v[0]))[:10]
    assert resample.frequent_windows(df.limit(0)).count() == 0
