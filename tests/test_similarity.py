import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.functions import kernels
from meterloom.functions.kernels import dtw_below
from meterloom.operators import barycentre, cluster as cl, distance as ds, patterns as pt


def plain_dtw(a, b):
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            cost[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    return cost[-1, -1] ** 0.5


def vectors(spark, arrays, **extra):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(arrays)], "id long, values array<double>")


def test_dtw_of_mixed_lengths_and_nulls(spark):
    rng = np.random.default_rng(0)
    pairs = [(rng.normal(size=rng.integers(1, 9)), rng.normal(size=rng.integers(1, 9))) for _ in range(60)]
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)] + [(60, None, [1.0]), (61, [], [1.0])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = {r.id: r for r in df.select("id", ds.dtw("a", "b").alias("d"), dtw_below("a", "b", 1.5).alias("n")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = plain_dtw(a, b)
        assert abs(got[i].d - want) < 1e-9
        assert got[i].n is None if want >= 1.5 else abs(got[i].n - want) < 1e-9
    assert got[60].d is None and got[61].d is None


def test_soft_dtw_approaches_dtw():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(4, 7)), rng.normal(size=(4, 5))
    assert np.allclose(kernels.soft_dtw_pairs(a, b, 1e-4), kernels.dtw_pairs(a, b) ** 2, atol=1e-2)


def test_matrix_and_threshold_forms_agree(spark):
    rng = np.random.default_rng(2)
    arrays = rng.normal(size=(60, 6)).round(2)
    arrays[50:] = arrays[0]  # copies of one series
    df = vectors(spark, arrays)
    edges = {(r.a, r.b): r.dist for r in ds.dtw_matrix(df).collect()}
    assert len(edges) == 60 * 59 // 2
    assert all(abs(d - plain_dtw(arrays[a], arrays[b])) < 1e-9 for (a, b), d in edges.items())
    near = {(r.a, r.b): r.dist for r in ds.dtw_within(df, 1.5).collect()}
    assert set(near) == {k for k, d in edges.items() if d < 1.5 and k[1] < 50} | {(0, i) for i in range(50, 60)}
    assert all(near[0, i] == 0 for i in range(50, 60))
    assert {r.id: r.rep for r in ds.representatives(df).collect()} == {i: 0 if i >= 50 else i for i in range(60)}


def test_every_pair_of_copies_is_listed(spark, monkeypatch):
    """Also where copies are dealt into parts, ids repeat or are unknown, and one id has two arrays."""
    monkeypatch.setattr(ds, "CROWD", 2)
    shapes = [[0.0, 1.0, 0.0], [0.0, 1.2, 0.0], [5.0, 5.0]]
    rows = [(i, "x" if i < 12 else "y", shapes[i % 3]) for i in range(18)]
    rows += [(3, "x", shapes[0]), (4, "x", shapes[0]), (None, "x", shapes[0]), (20, "x", []), (21, "x", []), (22, "x", None)]
    df = spark.createDataFrame(rows, "id long, f string, values array<double>")
    want = sorted(
        (f, a, b, round(plain_dtw(x, y), 9)) for a, f, x in rows for b, g, y in rows
        if f == g and x and y and a is not None and b is not None and a < b and plain_dtw(x, y) < 0.5
    )
    got = sorted((r.f, r.a, r.b, round(r.dist, 9)) for r in ds.dtw_within(df, 0.5, ["f"], every=True).collect())
    assert got == want and len(want) > 50


def plain_linkage(dist):
    """Merge the closest pair of clusters, one at a time."""
    clusters = {i: [i] for i in range(len(dist))}
    steps = []
    while len(clusters) > 1:
        d, a, b = min((np.mean([dist[x, y] for x in clusters[i] for y in clusters[j]]), i, j) for i in clusters for j in clusters if i < j)
        clusters[a] += clusters.pop(b)
        steps.append((d, a, b, len(clusters[a]), [sorted(c) for c in clusters.values()]))
    return steps


def square(n, seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 2)).round(3)
    return np.linalg.norm(points[:, None] - points[None], axis=2)


def edges_of(spark, dist):
    n = len(dist)
    return spark.createDataFrame([(i, j, float(dist[i, j])) for i in range(n) for j in range(i + 1, n)], "a long, b long, dist double")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster, []).append(r.id)
    assert all(k == min(v) for k, v in out.items())
    return sorted(sorted(v) for v in out.values())


def test_average_linkage(spark):
    dist = square(14, 4)
    edges, steps = edges_of(spark, dist), plain_linkage(dist)
    cut = 0.9
    want = next(([sorted(x) for x in steps[i - 1][4]] if i else [[k] for k in range(14)]) for i, s in enumerate(steps) if s[0] >= cut)
    assert groups(cl.agglomerate(edges, threshold=cut).collect()) == sorted(want)
    assert groups(cl.agglomerate(edges, k=4).collect()) == sorted(steps[9][4])
    table = cl.linkage_table(edges).orderBy("step").collect()
    node = {i: i for i in range(14)}
    for row, (d, a, b, size, _) in zip(table, steps, strict=True):
        assert abs(row.distance - d) < 1e-9 and row["count"] == size
        assert {row.child_a, row.child_b} == {node[a], node[b]}
        node[a] = 14 + row.step


def test_linkage_runs_every_key_at_once_and_merges_copies(spark):
    dist = square(6, 9)
    dist[0, 1] = dist[1, 0] = 0.0
    one = edges_of(spark, dist)
    two = one.withColumn("feature", F.lit(0)).unionByName(one.withColumn("dist", F.col("dist") + 100).withColumn("feature", F.lit(1)))
    got = cl.agglomerate(two, threshold=0.5, keys=["feature"]).collect()
    assert {r.cluster for r in got if r.feature == 1} == set(range(6))
    assert {r.cluster for r in got if r.feature == 0 and r.id < 2} == {0}


def points(spark, array):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(array)], "id long, features array<double>")


def plain_dbscan(p, eps, least):
    near = [[j for j in range(len(p)) if ((p[i] - p[j]) ** 2).sum() <= eps * eps] for i in range(len(p))]
    core = [len(x) >= least for x in near]
    label = [-1] * len(p)
    for i in range(len(p)):
        if core[i] and label[i] == -1:
            todo, label[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] == -1:
                        label[j] = i
                        todo.append(j)
    for i in range(len(p)):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return core, label


@pytest.mark.parametrize("seed, dims", [(0, 2), (1, 4)])
def test_dbscan(spark, seed, dims):
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 0.4, (60, dims)), rng.normal(2, 0.4, (40, dims)), rng.uniform(-3, 5, (30, dims))]).round(3)
    p[100:110] = p[3]
    core, label = plain_dbscan(p, 0.6, 5)
    got = sorted(cl.dbscan(points(spark, p), 0.6, 5).collect())
    assert [r.core for r in got] == core and [r.cluster for r in got] == label
    assert len(set(label)) > 2


def test_mean_shift_finds_separate_blobs(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 0.3, (50, 2)), rng.normal(6, 0.3, (30, 2)), [[20.0, 20.0]]])
    got = {r.id: r.cluster for r in cl.mean_shift(points(spark, p), 1.5).collect()}
    assert {got[i] for i in range(50)} == {0} and {got[i] for i in range(50, 80)} == {1} and got[80] == 2


def test_kmeans_min_size(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(9, 0.3, (3, 2))])
    got = cl.kmeans_min_size(points(spark, p), 2, 10).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [10, 33]
    with pytest.raises(ValueError):
        cl.kmeans_min_size(points(spark, p), 5, 10)


def test_silhouettes(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 1, (12, 3)), rng.normal(3, 1, (9, 3)), [[9.0, 9.0, 9.0]]])
    member = [0] * 12 + [1] * 9 + [2]
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)

    def value(i):
        mine = [d[i, j] for j in range(len(p)) if member[j] == member[i] and j != i]
        if not mine:
            return 0.0
        a = np.mean(mine)
        b = min(np.mean([d[i, j] for j in range(len(p)) if member[j] == c]) for c in set(member) - {member[i]})
        return (b - a) / max(a, b)

    want = [value(i) for i in range(len(p))]
    who = spark.createDataFrame(list(enumerate(member)), "id long, cluster int")
    direct = sorted(cl.silhouette_points(points(spark, p).join(who, "id")).collect())
    paired = sorted(cl.edge_silhouette(edges_of(spark, d), who).collect())
    assert np.allclose([r.silhouette for r in direct], want) and np.allclose([r.silhouette for r in paired], want)


def plain_soft_dtw(a, b, gamma):
    """Value and the share of alignments through each cell, cell by cell."""
    n, m = len(a), len(b)
    total = np.full((n + 2, m + 2), np.inf)
    total[0, 0] = 0
    cost = (np.asarray(a)[:, None] - np.asarray(b)[None, :]) ** 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            three = np.array([total[i - 1, j], total[i, j - 1], total[i - 1, j - 1]])
            total[i, j] = cost[i - 1, j - 1] + three.min() - gamma * np.log(np.exp(-(three - three.min()) / gamma).sum())
    share = np.zeros((n + 2, m + 2))
    share[n, m] = 1
    for i in range(n, 0, -1):
        for j in range(m, 0, -1):
            for x, y in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                if x <= n and y <= m:
                    share[i, j] += share[x, y] * np.exp((total[x, y] - cost[x - 1, y - 1] - total[i, j]) / gamma)
    return total[n, m], share[1:-1, 1:-1]


@pytest.mark.parametrize("gamma,scale", [(0.5, 1), (1.0, 30), (20.0, 3)])
def test_soft_alignment_of_mixed_lengths_equals_cell_by_cell(gamma, scale):
    rng = np.random.default_rng(21)
    xs = [rng.normal(0, scale, rng.integers(1, 10)) for _ in range(150)]
    ys = [rng.normal(0, scale, rng.integers(1, 10)) for _ in range(150)]
    (a, na), (b, nb) = kernels.padded(xs), kernels.padded(ys)
    value, weight, total = kernels.soft_alignment(a, b, gamma, na, nb)
    soft, hard = kernels.soft_dtw_pairs(a, b, gamma, na, nb), kernels.soft_dtw_pairs(a, b, 0.0, na, nb)
    for i, (x, y) in enumerate(zip(xs, ys)):
        want, share = plain_soft_dtw(x, y, gamma)
        assert value[i] == pytest.approx(want, rel=1e-9, abs=1e-9) and soft[i] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert hard[i] ** 0.5 == pytest.approx(plain_dtw(x, y))
        assert hard[i] >= want - 1e-9 >= hard[i] - kernels.soft_slack(len(x), len(y), gamma) - 2e-9
        assert np.allclose(weight[i, : len(y)], share.sum(axis=0)) and not weight[i, len(y) :].any()
        assert np.allclose(total[i, : len(y)], share.T @ x)


def test_soft_alignment_takes_logarithms_only_along_the_paths_that_count(monkeypatch):
    rng = np.random.default_rng(23)
    a, b = rng.normal(500, 60, (40, 150)), rng.normal(500, 60, (40, 148))
    taken, real = [], np.exp
    monkeypatch.setattr(np, "exp", lambda v, *rest, **more: (taken.append(np.size(v)), real(v, *rest, **more))[1])
    value, weight, total = kernels.soft_alignment(a, b, 1.0)
    assert sum(taken) < 0.05 * 40 * 150 * 148
    monkeypatch.undo()
    for i in (0, 39):
        want, share = plain_soft_dtw(a[i], b[i], 1.0)
        assert value[i] == pytest.approx(want, rel=1e-12)
        assert np.allclose(weight[i], share.sum(axis=0), atol=1e-7) and np.allclose(total[i], share.T @ a[i])


def test_nearest_centres_in_single_precision_are_the_exact_ones():
    rng = np.random.default_rng(24)
    rows = [rng.normal(1e4, 20, rng.integers(40, 50)) for _ in range(60)]
    base = rng.normal(1e4, 20, 45)
    models = {2: [base, base + 1e-6], 3: [base, rows[0], base[::-1] + 1e-7]}  # near ties
    x, nx = kernels.padded(rows)
    assert kernels.single(x, x, nx, nx)[2](0.0) < kernels.soft_slack(40, 40, 1.0)
    rough, exact = (barycentre._measured(x, nx, models, 1.0, exact=e) for e in (False, True))
    for k, centres in models.items():
        assert (rough[k][1] == exact[k][1]).all()
        assert exact[k][0][3] == pytest.approx([plain_dtw(rows[3], c) ** 2 for c in centres])


def test_soft_centres_equal_a_plain_loop_and_never_worsen(spark):
    rng = np.random.default_rng(22)
    arrays = [rng.normal(5 * (i % 3), 1, size=rng.integers(6, 9)) for i in range(18)]
    df = vectors(spark, arrays)
    start = [r.id for r in df.orderBy(barycentre.digest(0, "id"), "id").limit(3).collect()]
    got, values = barycentre.soft_models(barycentre._dealt(df), [2, 3], 1.0)
    for k in (2, 3):
        assert all(b <= a * (1 + 1e-12) for a, b in zip(values[k], values[k][1:]))
        centres, seen = [arrays[i].copy() for i in start[:k]], []
        for _ in values[k]:
            soft = [[plain_soft_dtw(x, c, 1.0) for c in centres] for x in arrays]
            near = [min(range(k), key=lambda c: row[c][0]) for row in soft]
            seen.append(sum(row[c][0] for row, c in zip(soft, near)))
            last = centres
            centres = []
            for c in range(k):
                weight, total = np.zeros(len(last[c])), np.zeros(len(last[c]))
                for x, row, n in zip(arrays, soft, near):
                    if n == c:
                        weight, total = weight + row[c][1].sum(axis=0), total + row[c][1].T @ x
                centres.append(total / weight if weight.any() else last[c])
        assert np.allclose(seen, values[k])
        assert all(np.allclose(a, b) for a, b in zip(got[k], last))


def test_series_kmeans_of_unknown_and_no_series(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [9.0])], "id long, values array<double>")
    got = {r.id: (r.cluster, r.distance, r.second) for r in cl.series_kmeans(df, 2).collect()}
    assert got[2] == got[3] == (0, None, None) and got[1][0] != got[4][0] and got[1][1] < got[1][2]
    assert cl.series_kmeans(df.filter("id > 9"), 2).count() == 0
    assert {r.id: r.second for r in cl.series_kmeans(df, 1).collect()} == dict.fromkeys((1, 2, 3, 4))


def test_series_kmeans_separates_shapes(spark):
    t = np.arange(24)
    rng = np.random.default_rng(6)
    arrays = [np.sin(t / 3 + s) for s in rng.uniform(0, 0.4, 8)] + [4 + np.cos(t / 5 + s) for s in rng.uniform(0, 0.4, 8)]
    got = {r.id: r.cluster for r in cl.series_kmeans(vectors(spark, arrays), 2, 0.1, seed=2).collect()}
    assert len({got[i] for i in range(8)}) == 1 and len({got[i] for i in range(8, 16)}) == 1 and got[0] != got[8]


def test_votes(spark):
    rows = [(1, 3), (1, 3), (1, 5), (2, 5), (2, 4), (3, None), (4, None), (4, 0)]
    got = {r.item: r.vote for r in pt.vote_label(spark.createDataFrame(rows, "item long, pred int")).collect()}
    assert got == {1: 3, 2: 4, 3: -1, 4: 0}


def test_pattern_classifier_end_to_end(spark):
    """Cluster per feature, keep pure clusters, vote by the nearest ones."""
    rng = np.random.default_rng(8)
    rows = []
    for item in range(24):
        label = item % 2
        for feature in range(3):
            shape = np.linspace(0, 1, 10) if label == 0 else np.linspace(1, 0, 10)
            rows.append((item, label, feature, (shape + rng.normal(0, 0.02, 10)).tolist()))
    df = spark.createDataFrame(rows, "id long, label int, feature int, values array<double>")
    train, test = df.filter("id < 16"), df.filter("id >= 16")
    edges = ds.dtw_matrix(train, keys=["feature"])
    marked = train.join(cl.agglomerate(edges, threshold=0.75, keys=["feature"]), ["feature", "id"])
    patterns = pt.valuable_patterns(marked)
    assert {(r.feature, r.label) for r in patterns.collect()} == {(f, l) for f in range(3) for l in range(2)}
    preds = pt.nearest_pattern(test, pt.cluster_centers(marked), patterns, item=("id",))
    votes = pt.vote_label(preds, item=("id",)).join(test.select("id", "label").distinct(), "id")
    assert pt.pattern_accuracy(votes).first().accuracy == 1.0


def test_mean_shift_of_unusable_and_no_points(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [9.0, 9.0]), (4, None), (5, [nan, 0.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    got = {r["id"]: r["cluster"] for r in cl.mean_shift(df, 1.0).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] == got[6] == -1
    assert cl.mean_shift(df.filter("id > 9"), 1.0).count() == 0
    assert {r["id"] for r in cl.mean_shift(df).collect()} == {1, 2, 3, 4, 5, 6}


def test_silhouette_far_from_the_origin_and_with_many_clusters(spark, monkeypatch):
    near = [(i, i % 3, [float(i % 3) * 5 + (i % 7) * 0.1, float(i % 5) * 0.1]) for i in range(60)]
    far = [(i, c, [x + 1e8 for x in f]) for i, c, f in near]
    score = lambda rows: {r["id"]: r["silhouette"] for r in cl.silhouette_points(spark.createDataFrame(rows, "id long, cluster int, features array<double>")).collect()}
    a, b = score(near), score(far)
    assert all(abs(a[i] - b[i]) < 1e-4 for i in a) and min(a.values()) < 0.9999
    monkeypatch.setattr(cl, "PACKED", 1)
    assert score(near) == pytest.approx(a)


def test_series_kmeans_goes_on_until_centres_rest(spark):
    # series of one value: soft-DTW is the squared difference; more rounds than the former default of 10
    x = np.arange(300.0) ** 1.5
    df = vectors(spark, x[:, None])
    got = {r.id: r.cluster for r in cl.series_kmeans(df, 5, seed=3).collect()}
    side = np.array([got[i] for i in range(len(x))])
    mids = np.array([x[side == c].mean() for c in range(5)])
    assert (np.abs(x[:, None] - mids).argmin(axis=1) == side).all()
    with pytest.raises(RuntimeError, match="still move after 10 rounds"):
        cl.series_kmeans(df, 5, max_iter=10, seed=3)


def test_series_kmeans_sweep_tries_two_to_five(spark, monkeypatch):
    from meterloom.plans import similarity
    from meterloom.plans.catalog import load

    rng = np.random.default_rng(11)
    arrays = [rng.normal(10 * (i % 4), 0.1, size=4) for i in range(24)]
    monkeypatch.setattr(similarity, "weeks", lambda t: vectors(spark, arrays))
    rows = load()["c13_series_kmeans"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["k"] for r in rows) == [2, 3, 4, 5]
    assert [r["k"] for r in rows if r["best"]] == [max(rows, key=lambda r: (r["silhouette"], -r["k"]))["k"]]


def test_bandwidth_uses_every_point(spark, monkeypatch):
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.normal(size=(700, 3)), rng.normal(9, 3, size=(60, 3)), np.zeros((40, 3))])  # some equal
    gaps = np.sort(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), axis=1)
    monkeypatch.setattr(cl, "BLOCK", 100)
    assert abs(cl.estimate_bandwidth(points(spark, p)) - gaps[:, int(0.3 * len(p)) - 1].mean()) < 1e-9
    assert abs(cl.estimate_bandwidth(points(spark, p[:700])) - np.sort(np.sqrt(((p[:700, None] - p[None, :700]) ** 2).sum(-1)), axis=1)[:, 209].mean()) < 1e-9


def test_bandwidth_by_tiles_narrows_brackets(spark, monkeypatch):
    rng = np.random.default_rng(13)
    p = np.concatenate([rng.normal(size=(500, 3)), rng.normal(1e6, 1e-3, size=(200, 3)), np.full((30, 3), 7.25), [[1e9] * 3]])
    p[520:560] = p[519] + np.eye(3)[rng.integers(0, 3, 40)]  # many equal distances
    gaps = np.sort(((p[:, None] - p[None]) ** 2).sum(-1), axis=1)
    monkeypatch.setattr(cl, "BLOCK", 300)
    monkeypatch.setattr(cl, "KEEP", 50)
    want = np.sqrt(gaps[:, int(0.3 * len(p)) - 1]).mean()
    assert cl.estimate_bandwidth(points(spark, p)) == pytest.approx(want, rel=1e-12)


def plain_mean_shift(p, b):
    """Seeds one step at a time, strongest modes first, each point at its nearest mode."""
    modes = set()
    for at in np.unique(np.round(p / b), axis=0) * b:
        while True:
            inside = ((p - at) ** 2).sum(1) <= b * b
            if not inside.any():
                break
            to = p[inside].mean(0)
            rests, at = ((to - at) ** 2).sum() <= (1e-3 * b) ** 2, to
            if rests:
                modes.add((-int(inside.sum()), tuple(np.round(at, 6))))
                break
    kept = []
    for _, mode in sorted(modes):
        if all(((np.array(mode) - k) ** 2).sum() > b * b for k in kept):
            kept.append(np.array(mode))
    return ((p[:, None] - np.array(kept)[None]) ** 2).sum(-1).argmin(1)


@pytest.mark.parametrize("local", [16384, 30])
def test_mean_shift_inside_tasks_and_step_by_step(spark, monkeypatch, local):
    rng = np.random.default_rng(14)
    p = np.concatenate([rng.normal(0, 0.4, (40, 2)), rng.normal(4, 0.4, (25, 2)), rng.normal((8, 0), 0.2, (12, 2))])
    monkeypatch.setattr(cl, "LOCAL", local)  # 30: the largest group steps round by round
    got = {r.id: r.cluster for r in cl.mean_shift(points(spark, p), 1.6).collect()}
    want = plain_mean_shift(p, 1.6)
    assert [got[i] for i in range(len(p))] == want.tolist() and len(set(want)) == 3
    with pytest.raises(RuntimeError, match="still move after 1 rounds"):
        cl.mean_shift(points(spark, p), 1.6, max_iter=1)


def test_mean_shift_sends_points_once_for_the_seeds_of_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(15)
    p = rng.uniform(0, 8, (300, 3))
    sent = spark.sparkContext.accumulator(0)
    real = cl._walker

    def counted(*args):
        walk = real(*args)

        def run(key, seeds, points):
            sent.add(len(points))
            return walk(key, seeds, points)

        return run

    monkeypatch.setattr(cl, "_walker", counted)  # by cells, not by seeds
    got = {r.id: r.cluster for r in cl.mean_shift(points(spark, p), 1.0).collect()}
    assert [got[i] for i in range(len(p))] == plain_mean_shift(p, 1.0).tolist()
    seeds = len(np.unique(np.round(p), axis=0))
    assert 0 < sent.value < seeds * len(p) / 8


def test_bandwidth_tiles_follow_the_partitions(spark, monkeypatch):
    p = np.random.default_rng(16).normal(size=(3000, 3))
    df = points(spark, p).withColumn("w", F.lit(1).cast("long"))
    for c in ("lo", "hi", "below"):
        df = df.withColumn(c, F.lit(0).cast("long"))
    tiles = cl._over_tiles(df, 3000, df, 3000, lambda q, places, w: q.iloc[:1].assign(n=len(places)), "n long")
    assert tiles.count() == 9  # 8 partitions; one block a partition on either side made 64


@pytest.mark.parametrize("part", [1024, 7])
def test_dbscan_deals_crowded_cells_into_parts(spark, monkeypatch, part):
    rng = np.random.default_rng(17)
    p = np.concatenate([rng.normal(0, 0.5, (120, 3)), rng.uniform(-4, 4, (60, 3))])
    monkeypatch.setattr(cl, "PART", part)
    core, label = plain_dbscan(p, 0.6, 5)
    got = sorted(cl.dbscan(points(spark, p), 0.6, 5).collect())
    assert [r["core"] for r in got] == list(core) and [r["cluster"] for r in got] == list(label)


def test_mean_shift_query_estimates_its_bandwidth(spark, monkeypatch):
    from meterloom.plans.catalog import load

    asked = []
    monkeypatch.setattr(cl, "mean_shift", lambda df, *a, **b: asked.append((a, b)) or df)
    load()["c11_mean_shift"](spark, "/root/testdata/sf0.001")
    assert asked == [((), {})]


def brute_merges(dist):
    """One merge at a time on sums of distances."""
    s, n = dist.copy(), np.ones(len(dist))
    np.fill_diagonal(s, np.inf)
    out = []
    for _ in range(len(dist) - 1):
        avg = s / (n[:, None] * n[None])
        a, b = np.unravel_index(avg.argmin(), avg.shape)
        n[a] += n[b]
        out.append((a, b, avg[a, b], int(n[a])))
        s[a] += s[b]
        s[:, a] += s[:, b]
        s[b] = s[:, b] = np.inf
        s[a, a] = np.inf
    return out


@pytest.mark.parametrize("n, local", [(200, 2048), (40, 15)])
def test_linkage_by_rounds_and_in_one_task(spark, n, local):
    """Distributed rounds on packed rows and the bounded last task build the tree of one merge at a time."""
    dist = square(n, n)
    dist[3, :] = dist[:, 3] = dist[5, :]  # a copy
    dist[3, 5] = dist[5, 3] = dist[3, 3] = 0.0
    edges = edges_of(spark, dist)
    want = brute_merges(dist)
    got = sorted(cl.merges(edges, local=local).collect(), key=lambda r: (r.dist, r["count"], r.a, r.b))
    assert [(r.a, r.b, r["count"]) for r in got] == [(a, b, c) for a, b, _, c in sorted(want, key=lambda m: (m[2], m[3], m[0], m[1]))]
    assert np.allclose([r.dist for r in got], sorted(m[2] for m in want))
    limit = want[n // 2][2] + 1e-9
    labels = {r.id: r.cluster for r in cl.agglomerate(edges, threshold=limit, local=local).collect()}
    root = {i: i for i in range(n)}
    for a, b, d, _ in want:
        if d < limit:
            root = {i: a if r == b else r for i, r in root.items()}
    assert labels == root
    two = edges.withColumn("f", F.lit("x")).unionByName(edges.filter("a < 9 and b < 9").withColumn("f", F.lit("y")))
    kept = cl.agglomerate(two, k=4, keys=["f"], local=local).collect()
    assert {f: len({r.cluster for r in kept if r.f == f}) for f in "xy"} == {"x": 4, "y": 4}
    assert len(kept) == n + 9
    lone = cl.agglomerate(edges.filter("a < 2 and b < 2"), k=1, nodes=spark.createDataFrame([(0,), (1,), (77,)], "id long"), local=local).collect()
    assert sorted((r.id, r.cluster) for r in lone) == [(0, 0), (1, 0), (77, 77)]


def plain_rounds(sums, limit):
    """Every round searches the whole matrix and merges all clusters that are each other's nearest."""
    sums, sizes, alive, log = sums.copy(), np.ones(len(sums)), np.ones(len(sums), dtype=bool), []
    np.fill_diagonal(sums, np.inf)
    while True:
        average = np.where(alive[:, None] & alive[None], sums / (sizes[:, None] * sizes[None]), np.inf)
        near = average.argmin(axis=1)
        found = [(i, j) for i, j in enumerate(near) if alive[i] and near[j] == i and i < j and average[i, j] < limit]
        if not found:
            return log
        log += [(i, j, average[i, j], int(sizes[i] + sizes[j])) for i, j in found]
        for axis in (0, 1):
            for i, j in found:
                if axis:
                    sums[:, i] += sums[:, j]
                else:
                    sums[i] += sums[j]
        for i, j in found:
            sizes[i] += sizes[j]
            alive[j] = False
        sums = np.minimum(sums, sums.T)
        np.fill_diagonal(sums, np.inf)


@pytest.mark.parametrize("kinds", [2, 5, 1000])
def test_linkage_rounds_in_place_equal_whole_searches(monkeypatch, kinds):
    """Also among many equal distances, copies and unknown distances; rows out of order and in several batches."""
    from meterloom.operators import linkage as lk

    monkeypatch.setattr(lk, "STRIPE", 7)
    rng = np.random.default_rng(kinds)
    for n in (2, 3, 40, 61):
        dist = rng.integers(0, kinds, (n, n)).astype(float)
        dist = np.minimum(dist, dist.T)
        if n == 61:
            dist[5, 9] = dist[9, 5] = np.nan
        rows = [(i, 1, np.delete(np.arange(n), i), np.delete(dist[i], i), np.ones(n - 1, dtype=int)) for i in rng.permutation(n)]
        pdf = pd.DataFrame(rows, columns=["node", "n", "others", "sums", "sizes"])
        for limit in (None, 0.6 * kinds):
            got = lk._finish((pdf.iloc[s : s + 9] for s in range(0, n, 9)), [], limit, n + 3)
            assert sorted(got.itertuples(index=False, name=None)) == sorted(plain_rounds(dist, limit or np.inf))


def test_thousands_of_clusters_are_finished_in_one_task(spark, monkeypatch):
    from meterloom.operators import linkage as lk

    cuts, real = [], lk.cut
    monkeypatch.setattr(lk, "cut", lambda df: cuts.append(df) or real(df))
    log = lk.merges(ds.dtw_rows(_noise(spark, 2100, 1)))
    assert log.count() == 2099 and len(cuts) == 2


def test_packed_rows_hold_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(ds, "TILE", 4)
    rng = np.random.default_rng(5)
    rows = [(i, "a" if i % 3 else "b", rng.normal(size=rng.integers(1, 6)).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, f string, values array<double>")
    want = {(r.f, r.a, r.b): r.dist for r in ds.dtw_matrix(df, ["f"]).collect()}
    got = {}
    for r in ds.dtw_rows(df, ["f"]).collect():
        for o, d in zip(r.others, r.dists, strict=True):
            assert (r.f, r.node, o) not in got
            got[r.f, r.node, o] = d
    assert got == {k: d for (f, a, b), d in want.items() for k in ((f, a, b), (f, b, a))}


@pytest.mark.parametrize("chunk", [512, 3])
def test_candidates_lose_no_near_pair(spark, monkeypatch, chunk):
    """Also with crowded cells, lengths below and above the number of pieces, and values below zero; bounds drop most far pairs."""
    monkeypatch.setattr(ds, "CHUNK", chunk)
    monkeypatch.setattr(ds, "CROWD", chunk)
    rng = np.random.default_rng(8)
    shapes = [np.cumsum(rng.normal(0, 0.4, 60)) for _ in range(6)]
    rows = [(i, "a" if i % 4 else "b", (shapes[i % 6][: rng.integers(1, 61)] + rng.normal(0, 0.05)).tolist()) for i in range(50)]
    rows += [(100 + i, "a", [0.0, *rng.normal(0, 1, 12).tolist(), 0.0]) for i in range(25)] + [(200, "a", [0.0]), (201, "a", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, f string, values array<double>")
    far = {(r.f, r.a, r.b): r.dist for r in ds.dtw_matrix(df, ["f"]).collect()}
    near = ds.near_pairs(df, 0.8, ["f"], measure=False).select("f", "a", "b").collect()
    assert len({tuple(r) for r in near}) == len(near)
    want = {k for k, d in far.items() if d < 0.8}
    assert want <= {tuple(r) for r in near} and len(near) < 0.5 * len(far)
    got = {(r.f, r.a, r.b): r.dist for r in ds.dtw_within(df, 0.8, ["f"]).collect()}
    assert set(got) == want and all(abs(far[k] - d) < 1e-9 for k, d in got.items())


def _noise(spark, n, length=6):
    rng = np.random.default_rng(11)
    return spark.createDataFrame([(i, rng.normal(size=length + i % 3).tolist()) for i in range(n)], "id long, values array<double>")


def test_tiles_of_few_series_use_every_core(spark):
    """The bytes of a tile say little about its work: small tables must not end up in one task."""
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    data = _noise(spark, 200)
    assert tasks(ds.dtw_matrix(data)) >= 4
    assert tasks(ds.dtw_rows(data)) >= 4


def test_edge_silhouette_measures_once_and_broadcasts_no_edges(spark):
    data = _noise(spark, 60)
    clusters = data.select("id", (F.col("id") % 3).alias("cluster"))
    edges = ds.dtw_matrix(data)
    points = cl.edge_silhouette(edges, clusters)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "BroadcastHashJoin" not in plan
    dist = {(r["a"], r["b"]): r["dist"] for r in edges.collect()}
    gap = lambda i, j: dist[min(i, j), max(i, j)]
    for r in points.collect():
        mean = [np.mean([gap(r["id"], j) for j in range(60) if j % 3 == c and j != r["id"]]) for c in range(3)]
        a, b = mean[r["cluster"]], min(m for c, m in enumerate(mean) if c != r["cluster"])
        assert abs(r["silhouette"] - (b - a) / max(a, b)) < 1e-9


def test_dtw_kernels_give_up_only_beyond_the_radius():
    rng = np.random.default_rng(12)
    for la, lb in ((1, 1), (1, 6), (6, 1), (9, 9), (5, 12), (30, 17)):
        a, b = rng.normal(size=(300, la)), rng.normal(size=(300, lb))
        table = np.full((300, la + 1, lb + 1), np.inf)
        table[:, 0, 0] = 0
        for i in range(la):
            for j in range(lb):
                table[:, i + 1, j + 1] = (a[:, i] - b[:, j]) ** 2 + np.minimum(np.minimum(table[:, i, j + 1], table[:, i + 1, j]), table[:, i, j])
        whole = np.sqrt(table[:, la, lb])
        assert np.allclose(kernels.dtw_pairs(a, b), whole)
        radius = float(np.quantile(whole, 0.3))
        assert np.allclose(kernels.dtw_pairs_below(a, b, radius), np.where(whole < radius, whole, np.nan), equal_nan=True)


def test_dtw_of_whole_numbers_is_exact_in_single_precision(monkeypatch):
    rng = np.random.default_rng(13)
    a, b = rng.integers(0, 60, (200, 31)).astype(float), rng.integers(0, 60, (200, 24)).astype(float)
    a[:20, :9], b[:20, 5:] = 2000.0, -2000.0  # sums beyond what single precision holds
    kinds, real = [], kernels._diagonals
    monkeypatch.setattr(kernels, "_diagonals", lambda x, y, *more: kinds.append((x.dtype.itemsize, len(x))) or real(x, y, *more))
    for shift, sizes in ((0.0, {(4, 200), (8, 20)}), (0.25, {(8, 200)})):
        kinds.clear()
        got = kernels.dtw_pairs(a + shift, b)
        assert set(kinds) == sizes
        assert np.array_equal(got, np.array([plain_dtw(x, y) for x, y in zip(a + shift, b)]))
        for radius in (float(np.quantile(got, 0.3)), 6000.0, 50000.0):
            assert np.array_equal(kernels.dtw_pairs_below(a + shift, b, radius), np.where(got < radius, got, np.nan), equal_nan=True)
