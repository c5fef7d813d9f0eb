"""Detectors against brute force, with block sizes far below the table's."""

import itertools

import numpy as np
import pytest

from sigloom.functions import kernels as K
from sigloom.operators import autoencoder, detectors, neighbours, records, supervised
from sigloom.sources import synthetic
from sigloom.workspace import Workspace, components


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_index long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))


@pytest.fixture()
def small_leaves(monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 40)
    monkeypatch.setattr(neighbours, "VISITORS", 30)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    x[300:] += 4
    x[:60] = x[0]  # a large group of equal rows
    return x, (x - x.mean(axis=0)) / x.std(axis=0)


def far(z):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    return d


def test_k_radius_over_many_leaves(spark, small_leaves, cloud):
    x, z = cloud
    d = far(z)
    np.fill_diagonal(d, np.inf)
    got = {r["row_index"]: r["anomaly_score"] for r in neighbours.knn_radius(table(spark, x), 70).collect()}
    assert [got[i] for i in range(600)] == pytest.approx(np.sort(d, axis=1)[:, 69])


def test_local_outlier_factor_over_many_leaves(spark, small_leaves, cloud):
    x, z = cloud
    d = far(z)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    dist = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(dist, dist[near, -1]).mean(axis=1) + 1e-10)
    want = density[near].mean(axis=1) / density
    got = {r["row_index"]: r["anomaly_score"] for r in neighbours.local_outlier_factor(table(spark, x), 10).collect()}
    assert [got[i] for i in range(600)] == pytest.approx(want)


def test_density_clusters_over_many_leaves(spark, small_leaves, cloud):
    x, z = cloud
    near = [np.flatnonzero(r <= 0.2) for r in far(z)]
    core = np.array([len(n) >= 6 for n in near])
    label, number = np.full(600, -1), 0
    for i in range(600):
        if core[i] and label[i] < 0:
            label[i], stack = number, [i]
            while stack:
                for j in near[stack.pop()]:
                    if label[j] < 0:
                        label[j] = number
                        if core[j]:
                            stack.append(j)
            number += 1
    assert number >= 2 and (label < 0).any()
    out = {r["row_index"]: r for r in neighbours.dbscan_scores(table(spark, x), 0.2, 6).collect()}
    assert [out[i]["cluster_label"] for i in range(600)] == label.tolist()
    centres = np.array([z[label == c].mean(axis=0) for c in range(number)])
    away = np.sqrt(((z[:, None] - centres[None]) ** 2).sum(axis=2)).min(axis=1)
    size = np.array([(label == c).sum() for c in range(number)])
    want = away + np.where(label >= 0, 1 / size[label], 1.0) + np.sort(far(z), axis=1)[:, 5] + np.where(label < 0, away.max() + 1, 0)
    assert [out[i]["anomaly_score"] for i in range(600)] == pytest.approx(want)


def test_robust_distance_equals_the_search_of_all_subsets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 2))
    x[:2] += 8
    n, p, h = 12, 2, 7
    best = min(itertools.combinations(range(n), h), key=lambda c: np.linalg.det(np.cov(x[list(c)].T, bias=True)))
    mean, cov = x[list(best)].mean(axis=0), np.cov(x[list(best)].T, bias=True)
    d = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
    cov = cov * np.median(d()) / detectors.chi2_quantile(0.5, p)
    good = d() < detectors.chi2_quantile(0.975, p)
    mean, cov = x[good].mean(axis=0), np.cov(x[good].T, bias=True)
    cov = cov * np.median(d()[good]) / detectors.chi2_quantile(0.5, p)
    got = {r["row_index"]: r["anomaly_score"] for r in detectors.robust_mahalanobis(table(spark, x)).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(d())


def test_robust_distance_concentrates_on_rows_beyond_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    x[:100] += 9
    whole = {r["row_index"]: r["anomaly_score"] for r in detectors.robust_mahalanobis(table(spark, x)).collect()}
    monkeypatch.setattr(detectors, "FIT_ROWS", 60)
    part = {r["row_index"]: r["anomaly_score"] for r in detectors.robust_mahalanobis(table(spark, x)).collect()}
    assert [part[i] for i in range(400)] == pytest.approx([whole[i] for i in range(400)], rel=0.02)


def test_one_class_machine_solves_its_program(spark):
    x = np.random.default_rng(4).normal(size=(30, 2))
    nu, n = 0.2, 30
    machine = detectors.OneClass(x, x.mean(axis=0), x.std(axis=0), nu, 0.5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    k = np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    a = np.zeros(n)
    for s, w in zip(machine.support, machine.weight):
        a[np.flatnonzero((z == s).all(axis=1))[0]] = w
    assert a.sum() == pytest.approx(1) and a.max() <= 1 / (nu * n) + 1e-9
    value = k @ a
    assert (value[a < 1e-9] >= machine.rho - 1e-4).all() and (value[a > 1 / (nu * n) - 1e-9] <= machine.rho + 1e-4).all()


def test_forest_scores_equal_a_walk_down_each_tree():
    x = np.random.default_rng(5).normal(size=(300, 3))
    forest = detectors.Forest(x, trees=10, size=64)
    for i in range(0, 300, 37):
        depth = 0.0
        for feature, cut, left, right, level in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[i, feature[at]] <= cut[at] else right[at]
            depth += level[at]
        want = 2 ** (-depth / 10 / detectors.average_path(64)) - 0.5
        assert forest(x[i : i + 1])["anomaly_score"][0] == pytest.approx(want)


def test_gradients_of_the_autoencoder():
    rng = np.random.default_rng(6)
    config = autoencoder.TrainConfig(latent=3, learning_rate=1e-3)
    for shape in ((7, 5), (1, 4), (2, 1), (6, 6)):
        x = rng.normal(size=(4, shape[0] * shape[1]))
        model = autoencoder.Autoencoder(shape, 0.0, 1.0, config)
        loss = lambda: ((model._forward(model.normal(x))[0] - model.normal(x)[:, 0]) ** 2).mean()  # noqa: E731, B023
        model.w = [w + rng.normal(0, 0.1, w.shape) for w in model.w]  # away from the kinks at 0
        before = [w.copy() for w in model.w]
        model._step(model.normal(x))
        slopes = [m / 0.1 for m in model.m]
        model.w = before
        for k in range(8):
            at = tuple(rng.integers(0, s) for s in model.w[k].shape)
            keep = model.w[k][at]
            model.w[k][at] = keep + 1e-6
            up = loss()
            model.w[k][at] = keep - 1e-6
            down = loss()
            model.w[k][at] = keep
            assert slopes[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_autoencoder_sees_every_patch(spark, monkeypatch):
    monkeypatch.setattr(autoencoder, "SHARD", 10)
    rng = np.random.default_rng(7)
    rows = [(i, 0, 2, 3, rng.normal(size=6).tolist()) for i in range(35)]
    train = spark.createDataFrame(rows, "record_id long, window_index long, n_frames long, n_bins long, patch array<double>")
    config = autoencoder.TrainConfig(epochs=2, latent=2)
    made = [autoencoder.fit(train, (2, 3), config) for _ in range(2)]
    assert all((a == b).all() for a, b in zip(made[0].w, made[1].w))
    assert made[0].errors(np.array([r[4] for r in rows])).shape == (35,)


def test_patch_flags(spark):
    patches = spark.createDataFrame([(1, 0, 0.0, 0.5), (1, 1, 0.5, 1.0)], "record_id long, window_index long, start_seconds double, end_seconds double")
    signals = spark.createDataFrame([(1, "r", None)], "record_id long, record_name string, label string")
    spans = spark.createDataFrame([(1, 0.5, 0.7), (1, 0.2, 0.2)], "record_id long, start_seconds double, end_seconds double")
    out = autoencoder.patch_metadata(patches, signals, spans).orderBy("window_index").collect()
    assert [r["known_anomaly_overlap"] for r in out] == [False, True]


@pytest.mark.parametrize("n", [1, 2, 5, 97, 1000])
def test_blocked_filter_equals_the_recursion(n):
    sos = K.butterworth("bandpass", 2, 100.0, 5.0, 20.0)
    x = np.random.default_rng(n).normal(size=(3, n))
    start = np.random.default_rng(1).normal(size=(len(sos), 2, 3))
    want = x.copy()
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s1, s2 = start[k]
        for i in range(n):
            v = want[:, i].copy()
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            want[:, i] = o
    assert K.sos_filter(sos, x, start) == pytest.approx(want)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolution_over_many_blocks(spark, monkeypatch, mode):
    monkeypatch.setattr(synthetic, "BLOCK", 7)
    monkeypatch.setattr(synthetic, "DIRECT", 3)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=40), rng.normal(size=19)
    a, b = (spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "sample_index long, value double") for s in (x, y))
    out = synthetic.convolve_signals(a, b, mode).orderBy("sample_index").collect()
    assert [r["value"] for r in out] == pytest.approx(np.convolve(x, y, mode))


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(50)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    out = {r["id"]: r["component_id"] for r in components(Workspace(spark, "t"), frame).collect()}
    assert len(out) == 3051 and {v for k, v in out.items() if k < 4000} == {0} and {v for k, v in out.items() if k >= 4000} == {5000}
    assert components(Workspace(spark, "t"), frame.limit(0)).count() == 0


def test_checks_and_trail(spark):
    rows = spark.createDataFrame([(1, 2.0, [1.0]), (2, 0.0, [1.0]), (3, 1.0, []), (4, 1.0, [float("nan")]), (5, 1.0, None)], "record_id long, sampling_rate_hz double, values array<double>")
    out = {r["record_id"]: r["status"] for r in records.checked(rows).collect()}
    assert out[1] == "ok" and all(out[i] != "ok" for i in (2, 3, 4, 5))
    trail = records.with_step(records.with_step(rows, "filter", kind="lowpass", low_cut_hz=None), "window", name="hann").first()["preprocessing"]
    assert trail == [{"step": "filter", "kind": "lowpass"}, {"step": "window", "name": "hann"}]


def test_groups_per_label(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "label string, g long")
    assert {tuple(r) for r in supervised.groups_per_label(rows, "label", "g").collect()} == {("a", 2, 3), ("b", 1, 1)}


def test_components_of_few_edges_take_few_jobs(spark):
    rng = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(300)]
    edges = [(a * 7919 % 1009, b * 7919 % 1009) for a, b in path] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (150, 2))]
    frame = spark.createDataFrame([*edges, (5000, None), (5001, 5001)], "src long, dst long").repartition(3)
    spark.sparkContext.setJobGroup("few", "components")
    try:
        few = {r["id"]: r["component_id"] for r in components(Workspace(spark, "t"), frame).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert few == want


def test_components_by_rounds_and_in_one_task_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(f"é{a}", f"é{b}" if b % 3 else f"Z{b}") for a, b in rng.integers(0, 400, (260, 2)).tolist()]
    edges += [("hub", f"h{i}") for i in range(1100)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    few = sorted(map(tuple, components(Workspace(spark, "t"), frame).collect()))
    monkeypatch.setattr("sigloom.workspace.FEW", 0)
    assert few == sorted(map(tuple, components(Workspace(spark, "t"), frame).collect())) and few
