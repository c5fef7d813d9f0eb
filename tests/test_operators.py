import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import autoencoder, detectors, joins, neighbours, quality, spectral, supervised
from sigloom.operators import features as feats
from sigloom.operators import samples as S
from sigloom.plans import pipeline, plotdata, report
from sigloom.sources import config, files, synthetic
from sigloom.sources.tables import to_long


def long(spark, values, record=1):
    return spark.createDataFrame([(record, i, v) for i, v in enumerate(values)], "record_id long, sample_index long, value double")


def signal(spark, values, rate, record=1, label=None):
    return spark.createDataFrame([(record, f"r{record}", label, float(rate), [float(v) for v in values])], "record_id long, record_name string, label string, sampling_rate_hz double, values array<double>")


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_interpolation_fills_every_kind_of_gap(spark):
    out = S.interpolate_missing(long(spark, [0.0, float("nan"), 2.0, float("inf"), 4.0])).orderBy("sample_index")
    assert [r["value"] for r in out.collect()] == [0, 1, 2, 3, 4]
    assert out.first()["missing_fraction"] == pytest.approx(0.4)
    edge = S.interpolate_missing(long(spark, [None, 1.0, None])).orderBy("sample_index")
    assert [r["value"] for r in edge.collect()] == [1, 1, 1]
    assert S.interpolate_missing(long(spark, [None, None])).first()["status"] == "all_missing"
    assert S.interpolate_missing(long(spark, [None, 1.0]), 0.1).first()["status"] == "too_many_missing"


@pytest.mark.parametrize("partial,step,sizes", [(False, 2, [4, 4, 4, 4]), (True, 4, [4, 4, 2]), (True, 2, [4, 4, 4, 4])])
def test_segments(spark, partial, step, sizes):
    out = S.segment(long(spark, [float(i) for i in range(10)]), 4, step, partial)
    counts = out.groupBy("window_index").count().orderBy("window_index").collect()
    assert [r["count"] for r in counts] == sizes
    with pytest.raises(ValueError):
        S.segment(long(spark, [1.0]), 2, 3)


def test_time_features_of_symmetric_constant_and_single(spark):
    rows = long(spark, [-2.0, -1.0, 0.0, 1.0, 2.0], 1).unionByName(long(spark, [1.0] * 10, 2)).unionByName(long(spark, [2.0], 3))
    out = {r["record_id"]: r for r in S.time_features(rows).collect()}
    assert out[1]["skewness"] == pytest.approx(0, abs=1e-12) and out[1]["kurtosis"] > 1
    assert out[2]["skewness"] == 0 and out[2]["kurtosis"] == 0 and out[2]["std"] == 0
    assert out[3]["rms"] == 2 and out[3]["crest_factor"] == 1 and out[3]["zero_crossing_rate"] == 0
    assert out[1]["zero_crossing_rate"] == pytest.approx(0.25)


def test_quality_flags(spark):
    sine = [max(-0.5, min(0.5, 2 * math.sin(i / 5))) for i in range(200)]
    rows = long(spark, sine, 1).unionByName(long(spark, [0.0] * 100 + [1.0] * 100, 2)).unionByName(long(spark, [None] * 4, 3))
    records = spark.createDataFrame([(i, f"r{i}", None, 100.0) for i in (1, 2, 3)], "record_id long, record_name string, label string, sampling_rate_hz double")
    table = quality.quality_table(rows, records)
    out = {r["record_id"]: r for r in table.collect()}
    assert table.columns[1:] == quality.COLUMNS and len(quality.COLUMNS) == 24
    assert out[1]["is_clipped"] and "possible_clipping" in out[1]["issues"]
    assert out[2]["is_likely_nonstationary"]
    assert out[3]["missing_fraction"] == 1 and out[3]["issues"] == "missing_values; all_values_missing" and out[3]["rms"] is None
    assert quality.quality_table(rows.limit(0), records).count() == 0


def test_extract_and_sliding_features(spark):
    x = 2 * np.sin(2 * np.pi * 10 * np.arange(200) / 100)
    rows = signal(spark, x, 100)
    made = feats.extract_features(rows, feats.FeatureConfig((feats.Band("in", 5, 15), feats.Band("over", 60, 80)))).first()
    assert made["dominant_frequency_hz"] == 10 and made["band_energy_in"] == pytest.approx(2.0) and math.isnan(made["band_energy_over"])
    slid = feats.sliding_features(rows, feats.SlidingConfig(0.5, 0.25)).collect()
    assert len(slid) == 7 and slid[0]["rms"] == pytest.approx(2**0.5) and slid[0]["dominant_frequency_hz"] == 10
    bad = feats.extract_features(signal(spark, [1.0, float("nan")], 10)).first()
    assert bad["status"] != "ok" and bad["rms"] is None
    with pytest.raises(ValueError):
        feats.SlidingConfig(0.1, 0.2)


def test_column_and_kernel_descriptors_agree(spark):
    x = np.random.default_rng(0).normal(size=64)
    rows = signal(spark, x, 64)
    bins = spectral.explode_spectrum(spectral.spectrum(rows))
    native = spectral.descriptors(bins).first()
    kernel = feats.extract_features(rows, feats.FeatureConfig((), 0.25)).first()
    for name in ("spectral_centroid_hz", "spectral_bandwidth_hz", "spectral_rolloff_85_hz", "spectral_flatness", "spectral_entropy"):
        assert native[name] == pytest.approx(kernel[name], rel=1e-9)


def test_filter_statuses(spark):
    short = signal(spark, [1.0] * 5, 100)
    assert "too short" in spectral.filter_signals(short, "lowpass", None, 10.0).first()["status"]
    assert spectral.filter_signals(short, "lowpass", None, 10.0, allow_causal_fallback=True).first()["status"] == "causal_fallback"
    assert "Nyquist" in spectral.filter_signals(short, "lowpass", None, 80.0).first()["status"]


def table(spark, n=40):
    rng = np.random.default_rng(3)
    rows = [(i, f"r{i}", None, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))] + [(n, "out", None, 9.0, 9.0)]
    return spark.createDataFrame(rows, "row_index long, record_name string, label string, rms double, crest_factor double")


@pytest.mark.parametrize(
    "run",
    [detectors.robust_z, detectors.mahalanobis, detectors.robust_mahalanobis, detectors.isolation_forest, detectors.one_class_svm,
     lambda t: detectors.pca_reconstruction(t, 1), neighbours.local_outlier_factor, neighbours.dbscan_scores, neighbours.knn_radius],
)
def test_every_detector_is_finite_ranked_and_keeps_metadata(spark, run):
    out = detectors.rank_scores(run(table(spark)))
    rows = out.collect()
    assert len(rows) == 41 and sorted(r["anomaly_rank"] for r in rows) == list(range(1, 42))
    assert all(math.isfinite(r["anomaly_score"]) for r in rows) and "record_name" in out.columns
    if run not in (detectors.one_class_svm,) and getattr(run, "__name__", "") != "<lambda>":
        assert min(rows, key=lambda r: r["anomaly_rank"])["row_index"] == 40


def test_robust_z_exact(spark):
    rows = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip([1.0, 2.0, 3.0, 4.0, 20.0], [2.0, 2.0, 2.0, 2.0, 8.0]))], "row_index long, rms double, crest double")
    scores = [r["anomaly_score"] for r in detectors.robust_z(rows).orderBy("row_index").collect()]
    assert scores == pytest.approx([0.6745 * max(0, v - 3) for v in (1, 2, 3, 4, 20)])
    with pytest.raises(ValueError):
        detectors.robust_z(rows, ["nope"])


def test_matrix_drops_empty_rows_and_fills_medians(spark):
    rows = spark.createDataFrame([(0, None, None), (1, 1.0, None), (2, 3.0, float("inf")), (3, 5.0, 4.0)], "row_index long, a double, b double")
    matrix, names = detectors.feature_matrix(rows)
    assert matrix.count() == 3 and [r["b"] for r in matrix.orderBy("row_index").collect()] == [4, 4, 4]


def test_all_noise(spark):
    rows = spark.createDataFrame([(i, float(i * i)) for i in range(4)], "row_index long, a double")
    out = neighbours.dbscan_scores(rows, 0.01, 2).collect()
    assert {r["cluster_label"] for r in out} == {-1}


def test_supervised_groups_do_not_leak(spark):
    rows = [(i, f"g{i // 2}", "a" if i < 12 else "b", float(i < 12) + 0.01 * i, 1.0 * (i % 3)) for i in range(24)]
    data = spark.createDataFrame(rows, "row_index long, record_name string, label string, x double, y double")
    made = supervised.run_baselines(data)
    assert [m.name for m in made] == ["logistic_regression", "random_forest"] and all(m.metrics["accuracy"] == 1 for m in made)
    split, _ = supervised.split_groups(data.withColumnRenamed("label", "true_label"), "true_label", None, 0.3, 0)
    assert split.groupBy("record_name").agg(F.count_distinct("_test").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(ValueError):
        supervised.run_baselines(data.where("label = 'a'"))


def test_metadata_priority_and_last_row_wins(spark):
    records = spark.createDataFrame([(1, "a", None, "/x/a.csv"), (2, "b", "own", "/x/b.csv"), (3, "c", None, "/x/c.csv")], "record_id long, record_name string, label string, source_path string")
    meta = spark.createDataFrame([(0, "a.csv", "old"), (1, "a.csv", "new"), (2, "b.csv", "other")], "row_pos long, file_name string, label string")
    assert got(joins.metadata_lookup(records, meta).orderBy("record_id"), "label") == [("new",), ("own",), (None,)]


def test_overlap_is_strict(spark):
    pieces = spark.createDataFrame([(1, 0, 4), (1, 4, 8), (2, 0, 4)], "record_id long, start long, end long")
    spans = spark.createDataFrame([(1, 4, 6)], "record_id long, start long, end long")
    assert got(joins.interval_overlap(pieces, spans).orderBy("record_id", "start"), "is_anomalous") == [(False,), (True,), (False,)]


def test_generators(spark):
    assert synthetic.window_signal(spark).agg(F.max("value")).first()[0] == pytest.approx(1.0, abs=1e-4)
    noisy = [r["value"] for r in synthetic.noisy_sine_wave(spark, seed=4).orderBy("sample_index").limit(3).collect()]
    t = np.arange(1000) / 1000
    want = np.sin(2 * np.pi * 50 * t) + np.random.default_rng(4).normal(0, 0.1, 1000)
    assert noisy == pytest.approx(want[:3])
    burst = synthetic.transient_burst(spark)
    assert burst.where("value <> 0").agg(F.min("sample_index"), F.max("sample_index")).first()[0] >= 800
    full = synthetic.convolve_signals(long(spark, [1.0, 2.0, 3.0]).drop("record_id"), long(spark, [1.0, 1.0]).drop("record_id"), "full")
    assert [r["value"] for r in full.orderBy("sample_index").collect()] == [1, 3, 5, 3]
    with pytest.raises(ValueError):
        synthetic.sine_wave(spark, duration_seconds=0)


def wav(values, width=2, channels=1, rate=100):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate), w.writeframes(values)
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,signal\n0,1\n0.1,2\n0.2,3\n0.35,4\n")
    (tmp_path / "b.csv").write_text("time,x,y\n0,1,2\n1,2,3\n")
    (tmp_path / "c.wav").write_bytes(wav(np.array([0, 16384, -16384], "<i2").tobytes()))
    (tmp_path / "d.wav").write_bytes(wav(np.array([[0, 1], [2, 3]], "<i2").tobytes(), channels=2))
    np.save(tmp_path / "e.npy", np.arange(3.0))
    out = {r["file_name"]: r for r in files.load_signals(spark, str(tmp_path)).collect()}
    a = out["a.csv"]
    assert a["sampling_rate_hz"] == pytest.approx(10) and a["time_step_jitter_fraction"] > 0 and a["values"] == [1, 2, 3, 4]
    assert "exactly one" in out["b.csv"]["status"] and "several channels" in out["d.wav"]["status"] and "rate" in out["e.npy"]["status"]
    assert out["c.wav"]["values"] == [0, 0.5, -0.5] and out["c.wav"]["sampling_rate_hz"] == 100
    split = files.load_signals(spark, str(tmp_path), ("d.wav",), split_channels=True)
    assert [r["record_name"] for r in split.orderBy("record_id").collect()] == ["d_0", "d_1"]
    assert files.decode_wav(wav(bytes([0, 128, 255]), 1))[1].tolist() == [-1, 0, 0.9921875]


def test_dataset_labels(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text("1 2 3")
    project = config.Project(config.Paths(data_dir=str(tmp_path)), config.Loading(sampling_rate_hz=4.0))
    meta = spark.createDataFrame([(0, "a", "m"), (1, "b", "m")], "row_pos long, stem string, label string")
    out = files.load_dataset(spark, project, meta, {"b": "mapped", "a": ""}).orderBy("record_id").collect()
    assert [r["label"] for r in out] == ["m", "mapped", None] and out[0]["sampling_rate_hz"] == 4


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("loading:\n  sampling_rate_hz: 10\nanalysis:\nfiltering:\n  enabled: true\n  kind: lowpass\n  high_cut_hz: 5\n")
    got_ = config.load_config(path)
    assert got_.loading.sampling_rate_hz == 10 and got_.analysis.window.size_seconds == 1 and got_.filtering.kind == "lowpass"
    path.write_text("filtering:\n  enabled: true\n")
    with pytest.raises(ValueError):
        config.load_config(path)


def test_synthetic_pipeline(spark):
    out = pipeline.run_synthetic(spark)
    assert out.features.count() == 6 and out.quality.count() == 6 and out.supervised == [] and out.anomalies.count() == 6
    assert out.markdown.count("\n## ") == 9
    with pytest.raises(ValueError):
        pipeline.analyze(synthetic.synthetic_dataset(spark).limit(0))


def test_report_files(tmp_path):
    assert report.save_summary("x", tmp_path, "my run!").read_text() == "x"
    with pytest.raises(ValueError):
        report.safe_stem("!!")


def test_plot_data(spark):
    rows = long(spark, [float(i % 7) for i in range(100)])
    out = plotdata.time_signal(rows, 10.0, 1.0, 5.0, 20)
    assert out.count() <= 20 and out.agg(F.min("sample_index")).first()[0] >= 10
    assert plotdata.frequency_spectrum(signal(spark, range(16), 16), log_frequency=True).where("frequency_hz = 0").isEmpty()


def test_autoencoder_flags_the_odd_one(spark):
    rng = np.random.default_rng(0)
    rows = [signal(spark, np.sin(np.arange(256)) + 0.01 * rng.normal(size=256), 256, i) for i in range(6)]
    train = rows[0]
    for r in rows[1:]:
        train = train.unionByName(r)
    test = train.limit(2).unionByName(signal(spark, rng.normal(size=256) * 5, 256, 99))
    c = autoencoder.PatchConfig(0.5, 0.25, 0.125, 0.0625, None)
    out = autoencoder.score(autoencoder.patches(train, c), autoencoder.patches(test, c), autoencoder.TrainConfig(epochs=10))
    assert out.orderBy("anomaly_rank").first()["record_id"] == 99
    assert to_long(rows[0]).count() == 256
