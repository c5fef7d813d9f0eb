"""Spectrogram patches and a convolutional autoencoder trained on all of them.

Training patches are dealt into shards by a hash.  In every epoch each shard takes its
own steps from the common weights, in a task of its own, and the shards' weights are
averaged; up to SHARD patches are one shard, which is plain training by mini-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import kernels as K
from sigloom.operators.detectors import rank_scores
from sigloom.workspace import Workspace
from sigloom.session import ship

SHARD, SHARDS = 5_000, 1_024  # patches of a shard, about, and shards at most; beyond, they hold more
CHANNELS = 8  # of the outer layers


@dataclass(frozen=True)
class PatchConfig:
    patch_window_seconds: float = 0.5
    patch_step_seconds: float = 0.1
    spectrogram_window_seconds: float = 0.064
    spectrogram_step_seconds: float = 0.032
    max_frequency_hz: float | None = 800.0

    def __post_init__(self) -> None:
        if min(self.patch_window_seconds, self.patch_step_seconds, self.spectrogram_window_seconds, self.spectrogram_step_seconds) <= 0:
            raise ValueError("All patch and spectrogram lengths must be positive.")
        if self.patch_step_seconds > self.patch_window_seconds:
            raise ValueError("patch_step_seconds must not exceed patch_window_seconds.")


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 25
    batch_size: int = 32
    learning_rate: float = 1e-3
    latent: int = 16
    threshold_quantile: float = 0.95
    random_state: int = 0

    def __post_init__(self) -> None:
        if self.epochs < 1 or self.batch_size < 1 or self.latent < 1 or self.learning_rate <= 0:
            raise ValueError("epochs, batch_size, latent and learning_rate must be positive.")
        if not 0 < self.threshold_quantile < 1:
            raise ValueError("threshold_quantile must lie between 0 and 1.")


def split_demo(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the ``split`` column; training records must all be labelled normal."""
    counts = signals.groupBy("split", "label").count().collect()
    if any(r["split"] == "train" and r["label"] != "normal" for r in counts):
        raise ValueError("Training records must be labelled normal.")
    have = {r["split"] for r in counts}
    if not {"train", "test"} <= have:
        raise ValueError("Both train and test records are needed.")
    if not any(r["split"] == "test" and r["label"] == "anomalous" for r in counts):
        raise ValueError("An anomalous test record is needed.")
    return signals.where("split = 'train'"), signals.where("split = 'test'")


def patches(signals: DataFrame, config: PatchConfig = PatchConfig()) -> DataFrame:
    """record_id, label, window_index, start_seconds, end_seconds, n_frames, n_bins, patch (dB, row-major frames)."""
    ship(signals.sparkSession)
    kind = dict(signals.dtypes)["record_id"]
    schema = f"record_id {kind}, label string, window_index long, start_seconds double, end_seconds double, n_frames long, n_bins long, patch array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                x = np.array(batch.column(2)[i].values.to_numpy(zero_copy_only=False), np.float64)
                rate = batch.column(3)[i].as_py()
                size, step = max(1, round(config.patch_window_seconds * rate)), max(1, round(config.patch_step_seconds * rate))
                for k, first in enumerate(range(0, len(x) - size + 1, step)):
                    f, _, p = K.spectrogram(x[first : first + size], rate, config.spectrogram_window_seconds, config.spectrogram_step_seconds)
                    if config.max_frequency_hz is not None:
                        p = p[:, f <= config.max_frequency_hz]
                    if not p.size:
                        raise K.SignalError("No frequency bin lies below max_frequency_hz.")
                    db = 10 * np.log10(np.maximum(p, 1e-24))
                    rows.append((k, first / rate, (first + size) / rate, p.shape[0], p.shape[1], db.reshape(-1).tolist()))
                if rows:
                    at = pa.array(np.full(len(rows), i))
                    made = [pa.array(c) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), *made],
                        ["record_id", "label", "window_index", "start_seconds", "end_seconds", "n_frames", "n_bins", "patch"],
                    )

    return signals.select("record_id", "label", "values", "sampling_rate_hz").mapInArrow(run, schema)


def patch_metadata(patches: DataFrame, signals: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """(record_id, record_name, label, window_index, start, end and center seconds, known_anomaly_overlap) of patches.

    ``intervals(record_id, start_seconds, end_seconds)`` are known anomalies; ends that only
    touch do not overlap, and an interval without extent counts for nothing.
    """
    named = patches.select("record_id", "window_index", "start_seconds", "end_seconds").join(signals.select("record_id", "record_name", "label"), "record_id")
    out = named.withColumn("center_seconds", (F.col("start_seconds") + F.col("end_seconds")) / 2)
    if intervals is None:
        return out.withColumn("known_anomaly_overlap", F.lit(False))
    spans = intervals.where("start_seconds < end_seconds").select("record_id", F.col("start_seconds").alias("_a"), F.col("end_seconds").alias("_b"))
    hit = patches.select("record_id", "window_index", "start_seconds", "end_seconds").join(spans, "record_id").where("start_seconds < _b and end_seconds > _a")
    hit = hit.select("record_id", "window_index").distinct().withColumn("known_anomaly_overlap", F.lit(True))
    return out.join(hit, ["record_id", "window_index"], "left").withColumn("known_anomaly_overlap", F.coalesce("known_anomaly_overlap", F.lit(False)))


def _spread(size: int, small: int) -> np.ndarray:
    """Weights of bilinear interpolation from ``small`` to ``size`` cells, centres aligned."""
    at = np.clip((np.arange(size) + 0.5) * small / size - 0.5, 0, small - 1)
    low = np.minimum(at.astype(int), small - 1)
    high = np.minimum(low + 1, small - 1)
    out = np.zeros((size, small))
    out[np.arange(size), low] += 1 - (at - low)
    out[np.arange(size), high] += at - low
    return out


def _cells(x: np.ndarray) -> np.ndarray:
    """The 3 x 3 surroundings of every cell: (n, c, h, w) to (n, h, w, 9 c)."""
    n, c, h, w = x.shape
    wide = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    return np.stack([wide[:, :, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=-1).transpose(0, 2, 3, 1, 4).reshape(n, h, w, 9 * c)


def _uncells(d: np.ndarray, c: int) -> np.ndarray:
    n, h, w, _ = d.shape
    wide = np.zeros((n, c, h + 2, w + 2))
    parts = d.reshape(n, h, w, c, 9)
    for k in range(9):
        wide[:, :, k // 3 : k // 3 + h, k % 3 : k % 3 + w] += parts[..., k].transpose(0, 3, 1, 2)
    return wide[:, :, 1:-1, 1:-1]


class Autoencoder:
    """Convolutions 1 - CHANNELS - latent, halved between them, and back by interpolation and two more."""

    def __init__(self, shape: tuple[int, int], mean: float, sd: float, config: TrainConfig):
        self.shape, self.mean, self.sd, self.config = shape, mean, sd if sd > 0 and np.isfinite(sd) else 1.0, config
        rng = np.random.default_rng(config.random_state)
        widths = [(1, CHANNELS), (CHANNELS, config.latent), (config.latent, CHANNELS), (CHANNELS, 1)]
        self.w = []
        for a, b in widths:
            self.w += [rng.normal(0, (2 / (9 * a)) ** 0.5, (9 * a, b)), np.zeros(b)]
        self.small = tuple(max(1, s // 2) for s in shape)
        self.rows, self.columns = _spread(shape[0], self.small[0]), _spread(shape[1], self.small[1])
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0

    def normal(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.sd).reshape(-1, 1, *self.shape)

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, list]:
        keep = []

        def layer(k: int, x: np.ndarray, active: bool) -> np.ndarray:
            cells = _cells(x)
            y = cells @ self.w[2 * k] + self.w[2 * k + 1]
            y = np.maximum(y, 0) if active else y
            keep.append((cells, y))
            return y.transpose(0, 3, 1, 2)

        a = layer(0, z, True)
        h, w = self.small
        block = a[:, :, : min(2 * h, a.shape[2]), : min(2 * w, a.shape[3])]
        block = block.reshape(len(z), CHANNELS, h, -1, w, block.shape[3] // w)
        pooled = block.max(axis=(3, 5))
        b = layer(1, pooled, True)
        up = np.einsum("ia,ncab,jb->ncij", self.rows, b, self.columns, optimize=True)
        c = layer(2, up, True)
        return layer(3, c, False)[:, 0], [keep, block, pooled]

    def train(self, x: np.ndarray, seed: int) -> None:
        """One epoch of Adam steps on the mean squared error."""
        z, rng = self.normal(x), np.random.default_rng(seed)
        order = rng.permutation(len(z))
        for a in range(0, len(z), self.config.batch_size):
            self._step(z[order[a : a + self.config.batch_size]])

    def _step(self, z: np.ndarray) -> None:
        out, (keep, block, pooled) = self._forward(z)
        grads: list[np.ndarray] = [None] * 8
        d = (2 * (out - z[:, 0]) / out.size)[..., None]

        def back(k: int, d: np.ndarray, channels: int) -> np.ndarray:
            cells, y = keep[k]
            if k < 3:
                d = d * (y > 0)
            grads[2 * k] = np.tensordot(cells, d, axes=([0, 1, 2], [0, 1, 2]))
            grads[2 * k + 1] = d.sum(axis=(0, 1, 2))
            return _uncells(d @ self.w[2 * k].T, channels)

        d = back(3, d, CHANNELS).transpose(0, 2, 3, 1)
        d = back(2, d, self.config.latent)
        d = np.einsum("ia,ncij,jb->ncab", self.rows, d, self.columns, optimize=True).transpose(0, 2, 3, 1)
        d = back(1, d, CHANNELS)
        top = block == pooled[:, :, :, None, :, None]
        share = top * (d / np.maximum(top.sum(axis=(3, 5)), 1))[:, :, :, None, :, None]
        full = np.zeros((len(z), CHANNELS, *self.shape))
        flat = share.reshape(len(z), CHANNELS, block.shape[2] * block.shape[3], -1)
        full[:, :, : flat.shape[2], : flat.shape[3]] = flat
        back(0, full.transpose(0, 2, 3, 1), 1)
        self.t += 1
        for k, g in enumerate(grads):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] = self.w[k] - self.config.learning_rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def errors(self, x: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for a in range(0, len(x), 256):
            z = self.normal(x[a : a + 256])
            out.append(((self._forward(z)[0] - z[:, 0]) ** 2).mean(axis=(1, 2)))
        return np.concatenate(out)

    def state(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for part in (self.w, self.m, self.v) for p in part])

    def take(self, state: np.ndarray, steps: int) -> None:
        at = 0
        for part in (self.w, self.m, self.v):
            for k, p in enumerate(part):
                part[k] = state[at : at + p.size].reshape(p.shape).copy()
                at += p.size
        self.t = steps


def fit(train: DataFrame, shape: tuple[int, int], config: TrainConfig) -> Autoencoder:
    """Trained on every patch of ``train(record_id, window_index, patch)``; reruns agree."""
    work = Workspace(train.sparkSession, "autoencoder")
    cells = train.select(F.explode("patch").alias("v")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    count = train.count()
    shards = max(1, min(SHARDS, -(-count // SHARD)))
    dealt = work.save(train.select("record_id", "window_index", "patch", F.pmod(F.xxhash64("record_id", "window_index"), F.lit(shards)).alias("shard")), "shards")
    model = Autoencoder(shape, float(cells["m"]), float(cells["s"]), config)
    for epoch in range(config.epochs):
        sent = train.sparkSession.sparkContext.broadcast((model, epoch))

        def run(table: pa.Table) -> pa.Table:
            own, number = sent.value
            table = table.sort_by([("record_id", "ascending"), ("window_index", "ascending")])
            x = table["patch"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            own.train(x, config.random_state + 1 + number)
            return pa.table({"n": pa.array([table.num_rows]), "steps": pa.array([own.t]), "shard": table["shard"].slice(0, 1), "state": pa.array([own.state()], pa.list_(pa.float64()))})

        made = dealt.groupBy("shard").applyInArrow(run, "n long, steps long, shard long, state array<double>").collect()
        made.sort(key=lambda r: r["shard"])
        weights = np.array([r["n"] for r in made], np.float64) / count
        model.take(sum(w * np.array(r["state"]) for w, r in zip(weights, made)), max(r["steps"] for r in made))
        sent.unpersist()
    work.close()
    return model


def score(train: DataFrame, test: DataFrame, config: TrainConfig = TrainConfig()) -> DataFrame:
    """Reconstruction error of every test patch, is_flagged above the training errors' quantile, and rank."""
    shapes = train.select("n_frames", "n_bins").unionByName(test.select("n_frames", "n_bins")).distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("All patches must have one shape, and there must be some.")
    if train.isEmpty():
        raise ValueError("No training patch was found.")
    model = fit(train, (shapes[0]["n_frames"], shapes[0]["n_bins"]), config)
    sent = ship(test.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def error(column):
        import pandas as pd

        return pd.Series(sent.value.errors(np.stack(column.to_numpy()).astype(np.float64)))

    cut = float(train.select(error("patch").alias("e")).agg(F.percentile("e", F.lit(config.threshold_quantile))).first()[0])
    scored = test.withColumn("anomaly_score", error("patch")).drop("patch")
    scored = scored.withColumn("row_index", F.struct("record_id", "window_index")).withColumn("is_flagged", F.col("anomaly_score") > F.lit(cut))
    return rank_scores(scored).drop("row_index")
