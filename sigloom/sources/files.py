"""Signal files: CSV, whitespace text, NumPy arrays and WAV, one record a channel.

Files are listed and read by Spark's binary source, so any file system that it
knows will do, and each is decoded whole in one task: a file is a record.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.kernels import SignalError
from sigloom.operators.detectors import numbered
from sigloom.operators.joins import metadata_lookup
from sigloom.session import ship

TIME_NAMES = {"time", "timestamp", "t", "seconds", "time_s", "time_seconds"}
SUFFIXES = (".csv", ".txt", ".npy", ".wav")
SCHEMA = (
    "record_name string, label string, sampling_rate_hz double, values array<double>, source_path string, file_name string, format string, "
    "signal_column string, time_column string, sampling_rate_source string, inferred_sampling_rate_hz double, "
    "sampling_rate_mismatch_fraction double, time_axis_valid boolean, time_step_median_seconds double, time_step_jitter_fraction double, "
    "time_gap_count long, time_axis_nonmonotonic_count long, status string"
)
_NAMES = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]


def load_signals(
    spark: SparkSession, path: str, patterns: tuple[str, ...] = ("*.csv", "*.txt", "*.npy", "*.wav"), sampling_rate_hz: float | None = None,
    signal_column: str | None = None, label_column: str | None = None, label: str | None = None, split_channels: bool = False, channel: int | None = None,
) -> DataFrame:
    """Records of all files of a folder (or of one file), numbered by path and name in record_id.

    Numbers come from the names alone, so no samples meet in one task.  A file that cannot be decoded gives a row without values whose ``status`` says why.
    """
    glob = "{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return decode_files(files, sampling_rate_hz, signal_column, label_column, label, split_channels, channel)


def decode_files(
    files: DataFrame, sampling_rate_hz: float | None = None, signal_column: str | None = None, label_column: str | None = None,
    label: str | None = None, split_channels: bool = False, channel: int | None = None,
) -> DataFrame:
    """Records of ``files(path, content)``, wherever their bytes come from; the suffix says how they are read."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += decode(file, content, sampling_rate_hz, signal_column, label_column, label, split_channels, channel)
                except (ValueError, struct.error) as error:
                    rows.append(_row(file, status=str(error)))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, _arrow(n)) for n in _NAMES]))

    records = files.mapInArrow(run, SCHEMA)
    names = numbered(records.select("source_path", "record_name"), F.asc("source_path"), F.asc("record_name"))
    return records.join(names, ["source_path", "record_name"]).select(*_NAMES, (F.col("number") - 1).alias("record_id"))


def load_dataset(
    spark: SparkSession, config, metadata: DataFrame | None = None, labels_by_name: dict[str, str] | None = None, split_channels: bool = False
) -> DataFrame:
    """All records of a project's data folder, with labels and facts of a metadata table.

    A record's own label beats ``labels_by_name``, which beats the metadata's; an
    empty mapped label counts as none.
    """
    rows = load_signals(
        spark, config.paths.data_dir, tuple(config.loading.file_patterns), config.loading.sampling_rate_hz,
        config.loading.signal_column, config.loading.label_column, split_channels=split_channels,
    )
    return label_records(rows, metadata, labels_by_name)


def label_records(rows: DataFrame, metadata: DataFrame | None = None, labels_by_name: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the labels that ``labels_by_name`` and then ``metadata`` have for those without one."""
    named = {k: v for k, v in (labels_by_name or {}).items() if v}
    if named:
        mapping = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
        rows = rows.withColumn("label", F.coalesce("label", mapping[F.col("record_name")]))
    return rows if metadata is None else metadata_lookup(rows, metadata)


def _arrow(name: str) -> pa.DataType:
    kind = dict((p.strip().split(" ")[0], p.strip().split(" ")[1]) for p in SCHEMA.split(","))[name]
    return {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_(), "long": pa.int64()}[kind]


def _row(path: str, **facts) -> dict:
    base = path.rsplit("/", 1)[-1]
    return dict.fromkeys(_NAMES) | {"source_path": path, "file_name": base, "record_name": base.rsplit(".", 1)[0], "status": "ok"} | facts


def decode(path, content, rate=None, signal_column=None, label_column=None, label=None, split_channels=False, channel=None) -> list[dict]:
    """The records of one file."""
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix == ".csv":
        return _decode_csv(path, content, rate, signal_column, label_column, label, split_channels)
    if suffix not in SUFFIXES:
        raise SignalError(f"Unsupported file suffix '{suffix}'.")
    source = "provided"
    if suffix == ".txt":
        data = np.loadtxt(io.BytesIO(content), ndmin=1)
    elif suffix == ".npy":
        data = np.load(io.BytesIO(content), allow_pickle=False)
    else:
        own, data = decode_wav(content)
        if rate is not None and not np.isclose(rate, own):
            raise SignalError("The provided sampling rate does not match the WAV file.")
        rate, source = own, "file"
    if rate is None or rate <= 0:
        raise SignalError("A positive sampling rate is needed for this format.")
    data = np.asarray(data, np.float64)
    data = data.squeeze() if data.ndim > 2 else data
    if data.ndim not in (1, 2) or not data.size:
        raise SignalError("The file must hold one or two dimensions of samples.")
    name = _row(path)["record_name"]
    if data.ndim == 1 or data.shape[1] == 1:
        channels = [(name, data.reshape(-1))]
    elif channel is not None:
        if not 0 <= channel < data.shape[1]:
            raise SignalError("channel is out of range.")
        channels = [(name, data[:, channel])]
    elif split_channels:
        channels = [(f"{name}_{k}", data[:, k]) for k in range(data.shape[1])]
    else:
        raise SignalError("The file has several channels; choose one or split them.")
    return [
        _row(path, record_name=n, label=label, sampling_rate_hz=float(rate), values=v.tolist(), format=suffix[1:], sampling_rate_source=source)
        for n, v in channels
    ]


def _decode_csv(path, content, rate, signal_column, label_column, label, split_channels) -> list[dict]:
    frame = pd.read_csv(io.BytesIO(content))
    if frame.empty:
        raise SignalError("The CSV file is empty.")
    if label_column is not None and label is None:
        if label_column not in frame:
            raise SignalError(f"Missing label column '{label_column}'.")
        seen = frame[label_column].dropna().unique()
        if len(seen) > 1:
            raise SignalError("The label column holds several labels.")
        label = str(seen[0]) if len(seen) else None
    numeric = [c for c in frame.columns if c != label_column and str(c).strip().lower() not in TIME_NAMES and pd.api.types.is_numeric_dtype(frame[c]) and frame[c].dtype != bool]
    if split_channels:
        chosen = numeric
        if not chosen:
            raise SignalError("The CSV file has no numeric signal column.")
    elif signal_column is not None:
        if signal_column not in frame:
            raise SignalError(f"Missing signal column '{signal_column}'.")
        chosen = [signal_column]
    elif len(numeric) != 1:
        raise SignalError("The CSV file must have exactly one numeric signal column, or one must be named.")
    else:
        chosen = numeric
    time = next((c for c in frame.columns if str(c).strip().lower() in TIME_NAMES), None)
    facts = axis_facts(pd.to_numeric(frame[time], errors="coerce").to_numpy(np.float64)) if time is not None else {}
    inferred = facts.get("inferred_sampling_rate_hz")
    use, source = (float(rate), "provided") if rate is not None else (inferred, "time_column")
    if use is None or use <= 0:
        raise SignalError("A sampling rate is needed: none was given and the time column gives none.")
    if rate is not None and inferred:
        facts["sampling_rate_mismatch_fraction"] = abs(rate - inferred) / inferred
    name = _row(path)["record_name"]
    return [
        _row(
            path, record_name=f"{name}_{c}" if split_channels else name, label=label, sampling_rate_hz=use, values=frame[c].to_numpy(np.float64).tolist(),
            format="csv", signal_column=str(c), time_column=None if time is None else str(time), sampling_rate_source=source, **facts,
        )
        for c in chosen
    ]


def axis_facts(time: np.ndarray) -> dict:
    """Diagnostics over the finite times of an axis."""
    t = time[np.isfinite(time)]
    d = np.diff(t)
    back = int((d <= 0).sum())
    if len(t) < 2 or back:
        return {"time_axis_valid": False, "time_axis_nonmonotonic_count": back}
    med = float(np.median(d))
    return {
        "time_axis_valid": True, "time_axis_nonmonotonic_count": 0, "time_step_median_seconds": med,
        "time_step_jitter_fraction": float(np.abs(d - med).max() / med), "time_gap_count": int((d > 1.5 * med).sum()), "inferred_sampling_rate_hz": 1.0 / med,
    }


def decode_wav(content: bytes) -> tuple[float, np.ndarray]:
    """(rate, samples scaled to [-1, 1]) of PCM and float RIFF files."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise SignalError("Not a WAV file.")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", content, at + 8)
            if form[0] == 0xFFFE and size >= 26:
                form = (struct.unpack_from("<H", content, at + 32)[0], *form[1:])
        elif name == b"data":
            data = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise SignalError("The WAV file has no format or no data.")
    code, channels, rate, _, _, bits = form
    if code == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128.0) / 128.0
    elif bits in (16, 32):
        x = np.frombuffer(data, f"<i{bits // 8}").astype(np.float64) / float(1 << (bits - 1))
    elif bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        v = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        x = np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    else:
        raise SignalError(f"Unsupported WAV format {code} with {bits} bits.")
    return float(rate), x.reshape(-1, channels) if channels > 1 else x
