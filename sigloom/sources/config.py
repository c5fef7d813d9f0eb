"""Project configuration from YAML: paths, loading, analysis and filtering."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

FILTER_KINDS = ("lowpass", "highpass", "bandpass")


@dataclass(frozen=True)
class Paths:
    data_dir: str = "data/raw"
    reports_dir: str = "reports"
    figures_dir: str = "reports/figures"
    summaries_dir: str = "reports/summaries"


@dataclass(frozen=True)
class Loading:
    file_patterns: tuple[str, ...] = ("*.csv", "*.txt", "*.npy", "*.wav")
    sampling_rate_hz: float | None = None
    label_column: str | None = None
    signal_column: str | None = None

    def __post_init__(self) -> None:
        if self.sampling_rate_hz is not None and self.sampling_rate_hz <= 0:
            raise ValueError("The loading section's sampling rate must lie above 0.")
        if not self.file_patterns:
            raise ValueError("The loading section needs a file pattern.")


@dataclass(frozen=True)
class Window:
    size_seconds: float = 1.0
    overlap_fraction: float = 0.5

    def __post_init__(self) -> None:
        if self.size_seconds <= 0:
            raise ValueError("An analysis window must last some time.")
        if not 0 <= self.overlap_fraction < 1:
            raise ValueError("Analysis windows overlap by a share from 0 to below 1.")


DEFAULT_BANDS = {"low": (0.0, 100.0), "mid": (100.0, 1000.0), "high": (1000.0, 5000.0)}


@dataclass(frozen=True)
class Analysis:
    window: Window = field(default_factory=Window)
    frequency_bands_hz: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(DEFAULT_BANDS))

    def __post_init__(self) -> None:
        for name, (low, high) in self.frequency_bands_hz.items():
            if not 0 <= low < high:
                raise ValueError(f"Frequency band '{name}' must have 0 <= low < high.")


@dataclass(frozen=True)
class Filtering:
    enabled: bool = False
    kind: str | None = None
    low_cut_hz: float | None = None
    high_cut_hz: float | None = None
    order: int = 4

    def __post_init__(self) -> None:
        if self.kind is not None and self.kind.lower() not in FILTER_KINDS:
            raise ValueError(f"Unknown filter; known are {FILTER_KINDS}.")
        if self.enabled and self.kind is None:
            raise ValueError("An enabled filter needs its kind.")
        if self.order <= 0:
            raise ValueError("A filter's order must be 1 or more.")


@dataclass(frozen=True)
class Project:
    paths: Paths = field(default_factory=Paths)
    loading: Loading = field(default_factory=Loading)
    analysis: Analysis = field(default_factory=Analysis)
    filtering: Filtering = field(default_factory=Filtering)


def _pick(kind, section: dict | None, **convert):
    """A section's known keys; a null section has the defaults."""
    section = section or {}
    if not isinstance(section, dict):
        raise ValueError("Each configuration section must be a mapping.")
    known = {f.name for f in fields(kind)}
    values = {k: convert.get(k, lambda v: v)(v) for k, v in section.items() if k in known and v is not None}
    return kind(**values)


def load_config(path: str | Path) -> Project:
    return parse_config(Path(path).read_text())


def parse_config(text: str) -> Project:
    import yaml

    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict):
        raise ValueError("The configuration must be a mapping.")
    bands = lambda v: {k: tuple(map(float, x)) for k, x in v.items()} if v else dict(DEFAULT_BANDS)
    return Project(
        _pick(Paths, raw.get("paths"), **{f.name: str for f in fields(Paths)}),
        _pick(Loading, raw.get("loading"), file_patterns=lambda v: (v,) if isinstance(v, str) else tuple(map(str, v)), sampling_rate_hz=float),
        _pick(Analysis, raw.get("analysis"), window=lambda v: _pick(Window, v, size_seconds=float, overlap_fraction=float), frequency_bands_hz=bands),
        _pick(Filtering, raw.get("filtering"), enabled=bool, low_cut_hz=float, high_cut_hz=float, order=int),
    )
