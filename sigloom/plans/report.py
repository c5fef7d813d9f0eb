"""Markdown reports and the file names they are saved under."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = (
    ("dataset_overview", "Dataset Overview"),
    ("quality_summary", "Signal Quality"),
    ("preprocessing_summary", "Preprocessing"),
    ("time_domain_summary", "Time-Domain Findings"),
    ("frequency_domain_summary", "Frequency-Domain Findings"),
    ("time_frequency_summary", "Time-Frequency Findings"),
    ("feature_model_summary", "Feature and Model Results"),
    ("limitations", "Limitations"),
    ("next_steps", "Next Steps"),
)


@dataclass
class Report:
    title: str = "Signal Analysis Summary"
    sections: dict[str, str] = field(default_factory=dict)
    figures: list[str] = field(default_factory=list)

    def markdown(self) -> str:
        """The nine sections in fixed order, then the figures."""
        out = [f"# {self.title}", ""]
        for key, heading in SECTIONS:
            out += [f"## {heading}", "", self.sections.get(key) or "Not available.", ""]
        if self.figures:
            out += ["## Figures", "", *[f"![{Path(f).stem}]({f})" for f in self.figures], ""]
        return "\n".join(out)


def safe_stem(stem: str) -> str:
    """Letters, digits, - and _ stay, all else becomes _; nothing left is an error."""
    got = re.sub(r"[^0-9A-Za-z_-]", "_", stem).strip("_")
    if not got:
        raise ValueError("The file stem must hold a letter or digit.")
    return got


def save_summary(markdown: str, folder: str | Path, stem: str = "summary", run_date: date | None = None) -> Path:
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    path = target / f"{(run_date or date.today()).isoformat()}_{safe_stem(stem)}.md"
    path.write_text(markdown)
    return path


def figure_path(folder: str | Path, stem: str, run_date: date | None = None) -> Path:
    """Where a figure belongs: ``<folder>/<date>/<stem>.png``."""
    return Path(folder) / (run_date or date.today()).isoformat() / f"{safe_stem(stem)}.png"


def overview(signals: DataFrame) -> str:
    """Counts of records, labels and rates, each from one aggregation."""
    n = signals.count()
    labels = signals.groupBy(F.coalesce("label", F.lit("unlabeled")).alias("l")).count().orderBy(F.desc("count"), "l").collect()
    ends = signals.agg(F.min("sampling_rate_hz").alias("a"), F.max("sampling_rate_hz").alias("b")).first()
    counted = ", ".join(f"{r['l']}: {r['count']}" for r in labels)
    return f"Records: {n}. Labels: {counted}. Sampling rates: {ends['a']:g} to {ends['b']:g} Hz." if n else "Records: 0."
