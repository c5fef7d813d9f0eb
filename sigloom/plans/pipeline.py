"""The record analysis: quality, filtering, features, models and a report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import detectors, joins, spectral, supervised
from sigloom.operators import features as feats
from sigloom.operators import quality as qual
from sigloom.operators.records import with_step
from sigloom.plans.report import Report, overview
from sigloom.sources.config import Filtering
from sigloom.sources.synthetic import synthetic_dataset
from sigloom.sources.tables import to_long


@dataclass(frozen=True)
class PipelineConfig:
    bands: tuple[feats.Band, ...] = ()
    run_modeling: bool = True
    run_anomaly_when_unlabeled: bool = True
    contamination: float | str = "auto"
    random_state: int = 0
    quality: qual.QualityConfig = field(default_factory=qual.QualityConfig)
    filtering: Filtering = field(default_factory=Filtering)
    features: feats.FeatureConfig | None = None
    invalid_record_policy: str = "skip"


@dataclass
class PipelineResult:
    quality: DataFrame
    features: DataFrame
    supervised: list[supervised.Evaluation]
    anomalies: DataFrame | None
    markdown: str
    notes: list[str]


def configured_filter(signals: DataFrame, config: Filtering) -> DataFrame:
    if not config.enabled:
        return with_step(signals.withColumn("status", F.lit("ok")), "none")
    made = spectral.filter_signals(signals, config.kind, config.low_cut_hz, config.high_cut_hz, config.order)
    return with_step(made, "filter", kind=config.kind, low_cut_hz=config.low_cut_hz, high_cut_hz=config.high_cut_hz, order=config.order)


def analyze(signals: DataFrame, config: PipelineConfig = PipelineConfig()) -> PipelineResult:
    """Quality of the raw records, features of the filtered ones, models on the features.

    A record that cannot be filtered or has missing samples is left out of the
    features with a note, or ends the run when the policy is ``raise``.
    """
    if config.invalid_record_policy not in ("skip", "raise"):
        raise ValueError("invalid_record_policy must be 'skip' or 'raise'.")
    if signals.isEmpty():
        raise ValueError("At least one record is needed.")
    table = qual.quality_table(to_long(signals), signals.drop("values"), config.quality)
    prepared = configured_filter(signals, config.filtering)
    made = feats.extract_features(prepared.where("status = 'ok'"), config.features or feats.FeatureConfig(config.bands)).cache()
    notes = [f"{r['record_name']}: {r['status']}" for r in prepared.where("status <> 'ok'").select("record_name", "status").orderBy("record_name").limit(100).collect()]
    notes += [f"{r['record_name']}: {r['status']}" for r in made.where("status <> 'ok'").select("record_name", "status").orderBy("record_name").limit(100).collect()]
    if notes and config.invalid_record_policy == "raise":
        raise ValueError(notes[0])
    usable = made.where("status = 'ok'").drop("status")
    if usable.isEmpty():
        raise ValueError("No record is usable.")
    models, anomalies = _models(usable.withColumn("row_index", F.col("record_id").cast("long")), config, notes) if config.run_modeling else ([], None)
    return PipelineResult(table, usable, models, anomalies, _report(signals, table, usable, models, anomalies, config, notes).markdown(), notes)


def run_synthetic(spark: SparkSession, config: PipelineConfig = PipelineConfig()) -> PipelineResult:
    return analyze(synthetic_dataset(spark), config)


def _models(table: DataFrame, config: PipelineConfig, notes: list[str]) -> tuple[list[supervised.Evaluation], DataFrame | None]:
    counts = table.agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("k")).first()
    models: list[supervised.Evaluation] = []
    wanted = counts["k"] == 0
    if counts["k"]:
        try:
            models = supervised.run_baselines(table, random_state=config.random_state)
            wanted = counts["k"] < counts["n"] and config.run_anomaly_when_unlabeled
        except ValueError as error:
            notes.append(f"Supervised baselines skipped: {error}")
            wanted = True
    if not wanted:
        return models, None
    try:
        return models, detectors.rank_scores(detectors.isolation_forest(table, config.contamination, config.random_state))
    except ValueError as error:
        notes.append(f"Anomaly scoring skipped: {error}")
        return models, None


def anomaly_text(scored: DataFrame, n: int = 5) -> str:
    facts = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("anomaly_score") > 0).cast("double")).alias("share"), F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi")
    ).first()
    top = ", ".join(str(r["row_index"]) for r in detectors.top_anomalies(scored, n).select("row_index").collect())
    return f"{facts['n']} rows scored, {100 * facts['share']:.1f}% anomalous; scores from {facts['lo']:.3g} to {facts['hi']:.3g}. Highest: rows {top}."


def _report(signals, table, features, models, anomalies, config, notes) -> Report:
    issues = ", ".join(f"{r['issue']}: {r['n']}" for r in qual.issue_counts(table).collect()) or "No issues were found."
    lead = {}
    for section, names in (
        ("time_domain_summary", ("rms", "crest_factor")),
        ("frequency_domain_summary", ("dominant_frequency_hz", "spectral_centroid_hz")),
        ("time_frequency_summary", ("max_spectrogram_energy", "high_frequency_transient_energy")),
    ):
        parts = []
        for name in names:
            best = joins.argmax_record(features, name).first()
            if best is not None and best["record_id"] is not None:
                parts.append(f"Largest {name}: record {best['record_id']} ({best['value']:.4g}).")
        lead[section] = " ".join(parts)
    bands = [f"band_energy_{b.name}" for b in (config.features.bands if config.features else config.bands)]
    if bands:
        known = {r["band"]: r["mean_energy"] for r in feats.band_means(features).collect() if r["mean_energy"] is not None}
        if known:
            lead["frequency_domain_summary"] += f" Highest mean band: {max(known, key=known.get)}."
    if models:
        results = " ".join(f"{m.name}: accuracy {m.metrics['accuracy']:.3g}, F1 {m.metrics['f1']:.3g}." for m in models)
    else:
        results = anomaly_text(anomalies) if anomalies is not None else "No model was run."
    filtering = f"{config.filtering.kind} filter of order {config.filtering.order}." if config.filtering.enabled else "No filter."
    return Report(
        sections={
            "dataset_overview": overview(signals),
            "quality_summary": issues,
            "preprocessing_summary": filtering,
            **lead,
            "feature_model_summary": results,
            "limitations": "\n".join(f"- {n}" for n in notes) or "Exploratory results; labels and thresholds need review.",
            "next_steps": "Check flagged records against the raw signals.",
        }
    )
