"""Join-like operators: metadata lookup, interval overlap, score consensus, label summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_COLUMNS = ("record_name", "name", "file_name", "filename", "stem", "source_path")
LABEL_COLUMNS = ("label", "condition", "class", "target")


def metadata_lookup(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of ``records(record_id, record_name, label, source_path)`` with a metadata table.

    Its key columns are tried in the order record name, file name, stem, full path;
    of metadata rows with one key the last (by ``row_pos``) counts; a path is found
    by its name and stem too.  A record's own label beats the metadata's.
    """
    keys = [c for c in KEY_COLUMNS if c in metadata.columns]
    if not keys:
        raise ValueError(f"The metadata needs one of the columns {KEY_COLUMNS}.")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    stem = lambda c: F.regexp_replace(base(c), r"\.[^.]*$", "")
    options = [F.col(c).cast("string") for c in keys]
    if "source_path" in keys:
        options += [base(F.col("source_path")), stem(F.col("source_path"))]
    payload = F.struct(*[F.col(c).cast("string").alias(c) for c in metadata.columns if c != "row_pos"])
    exploded = metadata.select("row_pos", F.explode(F.array_distinct(F.array_compact(F.array(*options)))).alias("key"), payload.alias("meta"))
    latest = exploded.groupBy("key").agg(F.max_by("meta", "row_pos").alias("meta"))
    path = F.coalesce(F.col("source_path"), F.lit("")) if "source_path" in records.columns else F.lit("")
    probes = F.array(F.col("record_name"), base(path), stem(path), path)
    tried = records.select("record_id", F.posexplode(probes).alias("order", "key")).where("key is not null and key <> ''")
    best = tried.join(latest, "key").groupBy("record_id").agg(F.min_by("meta", "order").alias("meta"))
    labels = [F.col(f"meta.{c}") for c in LABEL_COLUMNS if c in metadata.columns]
    return records.join(best, "record_id", "left").withColumn("label", F.coalesce(F.col("label"), *labels))


def interval_overlap(pieces: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds is_anomalous: whether [start, end) of a piece meets an interval of its record, touching ends apart."""
    hit = (
        pieces.join(intervals.withColumnsRenamed({"start": "_s", "end": "_e"}), "record_id")
        .where((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")))
        .select("record_id", "start", "end")
        .distinct()
        .withColumn("is_anomalous", F.lit(True))
    )
    return pieces.join(hit, ["record_id", "start", "end"], "left").withColumn("is_anomalous", F.coalesce("is_anomalous", F.lit(False)))


def consensus(scores: dict[str, DataFrame], top: int = 20) -> DataFrame:
    """Per row_index: each detector's min-max normalised score, their mean, and the top-``top`` votes."""
    stacked = reduce(
        DataFrame.unionByName,
        [s.select("row_index", F.lit(m).alias("method"), F.col("anomaly_score").cast("double").alias("score")) for m, s in sorted(scores.items())],
    )
    ends = stacked.groupBy("method").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = stacked.join(F.broadcast(ends), "method").withColumn(
        "scaled", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    )
    # the top of each method without ranking all of its rows
    best = [s.orderBy(F.desc("anomaly_score"), "row_index").limit(top).select("row_index", F.lit(m).alias("method"), F.lit(1).cast("long").alias("vote")) for m, s in sorted(scores.items())]
    voted = scaled.join(reduce(DataFrame.unionByName, best), ["row_index", "method"], "left").withColumn("vote", F.coalesce("vote", F.lit(0).cast("long")))
    wide = [F.max(F.when(F.col("method") == m, F.col("scaled"))).alias(f"{m}_score") for m in sorted(scores)]
    return voted.groupBy("row_index").agg(*wide, F.avg("scaled").alias("consensus_score"), F.sum("vote").alias("votes"))


def label_means(table: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    return table.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def value_counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def histogram(table: DataFrame, column: str, by: str | None = None, bins: int | None = None) -> DataFrame:
    """Counts in equal bins over the column's range; the top bin is closed.  bins: min(20, max(5, n))."""
    ends = table.where(F.col(column).isNotNull()).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    count = bins or min(20, max(5, ends["n"]))
    low, high = float(ends["lo"] or 0.0), float(ends["hi"] or 0.0)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / count
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(count - 1)).cast("long")
    keys = [by] if by else []
    return table.where(F.col(column).isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bin_start", F.lit(low) + F.col("bin") * F.lit(width)
    )


def argmax_record(table: DataFrame, column: str) -> DataFrame:
    """The first record with the column's largest value."""
    best = F.max(F.struct(F.col(column).alias("v"), (-F.col("record_id")).alias("k"), F.col("record_id").alias("record_id")))
    return table.where(F.col(column).isNotNull()).agg(best.alias("x")).select(F.lit(column).alias("feature"), F.col("x.record_id").alias("record_id"), F.col("x.v").alias("value"))
