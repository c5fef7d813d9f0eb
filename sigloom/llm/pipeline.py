"""The corpus pipeline: quality, near-duplicates, substrings, benchmark, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.  All but the
last keep the columns of documents, whatever others there are, and an empty
table stays empty in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, mixing, near_dup, quality, substrings
from sigloom.llm.workspace import Workspace, fresh, quoted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; all columns stay.

    Each row is judged by its text alone: null ids, repeated ids and repeated rows
    too.  A null text counts as empty, and a score at the cut is kept.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each near-duplicate group; all rows without doc_id.

    Rows that share a doc_id are documents of their own here, in the order of their
    texts: they go only where their texts are linked, and of equal rows one stays.
    Texts that are null or without words are linked with nothing and stay.
    """
    columns = [quoted(c) for c in docs.columns]
    if not _repeats(docs):
        kept = near_dup.near_duplicates(docs).where("kept").select("doc_id").distinct()
        return docs.join(kept, "doc_id", "left_semi").select(*columns)
    # the row's number in the order of doc_id stands for it
    key = fresh(docs.columns, "row_key")
    named = docs.where("doc_id is not null").orderBy("doc_id", F.xxhash64("text"), F.xxhash64(*columns))
    rows = Workspace(spark, "pipeline-rows").save(named.withColumn(key, F.monotonically_increasing_id()), "rows")
    kept = near_dup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where("kept")
    chosen = rows.join(kept.select(F.col("doc_id").alias(key)), key, "left_semi")
    return chosen.select(*columns).unionByName(docs.where("doc_id is null"))


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id repeats or is null."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes and more that repeat; all rows stay.

    n_chars is recounted where the documents have it; a null text stays null and has 0.
    Equal rows are each the other's copy, whatever their ids.
    """
    out = substrings.remove(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[quoted(c) for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, each row judged by its own text; a null text stays."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, copies, taken.

    A null source is a source of its own; null texts have size 0; equal rows are told
    apart by their number among each other, which also decides between them.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("substrings", substring_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]
#: SQL can express neither the classifier nor the edit distances.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
