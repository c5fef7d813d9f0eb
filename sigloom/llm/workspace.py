"""Work tables of the corpus operators, joins with frequent keys, reserved names and row keys."""

from __future__ import annotations

import gc

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.workspace import HOT, Workspace, close_all, components, shared_root

__all__ = ["HOT", "Workspace", "close_all", "components", "fresh", "hot_join", "keyed_rows", "shared_root", "tidy"]
WHOLE = ("bigint", "int", "smallint", "tinyint")


def tidy() -> None:
    """Let go of plans that nothing refers to any more, so that Spark removes their shuffle files.

    Spark learns of it from its own collector only; without this the files of all
    finished steps stay on the executors' disks.
    """
    gc.collect()
    context = SparkContext._active_spark_context
    if context is not None:
        context._jvm.System.gc()


def fresh(columns: list[str], base: str) -> str:
    """``base`` or, where a column of that name exists (in any case), ``base`` with underscores before it."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` on columns unique there, where ``weight`` of ``table`` says
    how many rows meet each of its rows.

    What meets more than a HOT-th of ``total`` rows, at most HOT rows of the table, is
    broadcast, so that one frequent key's rows do not meet in one task.
    """
    often = F.col(weight) * HOT > F.lit(total)
    hot = F.broadcast(table.where(often).drop(weight))
    rest = rows.join(hot, on, "left_anti").join(table.where(~often).drop(weight), on)
    return rows.join(hot, on).unionByName(rest)


def keyed_rows(docs: DataFrame, work: Workspace, id_column: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with one key for each row, and the key's name: the id where ids are whole numbers,
    unique and not null, else a number given once, in a table that is written for it."""
    name = fresh(docs.columns, "row_key")
    if dict(docs.dtypes)[id_column] in WHOLE:
        seen = docs.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").__gt__(1) | F.col(id_column).isNull())
        if seen.isEmpty():
            return docs.withColumn(name, F.col(id_column).cast("long")), name
    return work.save(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
