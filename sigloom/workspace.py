"""Shared-storage work tables and distributed connected components.

Every intermediate that cuts lineage is a Parquet table below the folder that
``spark.checkpoint.dir`` names, so any executor can be lost and any other can
read it.  Only a local session that does not set it (tests) uses a local folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import ship

_LOCAL: dict[str, str] = {}
_OPEN: list[Workspace] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOT = 1024  # a vertex with more than this part of all edge ends is joined by broadcast, so at most as many
FEW = 1 << 21  # edges up to which one task finds the components: some 32 MB, which rounds of shuffles would outlast
ORDERED = ("bigint", "int", "smallint", "tinyint", "string")  # that Arrow orders as Spark does


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="sigloom-")
    return "file://" + _LOCAL["root"]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Named work tables of one operator call, removed when no result needs them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = ship(spark)
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        _OPEN.append(self)

    def path(self, name: str) -> str:
        """A path of this workspace that nothing has used yet."""
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back: a cut in the lineage.

        The shuffles of the write go as it ends, not when Spark's collector comes by.
        """
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove work tables that nothing reads any more."""
        for table in tables:
            path = getattr(table, "_work_path", None)
            if path:
                delete_path(self.spark, path)

    def close(self) -> None:
        """Remove every table of this workspace; results that read them end with it."""
        delete_path(self.spark, self.root)
        if self in _OPEN:
            _OPEN.remove(self)


def close_all() -> None:
    """Remove the work tables of all finished calls; runs at interpreter exit too."""
    for work in list(_OPEN):
        try:
            work.close()
        except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
            _OPEN.remove(work)


atexit.register(close_all)


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``.

    Returns ``(id, component_id)`` for every vertex of an edge, where
    ``component_id`` is the smallest vertex reachable.  Up to FEW different edges meet in
    one task; more are contracted by alternating stars.  Each round of these is two
    aggregations with map-side combine and two joins; the few vertices that hold
    more than a HOT-th of all edge ends are joined by broadcast, so that a hub's
    edges never meet in one task.  Null ends and loops are ignored.  An empty
    input gives no rows.
    """
    cur = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    # written as they come: one task needs no shuffle for them
    cur = work.save(cur, "cc")
    kind = dict(cur.dtypes)["u"]
    if kind in ORDERED and cur.count() <= FEW:
        return work.save(cur.coalesce(1).mapInArrow(_labelled, f"id {kind}, component_id {kind}"), "cc-few")
    raw, cur = cur, work.save(cur.distinct(), "cc")
    work.drop(raw)
    if kind in ORDERED and cur.count() <= FEW:
        return work.save(cur.coalesce(1).mapInArrow(_labelled, f"id {kind}, component_id {kind}"), "cc-few")
    seen = _digest(cur)
    while seen[0]:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("ends")).select("u", F.least("u", "m").alias("m"), "ends")
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        large = _beside(both.where("v > u"), low, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.save(large, "cc-large")
        # small star: the smaller neighbours of u and u itself point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("ends"))
        small = (
            _beside(large, least, 2 * seen[0])
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = work.save(small, "cc-small")
        before, seen = seen, _digest(new)
        work.drop(cur, large)
        cur = new
        if seen == before:
            break
    roots = cur.groupBy("v").agg(F.first("v").alias("r")).select(F.col("v").alias("id"), F.col("r").alias("component_id"))
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component_id) of all vertices of the edges (u, v) in ``batches``."""
    edges = list(batches)
    if not edges:
        return
    kind = edges[0].schema.field(0).type
    ends = pa.chunked_array([b.column(c) for c in range(2) for b in edges])
    # in one piece: dictionaries of many pieces take longer to unify than all the rest
    ends = pa.concat_arrays((ends.cast(pa.large_string()) if pa.types.is_string(kind) else ends).chunks).dictionary_encode()
    ids = ends.dictionary
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.arange(len(ids), dtype=np.int32)
    place = rank[ends.indices.to_numpy()]
    ids, root = ids.take(pa.array(order)), roots(len(ids), *np.split(place, 2))
    least = ids.take(pa.array(root))
    for at in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([x.slice(at, 1 << 16).cast(kind) for x in (ids, least)], ["id", "component_id"])


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least vertex below ``n`` that edges (u, v) reach from each."""
    root = np.arange(n, dtype=np.int32)
    while len(u):
        # both ends' roots point to the lesser one, then all vertices to their root
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def _beside(edges: DataFrame, low: DataFrame, ends: int) -> DataFrame:
    """``edges(u, v)`` with the ``m`` that ``low(u, m, ends)`` has for u."""
    hot = low.where(F.col("ends") * HOT > F.lit(ends)).select("u", F.col("m").alias("hot"))
    marked = edges.join(F.broadcast(hot), "u", "left")
    cold = marked.where("hot is null").select("u", "v").join(low.select("u", "m"), "u")
    return marked.where("hot is not null").select("u", "v", F.col("hot").alias("m")).unionByName(cold)


def _digest(df: DataFrame) -> tuple:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return (row["n"], row["h"], row["s"])
