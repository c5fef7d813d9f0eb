"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors of one label are dealt into shards of bounded size; each shard gets a layered
graph (Malkov and Yashunin).  Vectors are inserted batch by batch: a batch searches the
graph as it stands, every vector is linked to diverse ones of those that its search
met, and these link back.  Every vector of the label queries every shard: it descends
the layers greedily and walks the lowest one with a beam.  Where a beam holds nothing
but hits, the hits' neighbours are followed until they give no more.  Brute force audits
a sample of every block of queries, and the beam is doubled until the audit is content.
Cosines are then computed in double precision.  Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.workspace import Workspace, components, hot_join

COSINE = 0.93
SHARD = 8192  # vectors of a graph at most, about
BLOCK = 16_384  # queries of a task's block at most, about
LINKS = 8  # of a vector to others on upper layers, and as many back; twice as many on the lowest
POOL = 24  # nearest vectors met that links are chosen from
BUILD_BEAM = 32
BEAM = 32
BATCH = 512
AUDIT = 128  # queries of a block that are audited by brute force
AUDIT_RECALL = 0.99  # share of the planted partners that must be found; of the sampled queries' own all must be
SLACK = 1e-5  # of single precision, which leads the walks


class Graph:
    """A navigable small-world graph over unit vectors; layers are nested."""

    def __init__(self, unit: np.ndarray, seed: int = 0):
        n = len(unit)
        self.unit = unit
        self.coarse = unit.astype(np.float32)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(2 * LINKS)).astype(np.int64), 6)
        self.layers: list[np.ndarray] = []  # from the top: neighbours by vector (-1: none), own links first, links back behind
        self.entry = int(np.argmax(level)) if n else -1
        for depth in range(int(level.max()) if n else -1, -1, -1):
            nodes = np.flatnonzero(level >= depth)
            nodes = np.concatenate([[self.entry], rng.permutation(nodes[nodes != self.entry])])
            self.layers.append(self._insert(nodes, 2 * LINKS if depth == 0 else LINKS))

    def _insert(self, nodes: np.ndarray, most: int) -> np.ndarray:
        table = np.full((len(self.unit), 2 * most), -1, np.int32)
        done = 1
        while done < len(nodes):
            batch = nodes[done : done + min(BATCH, done)]  # no more than the graph has to be searched
            met, score = self._walk(table, self.coarse[batch], self._descend(self.coarse[batch]), BUILD_BEAM)
            among = self.coarse[batch] @ self.coarse[batch].T
            np.fill_diagonal(among, -np.inf)
            near = np.argsort(-among, axis=1, kind="stable")[:, :POOL]
            met = np.concatenate([met, batch[near]], axis=1)
            score = np.concatenate([score, np.take_along_axis(among, near, 1)], axis=1)
            score[met < 0] = -np.inf
            chosen, value = self._diverse(met, score, most)
            table[batch, :most] = chosen
            self._link_back(table, batch, chosen, value, most)
            done += len(batch)
        return table

    def _diverse(self, ids: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates those that are nearer to it than to any chosen before, then the nearest others."""
        order = np.argsort(-score, axis=1, kind="stable")[:, :POOL]
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        valid = score > -np.inf
        v = self.coarse[np.maximum(ids, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        open_, kept = valid.copy(), np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            take = open_[:, j]
            kept[:, j] = take
            open_ &= ~take[:, None] | (among[:, j] < score)
        rank = np.where(kept, 0, 1) * POOL + np.arange(ids.shape[1])[None, :] + np.where(valid, 0, 4 * POOL)
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        fits = np.take_along_axis(valid, first, 1)
        chosen = np.where(fits, np.take_along_axis(ids, first, 1), -1)
        value = np.where(fits, np.take_along_axis(score, first, 1), -np.inf)
        if chosen.shape[1] < most:
            pad = ((0, 0), (0, most - chosen.shape[1]))
            chosen, value = np.pad(chosen, pad, constant_values=-1), np.pad(value, pad, constant_values=-np.inf)
        return chosen, value

    def _link_back(self, table: np.ndarray, batch: np.ndarray, chosen: np.ndarray, value: np.ndarray, most: int) -> None:
        ok = chosen >= 0
        target, source, score = chosen[ok], np.repeat(batch, ok.sum(axis=1)), value[ok]
        order = np.lexsort((source, -score, target))
        target, source, score = target[order], source[order], score[order]
        own, head = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(head, np.diff(np.append(head, len(target))))
        few = place < POOL  # the nearest of a batch that link to one vector
        row = np.searchsorted(own, target)
        ids = np.full((len(own), most + POOL), -1, np.int64)
        near = np.full(ids.shape, -np.inf, np.float32)
        ids[:, :most] = table[own, most:]
        near[:, :most] = np.where(ids[:, :most] >= 0, np.einsum("ij,ikj->ik", self.coarse[own], self.coarse[np.maximum(ids[:, :most], 0)]), -np.inf)
        ids[row[few], most + place[few]] = source[few]
        near[row[few], most + place[few]] = score[few]
        near[(ids[:, :, None] == table[own, None, :most]).any(axis=2)] = -np.inf  # a link is one way or the other
        table[own, most:] = self._diverse(ids, near, most)[0]

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Where each query's greedy walk through the layers built so far, but for the lowest, ends."""
        at, rows = np.full(len(queries), self.entry), np.arange(len(queries))
        best = np.einsum("ij,ij->i", queries, self.coarse[at])
        for table in self.layers[: 7 if self.depth is None else self.depth]:
            while True:
                near = table[at]
                score = np.where(near >= 0, np.einsum("ij,ikj->ik", queries, self.coarse[near]), -np.inf)
                top = score.argmax(axis=1)
                better = score[rows, top] > best
                if not better.any():
                    break
                at = np.where(better, near[rows, top], at)
                best = np.where(better, score[rows, top], best)
        return at

    depth: int | None = None  # layers to descend through; all, while the graph is built

    def _walk(self, table: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, cosines) in each query's beam, all queries in step: each opens its best closed vector until it holds none."""
        n, count = len(self.unit), len(queries)
        beam = min(beam, n)
        ids = np.full((count, beam), -1, np.int64)
        score = np.full((count, beam), -np.inf, np.float32)
        closed = np.zeros((count, beam), bool)
        seen = np.zeros((count, n), bool)
        ids[:, 0], score[:, 0], closed[:, 0] = start, np.einsum("ij,ij->i", queries, self.coarse[start]), True
        seen[np.arange(count), start] = True
        live = np.arange(count)
        while len(live):
            waiting = np.where(closed[live], score[live], -np.inf)
            top = waiting.argmax(axis=1)
            go = waiting[np.arange(len(live)), top] > -np.inf
            live, top = live[go], top[go]
            if not len(live):
                break
            closed[live, top] = False
            near = table[ids[live, top]]
            new = (near >= 0) & ~seen[live[:, None], near]
            value = np.where(new, np.einsum("ij,ikj->ik", queries[live], self.coarse[near]), np.float32(-np.inf))
            row = np.repeat(live, near.shape[1]).reshape(near.shape)
            seen[row[new], near[new]] = True
            all_score = np.concatenate([score[live], value], axis=1)
            keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            score[live] = np.take_along_axis(all_score, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1)
            closed[live] = np.take_along_axis(np.concatenate([closed[live], new], axis=1), keep, 1)
        return np.where(score > -np.inf, ids, -1), score

    def search(self, queries: np.ndarray, beam: int, threshold: float) -> tuple[list[np.ndarray], np.ndarray]:
        """(for each query the vectors met with a cosine of at least ``threshold``, its beam)."""
        queries, low = queries.astype(np.float32), threshold - SLACK
        self.depth = len(self.layers) - 1
        ids, score = self._walk(self.layers[-1], queries, self._descend(queries), beam)
        hit = score >= low
        out = [ids[i][hit[i]] for i in range(len(queries))]
        full = np.flatnonzero(hit.all(axis=1))
        if len(full):
            for i, found in zip(full.tolist(), self._follow(queries[full], [out[i] for i in full.tolist()], low)):
                out[i] = found
        return out, ids

    def _follow(self, queries: np.ndarray, hits: list[np.ndarray], low: float) -> list[np.ndarray]:
        """All that the neighbours of hits lead to, for queries that share what they meet."""
        table, seen = self.layers[-1], np.zeros(len(self.unit) + 1, bool)
        met = np.unique(np.concatenate(hits))
        found: list[list[np.ndarray]] = [[] for _ in hits]
        while len(met):
            seen[met] = True
            good = queries @ self.coarse[met].T >= low
            for i in range(len(found)):
                found[i].append(met[good[i]])
            met = np.unique(table[met[good.any(axis=0)]])
            met = met[(met >= 0) & ~seen[met]]
        return [np.concatenate(f) for f in found]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is scaled to 1 first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def audited(graph: Graph, queries: np.ndarray, threshold: float, seed: int = 0) -> list[np.ndarray]:
    """Search results after the beam has been widened until a brute-force audit is content.

    The audit asks for a sample of the queries, whose partners must all be found, and for
    vectors made to lie just above the threshold from a sample of the shard's, so that
    there is evidence where queries have no partner.
    """
    margin, rng = threshold - 1e-9, np.random.default_rng(seed)
    chosen = queries[rng.permutation(len(queries))[:AUDIT]]
    planted = graph.unit[rng.permutation(len(graph.unit))[:AUDIT]]
    away = rng.normal(size=planted.shape)
    away -= (away * planted).sum(axis=1, keepdims=True) * planted
    length = np.linalg.norm(away, axis=1, keepdims=True)
    t = min(threshold + 0.1 * (1 - threshold), 1.0)
    planted = np.where(length > 1e-9, t * planted + (1 - t * t) ** 0.5 * away / np.maximum(length, 1e-9), planted)
    asked = np.concatenate([chosen, planted])
    truth = [np.flatnonzero(c >= margin) for c in asked @ graph.unit.T]
    beam = BEAM
    while beam < len(graph.unit):
        found, _ = graph.search(asked, beam, margin)
        lost = [int((~np.isin(w, f)).sum()) for w, f in zip(truth, found)]
        if not sum(lost[: len(chosen)]) and sum(lost) <= (1 - AUDIT_RECALL) * sum(map(len, truth[len(chosen) :])):
            break
        beam *= 2
    out: list[np.ndarray] = []
    for a in range(0, len(queries), 256):
        out += map(np.unique, graph.search(queries[a : a + 256], beam, margin)[0])
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _build_shard(table: pa.Table) -> pa.Table:
    import pickle

    graph = Graph(_unit(_matrix(table["embedding"])))
    packed = pickle.dumps((graph.unit, graph.layers, graph.entry), protocol=5)
    return pa.table(
        {
            "space": table["space"].slice(0, 1),
            "shard": table["shard"].slice(0, 1),
            "graph": pa.array([packed], pa.binary()),
            "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
            "copies": pa.array([table["copies"].to_pylist()], pa.list_(pa.int64())),
        }
    )


def _query_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (graph, ids, copies, query ids, query vectors, threshold) to counts and a forest of links."""
    import pickle

    for batch in batches:
        for i in range(batch.num_rows):
            graph = Graph.__new__(Graph)
            graph.unit, graph.layers, graph.entry = pickle.loads(batch.column("graph")[i].as_py())
            graph.depth = len(graph.layers) - 1
            graph.coarse = graph.unit.astype(np.float32)
            ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
            copies = batch.column("copies")[i].values.to_numpy(zero_copy_only=False)
            own = batch.column("query_ids")[i].values.to_numpy(zero_copy_only=False)
            queries = _unit(batch.column("vectors")[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1))
            cut = batch.column("threshold")[i].as_py()
            counts = np.zeros(len(own), np.int64)
            parent = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            src, dst = [], []
            for q, found in enumerate(audited(graph, queries, cut)):
                found = found[graph.unit[found] @ queries[q] >= cut]
                found = found[ids[found] != own[q]]
                counts[q] = copies[found].sum()
                for other in ids[found].tolist():
                    a, b = root(int(own[q])), root(other)
                    if a != b:
                        parent[a] = b
                        src.append(int(own[q]))
                        dst.append(other)
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, np.array(src, np.int64)])),
                    pa.array(np.concatenate([counts, np.zeros(len(src), np.int64)])),
                    pa.array([None] * n + dst, pa.int64()),
                ],
                ["id", "n", "other"],
            )


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Links among ``vectors(vec_id, embedding, label)`` of one label, one result row for each row.

    Returns vec_id, n_links (rows linked directly), component_id (the smallest
    vec_id reachable over links, itself included) and kept (whether that is its
    own).  A null label, a null or empty vector, one with null, NaN or infinite
    components and the zero vector link with nothing; vectors of different lengths
    never link.  Repeated rows are linked with one another; a null vec_id has no
    links and is kept.  Other columns are ignored; an empty table gives an empty one.
    """
    work = Workspace(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))  # zeros of either sign are one
    named = rows.select("vec_id", "label", "embedding", "usable", *[F.xxhash64(F.lit(k), "label", plain).alias(f"c{k}") for k in (1, 2)])
    named = work.save(named, "rows")
    classes = named.where("usable").groupBy("c1", "c2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label")
    )
    space = F.concat_ws("/", F.col("label"), F.size("embedding").cast("string"))
    classes = work.save(classes.withColumn("space", space), "classes")
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    dealt = classes.join(sizes, "space").withColumn("shard", F.pmod("c1", F.ceil(F.col("n") / SHARD))).withColumn(
        "block", F.pmod("c2", F.ceil(F.col("n") / BLOCK))
    )
    graphs = work.save(
        dealt.select("space", "shard", "id", "copies", "embedding")
        .groupBy("space", "shard")
        .applyInArrow(_build_shard, "space string, shard long, graph binary, ids array<long>, copies array<long>"),
        "graphs",
    )
    blocks = dealt.groupBy("space", "block").agg(F.collect_list(F.struct("id", "embedding")).alias("q")).select(
        "space",
        "block",
        F.transform("q", lambda x: x["id"]).alias("query_ids"),
        F.flatten(F.transform("q", lambda x: x["embedding"])).alias("vectors"),
        F.lit(float(threshold)).alias("threshold"),
    )
    # each pair of a block and a shard of one label is a task of its own
    pairs = graphs.join(blocks, "space").repartition("space", "shard", "block")
    found = work.save(
        pairs.select("graph", "ids", "copies", "query_ids", "vectors", "threshold").mapInArrow(_query_shards, "id long, n long, other long"), "links"
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    # a doc with several classes (a repeated vec_id) joins them by its id
    groups = components(work, found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    out = classes.select("c1", "c2", "id", "copies").join(counts, "id", "left").join(groups, "id", "left")
    out = out.select("c1", "c2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), "copies")
    out = work.save(out, "found")
    whole = named.where("usable").select("vec_id", "c1", "c2")
    joined = hot_join(whole, out, ["c1", "c2"], "copies", whole.count()).select("vec_id", "n_links", "component_id")
    alone = named.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
