"""Neighbour-based detectors: local outlier factor, density clusters, k-radius.

Neighbours are exact at every size.  Rows with equal features are one point with a
number of copies.  A k-d tree over a sample of the points cuts the space into leaves;
the sample decides only how evenly they are filled.  A point first meets its own leaf,
which bounds how far its neighbours can be, and then just the leaves that lie within
that bound.  Leaves with many visitors are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import detectors as D
from sigloom.workspace import Workspace, components

LEAF = 1024  # points of a leaf, about
LEAVES = 8192  # leaves at most; beyond, they hold more points
TREE_SAMPLE = 65_536  # points that the tree is built from at most
VISITORS = 16_384  # points that ask a leaf in one task, about
BLOCK = 256
MARGIN = 1.0 + 1e-9  # for bounds, against rounding


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, without the cancellation of the expanded square."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j : j + 1] - b[None, :, j]) ** 2
    return np.sqrt(out)


class Tree:
    """Half-space cuts at medians until a leaf holds few points; leaves tile the whole space."""

    def __init__(self, points: np.ndarray, leaves: int):
        width = points.shape[1]
        self.dim, self.cut, self.left, self.right = [-1], [0.0], [-1], [-1]
        boxes = {0: (np.full(width, -np.inf), np.full(width, np.inf))}
        open_ = [(len(points), 0, points)]
        while open_ and len(boxes) < leaves:
            open_.sort(key=lambda x: x[0])
            _, at, own = open_.pop()
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(width)
            d = int(spread.argmax())
            if not spread[d] > 0:
                continue
            values = np.sort(own[:, d])
            cut = float(values[len(values) // 2])
            if cut == values[0]:
                cut = float(values[np.searchsorted(values, cut, "right")])
            low, high = boxes.pop(at)
            self.dim[at], self.cut[at] = d, cut
            for side, part in (("left", own[own[:, d] < cut]), ("right", own[own[:, d] >= cut])):
                new = len(self.dim)
                getattr(self, side)[at] = new
                for column, value in ((self.dim, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1)):
                    column.append(value)
                a, b = low.copy(), high.copy()
                (b if side == "left" else a)[d] = cut
                boxes[new] = (a, b)
                open_.append((len(part), new, part))
        self.dim, self.cut, self.left, self.right = (np.array(c) for c in (self.dim, self.cut, self.left, self.right))
        names = sorted(boxes)
        self.leaf = np.full(len(self.dim), -1, np.int64)
        self.leaf[names] = np.arange(len(names))
        self.low = np.stack([boxes[k][0] for k in names])
        self.high = np.stack([boxes[k][1] for k in names])

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            at[inner] = np.where(x[inner, self.dim[node]] < self.cut[node], self.left[node], self.right[node])

    def reach(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that hold points within ``radius`` of the rows."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(x), BLOCK):
            part, square = x[a : a + BLOCK], np.zeros((min(BLOCK, len(x) - a), len(self.low)))
            for j in range(x.shape[1]):
                square += np.maximum(np.maximum(self.low[None, :, j] - part[:, j : j + 1], part[:, j : j + 1] - self.high[None, :, j]), 0.0) ** 2
            r, leaf = np.nonzero(np.sqrt(square) <= radius[a : a + BLOCK, None] * MARGIN)
            rows.append(r + a)
            leaves.append(leaf)
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Space:
    """The standardised points of a feature matrix: ``points(id, copies, z, leaf)`` and ``rows(row_index, ..., id)``."""

    def __init__(self, matrix: DataFrame, names: list[str]):
        self.n, mean, cov = D._moments(matrix, names)
        if self.n < 2:
            raise ValueError("Neighbours need two rows or more.")
        self.names, self.work = names, Workspace(matrix.sparkSession, "neighbours")
        sd = D._standard(self.n, cov)
        z = F.array(*[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) + F.lit(0.0) for c, m, s in zip(names, mean, sd)])
        rows = matrix.withColumn("z", z)
        points = self.work.save(rows.groupBy("z").agg(F.min("row_index").cast("long").alias("id"), F.count(F.lit(1)).alias("copies")), "points")
        carry = [c for c in matrix.columns if c not in names]
        self.rows = self.work.save(rows.join(points.select("z", "id"), "z").select(*carry, "id"), "rows")
        count = points.count()
        sample = points.select("id", "z").orderBy(F.xxhash64("id"), "id").limit(TREE_SAMPLE).collect()
        self.tree = Tree(np.array([r["z"] for r in sorted(sample, key=lambda r: r["id"])], np.float64), min(LEAVES, -(-count // LEAF)))
        self.points = self.work.save(self.placed(points), "placed")

    def placed(self, points: DataFrame) -> DataFrame:
        """``points`` with the leaf that each lies in."""
        tree = points.sparkSession.sparkContext.broadcast(self.tree)
        at = points.columns.index("z")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.value.assign(_matrix(batch.column(at))) if batch.num_rows else np.zeros(0, np.int64)
                yield batch.append_column("leaf", pa.array(leaf, pa.int64()))

        schema = ", ".join(f"`{c}` {k}" for c, k in points.dtypes)
        return points.mapInArrow(run, f"{schema}, leaf long")

    def reached(self, points: DataFrame, radius: Column) -> DataFrame:
        """``points`` once for each leaf within ``radius`` of them."""
        tree = points.sparkSession.sparkContext.broadcast(self.tree)
        at = points.columns.index("z")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                radius = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                for a in range(0, batch.num_rows, 4 * BLOCK):
                    part = batch.slice(a, 4 * BLOCK)
                    row, leaf = tree.value.reach(_matrix(part.column(at)), radius[a : a + 4 * BLOCK])
                    yield part.drop_columns(["_radius"]).take(pa.array(row)).append_column("leaf", pa.array(leaf))

        kept = points.drop("leaf")
        schema = ", ".join(f"`{c}` {k}" for c, k in kept.dtypes)
        return kept.withColumn("_radius", radius.cast("double")).mapInArrow(run, f"{schema}, leaf long")

    def meet(self, visitors: DataFrame, points: DataFrame, compare: Callable, schema: str) -> DataFrame:
        """``compare(visitors, points) -> table`` for the visitors and points of each leaf."""
        visitors = self.work.save(visitors, "visitors")
        parts = visitors.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
        asking = visitors.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        asked = points.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
        return asking.groupBy("leaf", "part").cogroup(asked.groupBy("leaf", "part")).applyInArrow(lambda a, b: compare(a, b), schema)


NEAR = "id long, near array<struct<d:double,id:long,copies:long>>"


def _nearest_in_leaf(k: int) -> Callable:
    def compare(visitors: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("id")
        kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("copies", pa.int64())]))
        if not visitors.num_rows or not points.num_rows:
            return pa.table({"id": visitors["id"], "near": pa.array([[]] * visitors.num_rows, kind)})
        ask, z, own = visitors["id"].to_numpy(), _matrix(visitors["z"]), _matrix(points["z"])
        ids, copies = points["id"].to_numpy(), points["copies"].to_numpy()
        most, sizes, flat = min(k + 1, len(ids)), [], []
        for a in range(0, len(ask), BLOCK):
            d = _distances(z[a : a + BLOCK], own)
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            far = np.take_along_axis(d, order, 1)
            weight = copies[order] - (ids[order] == ask[a : a + BLOCK, None])  # a row is not its own neighbour
            keep = (weight > 0) & (np.cumsum(weight, axis=1) - weight < k)
            sizes.append(keep.sum(axis=1))
            flat.append((far[keep], ids[order][keep], weight[keep]))
        far, found, weight = (np.concatenate(c) for c in zip(*flat))
        cells = pa.StructArray.from_arrays([pa.array(far), pa.array(found), pa.array(weight)], ["d", "id", "copies"])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.table({"id": visitors["id"], "near": pa.ListArray.from_arrays(pa.array(ends), cells).cast(kind)})

    return compare


def _first(near: Column, k: int) -> Column:
    """The nearest of ``near`` until they are k rows; the last gives only what is missing."""
    ordered = F.array_sort(near)
    before = lambda i: F.aggregate(F.slice(ordered, 1, i), F.lit(0).cast("long"), lambda s, y: s + y["copies"])
    cut = F.transform(
        ordered,
        lambda x, i: F.struct(x["d"].alias("d"), x["id"].alias("id"), F.least(x["copies"], F.lit(k) - before(i)).cast("long").alias("copies")),
    )
    return F.filter(cut, lambda x: x["copies"] > 0)


def nearest(space: Space, k: int) -> DataFrame:
    """(id, near): each point's k nearest other rows by distance and id, as (d, id, copies)."""
    own = space.meet(space.points.select("id", "z", "leaf"), space.points, _nearest_in_leaf(k), NEAR)
    own = space.work.save(own.select("id", _first(F.col("near"), k).alias("near")), "own-leaf")
    count = F.aggregate("near", F.lit(0).cast("long"), lambda s, y: s + y["copies"])
    bound = F.when(count >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
    asking = space.points.select("id", "z", F.col("leaf").alias("home")).join(own.select("id", bound.alias("bound")), "id")
    others = space.reached(asking, F.col("bound")).where("leaf <> home").select("id", "z", "leaf")
    found = space.meet(others, space.points, _nearest_in_leaf(k), NEAR)
    both = own.unionByName(found).groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    return space.work.save(both.select("id", _first(F.col("near"), k).alias("near")), "nearest")


def _scored(space: Space, scores: DataFrame) -> DataFrame:
    """The rows with what ``scores(id, ...)`` says of their point."""
    return space.rows.join(scores, "id").drop("id")


def local_outlier_factor(table: DataFrame, n_neighbors: int = 20, contamination: float | str = "auto", columns: list[str] | None = None) -> DataFrame:
    """Standardised local outlier factor; predicted_anomaly -1 above 1.5 or the contamination's quantile.

    Exact over all rows; of neighbours at one distance the least row_index counts first.
    """
    if n_neighbors < 1:
        raise ValueError("n_neighbors must be 1 or more.")
    matrix, names = D.feature_matrix(table, columns)
    space = Space(matrix, names)
    k = min(n_neighbors, space.n - 1)
    near = nearest(space, k)
    radius = near.select("id", F.element_at("near", -1)["d"].alias("radius"))
    links = near.select("id", F.explode("near").alias("x")).select("id", F.col("x.id").alias("other"), F.col("x.d").alias("d"), F.col("x.copies").alias("w"))
    reach = links.join(radius.withColumnRenamed("id", "other"), "other").select("id", "other", "w", F.greatest("d", "radius").alias("reach"))
    density = reach.groupBy("id").agg((F.lit(1.0) / (F.sum(F.col("w") * F.col("reach")) / k + 1e-10)).alias("density"))
    density = space.work.save(density, "density")
    around = links.join(density.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other")
    around = around.groupBy("id").agg((F.sum(F.col("w") * F.col("theirs")) / k).alias("theirs"))
    scores = around.join(density, "id").select("id", (F.col("theirs") / F.col("density")).alias("anomaly_score"))
    scored = _scored(space, scores)
    cut = 1.5 if contamination == "auto" else scored.agg(F.percentile("anomaly_score", F.lit(1.0 - contamination))).first()[0]
    return scored.withColumn("predicted_anomaly", F.when(F.col("anomaly_score") > F.lit(float(cut)), F.lit(-1)).otherwise(F.lit(1)))


def knn_radius(table: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Standardised distance to the k-th nearest other row, exact over all rows."""
    matrix, names = D.feature_matrix(table, columns)
    space = Space(matrix, names)
    near = nearest(space, max(1, min(k, space.n - 1)))
    return _scored(space, near.select("id", F.element_at("near", -1)["d"].alias("anomaly_score")))


def _count_in_leaf(eps: float) -> Callable:
    def compare(visitors: pa.Table, points: pa.Table) -> pa.Table:
        z, own, copies = _matrix(visitors["z"]), _matrix(points["z"]), points["copies"].to_numpy()
        n = np.zeros(visitors.num_rows, np.int64)
        if len(copies):
            for a in range(0, len(z), BLOCK):
                n[a : a + BLOCK] = (_distances(z[a : a + BLOCK], own) <= eps) @ copies
        return pa.table({"id": visitors["id"], "n": pa.array(n)})

    return compare


def _join_in_leaf(eps: float) -> Callable:
    def compare(visitors: pa.Table, points: pa.Table) -> pa.Table:
        """A forest of the links between visitors and points."""
        ask, ids = visitors["id"].to_numpy(), points["id"].to_numpy()
        src, dst = [], []
        if len(ask) and len(ids):
            z, own = _matrix(visitors["z"]), _matrix(points["z"])
            group = np.arange(len(ids))
            for a in range(0, len(ask), BLOCK):
                for i, row in enumerate(_distances(z[a : a + BLOCK], own) <= eps):
                    met, first = np.unique(group[row], return_index=True)
                    if len(met):
                        src += [int(ask[a + i])] * len(met)
                        dst += ids[row][first].tolist()
                        if len(met) > 1:
                            group[np.isin(group, met)] = met[0]
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return compare


def _least_in_leaf(eps: float) -> Callable:
    def compare(visitors: pa.Table, points: pa.Table) -> pa.Table:
        """The least cluster among the points near each visitor."""
        least = np.full(visitors.num_rows, np.iinfo(np.int64).max)
        if visitors.num_rows and points.num_rows:
            z, own, cluster = _matrix(visitors["z"]), _matrix(points["z"]), points["cluster"].to_numpy()
            for a in range(0, len(z), BLOCK):
                near = _distances(z[a : a + BLOCK], own) <= eps
                least[a : a + BLOCK] = np.where(near, cluster[None, :], np.iinfo(np.int64).max).min(axis=1)
        found = least < np.iinfo(np.int64).max
        return pa.table({"id": visitors["id"].filter(pa.array(found)), "cluster": pa.array(least[found])})

    return compare


def clusters(space: Space, eps: float, least: int) -> DataFrame:
    """(id, cluster_label) of all points: density clusters (Ester et al.), -1 is noise.

    Clusters are numbered by their first core row; a border row belongs to the first
    cluster that reaches it.
    """
    asking = space.work.save(space.reached(space.points.select("id", "z"), F.lit(eps)), "asking")
    n = space.meet(asking, space.points, _count_in_leaf(eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core = space.work.save(n.where(F.col("n") >= least).select("id"), "core")
    inner = space.work.save(space.points.join(core, "id"), "core-points")
    links = space.meet(asking.join(core, "id"), inner, _join_in_leaf(eps), "src long, dst long")
    groups = components(space.work, space.work.save(links, "links"))
    named = core.join(groups, "id", "left").select("id", F.coalesce("component_id", "id").alias("cluster"))
    named = space.work.save(named, "clusters")
    border = space.meet(
        asking.join(core, "id", "left_anti"), inner.join(named, "id"), _least_in_leaf(eps), "id long, cluster long"
    ).groupBy("id").agg(F.min("cluster").alias("cluster"))
    labels = D.numbered(named.select("cluster").distinct(), F.asc("cluster")).select("cluster", (F.col("number") - 1).alias("cluster_label"))
    members = named.unionByName(border).join(labels, "cluster").select("id", "cluster_label")
    return space.work.save(space.points.select("id").join(members, "id", "left").select("id", F.coalesce("cluster_label", F.lit(-1).cast("long")).alias("cluster_label")), "labels")


def dbscan_scores(table: DataFrame, eps: float = 1.5, min_samples: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Distance to the nearest cluster, sparsity, neighbour radius and a boost for noise; adds cluster_label.

    Clusters and radii are exact over all rows.  Without any cluster the score is the radius.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps and min_samples must be above 0.")
    matrix, names = D.feature_matrix(table, columns)
    space = Space(matrix, names)
    near = nearest(space, min(max(min_samples - 1, 1), space.n - 1)).select("id", F.element_at("near", -1)["d"].alias("radius"))
    labelled = space.points.join(clusters(space, eps, min_samples), "id")
    means = [(F.sum(F.col("copies") * F.col("z")[j]) / F.sum("copies")).alias(f"c{j}") for j in range(len(names))]
    centres = labelled.where("cluster_label >= 0").groupBy("cluster_label").agg(F.sum("copies").alias("members"), *means)
    centres = space.work.save(
        centres.select("cluster_label", "members", F.col("cluster_label").alias("id"), F.lit(1).cast("long").alias("copies"), F.array(*[f"c{j}" for j in range(len(names))]).alias("z")), "centres"
    )
    if centres.isEmpty():
        return _scored(space, near.select("id", F.col("radius").alias("anomaly_score"), F.lit(-1).cast("long").alias("cluster_label")))
    away = _to_nearest(space, space.placed(centres.select("id", "copies", "z")))
    parts = labelled.select("id", "cluster_label").join(near, "id").join(away, "id").join(centres.select("cluster_label", "members"), "cluster_label", "left")
    parts = space.work.save(parts, "parts")
    far = float(parts.agg(F.max("away")).first()[0])
    noise = F.col("cluster_label") < 0
    score = F.col("away") + F.when(noise, 1.0).otherwise(F.lit(1.0) / F.col("members")) + F.col("radius") + F.when(noise, far + 1.0).otherwise(0.0)
    return _scored(space, parts.select("id", score.alias("anomaly_score"), "cluster_label"))


def _to_nearest(space: Space, centres: DataFrame) -> DataFrame:
    """(id, away): how far each point is from the nearest of ``centres(id, copies, z, leaf)``."""
    any_ = np.array(centres.select("z").first()["z"], np.float64)
    bound = F.sqrt(sum(((F.col("z")[j] - F.lit(float(c))) ** 2 for j, c in enumerate(any_)), F.lit(0.0)))
    # a centre in the point's own leaf bounds the distance, or else any centre
    asked = space.work.save(centres, "placed-centres")
    own = space.meet(space.points.select("id", "z", "leaf"), asked, _away_in_leaf, "id long, away double")
    asking = space.points.select("id", "z").join(own, "id").withColumn("bound", F.least("away", bound))
    asking = space.work.save(asking, "asking-centres")
    found = space.meet(space.reached(asking.select("id", "z", "bound"), F.col("bound")), asked, _away_in_leaf, "id long, away double")
    return found.groupBy("id").agg(F.min("away").alias("away"))


def _away_in_leaf(visitors: pa.Table, points: pa.Table) -> pa.Table:
    away = np.full(visitors.num_rows, np.inf)
    if visitors.num_rows and points.num_rows:
        z, own = _matrix(visitors["z"]), _matrix(points["z"])
        for a in range(0, len(z), BLOCK):
            away[a : a + BLOCK] = _distances(z[a : a + BLOCK], own).min(axis=1)
    return pa.table({"id": visitors["id"], "away": pa.array(away)})
