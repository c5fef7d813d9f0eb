"""Anomaly detectors on feature tables: ``table -> scored table``.

A table has a unique ``row_index``, feature columns and metadata.  Robust
statistics are exact over all rows.  A forest's trees see few rows each by
definition; only the one-class machine is fitted on a sample, and says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigloom.functions import exprs as X
from sigloom.session import ship

NOT_FEATURES = (
    "row_index row_pos record_id record_name label source_name source_path file_name condition target sampling_rate_hz n_samples "
    "duration_seconds window_index window_start_seconds window_end_seconds window_center_seconds window_n_samples frequency_window status"
).split()
METADATA = ("record_name", "label", "window_start_seconds", "window_end_seconds", "window_center_seconds")
NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")
FIT_ROWS = 20_000  # rows among which a start is searched for on the driver at most
STARTS = 60
TREES, TREE_ROWS = 100, 256  # an isolation forest's trees and the rows that each is grown from, by its definition


def numeric_features(table: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Feature columns: numeric, not metadata; names asked for must exist."""
    kinds = dict(table.dtypes)
    if columns is not None:
        missing = [c for c in columns if c not in kinds]
        if missing:
            raise ValueError(f"Missing feature columns: {missing}.")
    wanted = columns if columns is not None else [c for c in table.columns if c not in NOT_FEATURES]
    found = [c for c in wanted if kinds[c] in NUMBERS or kinds[c].startswith("decimal")]
    if not found:
        raise ValueError("No numeric feature columns were found.")
    return found


def feature_matrix(table: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Finite features, exact medians in place of missing ones; rows without any are dropped."""
    names = numeric_features(table, columns)
    finite = table.withColumns({c: X.finite_or_null(F.col(c).cast("double")) for c in names})
    stats = finite.agg(*[F.median(c).alias(c) for c in names]).first()
    names = [c for c in names if stats[c] is not None]
    if not names:
        raise ValueError("All feature columns are empty.")
    some = F.lit(False)
    for c in names:
        some = some | F.col(c).isNotNull()
    filled = finite.where(some).withColumns({c: F.coalesce(F.col(c), F.lit(float(stats[c]))) for c in names})
    return filled.select("row_index", *[m for m in METADATA if m in table.columns], *names), names


def rank_scores(scored: DataFrame) -> DataFrame:
    """Adds anomaly_rank: 1 for the highest score, ties by row_index."""
    return numbered(scored, F.desc("anomaly_score"), F.asc("row_index")).withColumnRenamed("number", "anomaly_rank")


def numbered(table: DataFrame, *order: Column) -> DataFrame:
    """Adds ``number``, 1 for the first row in ``order``, by range partitions with offsets, so that no task sees all rows."""
    ordered = table.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    inner = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ordered.withColumn("_in", inner).join(F.broadcast(offsets), "_part").withColumn(
        "number", (F.col("_in") + F.col("_before")).cast("long")
    ).drop("_part", "_in", "_before")


def top_anomalies(scored: DataFrame, n: int = 5) -> DataFrame:
    if n < 1:
        raise ValueError("n must be positive.")
    return scored.orderBy(F.desc("anomaly_score"), "row_index").limit(n)


def robust_z(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sum over features of max(0, .6745 (x - median) / MAD); a MAD of 0 adds nothing."""
    matrix, names = feature_matrix(table, columns)
    med = matrix.agg(*[F.median(c).alias(c) for c in names]).first()
    mad = matrix.agg(*[F.median(F.abs(F.col(c) - F.lit(float(med[c])))).alias(c) for c in names]).first()
    score: Column = F.lit(0.0)
    for c in names:
        if mad[c]:
            score = score + F.greatest(F.lit(0.0), F.lit(0.6745) * (F.col(c) - F.lit(float(med[c]))) / F.lit(float(mad[c])))
    return _scored(matrix, names, score)


def _scored(matrix: DataFrame, names: list[str], score: Column) -> DataFrame:
    return matrix.withColumn("anomaly_score", score.cast("double")).drop(*names)


def _moments(matrix: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariance) from one aggregation."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = matrix.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(names))]), cov


def _quadratic(names: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(names, mean)]
    total: Column = F.lit(0.0)
    for i in range(len(names)):
        for j in range(i, len(names)):
            weight = float(inverse[i, j] if i == j else inverse[i, j] + inverse[j, i])
            total = total + F.lit(weight) * d[i] * d[j]
    return total


def mahalanobis(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Squared distance from the mean under the pseudo-inverse of the sample covariance."""
    matrix, names = feature_matrix(table, columns)
    n, mean, cov = _moments(matrix, names)
    if n < 2:
        raise ValueError("At least two rows are needed.")
    return _scored(matrix, names, F.greatest(F.lit(0.0), _quadratic(names, mean, np.linalg.pinv(cov))))


def robust_mahalanobis(table: DataFrame, columns: list[str] | None = None, support_fraction: float | None = None, random_state: int = 0) -> DataFrame:
    """Squared distance under a minimum-covariance-determinant fit (FAST-MCD with reweighting).

    The search for a start runs on a bounded sample; the concentration steps, the
    consistency factors and the reweighting are over all rows.
    """
    matrix, names = feature_matrix(table, columns)
    p = len(names)
    n, _, cov = _moments(matrix, names)
    if n < 2 or np.linalg.matrix_rank(cov) < p:
        raise ValueError("The feature matrix does not have full rank.")
    if support_fraction is not None and not 0 < support_fraction <= 1:
        raise ValueError("support_fraction must lie above 0 and at most at 1.")
    h = min(n, int(np.ceil(support_fraction * n)) if support_fraction is not None else (n + p + 1) // 2)
    h = max(h, min(n, p + 1))
    mean, cov = _concentrated(matrix, names, *_mcd_start(_sample(matrix, names), h / n, random_state), h, n)
    if np.linalg.matrix_rank(cov) < p:
        raise ValueError("The robust covariance is singular.")
    return _scored(matrix, names, F.greatest(F.lit(0.0), _quadratic(names, mean, np.linalg.pinv(cov))))


def _sample(matrix: DataFrame, names: list[str], most: int = FIT_ROWS) -> np.ndarray:
    """All rows, or of more than ``most`` those with the least hash of row_index."""
    rows = matrix.select("row_index", *names).orderBy(F.xxhash64("row_index"), "row_index").limit(most).collect()
    rows.sort(key=lambda r: r["row_index"])
    return np.array([[r[c] for c in names] for r in rows], np.float64).reshape(len(rows), len(names))


def _mcd_start(x: np.ndarray, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the tightest ``share`` of the rows found from many small starts."""
    n, p = x.shape
    h = max(int(np.ceil(share * n - 1e-9)), min(n, p + 1))
    rng = np.random.default_rng(seed)

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
        keep = np.argsort(d, kind="stable")[:h]
        return x[keep].mean(axis=0), np.cov(x[keep].T, bias=True).reshape(p, p)

    tried = []
    for _ in range(STARTS):
        start = x[rng.choice(n, min(n, p + 1), replace=False)]
        mean, cov = start.mean(axis=0), np.cov(start.T, bias=True).reshape(p, p)
        for _ in range(2):
            mean, cov = step(mean, cov)
        tried.append((np.linalg.det(cov), len(tried), mean, cov))
    best = None
    for _, _, mean, cov in sorted(tried, key=lambda t: t[:2])[:8]:
        last = np.inf
        for _ in range(50):
            mean, cov = step(mean, cov)
            det = np.linalg.det(cov)
            if det >= last:
                break
            last = det
        if best is None or last < best[0]:
            best = (last, mean, cov)
    return best[1], best[2]


def _concentrated(matrix: DataFrame, names: list[str], mean: np.ndarray, cov: np.ndarray, h: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps to the h nearest of all rows until the determinant stands still, then the reweighted fit."""
    p, last = len(names), np.inf

    def distance(mean: np.ndarray, cov: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), _quadratic(names, mean, np.linalg.pinv(cov)))

    def fit(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        m, mean, cov = _moments(rows, names)
        return m, mean, cov * (m - 1) / m

    while True:
        d = distance(mean, cov)
        cut = matrix.agg(F.percentile(d, F.lit((h - 1) / max(n - 1, 1)))).first()[0]
        m, next_mean, next_cov = fit(matrix.where(d <= F.lit(float(cut) * (1 + 1e-12))))
        det = np.linalg.det(next_cov)
        if m < 2 or det >= last * (1 - 1e-12):
            break
        mean, cov, last = next_mean, next_cov, det
    d = distance(mean, cov)
    cov = cov * max(matrix.agg(F.median(d)).first()[0] / chi2_quantile(0.5, p), 1e-300)
    good = matrix.where(distance(mean, cov) < F.lit(chi2_quantile(0.975, p)))
    m, next_mean, next_cov = fit(good)
    if m > p:
        mean, cov = next_mean, next_cov
        cov = cov * max(good.agg(F.median(distance(mean, cov))).first()[0] / chi2_quantile(0.5, p), 1e-300)
    return mean, cov


def chi2_quantile(q: float, k: int) -> float:
    """Quantile of the chi-squared law by bisection on the regularised gamma series."""
    import math

    def cdf(v: float) -> float:
        if v <= 0:
            return 0.0
        a, z = k / 2, v / 2
        term = total = 1.0 / a
        i = 1
        while term > total * 1e-16 and i < 10000:
            term *= z / (a + i)
            total += term
            i += 1
        return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))

    low, high = 0.0, 10.0 * k + 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return (low + high) / 2


def _standard(n: int, cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(cov) * (n - 1) / n, 0))
    return np.where(sd == 0, 1.0, sd)


def pca_reconstruction(table: DataFrame, n_components: float | int = 0.95, columns: list[str] | None = None) -> DataFrame:
    """Mean squared residual of standardised rows behind the leading components."""
    if isinstance(n_components, int) and n_components <= 0 or isinstance(n_components, float) and not 0 < n_components < 1:
        raise ValueError("n_components must be a positive count or a share between 0 and 1.")
    matrix, names = feature_matrix(table, columns)
    n, mean, cov = _moments(matrix, names)
    if n < 2:
        raise ValueError("At least two rows are needed.")
    sd = _standard(n, cov)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    if isinstance(n_components, int):
        k = min(n_components, len(names), n)
    else:
        share = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones(len(values))
        k = int(np.searchsorted(share, n_components, "right")) + 1
        k = min(k, len(names))
    rest = np.eye(len(names)) - vectors[:, :k] @ vectors[:, :k].T
    z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(names, mean, sd)]
    total: Column = F.lit(0.0)
    for i in range(len(names)):
        part: Column = F.lit(0.0)
        for j in range(len(names)):
            part = part + F.lit(float(rest[i, j])) * z[j]
        total = total + part * part
    return _scored(matrix, names, total / F.lit(float(len(names))))


def _score_rows(matrix: DataFrame, names: list[str], score, extra: str = "") -> DataFrame:
    """Apply ``score(rows x features) -> dict of columns`` in Arrow batches."""
    spark = ship(matrix.sparkSession)
    sent = spark.sparkContext.broadcast(score)
    carry = [c for c in matrix.columns if c not in names]
    kinds = dict(matrix.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", anomaly_score double" + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            made = sent.value(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *[pa.array(v) for v in made.values()]], [*carry, *made])

    return matrix.select(*carry, *names).mapInArrow(run, schema)


class Forest:
    """Isolation trees, each grown from ``size`` rows (Liu, Ting and Zhou).

    ``x`` are all rows, or a random ``trees * size`` of them: then each tree has rows of its own.
    """

    def __init__(self, x: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(x))
        self.limit = int(np.ceil(np.log2(max(self.size, 2))))
        order = rng.permutation(len(x))
        enough = len(x) >= trees * size
        self.trees = [self._grow(x[order[t * size : (t + 1) * size] if enough else rng.choice(len(x), self.size, replace=False)], rng) for t in range(trees)]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, depth = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            at = len(feature)
            for column, value in zip((feature, cut, left, right, depth), (-1, 0.0, -1, -1, level + average_path(len(rows)))):
                column.append(value)
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if level < self.limit and len(spread):
                f = int(rng.choice(spread))
                c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                below = rows[:, f] <= c
                if below.any() and not below.all():
                    feature[at], cut[at] = f, c
                    left[at] = node(rows[below], level + 1)
                    right[at] = node(rows[~below], level + 1)
            return at

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, depth))

    def __call__(self, x: np.ndarray) -> dict[str, np.ndarray]:
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += depth[at]
        score = 2.0 ** (-total / len(self.trees) / max(average_path(self.size), 1e-12))
        return {"anomaly_score": score - 0.5}


def average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def isolation_forest(table: DataFrame, contamination: float | str = "auto", random_state: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Scores above 0 are anomalous; adds predicted_anomaly (-1 anomalous, 1 not)."""
    matrix, names = feature_matrix(table, columns)
    x = _sample(matrix, names, TREES * TREE_ROWS)
    if len(x) < 2:
        raise ValueError("At least two rows are needed.")
    scored = _score_rows(matrix, names, Forest(x, seed=random_state))
    cut = 0.0
    if contamination != "auto":
        if not 0 < contamination <= 0.5:
            raise ValueError("contamination must be 'auto' or lie above 0 and at most at 0.5.")
        cut = scored.agg(F.percentile("anomaly_score", F.lit(1.0 - contamination))).first()[0]
        scored = scored.withColumn("anomaly_score", F.col("anomaly_score") - F.lit(float(cut)))
    return scored.withColumn("predicted_anomaly", F.when(F.col("anomaly_score") > 0, F.lit(-1)).otherwise(F.lit(1)))


class OneClass:
    """nu-one-class support vector machine with an RBF kernel, by pairwise coordinate descent."""

    def __init__(self, x: np.ndarray, mean: np.ndarray, sd: np.ndarray, nu: float, gamma: float, rounds: int = 20000):
        self.mean, self.sd, self.gamma = mean, sd, gamma
        z = (x - mean) / sd
        n = len(z)
        k = self._kernel(z, z)
        most = 1.0 / (nu * n)
        a = np.zeros(n)
        whole = int(nu * n)
        a[:whole] = most
        if whole < n:
            a[whole] = 1.0 - most * whole
        g = k @ a
        for _ in range(rounds):
            up, down = a < most - 1e-12, a > 1e-12
            i = int(np.flatnonzero(up)[np.argmin(g[up])])
            j = int(np.flatnonzero(down)[np.argmax(g[down])])
            if g[j] - g[i] < 1e-5:
                break
            curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
            move = min((g[j] - g[i]) / curve, most - a[i], a[j])
            a[i] += move
            a[j] -= move
            g += move * (k[:, i] - k[:, j])
        free = (a > 1e-9) & (a < most - 1e-9)
        self.rho = float(g[free].mean()) if free.any() else float((g[a > 1e-9].min() + g[a > 1e-9].max()) / 2)
        keep = a > 1e-9
        self.support, self.weight = z[keep], a[keep]

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def __call__(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"anomaly_score": self.rho - self._kernel((x - self.mean) / self.sd, self.support) @ self.weight}


def one_class_svm(table: DataFrame, nu: float = 0.05, columns: list[str] | None = None, fit_rows: int = 2000) -> DataFrame:
    """Scores above 0 lie outside the support; adds fit_rows and predicted_anomaly (-1 outside, 1 inside).

    The kernel matrix is quadratic in the rows that the machine is fitted on: these are
    a sampling parameter, at most ``fit_rows`` by a hash of row_index.  All rows are
    standardised by the moments of all rows, and all are scored.
    """
    if not 0 < nu <= 1:
        raise ValueError("nu must lie above 0 and at most at 1.")
    matrix, names = feature_matrix(table, columns)
    n, mean, cov = _moments(matrix, names)
    if n < 2:
        raise ValueError("At least two rows are needed.")
    sd = _standard(n, cov)
    x = _sample(matrix, names, fit_rows)
    variance = ((x - mean) / sd).var()
    model = OneClass(x, mean, sd, nu, 1.0 / (len(names) * variance) if variance > 0 else 1.0)
    scored = _score_rows(matrix, names, model).withColumn("fit_rows", F.lit(len(x)).cast("long"))
    return scored.withColumn("predicted_anomaly", F.when(F.col("anomaly_score") > 0, F.lit(-1)).otherwise(F.lit(1)))
