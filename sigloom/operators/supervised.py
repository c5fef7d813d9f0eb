"""Leakage-aware supervised baselines with Spark ML: logistic regression and a random forest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import detectors as D

SHUFFLES = 50


@dataclass
class Evaluation:
    name: str
    metrics: dict[str, float]
    predictions: DataFrame
    confusion: DataFrame
    labels: list[str]
    split: str
    importances: dict[str, float] = field(default_factory=dict)


def split_groups(table: DataFrame, label: str, group: str | None, test_size: float, seed: int) -> tuple[DataFrame, str]:
    """Adds _test: whole groups fall on one side, and both sides hold every label.

    The group column is the one given, else source_name, else record_name.
    """
    column = group or next((c for c in ("source_name", "record_name") if c in table.columns), None)
    if group is not None and group not in table.columns:
        raise ValueError(f"Unknown group column '{group}'.")
    if column is None:
        order = F.row_number().over(D.W.partitionBy(label).orderBy(F.xxhash64("row_index", F.lit(seed)), "row_index"))
        size = F.count(F.lit(1)).over(D.W.partitionBy(label))
        return table.withColumn("_test", order <= F.greatest(F.lit(1), F.rint(size * test_size))), "stratified rows"
    # whole groups are dealt by a hash; only labels with too few groups come to the driver
    groups = table.groupBy(column).agg(F.collect_set(label).alias("_labels"))
    if not groups_per_label(table, label, column).where("n_groups < 2").isEmpty():
        raise ValueError("Every label must occur in two groups or more.")
    for attempt in range(SHUFFLES):
        share = F.pmod(F.xxhash64(F.lit(seed), F.lit(attempt), F.col(column).cast("string")), F.lit(1 << 30)) / float(1 << 30)
        sides = groups.select((share < test_size).alias("t"), F.explode("_labels").alias("l")).groupBy("l").agg(F.count_distinct("t").alias("sides"))
        if sides.where("sides < 2").isEmpty():
            return table.withColumn("_test", share < test_size), f"groups of {column}"
    raise ValueError("No split keeps every label on both sides.")


def groups_per_label(table: DataFrame, label: str, group: str) -> DataFrame:
    """(label, n_groups, n_rows); a label in one group only cannot stand on both sides of a split."""
    return table.groupBy(label, group).agg(F.count(F.lit(1)).alias("n")).groupBy(label).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


def run_baselines(
    table: DataFrame, label: str = "label", group: str | None = None, test_size: float = 0.3, random_state: int = 0
) -> list[Evaluation]:
    if label not in table.columns:
        raise ValueError(f"Missing label column '{label}'.")
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1.")
    known = table.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in known.select(F.col(label).cast("string")).distinct().collect())
    if len(labels) < 2:
        raise ValueError("Supervised baselines need at least two labels.")
    keep = [c for c in ("source_name", "record_name") if c in known.columns]
    matrix, names = D.feature_matrix(known.withColumn("_label", F.col(label).cast("string")))
    names = [n for n in names if n != "_label"]
    facts = known.select("row_index", F.col(label).cast("string").alias("true_label"), *keep)
    data = matrix.select("row_index", *names).join(facts, "row_index")
    data, how = split_groups(data, "true_label", group, test_size, random_state)
    code = F.create_map(*[x for k, v in enumerate(labels) for x in (F.lit(v), F.lit(float(k)))])
    stats = data.where("not _test").agg(*[F.avg(c).alias(c) for c in names], *[F.stddev_pop(c).alias(f"{c}__sd") for c in names]).first()
    n_train = data.where("not _test").count()
    scaled = data.withColumns({f"z_{c}": (F.col(c) - F.lit(float(stats[c]))) / F.lit(float(stats[f"{c}__sd"] or 0.0) or 1.0) for c in names})
    sizes = {r["true_label"]: r["count"] for r in data.where("not _test").groupBy("true_label").count().collect()}
    weight = F.create_map(*[x for v in labels for x in (F.lit(v), F.lit(n_train / (len(labels) * sizes.get(v, 1))))])
    ready = VectorAssembler(inputCols=[f"z_{c}" for c in names], outputCol="features").transform(scaled)
    ready = ready.withColumns({"y": code[F.col("true_label")], "w": weight[F.col("true_label")]}).select("row_index", "true_label", "features", "y", "w", "_test")
    ready = ready.repartition("row_index").sortWithinPartitions("row_index")
    train, test = ready.where("not _test"), ready.where("_test")
    models = {
        "logistic_regression": LogisticRegression(featuresCol="features", labelCol="y", maxIter=1000, regParam=1.0 / max(n_train, 1), standardization=False),
        "random_forest": RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=100, seed=random_state),
    }
    out = []
    for name, estimator in models.items():
        model = estimator.fit(train)
        decode = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int") + 1)
        predictions = model.transform(test).select("row_index", "true_label", decode.alias("predicted_label"))
        confusion = predictions.groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
        if name == "random_forest":
            values = model.featureImportances.toArray()
        else:
            values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
        out.append(Evaluation(name, metrics(confusion, labels), predictions, confusion, labels, how, dict(zip(names, map(float, values)))))
    return out


def metrics(confusion: DataFrame, labels: list[str]) -> dict[str, float]:
    """Accuracy and support-weighted precision, recall and F1; divisions by 0 count as 0."""
    cells = {(r["true_label"], r["predicted_label"]): r["n"] for r in confusion.collect()}
    total = sum(cells.values()) or 1
    out = {"accuracy": sum(n for (a, b), n in cells.items() if a == b) / total, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for x in labels:
        hit = cells.get((x, x), 0)
        said = sum(n for (_, b), n in cells.items() if b == x)
        real = sum(n for (a, _), n in cells.items() if a == x)
        p, r = hit / said if said else 0.0, hit / real if real else 0.0
        for key, v in (("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r) if p + r else 0.0)):
            out[key] += v * real / total
    return out
