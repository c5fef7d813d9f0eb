"""Quality classification by nearest-neighbour voting among latent-semantic vectors.

A bounded sample of labelled rows gives a term space (byte pairs, triples of
character classes, repetition levels), its latent-semantic projection and the
labelled vectors.  Both are sent to the executors; every document's whole text
is projected and its exact cosines with all labelled vectors come from blocked
matrix products.  The nearest labelled vectors vote, weighted by similarity and
by the share of all labelled rows that each of them stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.words import slices, word_hashes
from sigloom.session import ship

SAMPLE_PER_LABEL = 700  # bound of the fit: labelled rows of each label value
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 4.0
CUT = 0.7
PAIRS, CLASSES, LEVELS = 2048, 4096, 12
DIMS = PAIRS + CLASSES + 3 * LEVELS
BLOCK_ROWS = 256

_PAIR = np.random.default_rng(11).integers(0, PAIRS, 65536).astype(np.int64)
_CLASS = np.full(256, 15, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!", b"?", b"|", b"*#%&$@", b"()[]{}<>/\\", b"'\"`", b"-_=+~^")):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 14


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Term counts (rows x DIMS, float32) of a slice of texts."""
    rows = len(off) - 1
    out = np.zeros((rows, DIMS), np.float32)
    if len(data):
        row = np.repeat(np.arange(rows), np.diff(off))
        same = row[1:] == row[:-1]
        pair = _PAIR[data[:-1].astype(np.int64) << 8 | data[1:]]
        out[:, :PAIRS] = np.bincount((row[:-1] * PAIRS + pair)[same], minlength=rows * PAIRS).reshape(rows, PAIRS)
        kind = _CLASS[data]
        triple = kind[:-2] << 8 | kind[1:-1] << 4 | kind[2:]
        inside = same[1:] & same[:-1]
        out[:, PAIRS : PAIRS + CLASSES] = np.bincount((row[:-2] * CLASSES + triple)[inside], minlength=rows * CLASSES).reshape(rows, CLASSES)
    words, _, _, first = word_hashes(data, off)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            _, each = np.unique(words[a:b], return_counts=True)
            n = b - a
            # how far words repeat, one of them rules and neighbours agree; weighted like many terms
            twins = int((words[a + 1 : b] == words[a : b - 1]).sum())
            for k, share in enumerate((1 - len(each) / n, (int(each.max()) - 1) / n, (twins / n) ** 0.5)):
                out[i, PAIRS + CLASSES + k * LEVELS + min(LEVELS - 1, int(share * LEVELS))] = 20.0 if k < 2 else 400.0
    return out


def count_blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Term counts of all rows of a text column, a bounded block at a time."""
    for first, end, data, off in slices(column):
        for a in range(0, end - first, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, end - first)
            yield counts(data[off[a] : off[b]], off[a : b + 1] - off[a])


@dataclass
class Model:
    """What the executors need: bounded by the sample's bound and RANK."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    @property
    def prior(self) -> float:
        total = float(self.weights.sum())
        return float((self.weights * self.labels).sum() / total) if total else 0.5

    def latent(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        x = x @ self.project
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, tf: np.ndarray) -> np.ndarray:
        """Votes for label 1 in [0, 1]; texts without terms get the labelled rows' share."""
        if len(self.labels) == 0:
            return np.full(len(tf), self.prior)
        cosine = self.latent(tf) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** SHARPNESS * self.weights[near]
        total = vote.sum(axis=1)
        out = np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1.0), self.prior)
        return np.where(tf.any(axis=1), np.clip(out, 0.0, 1.0), self.prior)


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fit on at most ``sample_per_label`` labelled rows of each label (0 and 1).

    Only rows whose crc32(doc_id as text) mod 4 is not 2 and whose label is not
    null are learnt from.  Which of them are sampled is decided by a hash of
    doc_id; of documents that share a sampled id the first text in order counts, of
    labels that share one the lower.  The sample's ids (bounded) go to the executors,
    its term counts (bounded: DIMS numbers an id) come back.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 4) != 2)
    ).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_label)
        picked = part if picked is None else picked.unionByName(part)
    named = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = named.mapInArrow(_sample_batches, f"doc_id {kind}, quality int, tf binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    tf = np.stack([np.frombuffer(r["tf"], np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    y = np.array([r["quality"] for r in rows], np.float64)
    idf = np.log((1.0 + len(tf)) / (1.0 + (tf > 0).sum(axis=0))).astype(np.float32) + np.float32(1.0)
    weights = np.ones(len(y))
    for value in (0, 1):
        here = y == value
        if here.any():
            weights[here] = shares.get(value, 0) / here.sum()
    model = Model(idf, np.zeros((DIMS, min(RANK, max(len(tf), 1))), np.float32), np.zeros((0, 1), np.float32), y, weights)
    if len(tf):
        x = np.log1p(tf) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
        keep = np.argsort(-values)[:RANK]
        keep = keep[values[keep] > 1e-9]
        model.project = (x.T @ (left[:, keep] / np.sqrt(values[keep]))).astype(np.float32)
        model.vectors = model.latent(tf).astype(np.float32)
    return model


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tf = [row.tobytes() for block in count_blocks(batch.column(2)) for row in block]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tf, pa.binary())], ["doc_id", "quality", "tf"])


def classify(docs: DataFrame, model: Model, cut: float = CUT, id_column: str = "doc_id") -> DataFrame:
    """Score every row of ``docs(doc_id, text)``: doc_id, score and predicted (score >= cut).

    A null text counts as empty; empty texts and texts of one byte without a word
    get the labelled rows' share of label 1.  Null ids and repeated rows stay;
    texts of any length are read whole; other columns are ignored; an empty table
    gives an empty one.
    """
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            parts = [own.score(block) for block in count_blocks(batch.column(1))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())],
                [id_column, "score", "predicted"],
            )

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, with all their columns, in one pass.

    Rows with null ids and repeated rows are judged each; a null text counts as empty;
    columns of any name stay; an empty table gives an empty one.
    """
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.score(block) for block in count_blocks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= cut))

    return docs.mapInArrow(run, docs.schema)
