"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, character n-grams and repeated word
runs; a softmax layer on top tells the classes apart. Vectors and layer are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows, and every text is then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, settle, text_of
from .textnp import Rolling, grams, mix, repeated, text_bytes, words

BUCKETS = 1 << 17
DIMENSIONS = 8
CHAR_GRAMS = (3, 5)
# At most this many labelled rows are learned from: all, or those with the smallest hashes.
SAMPLE = 12_000
EPOCHS = 6
RATE = 40.0
SEED = 11


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Per group of features: buckets, and index of the text each belongs to."""
    data, starts = text_bytes(column)
    mask = np.uint64(BUCKETS - 1)
    begin, end, of = words(data, starts)
    hashes = Rolling(data).ranges(begin, end)
    groups = [((mix(hashes + np.uint64(1)) & mask).astype(np.int64), of)]
    wide, text_at = data.astype(np.uint64), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for n in CHAR_GRAMS:
        count = max(0, len(data) - n + 1)
        value = np.zeros(count, np.uint64)
        for i in range(n):
            value = (value << np.uint64(8)) | wide[i:i + count]
        inside = np.flatnonzero(text_at[:count] == text_at[n - 1:]) if count else np.zeros(0, np.int64)
        value = value[inside]
        value *= np.uint64(0x9E3779B97F4A7C15)
        groups.append(((value >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), text_at[inside]))
    # two buckets of their own: a run of three words found again in the text, or only here
    runs, at = grams(hashes, of, 3)
    groups.append((repeated(runs, of[at]).astype(np.int64), of[at]))
    return data, starts, groups


def weighted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of every text and their weights, which sum to 1 over each group present."""
    _, starts, groups = features(column)
    n = len(starts) - 1
    keys, weights = [], []
    for buckets, of in groups:
        keys.append(of * BUCKETS + buckets)
        weights.append((1.0 / (len(groups) * np.maximum(np.bincount(of, minlength=n), 1)))[of])
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights, len(distinct))
    edges = np.searchsorted(distinct, np.arange(n + 1) * BUCKETS)
    return [(distinct[a:b] % BUCKETS, total[a:b]) for a, b in zip(edges[:-1], edges[1:])]


class Model:
    """Vectors, softmax layer and bias."""

    def __init__(self, classes: int = 2):
        random = np.random.Generator(np.random.PCG64(SEED))
        self.vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
        self.layer = np.zeros((DIMENSIONS, classes))
        self.bias = np.zeros(classes)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Plain gradient steps, one document each, in a seeded order and with a falling rate."""
        random = np.random.Generator(np.random.PCG64(SEED + 1))
        done, steps = 0, max(1, epochs * len(rows))
        for _ in range(epochs):
            for i in random.permutation(len(rows)).tolist():
                buckets, weights = rows[i]
                step = 1 - done / steps
                done += 1
                hidden = weights @ self.vectors[buckets]
                logits = hidden @ self.layer + self.bias
                shown = np.exp(logits - logits.max())
                error = shown / shown.sum()
                error[labels[i]] -= 1
                back = self.layer @ error
                self.layer -= 0.5 * step * np.outer(hidden, error)
                self.bias -= 0.05 * step * error
                self.vectors[buckets] -= rate * step * np.outer(weights, back)

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1: the mean of vectors times the layer, taken apart."""
        difference = self.layer[:, 1] - self.layer[:, 0]
        return (self.vectors @ difference).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(examples: DataFrame) -> tuple[bytes, float]:
    """Model of ``(id, label, buckets, weights)``, a table of at most the sample's rows, trained in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            for b, w in zip(batch.column(2), batch.column(3)):
                rows.append((b.values.to_numpy(zero_copy_only=False).astype(np.int64), w.values.to_numpy(zero_copy_only=False).astype(np.float64)))
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        model = Model()
        model.train([rows[i] for i in order], np.array([labels[i] for i in order], np.int64))
        margins, bias = model.margins()
        yield pa.RecordBatch.from_arrays([pa.array([margins.tobytes()]), pa.array([bias])], ["margins", "bias"])

    trained = examples.coalesce(1).mapInArrow(run, "margins binary, bias double").first()
    return (bytes(trained["margins"]), trained["bias"]) if trained else (Model().margins()[0].tobytes(), 0.0)


def examples_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """``(id, label, buckets, weights)`` of the sampled labelled documents.

    The sample is taken from the labels, before any text is read, so the join broadcasts at most
    ``sample`` ids. A key that several rows share counts once, with one of their texts.
    """
    chosen = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    chosen = settle(chosen.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_of(F.col(f"`{text}`")).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found = weighted(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([b for b, _ in found], pa.list_(pa.int32())),
                 pa.array([w for _, w in found], pa.list_(pa.float32()))], ["id", "label", "buckets", "weights"])

    extracted = rows.mapInArrow(run, "id long, label int, buckets array<int>, weights array<float>")
    one = F.min(F.struct("buckets", "weights", "label"))
    return settle(extracted.groupBy("id").agg(one.alias("row")).select("id", "row.label", "row.buckets", "row.weights"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             sample: int = SAMPLE) -> DataFrame:
    """The key and text rows of ``docs`` with ``score``: how likely class 1 is, from 0 to 1.

    Null and empty texts score by the bias alone; null keys and repeated rows are scored like others.
    Without labels every score is 0.5. Labels other than 0 and 1 and null keys teach nothing.
    """
    margins, bias = fit(examples_of(docs, labels, key, text, label, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(margins, np.float32)
        for batch in bounded(batches, "__text"):
            _, starts, groups = features(batch.column("__text"))
            n = len(starts) - 1
            odds = np.full(n, bias)
            for buckets, of in groups:
                odds += np.bincount(of, table[buckets], n) / (len(groups) * np.maximum(np.bincount(of, minlength=n), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], [key, "score"])

    rows = docs.select(F.col(f"`{key}`"), text_of(F.col(f"`{text}`")).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
