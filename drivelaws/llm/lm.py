"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share vocabulary, smoothing and the set of bigrams kept. A
document's score is the mean over its tokens of target loss minus background loss: the lower, the
more it reads like the target.

The models grow with the corpus, so no task holds them whole: documents are dealt into blocks, a block
counts its own words and bigrams, the counts meet in ranges of their keys, and what the whole corpus has
of each returns to the blocks that hold it. A block then scores its documents with its slice of both models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, null_safe_join, settle, size_of, text_of
from .textnp import BASE, Rolling, mix, per_text, text_bytes, words

# A word is in the vocabulary, and a bigram in both models, from so many occurrences in all documents on.
LEAST = 2
# Weights of bigram, unigram and uniform probability.
BIGRAM, UNIGRAM, UNIFORM = 0.5, 0.4, 0.1
BLOCK_BYTES = 16 << 20
# The counts of the corpus are summed in so many ranges of keys for each block, and at least in so many.
RANGES, LEAST_RANGES = 8, 64
# Keys are 63 bits of a hash and a last bit that tells bigrams (1) from words (0). The two last even keys
# stand for all tokens and for the begin of a text, which is a context.
TOTAL, BEGIN = np.uint64(2 ** 64 - 4), np.uint64(2 ** 64 - 2)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Keys of the words, of the words before them and of both as a bigram; index of each word's text; number of texts."""
    data, starts = text_bytes(column)
    data = _LOWER[data]
    begin, end, of = words(data, starts)
    word = Rolling(data).ranges(begin, end) & ~np.uint64(1)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    first = np.ones(len(word), bool)
    first[1:] = of[1:] != of[:-1]
    before[first] = BEGIN
    pair = mix(before * np.uint64(BASE) + word) | np.uint64(1)
    return word, before, pair, of, len(starts) - 1


def pack(keys: np.ndarray, n: np.ndarray, target: np.ndarray) -> bytes:
    """How many, then ascending keys as differences and their counts, compressed by place of byte, where most are zero."""
    rows = np.stack([np.diff(keys, prepend=np.uint64(0)), n.astype(np.uint64), target.astype(np.uint64)])
    places = rows.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes()
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd").compress(places, asbytes=True)


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and target counts one after another, and how many there are in each."""
    codec = pa.Codec("zstd")
    sizes = [int.from_bytes(b[:8], "little") for b in packed]
    places = [np.frombuffer(codec.decompress(b[8:], 24 * n, asbytes=True), np.uint8) for b, n in zip(packed, sizes)]
    parts = [p.reshape(3, 8, n).transpose(0, 2, 1).copy().view(np.uint64)[..., 0] for p, n in zip(places, sizes)]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    return keys, *(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2)), np.array(sizes)


def summed(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, place of each key among them, sums of both counts."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at, *(np.bincount(at, x, len(distinct)).astype(np.int64) for x in (n, wanted))


class Tally:
    """Counts of keys in one block, all and within the target."""

    def __init__(self, block: int):
        self.block = block
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> None:
        distinct, _, *sums = summed(keys, n, wanted)
        self.parts.append((distinct, *sums))

    def add(self, batch: pa.RecordBatch) -> None:
        word, _, pair, of, n = keys_of(batch.column("text"))
        wanted = batch.column("wanted").to_numpy(zero_copy_only=False)
        spoken = per_text(of, None, n) > 0
        once = np.ones(len(word), np.int64)
        for keys in (word, pair):
            self.put(keys, once, wanted[of])
        self.put(np.array([BEGIN, TOTAL]), np.array([spoken.sum(), len(word)]), np.array([(spoken & wanted).sum(), wanted[of].sum()]))

    def batch(self, ranges: int) -> pa.RecordBatch:
        """One row per range of keys: the block's counts in it."""
        self.put(*(np.concatenate(p) for p in zip(*self.parts)))
        keys, n, wanted = self.parts[-1]
        cuts = [0, *np.searchsorted(keys, np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)).tolist(), len(keys)]
        held = [(i, low, high) for i, (low, high) in enumerate(zip(cuts, cuts[1:])) if high > low]
        entries = pa.array([pack(keys[low:high], n[low:high], wanted[low:high]) for _, low, high in held], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in held], pa.int64()), pa.array([self.block] * len(held), pa.int64()), entries],
                                          ["range", "block", "entries"])


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """The rows, settled, with the number of a block of about ``BLOCK_BYTES`` of text; a longer text ends its block."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = held + np.cumsum(lengths)
            held += int(lengths.sum())
            block = pa.array(first + (ends - lengths) // BLOCK_BYTES)
            yield pa.RecordBatch.from_arrays([block, *batch.columns], ["block", "id", "text", "wanted"])

    return settle(rows.select("id", "text", "wanted").mapInArrow(number, f"block long, id {kind}, text string, wanted boolean"))


def _slices(blocks: DataFrame) -> DataFrame:
    """``(block, entries, words, n, target)``, settled: packed counts over all documents of the block's keys.

    The last three are what a range of keys adds to the vocabulary, said in one of its rows.
    """
    ranges = max(LEAST_RANGES, RANGES * blocks.agg(F.count_distinct("block")).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = None
        for batch in batches:
            at = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
            for low, high in zip(edges, edges[1:]):
                if tally is not None and tally.block != at[low]:
                    yield tally.batch(ranges)
                    tally = None
                tally = tally or Tally(int(at[low]))
                for piece in bounded([batch.slice(low, high - low)], "text"):
                    tally.add(piece)
        if tally is not None:
            yield tally.batch(ranges)

    def count(parts: pa.Table) -> pa.Table:
        keys, *counts, sizes = unpack(parts["entries"].to_pylist())
        distinct, at, n, target = summed(keys, *counts)
        shared = (n >= LEAST) | (distinct >= TOTAL)
        vocabulary = shared & (distinct % np.uint64(2) == 0) & (distinct < TOTAL)
        entries = []
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            mine = at[end - size:end]
            mine = mine[shared[mine]]
            entries.append(pack(distinct[mine], n[mine], target[mine]))
        adds = [[int(x)] + [0] * (len(entries) - 1) for x in (vocabulary.sum(), n[vocabulary].sum(), target[vocabulary].sum())]
        return pa.table([parts["block"], pa.array(entries, pa.binary()), *(pa.array(x, pa.int64()) for x in adds)],
                        ["block", "entries", "words", "n", "target"])

    counted = blocks.select("block", "text", "wanted").mapInArrow(run, "range long, block long, entries binary")
    return settle(counted.groupBy("range").applyInArrow(count, "block long, entries binary, words long, n long, target long"))


class Models:
    """A block's slice of both models. ``size`` is that of the whole vocabulary, other words counting as one;
    ``known`` the tokens within it, of all documents and of the target."""

    def __init__(self, counts: pa.Table, size: int, known: tuple[int, int]):
        # a block whose rows were read in two tasks has its keys twice
        keys, *both, _ = unpack(counts["entries"].to_pylist())
        self.keys, at = np.unique(keys, return_index=True)
        self.counts = [c[at].astype(float) for c in both]
        self.size = size
        total = self.find(np.array([TOTAL]))[0]
        self.totals = [c[total] for c in self.counts]
        self.others = [t - k for t, k in zip(self.totals, known)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 for one that is not in the models."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def losses(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
        """Loss of every token under the background model and under the target model."""
        word, before, pair = self.find(word), self.find(before), self.find(pair)
        out = []
        for counts, total, others in zip(self.counts, self.totals, self.others):
            context = np.where(before >= 0, counts[before], 0.0)
            both = np.where(pair >= 0, counts[pair], 0.0)
            p = BIGRAM * np.divide(both, context, out=np.zeros(len(both)), where=context > 0)
            p += UNIGRAM * (np.where(word >= 0, counts[word], others) / max(total, 1)) + UNIFORM / self.size
            out.append(-np.log(p))
        return out


def marked(spark: SparkSession, docs: DataFrame, target_keys: DataFrame, key: str) -> DataFrame:
    """The rows with ``wanted``: whether their key is among the target's."""
    keys = settle(target_keys.select(F.col(f"`{key}`").alias("__key")).distinct().withColumn("wanted", F.lit(True)))
    small = size_of(spark, keys) <= BROADCAST_BYTES
    joined = null_safe_join(docs.withColumn("__key", F.col(f"`{key}`")), F.broadcast(keys) if small else keys, ["__key"], "left")
    return joined.withColumn("wanted", F.coalesce("wanted", F.lit(False))).drop("__key")


def score(docs: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, target_loss, background_loss, score)`` with one row per row of ``docs``.

    Losses are means per token. A word or bigram is in the models from ``LEAST`` occurrences on, at any
    size of the corpus; rarer words count as one, rarer bigrams back off. Texts without words, null or
    empty, have losses and score 0. Null keys are in the target only if the target names a null key;
    repeated rows count and score each; an empty table gives no rows; other columns take no part. With
    an empty target its model is uniform smoothing alone. Words are told apart by 63 bits.
    """
    rows = marked(docs.sparkSession, docs.select(F.col(f"`{key}`").alias("id"), text_of(F.col(f"`{text}`")).alias("text")),
                  target_keys.select(F.col(f"`{key}`").alias("id")), "id")
    kind = docs.schema[key].dataType.simpleString()
    blocks = _blocks(rows, kind)
    slices = _slices(blocks)
    entries, *known = (x or 0 for x in slices.agg(F.sum("words"), F.sum("n"), F.sum("target")).first())
    types = {"n_tokens": pa.int64(), "target_loss": pa.float64(), "background_loss": pa.float64(), "score": pa.float64()}

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        models = Models(counts, entries + 1, tuple(known))
        out = []
        for batch in bounded(texts.select(["id", "text"]).to_batches(), "text"):
            word, before, pair, of, n = keys_of(batch.column("text"))
            background, target = models.losses(word, before, pair)
            count = per_text(of, None, n)
            over = np.maximum(count, 1)
            sums = [np.bincount(of, x, n) / over for x in (target, background, target - background)]
            out.append(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count), *(pa.array(s) for s in sums)], ["id", *types]))
        return pa.Table.from_batches(out)

    scored = blocks.select("block", "id", "text").groupBy("block").cogroup(slices.select("block", "entries").groupBy("block"))
    scored = scored.applyInArrow(run, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("id", key)
