"""Ranked lexical search, reversed: the items are indexed and the documents stream through the index.

The inverted index over the items' terms goes to every task; a document's term counts run through it
and update bounded heaps, one per item; the heaps of all tasks are merged. Items beyond the bound of
an index are dealt into blocks with a pass over the documents each.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, settle, text_of

# Terms: ASCII digits and letters, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# An index holds about so many postings; only one longer item can make it larger.
POSTINGS = 200_000
SCORES = 1 << 21
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = re.compile(TERM)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def split_terms(text: str) -> list[str]:
    return _TERM.findall(text.encode().translate(_LOWER).decode())


def inverted(postings: list) -> dict:
    """Postings of a block of items by term: places of the items, and how often each holds the term."""
    terms: dict[str, int] = {}
    rows = sorted((terms.setdefault(p["term"], len(terms)), p["item"], p["times"]) for p in postings)
    flat = np.array(rows, np.int64).reshape(-1, 3)
    items, place = np.unique(flat[:, 1], return_inverse=True)
    return {"terms": terms, "items": items, "place": place.astype(np.int64), "times": flat[:, 2],
            "starts": np.searchsorted(flat[:, 0], np.arange(len(terms) + 1))}


def _counted(docs: DataFrame, index) -> DataFrame:
    """``(id, n, terms, tfs)``: the terms of all in a document, and its counts of indexed terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value["terms"]
        for batch in bounded(batches, "text"):
            sizes, at, tfs, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                found = split_terms(text)
                sizes.append(len(found))
                for term, tf in Counter(found).items():
                    number = known.get(term)
                    if number is not None:
                        at.append(number)
                        tfs.append(tf)
                ends.append(len(at))
            edges = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(tfs, pa.int64()))], ["id", "n", "terms", "tfs"])

    return settle(docs.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>"))


class Heaps:
    """The k best of every item: higher scores first, then smaller keys, a null key last."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # scores below it no longer enter

    def offer(self, item: int, score: int, key: int | None) -> None:
        entry = (score, key is not None, -(key or 0))
        heap = self.held[item]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


def _streamed(counted: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item, id, score)``: the heaps of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = index.value
        starts, place, times = postings["starts"], postings["place"], postings["times"]
        items = len(postings["items"])
        heaps, step = Heaps(items, k), max(1, min(256, SCORES // max(items, 1)))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                keys, n = batch.column("id").to_pylist(), batch.column("n").to_numpy()
                term, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("terms").offsets.to_numpy()))
                m = 100 - 25 + (25 * n * n_docs) // max(n_terms, 1)
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                many = starts[term + 1] - starts[term]
                at = np.repeat(starts[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                scores = np.zeros(batch.num_rows * items, np.int64)
                np.add.at(scores, np.repeat(doc, many) * items + place[at], np.repeat(value, many) * times[at])
                scores = scores.reshape(batch.num_rows, items)
                d, i = np.nonzero((scores > 0) & (scores >= heaps.least))
                for a, b, s in zip(d.tolist(), i.tolist(), scores[d, i].tolist()):
                    if s >= heaps.least[b]:
                        heaps.offer(b, s, keys[a])
        rows = [(postings["items"][i], -e[2] if e[1] else None, e[0]) for i, heap in enumerate(heaps.held) for e in heap]
        for first in range(0, len(rows), 50_000):
            item, key, score = zip(*rows[first:first + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, key, score)], ["item", "id", "score"])

    return counted.select("id", "n", "terms", "tfs").mapInArrow(run, "item long, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """``(item, rank, key, score)``: for every row of ``items`` the ``k`` best rows of ``docs`` with a score above 0.

    A term's weight is floor(1000 ln((2N+2) / (2df+1))), N documents with a term; a document of n terms,
    L in all, has m = 75 + 25 n N div L, and scores weight * (10^9 tf div (1000 tf + 12 m)) for every
    term of the item, repeats included. Equal scores go by smaller key, null keys last. Null and empty
    texts have no terms: such items have no rows. Repeated items are ranked each, repeated documents
    count each. Other columns take no part. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    named = settle(items.select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{item}`").alias("item_key"), text_of(F.col(f"`{item_text}`")).alias("text")))
    every = settle(named.select("item", F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    blocks = max(1, -(-every.count() // postings))
    out = None
    for block in range(blocks):
        # about ``postings`` rows, whatever the number of items
        own = every.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(inverted(own))
        counted = _counted(rows, index)
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weighed = df.select("term", F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).alias("w")).collect()
        weights = np.zeros(len(index.value["terms"]), np.int64)
        for r in weighed:
            weights[r["term"]] = r["w"]
        part = settle(_streamed(counted, index, weights, n_docs, n_terms, k))
        out = part if out is None else out.unionByName(part)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = out.withColumn("rank", F.row_number().over(place).cast("int")).filter(F.col("rank") <= k)
    return best.join(named.select("item", "item_key"), "item").select(F.col("item_key").alias(item), "rank", F.col("id").alias(key), "score")
