"""Removal of repeated strings, found in suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else. Windows of
hashed grams pick anchors so that any two equal strings share one: the smallest gram of a string
depends on the string alone. Where the whole surroundings of an anchor occur twice, all of them go.
Where only the anchor does, surroundings with the same anchor meet in one task, which sorts their
suffixes in two stages and compares neighbours, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, CHUNK_BYTES, bounded, null_safe_join, settle, size_of, text_of
from .textnp import Rolling, text_bytes

LENGTH = 200
GRAM = 40
# An anchor with more different surroundings than this is compared by hashes of whole strings instead,
# which spread over all tasks.
CROWDED = 8192
_NONE = np.uint64(2 ** 64 - 1)


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places of the leftmost smallest gram of every string of ``length`` bytes within a text."""
    count = len(data) - gram + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(count)
    hashes = Rolling(data).ranges(at, at + gram)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    for edge in starts[1:-1]:
        keys[max(0, edge - gram + 1):edge] = _NONE
    keys[max(0, starts[-1] - gram + 1):] = _NONE
    width, reach, least = length - gram + 1, 1, keys
    while reach * 2 <= width and len(least) > reach:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    if rest and len(least) > rest:
        least = np.minimum(least[:-rest], least[rest:])
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    chosen = np.unique(least[new])
    return (chosen[chosen != _NONE] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``(h, s, t, n, at, seen)``: hash of each anchor's gram and of its surroundings, text, its bytes, place, how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            data, starts = text_bytes(batch.column("text"))
            found = anchors(data, starts, length, gram)
            of = np.searchsorted(starts, found, "right") - 1
            rolling = Rolling(data)
            low = np.maximum(found + gram - length, starts[of])
            high = np.minimum(found + length, starts[of + 1])
            h = rolling.ranges(found, found + gram)
            # in a short text two places of one gram can have the same surroundings: those are one, seen twice
            order = np.lexsort((found, high, low, h))
            new = np.ones(len(order), bool)
            for x in (h, low, high):
                x = x[order]
                new[1:] &= x[1:] == x[:-1]
            new[1:] = ~new[1:]
            seen = np.diff(np.append(np.flatnonzero(new), len(order)))
            one = order[new]
            found, of, h, low, high = found[one], of[one], h[one], low[one], high[one]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(rolling.ranges(low, high).view(np.int64)),
                 batch.column("t").take(pa.array(of)), pa.array((starts[of + 1] - starts[of]).astype(np.int32)),
                 pa.array((found - starts[of]).astype(np.int32)), pa.array(seen.astype(np.int32))], ["h", "s", "t", "n", "at", "seen"])

    return rows.filter(F.octet_length("text") >= length).select("t", "text").mapInArrow(
        run, "h long, s long, t long, n int, at int, seen int")


def sort_suffixes(at: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their next ``depth`` bytes, eight at a time; only ties go on."""
    order = np.argsort(ahead[at], kind="stable")
    out = at[order]
    keys = ahead[out]
    fresh = np.ones(len(out), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    open_at = np.arange(len(out))
    for step in range(8, depth, 8):
        first = fresh[open_at]
        tied = ~first
        tied[:-1] |= ~first[1:]
        open_at, first = open_at[tied], first[tied]
        if not len(open_at):
            break
        part = out[open_at]
        keys = ahead[part + step]
        apart = np.flatnonzero((keys[1:] != keys[:-1]) & ~first[1:])
        # copies mostly go on alike, so few groups need their order changed
        group = np.cumsum(first) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[apart]] = True
        chosen = np.flatnonzero(mixed[group])
        order = np.lexsort((keys[chosen], group[chosen]))
        out[open_at[chosen]] = part[chosen][order]
        keys = keys[chosen][order]
        fresh[open_at[chosen[1:][keys[1:] != keys[:-1]]]] = True
    return out


def suffix_array(data: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the wanted suffixes by their first ``depth`` bytes, in two stages, and the bytes ahead of each place.

    Suffixes smaller than their successors are sorted directly. The others follow in one scan by first
    bytes: whoever stands before a suffix already placed, and is larger than it, comes next in its bucket.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * depth + 16, np.uint8)])
    ahead = np.zeros(n + 2 * depth + 8, np.uint64)
    for i in range(8):
        ahead <<= np.uint64(8)
        ahead |= padded[i:i + len(ahead)]
    # smaller than the successor: by the next byte that differs
    reach = n + depth
    step = np.sign(padded[1:reach + 1].astype(np.int16) - padded[:reach].astype(np.int16))
    nearest = np.where(step != 0, np.arange(reach), reach - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = step[nearest] >= 0
    # what is induced needs its successor, up to one that is sorted directly
    needed = np.zeros(reach, bool)
    needed[wanted] = True
    direct_at = np.flatnonzero(smaller)
    last = direct_at[np.searchsorted(direct_at, wanted)]
    change = np.zeros(reach + 1, np.int64)
    np.add.at(change, wanted, 1)
    np.add.at(change, last + 1, -1)
    needed |= np.cumsum(change[:-1]) > 0

    direct = sort_suffixes(np.flatnonzero(needed & smaller), ahead, depth)
    bounds = np.searchsorted(padded[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done: list[np.ndarray] = []
    for byte in range(256):
        front = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        induced = [front]
        while len(front):  # runs of this byte
            before = front[front > 0] - 1
            front = before[(padded[before] == byte) & needed[before] & ~smaller[before]]
            induced.append(front)
        bucket = np.concatenate([*induced, direct[bounds[byte]:bounds[byte + 1]]])
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(padded[before] > byte) & needed[before] & ~smaller[before]]
        order = np.argsort(padded[before], kind="stable")
        before = before[order]
        edges = np.searchsorted(padded[before], np.arange(257))
        for higher in np.unique(padded[before]).tolist():
            waiting[higher].append(before[edges[higher]:edges[higher + 1]])
    keep = np.zeros(reach, bool)
    keep[wanted] = True
    array = np.concatenate(done) if done else np.zeros(0, np.int64)
    return array[keep[array]], ahead


def common_prefix(array: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares ``depth`` bytes (a multiple of eight) with the one before it."""
    shared = np.zeros(len(array), bool)
    at = np.arange(1, len(array))
    for step in range(0, depth, 8):
        at = at[ahead[array[at] + step] == ahead[array[at - 1] + step]]
    shared[at] = True
    return shared


def repeats(data: np.ndarray, edges: np.ndarray, text_of_span: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans put end to end: (span, low, high) of what strings that start elsewhere cover, places in the text.

    The same string seen from two spans of one text is one string, not two.
    """
    sizes = np.diff(edges)
    counts = np.maximum(sizes - length + 1, 0)
    span = np.repeat(np.arange(len(sizes)), counts)
    wanted = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + edges[:-1][span]
    array, ahead = suffix_array(data, wanted, length)
    if not len(array):
        return (np.zeros(0, np.int64),) * 3
    runs = np.flatnonzero(~common_prefix(array, ahead, length))
    of = np.searchsorted(edges, array, "right") - 1
    _, text_number = np.unique(text_of_span, return_inverse=True, axis=0)
    identity = (text_number.astype(np.int64)[of] << 34) + place[of] + array - edges[of]
    apart = np.minimum.reduceat(identity, runs) != np.maximum.reduceat(identity, runs)
    covered = np.sort(array[np.repeat(apart, np.diff(np.append(runs, len(array))))])
    return _merge(covered, np.searchsorted(edges, covered, "right") - 1, edges, place, length)


def _merge(covered: np.ndarray, of: np.ndarray, edges: np.ndarray, place: np.ndarray, length: int):
    if not len(covered):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(covered), bool)
    new[1:] = (of[1:] != of[:-1]) | (covered[1:] - covered[:-1] > length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(covered)) - 1
    span = of[first]
    return span, covered[first] - edges[span] + place[span], covered[last] - edges[span] + place[span] + length


_COVER = "t long, n int, low int, high int"


def _covers(spans: list[pa.Table], length: int) -> pa.RecordBatch:
    table = pa.concat_tables(spans).combine_chunks()
    data, edges = text_bytes(table["text"].combine_chunks().cast(pa.large_binary()))
    texts = np.stack([table["t"].to_numpy(), table["n"].to_numpy().astype(np.int64)], axis=1)
    span, low, high = repeats(data, edges, texts, table["low"].to_numpy().astype(np.int64), length)
    return pa.RecordBatch.from_arrays(
        [table["t"].combine_chunks().take(pa.array(span)), table["n"].combine_chunks().take(pa.array(span)),
         pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["t", "n", "low", "high"])


def _sorted_covers(spans: DataFrame, length: int) -> DataFrame:
    """Covered ranges of spans that meet by anchor; every suffix array takes whole groups of anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
            first = 0
            for i, cut in enumerate(cuts):
                if held and size >= CHUNK_BYTES and h[first] != last:
                    yield _covers(held, length)
                    held, size = [], 0
                # small groups of one batch go together
                if i + 1 < len(cuts) and (cut - first) * 2 * length + size < CHUNK_BYTES:
                    continue
                part = batch.slice(first, cut - first)
                held.append(pa.Table.from_batches([part]))
                size += (cut - first) * 2 * length
                last, first = h[cut - 1], cut
        if held:
            yield _covers(held, length)

    return spans.repartition("h").sortWithinPartitions("h").mapInArrow(run, _COVER)


def _hashed_covers(spans: DataFrame, length: int) -> DataFrame:
    """The same by hashes of all strings of the spans, for anchors with very many surroundings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                data, edges = text_bytes(part.column("text").cast(pa.large_binary()))
                counts = np.maximum(np.diff(edges) - length + 1, 0)
                of = np.repeat(np.arange(part.num_rows), counts)
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = inner + edges[:-1][of]
                where = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column("h").take(where), pa.array(Rolling(data).ranges(at, at + length).view(np.int64)),
                     part.column("t").take(where), part.column("n").take(where),
                     pa.array((inner + part.column("low").to_numpy()[of]).astype(np.int32))], ["h", "w", "t", "n", "low"])

    strings = settle(spans.mapInArrow(run, "h long, w long, t long, n int, low int").distinct())
    one = F.struct("t", "n", "low")
    twice = strings.groupBy("h", "w").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a <> b").select("h", "w")
    return strings.join(twice, ["h", "w"]).select("t", "n", "low", (F.col("low") + length).cast("int").alias("high"))


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """``(t, n, low, high)`` arrays per text of ``(id, t, n, text)``: its removed bytes as sorted disjoint ranges."""
    placed = settle(_anchored(rows, length, gram))
    # settled, so that the join's sides are plain shuffles and a hot anchor can be split
    often = settle(placed.groupBy("h").agg(F.sum("seen").alias("times")).filter("times > 1").select("h"))
    shared = settle(placed.drop("seen").join(often, "h"))
    classes = settle(shared.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t", "n", "at")).alias("one")))
    # whole surroundings that occur twice
    alike = classes.filter("c > 1").select("h", "s")
    whole = shared.join(alike, ["h", "s"]).select(
        "t", "n", F.greatest(F.col("at") + gram - length, F.lit(0)).cast("int").alias("low"),
        F.least(F.col("at") + length, F.col("n")).cast("int").alias("high"))
    # one text per class stands for it where an anchor has a class of its own
    mixed = settle(classes.groupBy("h").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("k")).filter("least = 1"))
    one = F.struct("at", "h", "k")
    # texts are known by hash and length; of equal texts the row with the smallest id answers
    firsts = rows.groupBy("t", "n").agg(F.min("id").alias("id"))
    asked = classes.join(mixed.select("h", "k"), "h").select("h", "k", "one.*").groupBy("t", "n").agg(F.collect_list(one).alias("asked"))
    asked = settle(asked.join(firsts, ["t", "n"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            data, starts = text_bytes(batch.column("text"))
            wanted = batch.column("asked")
            of = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            at = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64) + starts[of]
            low, high = np.maximum(at + gram - length, starts[of]), np.minimum(at + length, starts[of + 1])
            sizes = high - low
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            joined = data[np.arange(edges[-1]) + np.repeat(low - edges[:-1], sizes)]
            texts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(joined)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [flat.field("h"), flat.field("k"), batch.column("t").take(pa.array(of)), batch.column("n").take(pa.array(of)),
                 pa.array((low - starts[of]).astype(np.int32)), texts], ["h", "k", "t", "n", "low", "text"])

    # what is asked for grows with the corpus, so it is joined, never broadcast
    spans = settle(null_safe_join(rows, asked, ["t", "n", "id"]).select("t", "n", "text", "asked").mapInArrow(
        cut, "h long, k long, t long, n int, low int, text binary"))
    ranges = whole.unionByName(_sorted_covers(spans.filter(F.col("k") <= crowded), length))
    many = spans.filter(F.col("k") > crowded)
    if not many.isEmpty():
        ranges = ranges.unionByName(_hashed_covers(many, length))
    gathered = ranges.groupBy("t", "n").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for found in batch.column("ranges"):
                low, high = (found.values.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                new = np.append(True, low[1:] > high[:-1])
                lows.append(low[new])
                highs.append(high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("t"), batch.column("n"), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))], ["t", "n", "low", "high"])

    return settle(gathered.mapInArrow(joined, "t long, n int, low array<int>, high array<int>"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   crowded: int = CROWDED) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept)`` with one row per row of ``docs``; ``kept`` are the bytes left.

    Strings are judged on the input and never cross texts; a repeated row is another text with the
    same strings. Null texts are empty. Null keys stay null. ``length`` is a multiple of eight.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("t"),
        F.octet_length(text_of(F.col(f"`{text}`"))).alias("n"), text_of(F.col(f"`{text}`")).alias("text"))
    found = repeated_ranges(rows, length, gram, crowded)
    small = size_of(docs.sparkSession, found.select("t", "n", F.size("low").alias("a"), F.explode("low").alias("b"))) <= BROADCAST_BYTES
    told = null_safe_join(rows, F.broadcast(found) if small else found, ["t", "n"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            removed, spans, kept = [], [], []
            for whole, low, high in zip(batch.column("text"), batch.column("low"), batch.column("high")):
                data = memoryview(whole.as_buffer())
                low, high = low.as_py() or [], high.as_py() or []
                removed.append(sum(high) - sum(low))
                spans.append(len(low))
                kept.append(b"".join(data[a:b] for a, b in zip([0, *high], [*low, len(data)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n").cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return told.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
