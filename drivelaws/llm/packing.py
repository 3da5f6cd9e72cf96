"""Best-fit packing of tokenized documents into sequences of fixed length.

Hierarchical residual packing: every partition packs its own items best-fit, nearly full bins are
done, and underfull bins meet in fewer partitions as items of the next round.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, settle, text_of, worker_state

CAPACITY = 2048
END_ID = 0
# A bin with at most this much room left is done in any round.
NEARLY_FULL = 2
FAN_IN = 8
ITEMS_PER_TASK = 250_000
CACHED_WORDS = 600_000
# Words repeat more often within larger batches.
BATCH_BYTES = 4 << 20
PIECE = "struct<key:bigint,piece:int,start:bigint,length:bigint,crc:bigint>"

# The tokenizer folds case and drops white space before it merges, so a text's ids are those of its words in turn.
_WORD = re.compile(r"[^ \t\n\r]+")
# A full stop or comma between a letter and white space is a part of its own to the tokenizer.
_STOP = re.compile(r"[.,](?=[ \t\n\r]|$)(?<=[a-zß-öø-ÿ][.,])")
_SPECIAL = "<|"
_LOWER = bytes(32 if b in b"\t\n\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_END = "</w>"


class Generation:
    """Words and their ids, one array for all."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.starts, self.counts, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def add(self, words: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        known = len(self.index)
        self.starts = _room(self.starts, known + len(words))
        self.counts = _room(self.counts, known + len(words))
        self.ids = _room(self.ids, self.used + len(flat))
        self.starts[known:known + len(words)] = self.used + np.cumsum(counts) - counts
        self.counts[known:known + len(words)] = counts
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(words, range(known, known + len(words))))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the words at these places have, and the ids of all in turn."""
        counts = self.counts[at]
        before = np.cumsum(counts) - counts
        return counts, self.ids[np.repeat(self.starts[at] - before, counts) + np.arange(int(counts.sum()))]

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words are; -1 for one not held."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))


def spaced(text: str) -> str:
    """The words with blanks between, stops apart, A to Z lower-cased unless the text may name special tokens, which are told by case."""
    if _SPECIAL in text:
        return " ".join(_WORD.findall(text))
    return _STOP.sub(r" \g<0>", text.encode().translate(_LOWER).decode())


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in turn, and where each text's begin (one more: the end). Arrow splits, no word is an object of Python."""
    split = pc.split_pattern(pa.array(map(spaced, texts), pa.large_string()), " ")
    words, starts = split.values, split.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[starts]


class WordIds:
    """Ids of words in two generations: what is asked for moves to the young one, and when that is full the old one goes."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.young, self.old = Generation(), Generation()
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith(WORD_END)]] = True

    def learn(self, words: list[str]) -> None:
        """Words of letters, with or without a full stop or comma, go as one text; others one by one."""
        ends, rest = [], []
        for w in words:
            if w.isalpha():
                ends.append((w, 1))
            elif w[-1] in ".," and w[:-1].isalpha():
                ends.append((w, 2))
            else:
                rest.append(w)
        for first in range(0, len(ends), 1000):
            self._learn_together(*map(list, zip(*ends[first:first + 1000])))
        self._learn_each(rest)

    def _learn_together(self, words: list[str], ends: list[int]) -> None:
        """One text, cut where its words end; no part ends once more if there are as many ends as expected, and none ends less often."""
        flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        found = np.flatnonzero(self.ends_word[flat])
        last = np.cumsum(ends)
        if len(found) == last[-1]:
            self.young.add(words, np.diff(found[last - 1], prepend=-1), flat)
        else:
            self._learn_each(words)

    def _learn_each(self, words: list[str]) -> None:
        for first in range(0, len(words), 20_000):
            part = words[first:first + 20_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.young.add(part, counts, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each word of the batch is looked up once, however often it stands there."""
        words, starts = split_words(texts)
        coded = words.dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = self.young.places(words)
        missing = np.flatnonzero(at < 0).tolist()
        fresh = [words[i] for i in missing]
        if len(self.young.index) + len(fresh) > self.most // 2:
            self.old, self.young, missing, fresh = self.young, Generation(), list(range(len(words))), words
        before = self.old.places(fresh)
        known = np.flatnonzero(before >= 0).tolist()
        self.young.add([fresh[i] for i in known], *self.old.gather(before[known]))
        self.learn([fresh[i] for i in np.flatnonzero(before < 0).tolist()])
        at[missing] = self.young.places(fresh)
        counts, ids = self.young.gather(at[coded.indices.to_numpy()])
        upto = np.append(0, np.cumsum(counts))[starts].tolist()
        return [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(upto[:-1], upto[1:])]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[:len(array)] = array
    return grown


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, start, length, crc)``: the pieces of every row, cut only where longer than ``capacity``.

    Null and empty texts are one piece that holds the closing id alone; null keys stay null, and
    repeated rows give their pieces each. ``crc`` is of the ids as little-endian unsigned 32 bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(f"words:{tokenizer}", lambda: WordIds(tokenizer))
        for batch in bounded(batches, "text", BATCH_BYTES):
            keys, rows = batch.column("key").to_pylist(), []
            for k, ids in zip(keys, words.encode(batch.column("text").to_pylist())):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    rows.append((k, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["key", "piece", "start", "length", "crc"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_of(F.col(f"`{text}`")).alias("text"))
    return rows.mapInArrow(run, "key long, piece int, start long, length long, crc long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Items by falling size, each into the fullest bin that takes it: items of each bin, and room left.

    Bins are kept by their room, and one bit per room tells which rooms exist.
    """
    bins: list[list[int]] = []
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            least = size + ((fitting & -fitting).bit_length() - 1)
            b = by_room[least].pop()
            if not by_room[least]:
                rooms &= ~(1 << least)
            bins[b].append(i)
            room[b] = least - size
        else:
            b = len(bins)
            bins.append([i])
            room.append(capacity - size)
        if room[b]:
            by_room[room[b]].append(b)
            rooms |= 1 << room[b]
    return bins, room


def _round(capacity: int, spare: int, number: int):
    """One round in a partition: bins in, bins out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        items = pa.Table.from_batches(held).combine_chunks()
        used, contents = items["used"].to_numpy(), items["pieces"].combine_chunks()
        # an order of its own, so that a task that runs again packs alike
        flat, starts = contents.flatten(), contents.offsets.to_numpy() - contents.offsets[0].as_py()
        lead = flat.take(pa.array(starts[:-1]))
        order = np.lexsort([np.nan_to_num(lead.field(f).to_numpy(zero_copy_only=False).astype(float)) for f in ("crc", "piece", "key")])
        bins, room = best_fit(used[order], capacity)
        members = [order[b] for b in bins]
        new = np.array([capacity - r for r in room], np.int64)
        counts = np.diff(starts)
        taken = np.concatenate(members)
        lengths = counts[taken]
        pick = np.repeat(starts[taken] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        per_bin = np.array([counts[m].sum() for m in members])
        offsets = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
        pieces = pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(pick)))
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        table = pa.RecordBatch.from_arrays(
            [pa.array(base + np.arange(len(bins))), pa.array(new), pieces, pa.array(np.array(room) <= spare)],
            ["bin", "used", "pieces", "done"])
        for first in range(0, table.num_rows, 10_000):
            yield table.slice(first, 10_000)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, spare: int = NEARLY_FULL, fan_in: int = FAN_IN,
         items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``(key, piece, start, length, crc, sequence_id, offset)``: every piece with its place in a sequence.

    Whole pieces of ``capacity`` are sequences already. Rounds go on, with ``fan_in`` times fewer
    partitions each, until one partition is left, or until bins that no longer combine fill
    ``items_per_task`` per partition; no task ever takes much more than that. A bin carries its
    pieces, at most ``capacity`` of them as each has a token. An empty table gives an empty result.
    """
    def bins_of(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("length").alias("used"), F.array(F.struct("key", "piece", "start", "length", "crc")).alias("pieces"))

    whole = pieces.filter(F.col("length") == capacity).select(
        "key", "piece", "start", "length", "crc",
        (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items, done, number = bins_of(pieces.filter(F.col("length") < capacity)), [], 0
    count = items.count()
    parts = max(1, -(-count // (items_per_task // fan_in)))
    schema = f"bin long, used long, pieces array<{PIECE}>, done boolean"
    while count:
        packed = settle(items.repartition(parts).mapInArrow(_round(capacity, spare, number), schema))
        left = packed.filter(~F.col("done"))
        remaining = left.count()
        last = parts == 1 or (remaining > 0.98 * count and remaining / parts > items_per_task / 2)
        done.append(packed if last else packed.filter("done"))
        if last:
            break
        items, count, number = left.select("used", "pieces"), remaining, number + 1
        parts = max(1, -(-parts // fan_in), -(-count // items_per_task))
    out = whole
    for packed in done:
        place = F.aggregate(
            F.col("pieces"), F.struct(F.lit(0).cast("long").alias("upto"), F.slice(F.array(F.lit(0).cast("long")), 1, 0).alias("at")),
            lambda s, p: F.struct((s["upto"] + p["length"]).alias("upto"), F.concat(s["at"], F.array(s["upto"])).alias("at")), lambda s: s["at"])
        placed = packed.select("bin", F.inline(F.arrays_zip(F.col("pieces").alias("p"), place.alias("offset"))))
        out = out.unionByName(placed.select("p.*", F.col("bin").alias("sequence_id"), "offset"))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    # a little less than is encoded at once, so that no batch is cut again
    return pack(settle(tokenize(docs, tokenizer, key, text, capacity), BATCH_BYTES * 7 // 8), capacity)
