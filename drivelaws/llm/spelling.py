"""Spelling variants: words one edit apart, by Gram matrices of letter counts.

With letters dealt into a few groups, an edit touches at most two groups, so two near words have equal
letter counts in all others: every pair of groups makes blocks of words with the same counts outside
the pair. Within a block NumPy products of the letter counts give all squared distances; pairs at most
two apart, in adjacent lengths, are verified letter by letter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, bounded, crowded_cells, in_groups, settle, text_of, with_blocks
from .textnp import mix

LEAST_LENGTH = 5
LEAST_COUNT = 3
DROP_EVERY = 97
FORM_TIMES = 2
GROUPS = 5
# Blocks with more words than this are cut, and every two cuts meet.
CROWDED = 20_000
HELD_WORDS = 200_000
TILE = 256
TILE_BYTES = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
# lower-cased runs hold these letters only, one byte each in Latin-1
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
_COLUMN = np.full(256, -1, np.int64)
_COLUMN[LETTERS] = np.arange(len(LETTERS))
_VALUE = mix(np.arange(1000, 1000 + len(LETTERS), dtype=np.uint64))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: words of five letters and more with all their occurrences, summed within tasks first.

    Shorter runs can't become such words, as a run only ever loses a letter. A null key hashes like an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for first in range(0, len(names), 50_000):
                part = names[first:first + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
            held.clear()

        for batch in bounded(batches, "text"):
            for doc, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                before = crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(_RUN.findall(value.encode().translate(_LOWER).decode())).items():
                    h = crc32(word.encode(), before)
                    if h % DROP_EVERY == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1:]
                        if len(word) < LEAST_LENGTH:
                            continue
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield from told()
        yield from told()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' columns of all words in turn, the word of each, and the words' lengths."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    return _COLUMN[np.frombuffer(b"".join(raw), np.uint8)], np.repeat(np.arange(len(raw)), lengths), lengths


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """The group of each letter: letters by falling frequency, each to the group with the fewest so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LETTERS), np.int64)
        for batch in batches:
            total += np.bincount(letters_of(batch.column("word").to_pylist())[0], minlength=len(LETTERS))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(LETTERS))), pa.array(total)], ["letter", "n"])

    counts = np.zeros(len(LETTERS), np.int64)
    for r in words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        counts[r["letter"]] = r["n"]
    of, held = np.zeros(len(LETTERS), np.int64), np.zeros(groups, np.int64)
    for letter in np.argsort(-counts, kind="stable").tolist():
        of[letter] = held.argmin()
        held[of[letter]] += counts[letter] + 1
    return of


def _cells(words: DataFrame, of: np.ndarray, groups: int) -> DataFrame:
    """``(cell, pair, word, n)``: every word in one block per pair of groups, by its letter counts outside the pair."""
    pairs = np.array(list(combinations(range(groups), 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            letter, whose, _ = letters_of(names)
            sums = np.zeros((len(names), groups), np.uint64)
            np.add.at(sums, (whose, of[letter]), _VALUE[letter])
            rest = sums.sum(1, dtype=np.uint64)[:, None] - sums[:, pairs[:, 0]] - sums[:, pairs[:, 1]]
            cells = mix(rest + mix(np.arange(1, len(pairs) + 1, dtype=np.uint64))[None, :])
            each = pa.array(np.repeat(np.arange(len(names)), len(pairs)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel().view(np.int64)), pa.array(np.tile(np.arange(len(pairs), dtype=np.int32), len(names))),
                 batch.column("word").take(each), batch.column("n").take(each)], ["cell", "pair", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "cell long, pair int, word string, n long")


def one_edit(letters: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j (rows of padded letters; j at most one longer) differ by exactly one edit."""
    out = np.zeros(len(i), bool)
    step = max(1, TILE_BYTES // max(letters.shape[1], 1))
    for first in range(0, len(i), step):
        a, b = letters[i[first:first + step]], letters[j[first:first + step]]
        differs = a != b
        same = length[i[first:first + step]] == length[j[first:first + step]]
        # behind the first difference the longer word goes on as the shorter one, one place later
        late = np.maximum.accumulate(differs, axis=1)
        shifted = (a[:, :-1] != b[:, 1:]) & late[:, :-1]
        out[first:first + step] = np.where(same, differs.sum(1) == 1, ~shifted.any(1) & differs.any(1))
    return out


def near_pairs(names: list[str], cell: np.ndarray, pair: np.ndarray, part: np.ndarray, of: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one cell, one edit apart, each in the one block that the touched groups name.

    Rows are in order of cell and length. Tiles of rows take in several small cells; a row meets the
    rows behind it, in its cell and at most one letter longer. Parts 0 and 1 meet across only.
    """
    pairs = np.array(list(combinations(range(groups), 2)))
    member = np.zeros((len(LETTERS), groups), np.float32)
    member[np.arange(len(LETTERS)), of] = 1
    letter, whose, length = letters_of(names)
    n = len(names)
    starts = np.append(0, np.cumsum(length))
    new_cell = np.append(True, cell[1:] != cell[:-1])
    number = np.cumsum(new_cell) - 1
    cell_end = np.append(np.flatnonzero(new_cell)[1:], n)[number]
    # the last row that any row may meet: same cell, at most one letter longer
    most = int(length.max()) + 2
    reach = np.minimum(np.searchsorted(number * most + length, number * most + length + 1, "right"), cell_end)
    found_i, found_j = [], []

    def padded(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        own, at = length[lo:hi], slice(starts[lo], starts[hi])
        letters = np.zeros((hi - lo, int(own.max()) + 1), np.uint8)
        letters[whose[at] - lo, np.arange(starts[lo], starts[hi]) - starts[whose[at]]] = letter[at] + 1
        # products of longer words than this would leave the whole numbers of 32-bit floats
        counts = np.bincount((whose[at] - lo) * len(LETTERS) + letter[at], minlength=(hi - lo) * len(LETTERS)).reshape(hi - lo, -1)
        return letters, counts.astype(np.float32 if own.max() < 2000 else np.float64)

    lo = 0
    while lo < n:
        hi = min(lo + TILE, n)
        while hi > lo + 1 and (hi - lo) * int(length[lo:hi].max()) > TILE_BYTES:
            hi = lo + (hi - lo) // 2
        # a tile is whole where cells are small: what its last rows reach comes as further columns
        end = int(reach[lo:hi].max())
        letters, counts = padded(lo, hi)
        norm = (counts * counts).sum(1)
        for c in range(lo, end, 4 * TILE):
            d = min(c + 4 * TILE, end)
            other_letters, other = padded(c, d)
            near = norm[:, None] + (other * other).sum(1)[None, :] - 2 * (counts @ other.T) <= 2
            i, j = np.nonzero(near)
            i, j = i + lo, j + c
            ok = (j > i) & (j < reach[i]) & (pair[i] == pair[j]) & ((part[i] < 0) | (part[i] != part[j]))
            i, j = i[ok], j[ok]
            touched = np.abs(counts[i - lo] - other[j - c]) @ member > 0
            two = touched.sum(1)
            first, last = touched.argmax(1), groups - 1 - touched[:, ::-1].argmax(1)
            # one touched group counts in its pair with the next (the last with the first)
            last = np.where(two == 1, (first + 1) % groups, last)
            at = pairs[pair[i]]
            ok = (two > 0) & (np.minimum(first, last) == at[:, 0]) & (np.maximum(first, last) == at[:, 1])
            i, j = i[ok], j[ok]
            if len(i):
                wide = max(letters.shape[1], other_letters.shape[1])
                both = np.zeros((hi - lo + d - c, wide), np.uint8)
                both[:hi - lo, :letters.shape[1]], both[hi - lo:, :other_letters.shape[1]] = letters, other_letters
                sizes = np.concatenate([length[lo:hi], length[c:d]])
                ok = one_edit(both, sizes, i - lo, j - c + hi - lo)
                found_i.append(i[ok])
                found_j.append(j[ok])
        lo = hi
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _neighbours(dealt: DataFrame, of: np.ndarray, groups: int) -> DataFrame:
    """``(word, n_near, best_n, best)`` per block: how many near words, and the most frequent, smallest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, "task"):
            # one part of a cut block is before the other in every length, so that shorter words come first
            task, pair, n, part = (table[c].to_numpy() for c in ("task", "pair", "n", "part"))
            names = table["word"].to_pylist()
            i, j = near_pairs(names, task, pair, part, of, groups)
            if not len(i):
                continue
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
            used = np.unique(i)
            rank = np.zeros(len(names), np.int64)
            by_name = sorted(used.tolist(), key=names.__getitem__)
            rank[by_name] = np.arange(len(by_name))
            order = np.lexsort((rank[j], -n[j], i))
            i, j = i[order], j[order]
            lead = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            words = table["word"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(i[lead])), pa.array(np.diff(np.append(lead, len(i)))), pa.array(n[j[lead]]), words.take(pa.array(j[lead]))],
                ["word", "n_near", "best_n", "best"])

    rows = dealt.select("task", "pair", "word", "n", "part", F.length("word").alias("size"))
    rows = rows.repartition("task").sortWithinPartitions("task", "size", "word")
    return rows.mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, groups: int = GROUPS, crowded: int = CROWDED) -> DataFrame:
    """``(word, n_near, best_n, best)`` of every word of ``(word, n)`` that has near words."""
    of = letter_groups(words, groups)
    cells = _cells(words, of, groups)
    crowd = crowded_cells(cells, "cell", crowded)
    if crowd is None:
        dealt = cells.select(F.col("cell").alias("task"), "pair", "word", "n", F.lit(-1).alias("part"))
    else:
        blocks = with_blocks(cells, crowd, "cell").withColumn("block", block_of("word"))
        met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        alone = F.col("block") == F.col("other")
        dealt = met.select(
            F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))).alias("task"),
            "pair", "word", "n", F.when(alone, -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("part"))
    found = _neighbours(dealt, of, groups)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("one")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("one.less")).alias("best_n"), F.col("one.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``, each form followed to its last by doubling the step."""
    at = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = settle(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, times: int = FORM_TIMES,
             groups: int = GROUPS, crowded: int = CROWDED) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word with at least ``least_count`` occurrences.

    A word's form is its near word with the most occurrences (the smallest of equals), if it has at
    least ``times`` as many; the root is the last form of forms, or the word. Null and empty texts have
    no words, repeated rows count each, other columns take no part, an empty table gives an empty result.
    """
    words = settle(word_counts(docs, key, text).filter(F.col("n") >= least_count))
    near = settle(near_words(words, groups, crowded))
    formed = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= times * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n"))).alias("found")))
    last = roots(formed.filter("found is not null").select("word", "found.form"))
    return formed.join(last, "word", "left").select(
        "word", "found.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "found.form_n")
