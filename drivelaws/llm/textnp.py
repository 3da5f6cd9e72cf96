"""Words, lines and rolling hashes of many texts at once, on their UTF-8 bytes in numpy.

White space here is ASCII only (tab to carriage return, and the space), so bytes decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# one random odd multiplier and one random value per byte: hashes are the same in every task and run
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUE = _RANDOM.integers(0, 2 ** 64, 256, dtype=np.uint64)
BASE = int(_RANDOM.integers(0, 2 ** 63)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 2 ** 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (one more: the end). Null is empty."""
    column = column if pa.types.is_large_binary(column.type) else pc.fill_null(column.cast(pa.large_string()), "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hash of any byte range in constant time, from sums of byte values times powers of a base."""

    _powers = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(self._powers[0]) <= len(data):
            size = (len(data) // 65536 + 1) * 65536
            Rolling._powers = powers(size, BASE), powers(size, BASE_INVERSE)
        up, self.down = self._powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def pieces(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of true bytes that stay within a text: begins, ends, index of the text."""
    n = len(inside)
    edges = starts[:-1][starts[:-1] < n]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pieces(~SPACE[data], starts)


def per_text(of: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    """Sums (or counts) per text, as whole numbers."""
    return np.bincount(of, weights, n).astype(np.int64)


def grams(word_hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words within a text, and the index of each run's first word."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total *= np.uint64(BASE)
        total += word_hashes[i:i + count]
    at = np.flatnonzero(of[:count] == of[n - 1:])
    return mix(total[at]), at


def repeated(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more within their text."""
    keys = hashes ^ mix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a run of n words that begins at one of ``at``."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change[:-1]) > 0
