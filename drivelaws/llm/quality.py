"""Quality rules by repetition coverage.

Every run of n words gets a rolling hash, for several n. What counts is the share of a text's
characters that lie inside runs found twice or more in it, and inside lines equal to an earlier line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, text_of
from .textnp import Rolling, covered, grams, pieces, per_text, repeated, text_bytes, words

# Largest allowed share of word characters inside repeated runs, in percent by run length. Both copies
# count, so a short clean text that says one paragraph twice reaches forty: it has to stay.
GRAM_LIMITS = {5: 50, 7: 48, 10: 45}
# Largest allowed share of word characters inside lines equal to an earlier one, in percent.
LINE_LIMIT = 30
LEAST_WORDS = 50
REPEAT_LIMIT = 50
SYMBOLS = b"#*$%&|<>"


def measure(column: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The figures of a batch of texts, one array per figure."""
    data, starts = text_bytes(column)
    n = len(starts) - 1
    points = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[data], out=symbols[1:])
    rolling = Rolling(data)

    begin, end, of = words(data, starts)
    chars = points[end] - points[begin]
    hashes = rolling.ranges(begin, end)
    out = {
        "n_words": per_text(of, None, n),
        "word_chars": per_text(of, chars, n),
        "n_symbols": symbols[starts[1:]] - symbols[starts[:-1]],
    }
    for length in (3, *lengths):
        found, at = grams(hashes, of, length)
        inside = covered(at[repeated(found, of[at])], length, len(of))
        if length == 3:
            out["n_repeat_words"] = per_text(of[inside], None, n)
        else:
            out[f"chars_{length}"] = per_text(of[inside], chars[inside], n)

    # a line counts only if it has a word; all its bytes decide whether it equals another
    first, last, line_of = pieces(data != 0x0A, starts)
    spoken = np.searchsorted(begin, last, "left") > np.searchsorted(begin, first, "left")
    first, last, line_of = first[spoken], last[spoken], line_of[spoken]
    keys = rolling.ranges(first, last)
    order = np.lexsort((first, keys, line_of))
    again = np.zeros(len(keys), bool)
    again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (line_of[order[1:]] == line_of[order[:-1]])
    out["n_dup_lines"] = per_text(line_of[again], None, n)
    upto = np.concatenate([[0], np.cumsum(chars)])
    line_chars = upto[np.searchsorted(begin, last, "left")] - upto[np.searchsorted(begin, first, "left")]
    out["line_chars"] = per_text(line_of[again], line_chars[again], n)
    return out


def repetition(docs: DataFrame, text: str = "text", gram_limits: dict[int, int] | None = None,
               line_limit: int = LINE_LIMIT) -> DataFrame:
    """The rows with a struct ``quality``: figures, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; ``kept`` is never null. Rows pass through one by one,
    so repeated rows, ties and other columns (whatever their names) stay as they are; a column that is
    already called ``quality`` is replaced. No shuffle.
    """
    limits = dict(GRAM_LIMITS if gram_limits is None else gram_limits)
    lengths = tuple(sorted(limits))
    columns = [c for c in docs.columns if c != "quality"]
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               *(f"chars_{k}" for k in lengths), "line_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "__text"):
            got = measure(batch.column("__text"), lengths)
            figure_arrays = [pa.array(got[f], pa.int64()) for f in figures]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.StructArray.from_arrays(figure_arrays, figures)], ["__row", "quality"])

    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), text_of(F.col(f"`{text}`")).alias("__text"))
    row_type = kept.schema["__row"].dataType.simpleString()
    measured = kept.mapInArrow(run, f"__row {row_type}, quality struct<{', '.join(f'{f}:bigint' for f in figures)}>")
    q = F.col("quality")
    base_failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > REPEAT_LIMIT * q["n_words"])
    bad = 100 * q["line_chars"] > line_limit * q["word_chars"]
    for k, most in limits.items():
        bad = bad | (100 * q[f"chars_{k}"] > most * q["word_chars"])
    return measured.select(
        *(F.col("__row")[c].alias(c) for c in columns),
        q.withField("base_failed", base_failed).withField("kept", ~base_failed & ~bad).alias("quality"))
