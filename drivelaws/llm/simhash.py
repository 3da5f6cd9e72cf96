"""Near-duplicates by SimHash, joined in a space of bit counts.

A fingerprint is embedded as the bit counts of its two-bit segments. The Manhattan distance of two
embeddings is a lower bound of the number of differing bits. The range join under that distance runs
over grids: the segments are cut into blocks, and two embeddings at most ``distance`` apart agree in
all but ``distance`` blocks, so they share a cell of a grid over that many blocks. In a cell the
Manhattan distance, then the bits themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, bounded, crowded_cells, in_groups, settle, text_of, with_blocks
from .components import components
from .textnp import SPACE, mix, text_bytes, words

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7
# Cells with more fingerprints than this are cut into blocks of about so many.
CROWDED = 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_ODD = np.uint64(0x5555555555555555)


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, repeats included, and the text of each. Fewer words: the whole sequence."""
    data, starts = text_bytes(column)
    data = _LOWER[data]
    begin, end, of = words(data, starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # words of a text, each with one space behind it where another word of the text follows
    keep = ~SPACE[data]
    behind = end[:-1][of[1:] == of[:-1]]
    data[behind], keep[behind] = 0x20, True
    place = np.cumsum(keep) - 1
    joined = data[keep].tobytes()
    first, last = place[begin], place[end - 1] + 1
    n = np.bincount(of, minlength=len(starts) - 1)
    lead = np.cumsum(n) - n
    at = np.flatnonzero(of[:len(of) - SHINGLE + 1] == of[SHINGLE - 1:]) if len(of) >= SHINGLE else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    a = np.concatenate([first[at], first[lead[short]]])
    b = np.concatenate([last[at + SHINGLE - 1], last[lead[short] + n[short] - 1]])
    whose = np.concatenate([of[at], short])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(a))
    order = np.argsort(whose, kind="stable")
    return hashes[order], whose[order]


def fingerprints(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """One fingerprint per text: a bit is set where over half of its hashes have it. No hashes: zero."""
    counts = np.zeros((n, 64), np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part, whose = hashes[first:first + (1 << 16)], of[first:first + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
        counts[whose[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    total = np.bincount(of, minlength=n)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def embedded(fingerprint: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments in unary: 00, 01 or 11, so that differing bits are the Manhattan distance."""
    low, high = fingerprint & _ODD, (fingerprint >> np.uint64(1)) & _ODD
    return (low | high) | ((low & high) << np.uint64(1))


def grids(blocks: int, distance: int) -> list[int]:
    """Masks of the embeddings' coordinates that each grid looks at."""
    edges = [32 * i // blocks for i in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges[:-1], edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - distance)]


def _cells(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """``(cell, fp)``: every fingerprint in its cell of every grid."""
    masks = np.array(grids(blocks, distance), np.uint64)
    salts = mix(np.arange(1, len(masks) + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            code = embedded(fp.view(np.uint64))
            cells = mix((code[:, None] & masks[None, :]) + salts[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().view(np.int64)), pa.array(np.repeat(fp, len(masks)))], ["cell", "fp"])

    return fps.mapInArrow(run, "cell long, fp long")


def _near(code: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    ok = np.bitwise_count(code[i] ^ code[j]) <= distance
    ok[ok] = np.bitwise_count(fp[i[ok]] ^ fp[j[ok]]) <= distance
    return ok


def _spread(fp: np.ndarray, code: np.ndarray, part: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what hangs together in one large cell: each row is reached once, so they are fewer than its rows."""
    us, vs, left = [], [], np.arange(len(fp))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = np.bitwise_count(code[now][:, None] ^ code[left][None, :]) <= distance
            i, j = np.nonzero(near & ((part[now][:, None] < 0) | (part[now][:, None] != part[left][None, :])))
            ok = np.bitwise_count(fp[now[i]] ^ fp[left[j]]) <= distance
            j, at = np.unique(j[ok], return_index=True)
            us.append(fp[now[i[ok][at]]])
            vs.append(fp[left[j]])
            front = np.concatenate([front, left[j]])
            left = np.delete(left, j)
    return np.concatenate([np.zeros(0, np.uint64), *us]), np.concatenate([np.zeros(0, np.uint64), *vs])


def linked(group: np.ndarray, fp: np.ndarray, part: np.ndarray, distance: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group at most ``distance`` bits apart, enough to join all that hang together in it.

    ``group`` is in order. Rows of part 0 and 1 meet across only, of part -1 all. Groups of up to
    ``small`` rows are compared together, row by row at growing steps.
    """
    code = embedded(fp)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    us, vs = [], []
    for g in np.flatnonzero(sizes > small).tolist():
        rows = slice(starts[g], starts[g] + sizes[g])
        u, v = _spread(fp[rows], code[rows], part[rows], distance)
        us.append(u)
        vs.append(v)
    few = np.where(sizes > small, 0, sizes)
    after = np.repeat(starts + few, sizes)  # where the small group of each row ends
    i = np.arange(len(group))
    step = 1
    while len(i):
        i = i[i + step < after[i]]
        ok = (part[i] < 0) | (part[i] != part[i + step])
        a = i[ok]
        a = a[_near(code, fp, a, a + step, distance)]
        us.append(fp[a])
        vs.append(fp[a + step])
        step += 1
    return np.concatenate(us), np.concatenate(vs)


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """``(u, v)`` from ``(task, fp, part)``, the rows of one task key within one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, "task"):
            task, fp, part = (table[c].to_numpy() for c in ("task", "fp", "part"))
            u, v = linked(task, fp.view(np.uint64), part, distance)
            for first in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[first:first + 100_000].view(np.int64)) for x in (u, v)], ["u", "v"])

    dealt = rows.select("task", "fp", "part").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "u long, v long")


def near_fingerprints(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowded: int = CROWDED) -> DataFrame:
    """``(node, component)`` of all fingerprints (``fp``, distinct) that have a link: the smallest that they reach.

    All rows of a cell meet in one task. A crowded cell is cut into blocks: first each block for
    itself, dealt anew in every grid; of cells that this leaves in several components every two blocks
    then meet in a task of their own.
    """
    cells = _cells(fps, blocks, distance)
    crowd = crowded_cells(cells, "cell", crowded)
    if crowd is None:
        return components(_links(cells.select(F.col("cell").alias("task"), "fp", F.lit(-1).alias("part")), distance))
    dealt = with_blocks(cells, crowd, "cell").withColumn("block", block_of("fp", "cell"))
    alone = dealt.select(F.xxhash64("cell", "block").alias("task"), "fp", F.lit(-1).alias("part"))
    links = settle(_links(alone, distance))
    of = components(links).select(F.col("node").alias("fp"), "component")
    many = settle(dealt.filter("blocks > 1").join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    mixed = many.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("cell")
    rest = settle(many.join(settle(mixed), "cell", "left_semi"))
    pairs = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block <> other").select(
        F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "fp",
        (F.col("block") > F.col("other")).cast("int").alias("part"))
    return components(links.unionByName(_links(pairs, distance)))


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp)`` per row of ``docs``; the unsigned 64 bits as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            hashes, of = shingle_hashes(batch.column("text"))
            fp = fingerprints(hashes, of, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE,
                    blocks: int = BLOCKS, crowded: int = CROWDED) -> DataFrame:
    """``(key, fingerprint, component_id)`` with one row per row of ``docs``.

    Rows link where their fingerprints differ in at most ``distance`` bits (fewer than ``blocks``); no
    link is lost. Null, empty and blank texts have the fingerprint zero and link like any other. A
    component is named by its smallest key, null keys aside (null if it has no other). Repeated rows
    share their component; other columns take no part; an empty table gives an empty result.
    """
    rows = settle(fingerprinted(docs, key, text))
    fps = settle(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = near_fingerprints(fps.select("fp"), distance, blocks, crowded)
    labelled = settle(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = settle(labelled.join(settle(least), "component").select("fp", "component_id"))
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
