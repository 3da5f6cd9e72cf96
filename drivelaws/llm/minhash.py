"""Near-duplicates by SuperMinHash.

An element of a set is ranked by one random permutation of all signature places, so its values are
spread without repeats, and a signature is done as soon as every place is filled by earlier ranks.
Bands of the signature propose pairs, full sets confirm them, components group them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, null_safe_join, settle, size_of, text_key, text_of, unclashed
from .components import components
from .textnp import BASE, Rolling, grams, mix, per_text, text_bytes, words

SHINGLE = 5
SIMILAR = 75  # percent
ROWS, BANDS = 4, 40
PLACES = ROWS * BANDS
# Buckets with more texts than this, not yet in one component, are cut into blocks of about so many.
CROWDED = 2000
CELLS = 1024
# Of the pairs of two components in a bucket so many are confirmed first: one link makes the others needless.
FIRST_PAIRS = 8
# Pairs are confirmed on full sets unless their signatures share so few places that a similar pair
# does so once in three million: five deviations below what is expected.
LEAST_SHARED = int(PLACES * SIMILAR / 100 - 5 * (PLACES * SIMILAR / 100 * (1 - SIMILAR / 100)) ** 0.5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_EMPTY = np.iinfo(np.uint64).max


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text, the text of each, and two hashes of each text's words in turn."""
    data, starts = text_bytes(column)
    data, n = _LOWER[data], len(starts) - 1
    begin, end, of = words(data, starts)
    hashes = Rolling(data).ranges(begin, end)
    found, at = grams(hashes, of, SHINGLE)
    counts = per_text(of, None, n)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = counts[short].astype(np.uint64)
    for i in range(SHINGLE - 1):
        has = counts[short] > i
        whole[has] = whole[has] * np.uint64(BASE) + hashes[first[short][has] + i]
    found, of_found = np.concatenate([found, mix(whole)]), np.concatenate([of[at], short])
    order = np.lexsort((found, of_found))
    found, of_found = found[order], of_found[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of_found[1:] != of_found[:-1])
    # the words in turn: a sum over places of hash and place mixed
    place = np.arange(len(of), dtype=np.uint64) - np.repeat(first, counts).astype(np.uint64)
    sequence = np.zeros((2, n), np.uint64)
    for k in range(2):
        each = mix(hashes * np.uint64(2 * k + 3) + mix(place + np.uint64(k << 40)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        sequence[k] = sums[first + counts] - sums[first]
    return found[fresh], of_found[fresh], sequence[0], sequence[1]


def signatures(elements: np.ndarray, of: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of n sets: rank in the high, random part in the low 32 bits of each place."""
    signature = np.full(n * places, _EMPTY, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    order = None
    for rank in range(places):
        drawn = mix(elements + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) & (2 ** 64 - 1)))
        pick = rank + ((drawn >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            place = order[np.arange(len(elements)), pick].astype(np.int64)
        np.minimum.at(signature, of * places + place, np.uint64(rank << 32) | (drawn & low))
        open_sets = (signature.reshape(n, places) == _EMPTY).any(1)
        still = open_sets[of]
        if not still.any():
            break
        if order is None:
            order = np.broadcast_to(np.arange(places, dtype=np.uint16), (int(still.sum()), places)).copy()
        else:
            order = order[still]
        elements, of, pick = elements[still], of[still], pick[still]
        order[np.arange(len(elements)), pick] = order[:, rank]
    return signature.reshape(n, places)


def marks_of(signature: np.ndarray) -> np.ndarray:
    """Sixteen bits of each place: enough for bands of four and to count the places that two sets share."""
    return (mix(signature.copy()) >> np.uint64(48)).astype("<u2")


def band_keys(marks: np.ndarray) -> np.ndarray:
    """One hash per band, by set; bands never share keys."""
    parts = marks.reshape(len(marks), -1, ROWS).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for i in range(ROWS):
        keys = (keys << np.uint64(16)) | parts[:, :, i]
    return mix(mix(keys) + np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(BASE))


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<u2").reshape(-1, PLACES)


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Shingles by ten bits of their hashes. The smaller counts of two sets bound what they share from above."""
    counts = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8)


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            n = batch.num_rows
            found, of, one, two = shingle_sets(batch.column("text"))
            sizes = np.bincount(of, minlength=n)
            marks = [m.tobytes() for m in marks_of(signatures(found, of, n))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.array(sizes), pa.array(marks, pa.binary())], ["id", "t1", "t2", "w1", "w2", "n", "marks"])

    t1, t2 = text_key(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), t1.alias("t1"), t2.alias("t2"), text_of(F.col(f"`{text}`")).alias("text"))
    return settle(rows.mapInArrow(run, "id long, t1 long, t2 long, w1 long, w2 long, n long, marks binary"))


def _sets(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """``(node, shingles)``: the full sets of the named nodes, from one row of their text each."""
    t1, t2 = text_key(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), t1.alias("t1"), t2.alias("t2"), text_of(F.col(f"`{text}`")).alias("text"))
    small = size_of(docs.sparkSession, nodes) <= BROADCAST_BYTES
    joined = null_safe_join(rows, F.broadcast(nodes) if small else nodes, ["t1", "t2", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found, of, _, _ = shingle_sets(batch.column("text"))
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1))
            sets = [found[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1], edges[1:])]
            cells = [histogram(found[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary()), pa.array(cells, pa.binary())], ["node", "shingles", "cells"])

    # repeated rows of one key and text give the same set again
    sets = joined.select("node", "text").mapInArrow(run, "node long, shingles binary, cells binary")
    return settle(sets.groupBy("node").agg(F.min("shingles").alias("shingles"), F.min("cells").alias("cells")))


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v")):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= similar * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v").join(left, "u").join(right, "v").mapInArrow(run, "u long, v long")


def _close(n: str, m: str, similar: int):
    """Sizes that allow the similarity."""
    return (100 * F.least(n, m) >= similar * F.greatest(n, m))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR, crowded: int = CROWDED) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` with one row per row of ``docs``.

    Texts with the same words are one node. In every band bucket all nodes meet the bucket's first
    one; nodes of a bucket that this leaves in different components then meet each other, so a bucket
    of copies costs its length, not its square. A pair of similarity 0.75 shares no band at all with
    probability 3e-7; nothing else is lost. Null and empty texts have no shingles and no links. Null
    keys count as the last of their component; repeated rows share its id.
    """
    out = grouped(docs, key, text, similar, crowded)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR, crowded: int = CROWDED) -> DataFrame:
    """The rows of ``docs``, one per group of near-duplicates: the one with the smallest key.

    Texts without words are in no group and all stay; of rows that repeat key and text one stays. Null keys
    come last. Other columns, whatever their names, stay as they are. An empty table gives an empty result.
    """
    docs, names = unclashed(docs)
    key, text = names[key], names[text]
    rows = grouped(docs, key, text, similar, crowded)
    one = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "t1", "t2")).alias("one")
    chosen = rows.filter("group is not null").groupBy("group").agg(one).select("one.id", "one.t1", "one.t2").withColumn("alone", F.lit(True))
    chosen = settle(chosen.unionByName(
        rows.filter("group is null").select("id", "t1", "t2").distinct().withColumn("alone", F.lit(False))))
    t1, t2 = text_key(F.col(f"`{text}`"))
    named = {"id": "__id", "t1": "__t1", "t2": "__t2", "alone": "__alone"}
    keyed = docs.withColumns({"__id": F.col(f"`{key}`").cast("long"), "__t1": t1, "__t2": t2})
    chosen = chosen.withColumnsRenamed(named)
    small = size_of(docs.sparkSession, chosen) <= BROADCAST_BYTES
    left = null_safe_join(keyed, F.broadcast(chosen) if small else chosen, ["__id", "__t1", "__t2"])
    # only rows that repeat both key and text still stand for one document
    repeats = rows.filter("group is not null").groupBy("id", "t1", "t2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    repeats = settle(repeats.select("id", "t1", "t2", F.lit(True).alias("again")).withColumnsRenamed(named))
    small = size_of(docs.sparkSession, repeats) <= BROADCAST_BYTES
    marked = null_safe_join(left, F.broadcast(repeats) if small else repeats, ["__id", "__t1", "__t2"], "left")
    again = F.col("again").isNotNull() & F.col("__alone")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = marked.filter(again).dropDuplicates(["__id", "__t1", "__t2"])
    return marked.filter(~again).select(*columns).unionByName(once.select(*columns)).toDF(*names)


def grouped(docs: DataFrame, key: str, text: str, similar: int, crowded: int) -> DataFrame:
    """``(id, t1, t2, n, group, component_id)`` per row; texts without words have no group."""
    rows = _signed(docs, key, text)
    by_sequence = rows.filter("n > 0").groupBy("w1", "w2").agg(
        F.min("id").alias("first_id"), F.min(F.struct(F.col("id").isNull().alias("late"), "id", "t1", "t2", "n", "marks")).alias("one"))
    nodes = settle(by_sequence.select(
        F.monotonically_increasing_id().alias("node"), "w1", "w2", "first_id", "one.id", "one.t1", "one.t2", "one.n", "one.marks"))
    banded = _banded(nodes.select("node", "n", "marks"))

    # star: every node of a bucket with the bucket's first
    # (settled, so that the join's sides are plain shuffles and a hot bucket can be split)
    heads = settle(banded.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    star = banded.join(heads.select("bucket", F.col("head.node").alias("v"), F.col("head.n").alias("m")), "bucket").filter(
        F.col("node") != F.col("v"))
    met = settle(star.groupBy(F.col("node").alias("u"), "v").agg(F.first("n").alias("n"), F.first("m").alias("m")))
    named = settle(met.select(F.col("u").alias("node")).union(met.select("v")).distinct())
    wanted = settle(nodes.join(named, "node", "left_semi").select("node", "t1", "t2", "id"))
    sets = _sets(docs, wanted, key, text)
    links = settle(_confirmed(met.filter(_close("n", "m", similar)), sets, similar))

    # rest: nodes of one bucket that are not yet connected; first the likeliest pairs of each two
    # components, then whatever pairs are left between those that this has not joined
    told = settle(nodes.join(sets.select("node", "cells"), "node").select("node", "n", "marks", "cells"))
    checked = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    for first_pairs in (FIRST_PAIRS, None):
        rest = _unconnected(told, components(links), crowded, similar, first_pairs)
        pairs = settle(rest.select("u", "v").distinct().join(checked, ["u", "v"], "left_anti"))
        checked = checked.unionByName(pairs)
        links = links.unionByName(settle(_confirmed(pairs, sets, similar)))
        if rest.filter("more").isEmpty():  # nothing is left
            break

    found = components(links)
    labelled = nodes.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    firsts = labelled.groupBy("group").agg(F.min("first_id").alias("component_id"))
    by_words = settle(labelled.join(firsts, "group").select("w1", "w2", "group", "component_id"))
    out = rows.drop("marks").join(by_words, ["w1", "w2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "t1", "t2", "n", F.when(F.col("n") > 0, F.col("group")).alias("group"), own.alias("component_id"))


def _banded(nodes: DataFrame) -> DataFrame:
    """``(node, n, band, bucket)`` of ``(node, n, marks)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_marks(batch.column("marks")))
                each = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(each), batch.column("n").take(each),
                     pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), batch.num_rows)), pa.array(keys.ravel().view(np.int64))],
                    ["node", "n", "band", "bucket"])

    return nodes.mapInArrow(run, "node long, n long, band int, bucket long")


def _blocks(rows: DataFrame, crowded: int, similar: int) -> DataFrame:
    """``(bucket, node, n, component, part)``: crowded buckets as pairs of blocks, each a bucket of its own.

    A bucket is cut by its largest component and the rest, by classes of size, and these by hash into
    blocks. Every two blocks meet, and each with itself, unless both are of the largest component or no
    size of one allows the similarity with a size of the other. All counts are partial sums.
    """
    base = max(1.05, 100 / max(similar, 1))
    each = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = settle(each.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top")).select("bucket", F.col("top.component").alias("largest")))
    classed = settle(rows.join(largest, "bucket").select(
        "bucket", "node", "n", "component", (F.col("component") != F.col("largest")).alias("rest"),
        F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(base))).cast("int").alias("class")))
    by = ["bucket", "rest", "class"]
    groups = settle(classed.groupBy(*by).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(crowded)).cast("int").alias("blocks"), F.min("n").alias("low"), F.max("n").alias("high")))
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = F.struct("rest", "class", "block").alias("one")
    a, b = every.select("bucket", held, "low", "high"), every.select("bucket", held.alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = (F.col("one") <= F.col("two")) & (F.col("one.rest") | F.col("two.rest"))
    meet &= (100 * F.col("high") >= similar * F.col("low2")) & (100 * F.col("high2") >= similar * F.col("low"))
    met = settle(a.join(b, "bucket").filter(meet).select("bucket", "one", "two", F.xxhash64("bucket", "one", "two").alias("task")))
    alone = F.col("one") == F.col("two")
    members = met.select("bucket", F.col("one").alias("at"), "task", F.when(alone, -1).otherwise(0).alias("part")).unionByName(
        met.filter(~alone).select("bucket", F.col("two").alias("at"), "task", F.lit(1).alias("part")))
    members = settle(members.select("bucket", "at.*", "task", "part"))
    placed = settle(classed.join(groups.select(*by, "blocks"), by).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).drop("blocks"))
    return placed.join(members, [*by, "block"]).select(F.col("task").alias("bucket"), "node", "n", "component", "part")


def _compare(table: pa.Table, similar: int, first_pairs: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one bucket (of its two parts, if it has them) in different components whose sizes, signatures and histograms allow the similarity.

    With ``first_pairs`` the likeliest of each two components only, and whether there are more.
    """
    node, n, component, part = (table[c].to_numpy() for c in ("node", "n", "component", "part"))
    marks, us, vs, likely = _marks(table["marks"].combine_chunks()), [], [], []
    cells = np.frombuffer(b"".join(x.as_py() for x in table["cells"].combine_chunks()), np.uint8).reshape(-1, CELLS)
    full = (cells == 255).any(1)
    for first in range(0, len(node), 32):
        rows = slice(first, first + 32)
        open_ = (component[rows, None] != component[None, :]) & (node[rows, None] < node[None, :])
        open_ &= (part[rows, None] != part[None, :]) | (part[rows, None] < 0)
        open_ &= 100 * np.minimum(n[rows, None], n[None, :]) >= similar * np.maximum(n[rows, None], n[None, :])
        i, j = np.nonzero(open_)
        for k in range(0, len(i), 20_000):
            a, b = i[k:k + 20_000] + first, j[k:k + 20_000]
            places = (marks[a] == marks[b]).sum(1)
            near = places >= LEAST_SHARED
            a, b, places = a[near], b[near], places[near]
            most = np.minimum(cells[a], cells[b]).sum(1, dtype=np.int64)
            near = (100 * most >= similar * (n[a] + n[b] - most)) | full[a] | full[b]
            us.append(a[near])
            vs.append(b[near])
            likely.append(places[near])
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    more = False
    a, b, places = np.concatenate(us), np.concatenate(vs), np.concatenate(likely)
    if first_pairs is not None and len(a):
        low, high = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
        order = np.lexsort((b, a, -places, high, low))
        low, high = low[order], high[order]
        new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        more = bool((rank >= first_pairs).any())
        order = order[rank < first_pairs]
        a, b = a[order], b[order]
    return node[a], node[b], more


def _compared(rows: DataFrame, similar: int, first_pairs: int | None) -> DataFrame:
    """``(u, v, more)`` from ``(bucket, node, n, component, part, marks, cells)``, each bucket within one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def pairs() -> pa.RecordBatch:
            u, v, more = _compare(pa.concat_tables(held), similar, first_pairs)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array([more] * len(u), pa.bool_())], ["u", "v", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
            for first, end in zip(cuts[:-1], cuts[1:]):
                if held and bucket[first] != last:
                    yield pairs()
                    held = []
                held.append(pa.Table.from_batches([batch.slice(first, end - first)]))
                last = bucket[first]
        if held:
            yield pairs()

    return rows.repartition("bucket").sortWithinPartitions("bucket").select(
        "bucket", "node", "n", "component", "part", "marks", "cells").mapInArrow(
        run, "u long, v long, more boolean")


def _unconnected(nodes: DataFrame, found: DataFrame, crowded: int, similar: int, first_pairs: int | None) -> DataFrame:
    """``(u, v, more)``: pairs that share a bucket, are in different components and may be similar.

    They are told apart by signature within the bucket's task, so none but likely ones come out. A
    crowded bucket is cut into blocks, of which every two that may hold such a pair meet in a task.
    """
    joined = settle(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    marks = joined.select("node", "marks", "cells")
    rows = _banded(joined.select("node", "n", "marks")).join(joined.select("node", "component"), "node")
    mixed = settle(rows.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high"))
    rows = settle(rows.join(mixed.select("bucket", "size"), "bucket"))
    few = rows.filter(F.col("size") <= crowded).select("bucket", "node", "n", "component", F.lit(-1).alias("part"))
    many = rows.filter(F.col("size") > crowded)
    if not many.isEmpty():
        few = few.unionByName(settle(_blocks(many, crowded, similar)))
    return settle(_compared(few.join(marks, "node"), similar, first_pairs).groupBy("u", "v").agg(F.max("more").alias("more")))
