"""Crowded buckets of the near-dedup: every pair that shares a bucket has to meet."""

import numpy as np
import pytest

from drivelaws.llm import minhash


@pytest.mark.parametrize("crowded", [2, 3, 100])
def test_pairs_whose_only_shared_band_is_crowded_meet(spark, crowded):
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2 ** 16, minhash.PLACES).astype("<u2")
    rows, sizes, components = [], [100, 100, 90, 130, 70, 100, 101, 102, 103], [0, 0, 0, 0, 4, 5, 5, 7, 8]
    for i, n in enumerate(sizes):
        marks = shared.copy()
        marks[:-minhash.ROWS:minhash.ROWS] = i  # one place of every band but the last
        rows.append((i, n, bytearray(marks.tobytes()), bytearray(np.full(minhash.CELLS, 255, np.uint8).tobytes())))
    nodes = spark.createDataFrame(rows, "node long, n long, marks binary, cells binary")
    found = spark.createDataFrame([(i, c) for i, c in enumerate(components)], "node long, component long")
    out = minhash._unconnected(nodes, found, crowded, 75, None).collect()
    want = {(u, v) for v in range(9) for u in range(v) if components[u] != components[v]
            and 100 * min(sizes[u], sizes[v]) >= 75 * max(sizes[u], sizes[v])}
    assert sorted((r["u"], r["v"]) for r in out) == sorted(want)
