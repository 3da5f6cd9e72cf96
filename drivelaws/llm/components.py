"""Connected components of a distributed graph: union-find within tasks, star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: every node with the smallest that it reaches by them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in parent]
    pairs = np.array([p for p in found if p[0] != p[1]], np.int64).reshape(-1, 2)
    for first in range(0, len(pairs), 100_000):
        part = pairs[first:first + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one center and no center has one."""
    n, distinct = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == distinct and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``(u, v)``: the smallest node that it reaches.

    Tasks first reduce their own edges to stars, which are fewer than their nodes. While stars of
    several tasks still hang together, a round ties all larger neighbours of a node to its smallest
    one, then all smaller ones. A node with very many edges is a partial aggregate and a join that can
    be split, never one task. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = settle(edges.filter("u <> v").select("u", "v").mapInArrow(_forest, "u long, v long").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # settled, so that the join's sides are plain shuffles and a node of very many edges can be split
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = settle(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
