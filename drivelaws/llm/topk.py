"""Exact top-k search by inner product with dual cover trees.

Spark deals queries and data into blocks and pairs every block of queries with every block of data.
In a pair both sides are indexed together, and pairs of nodes are pruned by their covering radii
against the worst k-th score of the query node. The k best of each pair then meet per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

DATA_BLOCK = 8192
QUERY_BLOCK = 4096
LEAF = 96
CHILDREN = 12
# Rows that a query leaf meets in one product: a pair that can't be pruned costs little more than the product.
PRODUCT = 4096


class Node:
    """A point, the radius that covers all points below it, and the nodes or rows below."""

    __slots__ = ("center", "norm", "radius", "children", "rows")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray):
        self.center, self.radius, self.rows = center, radius, rows
        self.norm = float(np.sqrt(center @ center))
        self.children: list[Node] = []


def cover_tree(points: np.ndarray, rows: np.ndarray) -> Node:
    """Children are chosen farthest first, so they are at least as far apart as the radius that covers them."""
    center = points[rows[0]]
    distance = np.sqrt(((points[rows] - center) ** 2).sum(1))
    root = Node(center, float(distance.max()), rows)
    open_nodes = [(root, distance)]
    while open_nodes:
        node, nearest = open_nodes.pop()
        if len(node.rows) <= LEAF or node.radius == 0:
            continue
        own = points[node.rows]
        owner = np.zeros(len(own), np.int64)
        nearest = nearest.copy()
        chosen = [node.center]
        while len(chosen) < CHILDREN and nearest.max() > 0:
            chosen.append(own[int(nearest.argmax())])
            d = np.sqrt(((own - chosen[-1]) ** 2).sum(1))
            closer = d < nearest
            owner[closer] = len(chosen) - 1
            nearest[closer] = d[closer]
        for i, c in enumerate(chosen):
            mine = np.flatnonzero(owner == i)
            if len(mine):
                child = Node(c, float(nearest[mine].max()), node.rows[mine])
                node.children.append(child)
                open_nodes.append((child, nearest[mine]))
    return root


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.at = np.full((queries, k), -1, np.int64)
        self.met = 0  # pairs whose score was worked out

    def worst(self, rows: np.ndarray) -> float:
        return float(self.scores[rows, -1].min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        """``scores[i, j]`` of query ``rows[i]`` and data row ``at[j]``; equal scores go by smaller id."""
        self.met += scores.size
        floor = self.scores[rows, -1]
        hits = scores >= floor[:, None]
        if hits.sum() > 4 * self.k * len(rows) and scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
            hits = scores >= floor[:, None]
        hits &= scores > -np.inf
        i, j = np.nonzero(hits)
        if not len(i):
            return
        row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), i])
        score = np.concatenate([self.scores[rows].ravel(), scores[i, j]])
        where = np.concatenate([self.at[rows].ravel(), at[j]])
        order = np.lexsort((np.where(where >= 0, ids[where], np.iinfo(np.int64).max), -score, row))
        n = np.bincount(row, minlength=len(rows))
        order = order[(np.cumsum(n) - n)[:, None] + np.arange(self.k)]
        self.scores[rows] = score[order]
        self.at[rows] = where[order]


class Forest:
    """A tree's nodes as arrays, so that one query node meets many of them in one product."""

    def __init__(self, root: Node):
        nodes, self.below = [root], []
        for node in nodes:  # grows while it is read
            self.below.append(np.arange(len(nodes), len(nodes) + len(node.children)))
            nodes += node.children
        self.centers = np.array([n.center for n in nodes])
        self.radii, self.norms = np.array([n.radius for n in nodes]), np.array([n.norm for n in nodes])
        self.rows = [n.rows for n in nodes]

    def most(self, q: Node, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores between the points below ``q`` and those below each of the nodes."""
        radii = self.radii[nodes]
        most = self.centers[nodes] @ q.center + q.radius * self.norms[nodes] + radii * q.norm + q.radius * radii
        return most + 1e-9 * np.abs(most) + 1e-6  # room for rounding, so that nothing equal is pruned

    def opened(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.below[i] if len(self.below[i]) else nodes[k:k + 1] for k, i in enumerate(nodes.tolist())])


def dual_search(queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """Best rows of ``data`` for every query, whose own row takes no part."""
    best = Best(len(queries), k)
    top, forest = cover_tree(queries, np.arange(len(queries))), Forest(cover_tree(data, np.arange(len(data))))
    by_row = np.argsort(data_rows)
    own = by_row[np.minimum(np.searchsorted(data_rows, query_rows, sorter=by_row), len(data) - 1)]
    own = np.where(data_rows[own] == query_rows, own, -1)
    column = np.full(len(data) + 1, -1)  # of a data row in the product at hand; the last entry stands for none
    longest = np.sqrt((queries ** 2).sum(1).max() * (data ** 2).sum(1).max())
    exact = np.float32 if longest < 2 ** 24 else np.float64  # no sum of whole products is longer
    left, right = queries.astype(exact), data.astype(exact)

    def meet(q: Node, at: np.ndarray) -> None:
        scores = left[q.rows] @ right[at].T
        column[at] = np.arange(len(at))
        mine = column[own[q.rows]]
        scores[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
        column[at] = -1
        best.offer(q.rows, scores, at, ids)

    def leaf(q: Node, nodes: np.ndarray) -> None:
        """The best bounds first, so many leaves a product as hold ``PRODUCT`` rows; what is left is pruned in between."""
        while any(len(forest.below[i]) for i in nodes.tolist()):
            nodes = forest.opened(nodes)
            nodes = nodes[forest.most(q, nodes) >= best.worst(q.rows)]
        most = forest.most(q, nodes)
        order = np.argsort(-most, kind="stable")
        nodes, most = nodes[order], most[order]
        first = PRODUCT // 8  # a smaller product for the first thresholds
        while len(nodes):
            n = int(np.searchsorted(np.cumsum([len(forest.rows[i]) for i in nodes.tolist()]), first)) + 1
            meet(q, np.concatenate([forest.rows[i] for i in nodes[:n].tolist()]))
            nodes, most, first = nodes[n:], most[n:], PRODUCT
            keep = most >= best.worst(q.rows)
            nodes, most = nodes[keep], most[keep]

    def visit(q: Node, nodes: np.ndarray) -> None:
        nodes = nodes[forest.most(q, nodes) >= best.worst(q.rows)]
        if not len(nodes):
            return
        if not q.children:
            leaf(q, nodes)
            return
        for child in q.children:
            visit(child, forest.opened(nodes))

    visit(top, np.zeros(1, np.int64))
    return best


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
          data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, key, score)``: for every query row its k best other rows by whole-number inner product.

    Components become floor(scale * x). Rows whose vector is null, empty or holds a null or non-finite
    component take no part; vectors of different lengths never meet. Rows are told apart by an own
    number, so a repeated row is a candidate of its twin. Ties go to the smaller key, then to either of
    equal rows. Sums of products stay exact below 2 ** 53. Null keys are no queries and come last in ties.
    """
    v = F.col(f"`{vector}`")
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False)) & (F.size(v) > 0)
    rows = settle(vectors.filter(good).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), whole.alias("v"),
        F.monotonically_increasing_id().alias("row")))
    n, nq = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    data_blocks, query_blocks = max(1, -(-n // data_block)), max(1, -(-nq // query_block))
    place = F.xxhash64("row")
    data = rows.select("row", "id", "v", F.size("v").alias("length"), F.pmod(place, F.lit(data_blocks)).alias("db"),
                       F.explode(_numbers(query_blocks)).alias("qb"))
    queries = rows.filter("is_query").select(
        "row", "id", "v", F.size("v").alias("length"), F.pmod(place, F.lit(query_blocks)).alias("qb"),
        F.explode(_numbers(data_blocks)).alias("db"))
    out = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return out.empty_table()
        q, d = q.sort_by("row"), d.sort_by("row")
        query_rows, data_rows = q["row"].to_numpy(), d["row"].to_numpy()
        order = d["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        best = dual_search(_matrix(q["v"]), query_rows, _matrix(d["v"]), data_rows, order, k)
        i, j = np.nonzero(best.scores > -np.inf)
        at = best.at[i, j]
        return pa.table([query_rows[i], q["id"].take(pa.array(i)), data_rows[at], d["id"].take(pa.array(at)), best.scores[i, j].astype(np.int64)], schema=out)

    keys = ["qb", "db", "length"]
    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(
        search, "query_row long, query_id long, row long, id long, score long")
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
