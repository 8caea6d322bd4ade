"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size, queries into blocks of their own, and each pair of
blocks is one task. Inside a block the vectors are turned to their principal axes, where a few
dimensions carry most of a product. Each of these has a list of the vectors in order of that
component; one more list orders them by the length of all that is left, which bounds the rest of
a product (Cauchy-Schwarz). A query walks each list from the end at which its own component makes
products large, all to the same depth. A vector that no list has shown scores at most the sum, over
the lists, of the query's component times the list's value at that depth, so the walk stops at the
first depth at which this bound is below the kth best score known from the vectors scored first
(the longest ones and some at equal steps). The vectors shown by then are scored exactly. Queries
whose bound does not fall in time, because most vectors would be shown anyway, are scored against
the block in one matrix product.

Scores are exact integers: products are taken in floats only where these hold every partial sum.
The bounds are floats with a margin above their rounding. The blocks' results are cut to k per
query again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that a block of vectors holds, and how many blocks of queries make up one of vectors.
NUMBERS, QUERY_SHARE = 1 << 22, 8
#: Sorted lists of a block besides that of the rests, and vectors that are scored ahead of the walk.
LISTS, AHEAD = 8, 4096
#: Depths at which a walk may stop, as shares of the block.
DEPTHS = (1 / 1024, 1 / 256, 1 / 64, 1 / 24)
#: Scores held at a time.
SCORES = 1 << 22


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(scale * component) as longs; rows with null or non-finite components are left out."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.where(x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, bad)).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")
    )


class Lists:
    """The sorted per-dimension lists of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n, dims = vectors.shape
        self.ids, self.vectors = ids, vectors
        x = vectors.astype(np.float64)
        _, axes = np.linalg.eigh(x.T @ x)
        self.axes = axes[:, ::-1]  # the heaviest first
        p = self.lists = min(LISTS, dims)
        turned = x @ self.axes
        rest = np.sqrt((turned[:, p:] ** 2).sum(axis=1))
        keys = np.concatenate([turned[:, :p], rest[:, None]], axis=1)
        self.order = np.argsort(-keys, axis=0, kind="stable").T  # (lists, n), largest first
        self.sorted = np.take_along_axis(keys.T, self.order, axis=1)
        length = np.sqrt((x * x).sum(axis=1))
        self.longest = float(length.max(initial=0.0))
        longest = np.argsort(-length, kind="stable")[: AHEAD // 2]
        self.ahead = np.union1d(longest, np.arange(0, n, max(1, 2 * n // AHEAD)))
        self.depths = sorted({max(1, int(n * d)) for d in DEPTHS if max(1, int(n * d)) < n})

    def floors(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """A score of each query that at least k vectors reach; minus infinity where too few are looked at."""
        if len(self.ahead) < k:
            return np.full(len(queries), -np.inf)
        scores = (queries @ self.vectors[self.ahead].T).astype(np.float64)
        # a float score may lie above the integer it stands for only where integers are beyond 2^53
        scores = np.nextafter(scores, -np.inf) if self.vectors.dtype == np.int64 else scores
        scores[own[:, None] == self.ids[self.ahead][None, :]] = -np.inf
        return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]

    def stops(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """The depth at which each query's walk stops; the number of vectors where it does not."""
        n, p = len(self.ids), self.lists
        turned = queries.astype(np.float64) @ self.axes
        rest = np.sqrt((turned[:, p:] ** 2).sum(axis=1))
        parts = np.concatenate([turned[:, :p], rest[:, None]], axis=1)
        slack = 1e-9 * (1.0 + self.longest * np.sqrt((turned**2).sum(axis=1)))
        out = np.full(len(queries), n)
        for depth in reversed(self.depths):
            bound = np.maximum(parts, 0) @ self.sorted[:, depth - 1] + np.minimum(parts, 0) @ self.sorted[:, n - depth]
            out[bound + slack < floors] = depth
        return out

    def shown(self, query: np.ndarray, depth: int) -> np.ndarray:
        """The vectors that the query's lists show down to a depth."""
        n, p = len(self.ids), self.lists
        turned = query.astype(np.float64) @ self.axes[:, :p]
        ends = [order[:depth] if x >= 0 else order[n - depth :] for order, x in zip(self.order, [*turned, 0.0])]
        return np.unique(np.concatenate(ends))

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, score) that hold each query's k best, and how many products were taken beside those ahead.

        Vectors with the id in `own` are left out.
        """
        found, n = [], len(self.ids)
        taken, step = 0, max(1, SCORES // max(n, AHEAD))
        for at in range(0, len(queries), step):
            qs, mine = queries[at : at + step], own[at : at + step]
            floors = self.floors(qs, mine, k)
            stops = self.stops(qs, floors)
            whole = np.flatnonzero(stops == n)
            if len(whole):
                scores = qs[whole] @ self.vectors.T
                i, rows = np.nonzero(scores >= floors[whole][:, None])
                found.append(self._best(whole[i], rows, scores[i, rows], mine, k, at))
                taken += n * len(whole)
            for i in np.flatnonzero(stops < n):
                rows = self.shown(qs[i], stops[i])
                scores = self.vectors[rows] @ qs[i]
                taken += len(rows)
                near = scores >= floors[i]
                found.append(self._best(np.full(near.sum(), i), rows[near], scores[near], mine, k, at))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return parts[0], parts[1], parts[2], taken

    def _best(self, which, rows, scores, own, k, at):
        """The k best of each query, ties by smaller id."""
        other = self.ids[rows] != own[which]
        which, rows, scores = which[other], rows[other], scores[other].astype(np.int64)
        order = np.lexsort((self.ids[rows], -scores, which))
        which, rows, scores = which[order], rows[order], scores[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        kept = place < k
        return which[kept] + at, rows[kept], scores[kept]


def _matrix(lists, dims: int) -> np.ndarray:
    """An Arrow column of lists as rows; shorter ones are filled with zeros."""
    import pyarrow.compute as pc

    column = lists.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _exact(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The fastest type that holds every partial sum of a product."""
    size = lambda x: max(abs(int(x.min())), abs(int(x.max())), 1)
    largest = size(vectors) * size(queries) * vectors.shape[1]
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of `vectors`, rows of its own id left out.

    Equal scores go to the smaller vec_id; with fewer than k other vectors all are returned. Null
    ids, null vectors and vectors with null or non-finite components take no part. Missing
    components of a shorter vector count as zero, so an empty vector scores 0. Repeated ids are rows
    of their own; an empty table gives no rows.

    A block of vectors holds at most NUMBERS numbers, whatever their dimension. A vector is sent once
    for each block of queries, a query once for each block of vectors.
    """
    rows = quantized(vectors, scale, id_col, vector_col)
    asked = quantized(queries, scale, id_col, vector_col)
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    m, longest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(dims or 0, longest or 0, 1)
    per_block = max(1, NUMBERS // dims)
    n_blocks = -(-max(n, 1) // per_block)
    q_blocks = -(-max(m, 1) // max(1, per_block // QUERY_SHARE))
    # every block of queries meets every block of vectors; both are dealt by hash, so blocks are even
    lot = lambda of: F.pmod(F.xxhash64("vec_id", "v"), F.lit(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select("vec_id", "v", lot(n_blocks).alias("b"), all_of(q_blocks).alias("q"))
    right = asked.select("vec_id", "v", lot(q_blocks).alias("q"), all_of(n_blocks).alias("b"))

    def run(these, ask):
        import pyarrow as pa

        ids, own = (t.column("vec_id").to_numpy().astype(np.int64) for t in (these, ask))
        which = row = scores = np.zeros(0, np.int64)
        if len(ids) and len(own):
            vs, qs = _matrix(these.column("v"), dims), _matrix(ask.column("v"), dims)
            kind = _exact(vs, qs)
            which, row, scores, _ = Lists(ids, vs.astype(kind)).top(qs.astype(kind), own, k)
        return pa.table({"query_id": own[which], "vec_id": ids[row], "score": scores.astype(np.int64)})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
