"""Approximate nearest neighbours by stable projections and kd-trees.

The nearest are those of largest inner product. A vector x of norm up to M is
put at (x, sqrt(M^2 - |x|^2)) and a query at (q, 0); there the squared distance
is |q|^2 + M^2 - 2 q.x, so the nearest points have the largest products. M is
taken over all vectors.

Points are projected to m dimensions by normal random directions: the squared
projected distance of a point at distance d is d^2 times a chi-square variable
of m degrees. A block of points is indexed by a kd-tree over the projections. A
query takes a block's points in the order of their projected distance, leaf by
leaf of the tree, and verifies them by exact products. With d_k the k-th
distance so far, it stops when the next projected distance r has

    r^2 > d_k^2 * quantile(p) of chi-square with m degrees,

for then a true neighbour that is still unseen has probability below 1 - p.

Blocks are cut by the hash of the id, so they are even, whatever the vectors:
copies of a hot vector lie in all blocks. A task holds a block of points and one
of queries. All points are indexed, none is sampled.

Nulls and ties: vectors that are null, empty, zero or hold null or non-finite
components take no part, as queries or candidates; nor do rows with a null id.
Equal products go by the smaller id. A query's own id is not its neighbour, in
whatever rows it is; repeated rows are candidates of their own. Vectors with
another number of components than most of the data have take no part. An empty
table has no neighbours. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm import vectors as V
from posframe.llm.common import table

M_DIMENSIONS, CONFIDENCE, LEAF = 8, 0.95, 128


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m, by bisection."""
    if m % 2 or not 0 < p < 1:
        raise ValueError("an even number of dimensions and 0 < p < 1")

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class KdTree:
    """Points split at the median of their widest axis until a leaf's size; the
    leaves' boxes are kept, and `order` lists the points leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, order, edges = points, [], []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                edges.append(len(own))
                order.append(own)
                continue
            part = points[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = len(own) // 2
            cut = np.argpartition(part[:, axis], half)
            todo += [own[cut[half:]], own[cut[:half]]]
        self.order = np.concatenate(order) if order else np.zeros(0, int)
        self.ends = np.cumsum(edges)
        self.starts = self.ends - np.array(edges, dtype=int)
        sorted_points = points[self.order]
        self.low = np.minimum.reduceat(sorted_points, self.starts, axis=0)
        self.high = np.maximum.reduceat(sorted_points, self.starts, axis=0)

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the leaves' boxes."""
        out = np.zeros((len(queries), len(self.starts)))
        for axis in range(queries.shape[1]):
            q = queries[:, axis : axis + 1]
            out += np.maximum(np.maximum(self.low[:, axis] - q, q - self.high[:, axis]), 0) ** 2
        return out


def search_block(ids, x, queries, q, k, m, limit, seed, norm2, leaf=LEAF):
    """(query index, id, product) of the neighbours found in one block of points."""
    r = V.gaussian(x.shape[1] + 1, m, seed)
    lift = np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))
    tree = KdTree(x @ r[:-1] + lift[:, None] * r[-1], leaf)
    projected = q @ r[:-1]
    ids, x, points = ids[tree.order], x[tree.order], tree.points[tree.order]
    squares, q2 = (points * points).sum(axis=1), (q * q).sum(axis=1)
    leaves = tree.distances(projected)
    out = ([], [], [])
    for i in range(len(q)):
        order = np.argsort(leaves[i], kind="stable")
        lead = leaves[i][order]
        worst, at, step = np.inf, 0, max(1, -(-4 * k // leaf))
        found_s, found_at = np.zeros(0), np.zeros(0, int)
        while at < len(order) and lead[at] <= worst * limit * (1 + 1e-9) + 1e-12:
            own = order[at : at + step]
            at, step = at + step, 2 * step
            places = np.concatenate([np.arange(tree.starts[j], tree.ends[j]) for j in own])
            gaps = squares[places] - 2 * (points[places] @ projected[i]) + projected[i] @ projected[i]
            places = places[gaps <= worst * limit * (1 + 1e-9) + 1e-9]  # later ones fail the test, which only gets stricter
            places = places[ids[places] != queries[i]]
            s = np.concatenate([found_s, (x[places] * q[i]).sum(axis=1)])
            places = np.concatenate([found_at, places])
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = s >= least
                s, places = s[above], places[above]
                if len(s) > k:  # ties at the end go by id
                    cut = np.lexsort((ids[places], -s))[:k]
                    s, places = s[cut], places[cut]
            found_s, found_at = s, places
            if len(s) >= k:
                worst = max(0.0, q2[i] + norm2 - 2 * s.min())
        out[0].append(np.full(len(found_s), i))
        out[1].append(ids[found_at])
        out[2].append(found_s)
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (int, np.int64, float), strict=True))


def search(data: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", m: int = M_DIMENSIONS, confidence: float = CONFIDENCE, block_rows: int = 16384, query_rows: int = 4096, seed: int = 17) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: the k of data nearest to each of queries."""
    own = lambda df: df.select(F.col(vec_id).cast("long").alias("__id"), F.col(vector).cast("array<double>").alias("__x")).filter(F.col("__id").isNotNull() & V.finite("__x") & F.exists("__x", lambda c: c != 0))
    data, queries = own(data), own(queries)
    length = V.dimension(data, "__x")
    data, queries = (df.filter(F.size("__x") == length) for df in (data, queries))
    rows, norm2 = data.agg(F.count("*"), F.max(F.aggregate("__x", F.lit(0.0), lambda a, c: a + c * c))).first()
    asked = queries.count()
    limit = chi_square_quantile(confidence, m)
    blocks, groups = max(1, -(-rows // block_rows)), max(1, -(-asked // query_rows))
    top = float(norm2 or 0)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qi = b.column("__id").to_numpy()
        if a.num_rows and b.num_rows:
            i, ids, s = search_block(a.column("__id").to_numpy(), V.matrix(a.column("__x")), qi, V.matrix(b.column("__x")), k, m, limit, seed, top)
        else:
            i, ids, s = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": pa.array(qi[i], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.float64())})

    found = V.pairs(data.withColumn("__block", V.number("__id", blocks)), queries.withColumn("__block", V.number("__id", groups)), blocks, groups, run, "query_id long, vec_id long, score double")
    return V.ranked(found, k)


def op1_ann(spark, sf_dir) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(data, data.filter("vec_id % 20 = 0"))
