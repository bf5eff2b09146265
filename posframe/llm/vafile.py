"""Exact top-k inner products by vector-approximation files.

Components are made integers, floor(scale * x). A block of vectors is stored as
its approximation, each component quantised to one of 2**bits cells of equal
width between the least and greatest of its dimension (a byte each), beside the
exact vectors. A query scans the approximations: a cell's bounds give an upper
and a lower bound of each product. With t the k-th greatest lower bound, only
vectors whose upper bound reaches t can be in the result; of these exact vectors
are read in the order of their bounds, until the k-th product found is greater
than every bound that is left. Scores are exact: where products may pass 2**53 they
are summed as longs, or as integers of any size, and bounds are widened by what
doubles can be off. A score beyond a long is the nearest long.

Blocks are cut by the hash of the id, so they are even, whatever the vectors. A
task holds a block and a block of queries.

Nulls and ties: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id. Equal products go by the
smaller id. A query's own id is not in its result, in whatever rows it is;
repeated rows are candidates of their own. Vectors with another number of components
than most of the data have take no part. An empty table has no results. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm import vectors as V
from posframe.llm.common import table

BITS, SCALE = 6, 1024


class Approximation:
    """The quantised cells of a block of integer vectors; exact: whether doubles hold all products."""

    def __init__(self, x: np.ndarray, bits: int = BITS, exact: bool = True):
        self.exact, cells = exact, 1 << bits
        if exact:
            self.low = x.min(axis=0)
            self.width = np.maximum(1, -(-(x.max(axis=0) - self.low + 1) // cells))
            self.cells = ((x - self.low) // self.width).astype(np.uint8)
            self.spread, self.low = self.width - 1, self.low.astype(float)
        else:
            x = x.astype(float)
            self.low, self.most = x.min(axis=0), abs(x).max(axis=0)
            self.spread = self.width = np.maximum(1.0, (x.max(axis=0) - self.low) / cells)
            self.cells = np.minimum((x - self.low) // self.width, cells - 1).astype(np.uint8)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of each query with each vector."""
        least = (q * self.width) @ self.cells.T.astype(float) + (q @ self.low)[:, None]
        spread = q * self.spread
        low, high = least + np.minimum(spread, 0).sum(axis=1)[:, None], least + np.maximum(spread, 0).sum(axis=1)[:, None]
        if not self.exact:
            off = (abs(q) @ (self.most + self.spread) * (q.shape[1] + 8) * 2.0**-49)[:, None]
            low, high = (np.clip(x, -(2.0**63), 2.0**63) for x in (low - off, high + off))
        return low, high


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of integer vectors with one, as longs."""
    if abs(x.astype(float)).max(initial=0) * abs(q.astype(float)).max(initial=0) * len(q) < 2**62:
        return (x * q).sum(axis=1)
    most = 2**63 - 1
    return np.array([max(-most, min(most, sum(a * b for a, b in zip(v, q.tolist(), strict=True)))) for v in x.tolist()], dtype=np.int64)


def search_block(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int, bits: int = BITS, rows: int = 256):
    """(query index, id, product) of the block's k best for each query."""
    exact = abs(x.astype(float)).max(initial=0) * abs(q.astype(float)).max(initial=0) * x.shape[1] * 4 < 2**53
    approximation = Approximation(x, bits, exact)
    if exact:
        x, q = x.astype(float), q.astype(float)
    of = np.matmul if exact else products
    out = ([], [], [])
    for start in range(0, len(q), rows):
        low, high = approximation.bounds(q[start : start + rows].astype(float))
        for i in range(len(low)):
            own = ids != queries[start + i]
            n = int(own.sum())
            if not n:
                continue
            lower = np.where(own, low[i], -np.inf)
            t = np.partition(lower, len(lower) - k)[len(lower) - k] if n >= k else -np.inf
            near = np.flatnonzero(own & (high[i] >= t))
            near = near[np.argsort(-high[i][near], kind="stable")]
            s, at, worst, step = np.zeros(0, x.dtype), 0, -np.inf, 4 * k
            while at < len(near) and high[i][near[at]] >= worst:
                s = np.concatenate([s, of(x[near[at : at + step]], q[start + i])])
                at, step = min(len(near), at + step), 2 * step
                if len(s) >= k:
                    worst = np.partition(s, len(s) - k)[len(s) - k]
            places = near[:at]
            if len(s) > k:
                above = s >= worst
                s, places = s[above], places[above]
                cut = np.lexsort((ids[places], -s))[:k]
                s, places = s[cut], places[cut]
            out[0].append(np.full(len(s), start + i))
            out[1].append(ids[places])
            out[2].append(s.astype(np.int64))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def search(data: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, bits: int = BITS, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the k greatest integer products of each query."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell's number takes a byte")
    own = lambda df: df.select(F.col(vec_id).cast("long").alias("__id"), F.col(vector).alias("__v")).filter(F.col("__id").isNotNull() & V.finite("__v")).select("__id", F.transform("__v", lambda c: F.floor(c.cast("double") * scale)).alias("__x"))
    data, queries = own(data), own(queries)
    length = V.dimension(data, "__x")
    data, queries = (df.filter(F.size("__x") == length) for df in (data, queries))
    rows, asked = data.count(), queries.count()
    blocks, groups = max(1, -(-rows // block_rows)), max(1, -(-asked // query_rows))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qi = b.column("__id").to_numpy()
        if a.num_rows and b.num_rows:
            i, ids, s = search_block(a.column("__id").to_numpy(), V.matrix(a.column("__x")), qi, V.matrix(b.column("__x")), k, bits)
        else:
            i, ids, s = (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(qi[i], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.int64())})

    found = V.pairs(data.withColumn("__block", V.number("__id", blocks)), queries.withColumn("__block", V.number("__id", groups)), blocks, groups, run, "query_id long, vec_id long, score long")
    return V.ranked(found, k)


def op2_vafile(spark, sf_dir) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(data, data.filter("vec_id % 100 = 0"))


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
