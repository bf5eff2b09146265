"""What both vector searches share: blocks of vectors and of queries, and ranks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posframe.llm.common import mix64


def finite(column: str):
    """Vectors with components, none of them null, infinite or not a number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def dimension(data: DataFrame, column: str) -> int:
    """The number of components that most vectors have (the least of ties); 0 without vectors."""
    found = data.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.d if found else 0


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def number(column: str, blocks: int):
    """A block for each row, by its hash: blocks of even size, whatever the vectors."""
    return F.pmod(F.xxhash64(column, F.lit(11)), F.lit(blocks)).cast("int")


def pairs(data: DataFrame, queries: DataFrame, data_blocks: int, query_blocks: int, search: Callable, schema: str) -> DataFrame:
    """search(data table, query table) of each pair of a block of data and a block of
    queries. data and queries have a column __block; a cell of the grid of blocks has
    one block of each, so no task holds more, and no row meets another by a cross join."""

    def dealt(df, other_blocks, names):
        """Each row once for each block of the other side."""
        rest = [c for c in df.columns if c != "__block"]
        return df.select(F.col("__block").alias(names[0]), F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(names[1]), *rest)

    left = dealt(data, query_blocks, ("__d", "__q")).groupBy("__d", "__q")
    right = dealt(queries, data_blocks, ("__q", "__d")).groupBy("__d", "__q")

    return left.cogroup(right).applyInArrow(search, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of the lists that blocks gave. A
    block gives a query k rows, and Spark limits the rows by rank before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def gaussian(dimension: int, m: int, seed: int) -> np.ndarray:
    """A dimension x m matrix of normal (2-stable) numbers, the same everywhere."""
    n = np.arange(dimension * m * 2, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)
    u = ((mix64(n * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
    return (np.sqrt(-2 * np.log(u[::2])) * np.cos(2 * np.pi * u[1::2])).reshape(dimension, m)
