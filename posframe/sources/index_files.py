"""Files of fixed index sets: a sorted one-dimensional array of 64-bit numbers."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from posframe import schema as S
from posframe.operators.sampling import floyd


def size_label(n: int) -> str:
    """A number of rows as file names show it: 999, 12k, 1500k, 2M."""
    if n < 1000:
        return str(n)
    return f"{n // 1_000_000}M" if n >= 1_000_000 and n % 1_000_000 == 0 else f"{n // 1000}k"


def checked(index: np.ndarray, n: int) -> np.ndarray:
    """The index set in order; ValidationError if it is empty, out of range or holds a number twice."""
    if not len(index):
        raise S.ValidationError("the index set is empty")
    index = np.sort(index.astype(np.int64))
    if index[0] < 0 or index[-1] >= n:
        raise S.ValidationError(f"the index set reaches from {index[0]} to {index[-1]}, of {n} rows")
    if (np.diff(index) <= 0).any():
        raise S.ValidationError("the index set holds a number twice")
    return index


def write(index: list[int] | np.ndarray, n: int, folder: str, seed: int, force: bool = False) -> str:
    """Writes an index set of a table of n rows; the name tells size, seed and n."""
    index = checked(np.asarray(index), n)
    path = f"{folder}/val_{size_label(len(index))}_seed{seed}_n{n}.npy"
    if os.path.exists(path) and not force:
        raise S.WriteError(f"{path} exists")
    os.makedirs(folder, exist_ok=True)
    np.save(path, index)
    return path


def sample(n: int, k: int, folder: str, seed: int, force: bool = False) -> str:
    """A file of k distinct numbers below n."""
    if not 0 < k <= n:
        raise S.WriteError(f"{k} of {n}")
    return write(floyd(n, k, seed), n, folder, seed, force)


def read(spark: SparkSession, path: str, n: int) -> DataFrame:
    """idx, in order, of an index file of a table of n rows. The file is a split's, of bounded size."""
    return spark.createDataFrame(pa.table({"idx": checked(np.load(path), n)}))
