"""Scores of positions by a small two-sided net with an output for each count bucket."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.functions import codecs as C
from posframe.functions import features as X


@dataclass
class Head:
    """The layers behind the feature sums: rows of `hidden` over both sides' sums, rows
    of `out` (one a bucket) over the hidden layer. Small, whatever the data."""

    hidden: list[list[float]]
    out: list[list[float]]
    hidden_bias: list[float]
    out_bias: list[float]
    feature_bias: list[float]


def bag_sums(rows: DataFrame, weights: DataFrame, size: int, features: str = "features", by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """by and acc: the sum of the vectors (f, w: array of `size`) of each row's features.
    Features without a vector add nothing. Sums are combined before they are shuffled."""
    each = rows.select(*by, F.explode_outer(F.col(features).cast("array<long>")).alias("f")).join(weights.select("f", "w"), "f", "left")
    sums = each.groupBy(*by).agg(*[F.sum(F.col("w")[j]).alias(f"__{j}") for j in range(size)])
    return sums.select(*by, F.array(*[F.coalesce(f"__{j}", F.lit(0.0)) for j in range(size)]).alias("acc"))


def _vectors(pos: DataFrame, weights: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature ids and, row by row, the sum of each one's vectors (a null component
    adds nothing), then a row of zeros. Of weights, only those between the least and the
    greatest id of pos, from either side, reach the driver."""
    white, black = F.col("features"), X.flip_all("features")
    low, high = pos.agg(F.min(F.least(F.array_min(white), F.array_min(black))), F.max(F.greatest(F.array_max(white), F.array_max(black)))).first()
    w = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.coalesce(F.get("w", j), F.lit(0.0)).cast("double"))
    found = weights.filter(F.col("f").between(F.lit(low), F.lit(high))).select(F.col("f").cast("long").alias("f"), w.alias("w")).toArrow()
    ids, place = np.unique(found.column("f").to_numpy(), return_inverse=True)
    vectors = np.zeros((len(ids) + 1, size))
    np.add.at(vectors, place, found.column("w").combine_chunks().flatten().to_numpy().reshape(-1, size))
    return ids, vectors


def _sums(features: pa.Array, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each row's features."""
    count = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = features.flatten()
    f, at = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), np.full(len(flat), len(ids))
    if len(ids):
        near = np.minimum(np.searchsorted(ids, f), len(ids) - 1)
        at = np.where((ids[near] == f) & pc.is_valid(flat).to_numpy(zero_copy_only=False), near, len(ids))
    total, some = np.zeros((len(count), vectors.shape[1])), count > 0
    if some.any():
        total[some] = np.add.reduceat(vectors[at], (np.cumsum(count) - count)[some], axis=0)
    return total


def _activated(x: np.ndarray) -> np.ndarray:
    """As codecs.screlu; like there, NaN counts as greater than others."""
    return np.fmin(np.maximum(x, 0.0), 1.0) ** 2


def forward(pos: DataFrame, weights: DataFrame, head: Head) -> DataFrame:
    """idx, bucket and out: the output that the bucket of piece_count selects. pos has
    idx, stm, piece_count and features (white's ids). A row is scored by itself, where it
    is read, so nothing is shuffled or written; rows without an idx have no score. Null
    features are none."""
    sent = pos.sparkSession.sparkContext.broadcast(_vectors(pos, weights, len(head.feature_bias)))

    def run(it):
        layers = [(np.array(w, dtype=float).T, np.array(b, dtype=float)) for w, b in ((head.hidden, head.hidden_bias), (head.out, head.out_bias))]
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.concatenate([_activated(_sums(part.column(k), *sent.value) + np.array(head.feature_bias)) for k in (2, 3)], axis=1)
                out = _activated(x @ layers[0][0] + layers[0][1]) @ layers[1][0] + layers[1][1]
                bucket = part.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out[np.arange(len(out)), bucket])], names=["idx", "bucket", "out"])

    own, other = X.streams(F.col("features"), F.col("stm"))
    rows = pos.filter("idx is not null").select("idx", C.output_bucket(F.col("piece_count").cast("int")).alias("bucket"), own.alias("own"), other.alias("other"))
    return rows.mapInArrow(run, f"idx {rows.schema['idx'].dataType.simpleString()}, bucket int, out double")


def sanity(fens: DataFrame, weights: DataFrame, head: Head, scale: float = 400.0) -> DataFrame:
    """idx, bucket, out and cp of positions (idx, stm, piece_count, features) whose scores are known."""
    return forward(fens, weights, head).withColumn("cp", F.round(F.col("out") * scale).cast("long"))
