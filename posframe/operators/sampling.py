"""Splits, shuffles and batches. Shuffles order by an arithmetic hash of the row
and the seed, so they are the same on any cluster."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_STEP = 1_000_003


def mixed(idx: Column, seed: int) -> Column:
    return F.pmod(idx * 2654435761 + F.lit(seed), F.lit(4294967296))


def floyd(n: int, k: int, seed: int) -> list[int]:
    """k distinct numbers below n, sorted, in O(k): for each j of the last k, a
    number up to j, or j itself if that is taken."""
    if k > n:
        raise ValueError(f"{k} of {n}")
    draw, taken = random.Random(seed), set()
    for j in range(n - k, n):
        t = draw.randrange(0, j + 1)
        taken.add(j if t in taken else t)
    return sorted(taken)


def val_index(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    return spark.createDataFrame([(x,) for x in floyd(n, k, seed)], "idx long")


def val_size(n: int, share: float, most: int) -> int:
    return min(most, int(n * share))


def index_checks(index: DataFrame, n: int) -> DataFrame:
    """One row: rows, below, above, duplicates, ok of an index set."""
    out = index.agg(F.count("*").alias("rows"), F.sum((F.col("idx") < 0).cast("long")).alias("below"), F.sum((F.col("idx") >= n).cast("long")).alias("above"), (F.count("*") - F.countDistinct("idx")).alias("duplicates"))
    out = out.select("rows", F.coalesce("below", F.lit(0)).cast("long").alias("below"), F.coalesce("above", F.lit(0)).cast("long").alias("above"), F.col("duplicates").cast("long").alias("duplicates"))
    return out.withColumn("ok", (F.col("rows") > 0) & (F.col("below") == 0) & (F.col("above") == 0) & (F.col("duplicates") == 0))


def not_increasing(index: DataFrame) -> DataFrame:
    """place, idx, before: the entries of an index set (place, idx) that are not above the one before."""
    before = index.select((F.col("place") + 1).alias("place"), F.col("idx").alias("before"))
    return index.join(before, "place").filter("idx <= before").select("place", "idx", "before")


def permuted(df: DataFrame, seed: int, idx: str = "idx", name: str = "place") -> DataFrame:
    """df with its place in a seeded permutation of all rows. The hash is a bijection of
    32-bit numbers, so it orders up to 2**32 dense rows; no task sees all of them."""
    from posframe.operators.ingest import dense_index

    return dense_index(df.withColumn("__mixed", mixed(F.col(idx), seed)), "__mixed", name).drop("__mixed")


def excluded(pos: DataFrame, val: DataFrame) -> DataFrame:
    """Training rows: all but the validation set. Spark broadcasts it while it is small."""
    return pos.join(val.select("idx"), "idx", "left_anti")


def mirror_doubled(df: DataFrame) -> DataFrame:
    """Each row twice, with `mirror` false and true."""
    return df.withColumn("mirror", F.explode(F.array(F.lit(False), F.lit(True))))


def chunk_shuffled(df: DataFrame, chunk: int, seed: int, epoch: int = 0, idx: str = "idx") -> DataFrame:
    """df with chunk_id and slot, a seeded permutation inside the chunk."""
    key = mixed(F.col(idx), seed + epoch * EPOCH_STEP)
    own = df.withColumn("chunk_id", F.floor(F.col(idx) / chunk).cast("long"))
    return own.withColumn("slot", F.row_number().over(Window.partitionBy("chunk_id").orderBy(key, idx)) - 1)


def chunk_order(chunks: DataFrame, seed: int, workers: int) -> DataFrame:
    """chunk_id, place, worker: the chunks (a small table) in a seeded order, dealt in turn."""
    place = F.row_number().over(Window.orderBy(mixed(F.col("chunk_id"), seed), "chunk_id")) - 1
    return chunks.select("chunk_id").distinct().withColumn("place", place).withColumn("worker", F.col("place") % workers)


def epoch_batches(df: DataFrame, chunk: int, batch: int, seed: int, epoch: int, workers: int, drop_last: bool = True, budget: int | None = None, max_batches: int | None = None) -> DataFrame:
    """idx, worker, batch_id, pos: each worker's chunks one after the other, cut into
    batches that go on across the borders of chunks. Places of a worker's rows come
    from the sizes of its chunks, so no task orders more than a chunk. The last,
    shorter batch goes with drop_last; budget: rows an epoch, shared out to workers;
    max_batches: the most batches of a worker."""
    shuffled = chunk_shuffled(df.select("idx"), chunk, seed, epoch)
    sizes = shuffled.groupBy("chunk_id").agg(F.count("*").alias("n"))
    order = chunk_order(sizes, seed + epoch * EPOCH_STEP, workers).join(sizes, "chunk_id")
    w = Window.partitionBy("worker").orderBy("place")
    order = order.withColumn("base", F.sum("n").over(w) - F.col("n")).withColumn("whole", F.sum("n").over(Window.partitionBy("worker")))
    out = shuffled.join(order, "chunk_id").withColumn("at", F.col("base") + F.col("slot"))
    end = F.col("whole") if budget is None else F.least(F.col("whole"), F.ceil(F.lit(budget // workers) / batch) * batch)
    if drop_last:
        end = F.floor(end / batch) * batch
    if max_batches is not None:
        end = F.least(end, F.lit(max_batches * batch))
    return out.filter(F.col("at") < end).select("idx", F.col("worker").cast("int").alias("worker"), F.floor(F.col("at") / batch).cast("long").alias("batch_id"), (F.col("at") % batch).cast("int").alias("pos"))


def epoch_length(samples: int, batch: int, drop_last: bool) -> int:
    return samples // batch if drop_last else -(-samples // batch)


def worker_stride(batches: DataFrame, worker: int, workers: int) -> DataFrame:
    return batches.filter(F.col("batch_id") % workers == worker)


def contiguous_split(val: DataFrame, n: int, workers: int) -> DataFrame:
    """idx, slot, worker: even runs of a validation set of n rows, the last worker taking the rest."""
    slot = F.row_number().over(Window.orderBy("idx")) - 1
    each = max(1, n // workers)
    return val.select("idx").withColumn("slot", slot).withColumn("worker", F.least(F.floor(F.col("slot") / each), F.lit(workers - 1)).cast("int"))


def batch_offsets(batches: DataFrame, pos: DataFrame) -> DataFrame:
    """worker, batch_id, pos, start: each row's first feature in its batch."""
    w = Window.partitionBy("worker", "batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = batches.join(pos.select("idx", "piece_count"), "idx")
    return own.select("worker", "batch_id", "pos", "idx", (F.sum("piece_count").over(w) - F.col("piece_count")).cast("long").alias("start"))


def concatenated(parts: list[DataFrame], max_rows: int | None = None, split: str = "train") -> DataFrame:
    """The parts one after the other: idx goes on, file says which. Bases come from
    counts; of parts beyond max_rows in all only the first rows (by idx) are taken.
    split is train or val; both take the same rows, for a part is a split of its own."""
    if split not in ("train", "val"):
        raise ValueError(f"split is train or val, not {split!r}")
    out, base = None, 0
    for k, p in enumerate(parts):
        n = p.count()
        take = n if max_rows is None else max(0, min(n, max_rows - base))
        own = p.filter(F.col("idx") < take).withColumn("idx", (F.col("idx") + base).cast("long")).withColumn("file", F.lit(k))
        out = own if out is None else out.unionByName(own)
        base += take
    return out
