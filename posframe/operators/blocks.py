"""Block index of the ragged feature lists: totals, anchors, prefixes, offsets.

Sums run inside a block, then over blocks inside a run of 4096 of them, then over
the runs: only the table of runs, a row per four million positions, is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posframe import schema as S


def _blocked(pos: DataFrame, size: int) -> DataFrame:
    return pos.withColumn("block_id", F.floor(F.col("idx") / size).cast("long"))


def totals(pos: DataFrame, size: int = S.BLOCK_SIZE) -> DataFrame:
    """block_id, n, total."""
    return _blocked(pos, size).groupBy("block_id").agg(F.count("*").alias("n"), F.sum("piece_count").cast("long").alias("total"))


def anchors(pos: DataFrame, size: int = S.BLOCK_SIZE, run: int = 4096) -> DataFrame:
    """block_id, anchor: the features before the block."""
    t = totals(pos, size).withColumn("__run", F.floor(F.col("block_id") / run).cast("long"))
    runs = t.groupBy("__run").agg(F.sum("total").alias("__all"))
    base = runs.select("__run", (F.sum("__all").over(Window.orderBy("__run")) - F.col("__all")).alias("__base"))
    local = F.sum("total").over(Window.partitionBy("__run").orderBy("block_id")) - F.col("total")
    return t.withColumn("__local", local).join(base, "__run").select("block_id", (F.col("__base") + F.col("__local")).cast("long").alias("anchor"))


def local_prefix(pos: DataFrame, size: int = S.BLOCK_SIZE) -> DataFrame:
    """idx, block_id, prefix: the features of the block before the row."""
    w = Window.partitionBy("block_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return _blocked(pos, size).select("idx", "block_id", "piece_count", (F.sum("piece_count").over(w) - F.col("piece_count")).cast("long").alias("prefix"))


def block_table(pos: DataFrame, size: int = S.BLOCK_SIZE) -> DataFrame:
    """block_id, anchor, prefix: size + 1 sums, the last repeated in a block that isn't full."""
    each = local_prefix(pos, size).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("prefix") + F.col("piece_count")).cast("int").alias("end")))).alias("e"))
    ends = F.transform("e", lambda x: x["end"])
    prefix = F.concat(F.array(F.lit(0)), ends, F.array_repeat(F.element_at(ends, -1), F.lit(size) - F.size("e")))
    return each.select("block_id", prefix.alias("prefix")).join(anchors(pos, size), "block_id").select("block_id", "anchor", "prefix")


def csr_offsets(pos: DataFrame, size: int = S.BLOCK_SIZE) -> DataFrame:
    """idx, start, end of each row's features in one flat array."""
    out = local_prefix(pos, size).join(anchors(pos, size), "block_id")
    start = F.col("anchor") + F.col("prefix")
    return out.select("idx", start.alias("start"), (start + F.col("piece_count")).cast("long").alias("end"))
