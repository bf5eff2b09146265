"""Ingest: the filter cascade and its counters in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posframe import schema as S
from posframe.functions import features as X
from posframe.sources.folders import shared_dir


def reason(filters: bool = True, max_feature_id: int = S.MAX_FEATURE_ID) -> Column:
    """Why a row is not kept, null if it is. One cascade, so the counts are disjoint."""
    rejected = ~(
        F.col("stm").isin(0, 1) & F.col("piece_count").between(S.COUNT_BASE, S.MAX_COUNT) & (F.size("features") == F.col("piece_count"))
        & F.col("wdl").isin(-1, 0, 1) & X.all_below(F.col("features"), max_feature_id)
    )
    out = F.when(F.col("is_capture"), "capture").when(F.col("in_check"), "in_check") if filters else None
    cascade = out.when if out is not None else F.when
    return cascade(F.coalesce(rejected, F.lit(True)), "rejected")


def kept(raw: DataFrame, filters: bool = True) -> DataFrame:
    return raw.withColumn("__r", reason(filters)).filter("__r is null").drop("__r")


def counters(raw: DataFrame, filters: bool = True) -> DataFrame:
    """read, kept, captures, in_check, rejected, kept_pct."""
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    r = F.col("r")
    out = raw.select(reason(filters).alias("r")).agg(F.count("*").alias("read"), n(r.isNull()).alias("kept"), n(r == "capture").alias("captures"), n(r == "in_check").alias("in_check"), n(r == "rejected").alias("rejected"))
    return out.withColumn("kept_pct", F.round(100.0 * F.col("kept") / F.greatest("read", F.lit(1)), 4))


def capped(raw: DataFrame, cap: int, filters: bool = True, order: str = "idx") -> DataFrame:
    """The first `cap` kept rows in source order (0: all): a bounded top-n per task."""
    out = kept(raw, filters)
    return out.orderBy(order).limit(cap) if cap else out


def dense_index(df: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """df with 0, 1, ... in the order of a column of distinct numbers. Rows are range
    partitioned and numbered inside; each partition's base is the sum of the counts
    before it, a table with a row per partition. No task sees all rows. The ranges
    are checkpointed, so counts and numbers are of the same ones."""
    from pyspark.sql import Window

    shared_dir(df.sparkSession)
    spread = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).checkpoint()
    sizes = spread.groupBy("__p").agg(F.count("*").alias("n"))
    base = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("base"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return spread.withColumn("__l", local).join(base, "__p").withColumn(name, (F.col("base") + F.col("__l")).cast("long")).drop("__p", "__l", "base")


def first_rejected(raw: DataFrame, most: int = 5, filters: bool = True, max_feature_id: int = S.MAX_FEATURE_ID) -> DataFrame:
    """idx and why of the first `most` rejected rows in order: which rule of an input row is
    broken first. A bounded top-n per task."""
    parts = [
        (~F.col("stm").isin(0, 1), "stm"), (~F.col("piece_count").between(S.COUNT_BASE, S.MAX_COUNT), "piece_count"), (F.size("features") != F.col("piece_count"), "features.size"),
        (~X.all_below(F.col("features"), max_feature_id), "feature id"), (~F.col("wdl").isin(-1, 0, 1), "wdl"),
    ]
    why = F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), name) for broken, name in parts])
    return raw.filter(reason(filters, max_feature_id) == "rejected").orderBy("idx").limit(most).select("idx", why.alias("why"))
