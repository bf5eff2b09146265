"""Dataset profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe import schema as S


def wdl_distribution(pos: DataFrame) -> DataFrame:
    """wdl, n, pct. The share's total is a one-row aggregate of the three groups."""
    from pyspark.sql import Window

    n = pos.groupBy(F.col("wdl").cast("int").alias("wdl")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def feature_density(pos: DataFrame) -> DataFrame:
    return pos.agg(F.count("*").alias("positions"), F.sum(F.size("features")).cast("long").alias("features"), F.round(F.sum(F.size("features")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("density"))


def summary(pos: DataFrame, metadata: str = S.DEFAULT_METADATA) -> DataFrame:
    return pos.agg(F.count("*").alias("positions"), F.ceil(F.count("*") / S.BLOCK_SIZE).cast("long").alias("blocks"), F.coalesce(F.sum("piece_count"), F.lit(0)).cast("long").alias("features"), F.lit(len(metadata.encode())).cast("long").alias("metadata_bytes"))


def dataset_stats(pos: DataFrame) -> DataFrame:
    is_ = lambda v: F.sum((F.col("wdl") == v).cast("long")).alias(f"wdl_{'minus' if v < 0 else 'plus' if v else 'zero'}")
    return pos.agg(
        F.count("*").alias("n"), F.sum("piece_count").cast("long").alias("features"), F.round(F.avg("piece_count"), 6).alias("avg_features"),
        F.min("eval_raw").cast("int").alias("eval_min"), F.max("eval_raw").cast("int").alias("eval_max"), is_(1), is_(0), is_(-1),
        F.countDistinct("piece_count").cast("long").alias("distinct_counts"),
    )


def histogram(pos: DataFrame, column: str, width: int) -> DataFrame:
    """bucket (its least value), n."""
    return pos.groupBy((F.floor(F.col(column) / width) * width).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
