"""Ingest as a stream: the same cascade and codecs over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posframe.operators.ingest import kept, reason
from posframe.sources.positions import encoded


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def positions(raw: DataFrame, filters: bool = True) -> DataFrame:
    return encoded(kept(raw, filters))


def rates(raw: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, reason ('kept' if null), n of each window of event time; rows later than the watermark are not counted."""
    out = raw.withWatermark(time, late).withColumn("reason", F.coalesce(reason(), F.lit("kept")))
    return out.groupBy(F.window(time, window), "reason").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "reason", "n")


def write(df: DataFrame, path: str, checkpoint: str):
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
