"""Position rows: from the event table, from FEN strings, and literal samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posframe import schema as S
from posframe.functions import codecs as C
from posframe.functions import features as X


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One input position per event, with the flags of the ingest filters."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    i, u = F.col("event_id"), F.col("user_id")
    mate = F.when(i % 2 == 0, 1).otherwise(-1) * (25001 + i % 7000)
    score = F.when(F.col("event_type") == "error", mate).otherwise(F.floor((F.col("value") - 50) * 12))
    count = (2 + (i * 7 + u) % 31).cast("int")
    feature = lambda k: X.feature_id((F.floor(k / 2) + i % 2) % 2, (k + u % 6) % 6, (i % 64 + 29 * k) % 64)
    return e.select(
        i.alias("idx"), score.cast("int").alias("score_cp"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", -1).otherwise(i % 3 - 1).cast("int").alias("wdl"),
        (u % 2).cast("int").alias("stm"), count.alias("piece_count"), (i % 7 == 0).alias("is_capture"), (u % 5 == 0).alias("in_check"),
        F.transform(F.sequence(F.lit(0), count - 1), feature).alias("features"),
    )


def encoded(raw: DataFrame) -> DataFrame:
    """Input positions as stored ones, with the columns of POSITION; other columns are dropped."""
    flags = C.encode_flags(F.col("stm"), F.col("piece_count"))
    value = C.encode_eval_from_cp(F.col("score_cp"))
    return raw.select(
        "idx", flags.alias("flags"), value.alias("eval_raw"), C.decode_eval(value).alias("eval_norm"), C.checked_wdl(F.col("wdl")).alias("wdl"),
        F.col("stm").cast("byte").alias("stm"), F.col("piece_count").cast("byte").alias("piece_count"), "features",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(events_raw(spark, sf_dir))


def sample5(spark: SparkSession) -> DataFrame:
    """Five literal rows of differing scores and counts."""
    rows = [(120, 1, 0, 16), (-45, 0, 1, 16), (500, -1, 0, 8), (-1500, 0, 1, 10), (28000, 1, 0, 6)]
    return spark.createDataFrame([(cp, w, s, n, list(range(n))) for cp, w, s, n in rows], S.INPUT_POSITION).coalesce(1)


def from_fen(df: DataFrame, fen: str = "fen") -> DataFrame:
    """df with stm, features (white's ids), features_black and piece_count of a FEN column."""
    own = X.fen_features(F.col(fen))
    return df.withColumn("stm", X.fen_stm(F.col(fen))).withColumn("features", own).withColumn("features_black", X.flip_all("features")).withColumn("piece_count", F.size("features"))
