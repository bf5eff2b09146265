"""Losses, validation metrics and model selection as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posframe import schema as S
from posframe.functions import codecs as C


def _ratio(weight: Column, square: Column, keep: Column) -> Column:
    return F.coalesce(F.sum(F.when(keep, weight * square)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(keep, weight)), F.lit(0.0)), F.lit(1e-8))


def loss(wdl_weight: float = 0.0, real_wdl: bool = True) -> Column:
    """The blended loss of a group of predictions (pred, eval_stm, has_eval, wdl_stm, has_wdl, piece_count)."""
    e, p = F.col("eval_stm"), F.tanh("pred")
    weight = C.loss_weight(e, F.col("piece_count"))
    keep = F.col("has_eval") & (F.abs(e) <= S.SKIP_THRESHOLD)
    out = _ratio(weight, F.pow(p - F.tanh(e), 2), keep)
    if wdl_weight <= 0:
        return out
    if real_wdl:
        both = keep & F.col("has_wdl")
        other = F.when(F.sum(F.when(both, 1)).isNull(), out).otherwise(_ratio(weight, F.pow(p - F.col("wdl_stm"), 2), both))
    else:
        other = _ratio(weight, F.pow(p - C.synthetic_wdl(e), 2), keep)
    return F.when(F.sum(F.when(keep, 1)).isNull(), 0.0).otherwise((1 - wdl_weight) * out + wdl_weight * other)


def loss_by_phase(pred: DataFrame, wdl_weight: float = 0.0) -> DataFrame:
    """phase (and 'all'), samples, loss: the mean of each batch's loss, weighted by its rows."""
    own = pred.withColumn("phase", C.phase(F.col("piece_count")))
    per = own.groupingSets([["batch_id", "phase"], ["batch_id"]], "batch_id", "phase").agg(F.count("*").alias("n"), loss(wdl_weight).alias("l"))
    return per.groupBy(F.coalesce("phase", F.lit("all")).alias("phase")).agg(F.sum("n").alias("samples"), (F.sum(F.col("l") * F.col("n")) / F.sum("n")).alias("loss"))


def calibration(pred: DataFrame) -> DataFrame:
    """One row: scale_ratio, mae_cp, sign_acc, n."""
    t, e = F.tanh("pred"), F.tanh("eval_stm")
    own = pred.filter("has_eval").select((t * S.EVAL_SCALE).alias("p"), (e * S.EVAL_SCALE).alias("v"), t.alias("t"), e.alias("e"))
    decided = F.abs("e") > 0.05
    spread = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col(c) * F.col(c)) - F.pow(F.avg(c), 2)))
    right = F.sum(F.when(decided & ((F.col("t") > 0) == (F.col("e") > 0)), 1).otherwise(0))
    return own.agg((spread("p") / F.greatest(spread("v"), F.lit(1e-6))).alias("scale_ratio"), F.avg(F.abs(F.col("p") - F.col("v"))).alias("mae_cp"), (100.0 * right / F.greatest(F.sum(decided.cast("int")), F.lit(1))).alias("sign_acc"), F.count("*").alias("n"))


def composite(pred: DataFrame, wdl_weight: float = 0.0) -> DataFrame:
    """One row: score, penalty, quality."""
    by_phase = loss_by_phase(pred, wdl_weight)
    parts = [F.sum(F.when(F.col("phase") == k, F.col("loss") * w).otherwise(0.0)) for k, w in S.PHASE_WEIGHTS.items()]
    score = by_phase.agg((parts[0] + parts[1] + parts[2]).alias("score"))
    out = score.crossJoin(calibration(pred).select("scale_ratio"))  # one row and one row
    penalty = S.QUALITY_PENALTY * F.greatest(F.lit(0.0), 1 - F.col("scale_ratio"))
    return out.select("score", penalty.alias("penalty"), (F.col("score") + penalty).alias("quality"))


def best_so_far(runs: DataFrame) -> DataFrame:
    """runs (epoch, quality) with best, the least quality up to the epoch, and improved."""
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    before = F.min("quality").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("best", F.min("quality").over(w)).withColumn("improved", before.isNull() | (F.col("quality") < before))


def best_epoch(runs: DataFrame) -> DataFrame:
    return runs.agg(F.min_by("epoch", "quality").alias("epoch"), F.min("quality").alias("quality"))


def saturation(weights: DataFrame, column: str, bound: int = 127) -> DataFrame:
    return weights.agg((100.0 * F.avg((F.abs(column) == bound).cast("double"))).alias("saturated_pct"))
