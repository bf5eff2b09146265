"""Point and batch lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posframe.functions import features as X


def at(pos: DataFrame, idx: int) -> DataFrame:
    """One position; the predicate reaches the scan's row-group statistics."""
    if idx < 0:
        raise IndexError(idx)
    return pos.filter(F.col("idx") == idx)


def six_digits(x: Column) -> Column:
    """A number between 0.0001 and 99999 (or 0) with six significant digits, without zeros at the end."""
    size = F.abs(x)
    shown = F.format_string("%.9f", x)
    for least, places in ((1e-3, 8), (1e-2, 7), (0.1, 6), (1.0, 5), (10.0, 4), (100.0, 3), (1000.0, 2), (10000.0, 1)):
        shown = F.when(size >= least, F.format_string(f"%.{places}f", x)).otherwise(shown)
    return F.regexp_replace(shown, r"\.?0+$", "")


def dump(pos: DataFrame, start: int = 0, end: int = 5) -> DataFrame:
    """idx and a line of text of the rows start..end-1, in order."""
    if start > end:
        raise ValueError(f"bad range {start}:{end}")
    line = F.format_string("[%d] stm=%d pc=%d wdl=%d eval=%s features=[%s]", "idx", F.col("stm").cast("int"), F.col("piece_count").cast("int"), F.col("wdl").cast("int"), six_digits(F.col("eval_norm").cast("double")), X.as_text(F.col("features")))
    return pos.filter(F.col("idx").between(start, end - 1)).orderBy("idx").select("idx", line.alias("line"))


def parse_range(text: str) -> tuple[int, int]:
    start, colon, end = text.partition(":")
    if not colon or not start.isdigit() or not end.isdigit() or int(start) > int(end):
        raise ValueError(f"not START:END: {text!r}")
    return int(start), int(end)


def gather(pos: DataFrame, request: DataFrame, strict: bool = True) -> DataFrame:
    """The positions that request (slot, idx) names, one row for each of its rows;
    `strict` raises for an idx that there is not. Spark picks the join by size."""
    found = request.join(pos.withColumn("__there", F.lit(True)), "idx", "left")
    if strict:
        ok = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("index out of range: "), F.col("idx").cast("string"))).cast("long")).otherwise(F.col("idx"))
        found = found.withColumn("idx", ok)
    return found.drop("__there")


def gather_matrix(pos: DataFrame, request: DataFrame) -> DataFrame:
    """gather() with features padded to 32."""
    return gather(pos, request).withColumn("features", X.padded(F.col("features")))
