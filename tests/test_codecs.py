import numpy as np
import pytest
from pyspark.sql import functions as F

from posframe import schema as S
from posframe.functions import codecs as C
from posframe.functions import features as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("cp,target,raw", [(0, 0.0, 0), (200, 0.5, 1500), (-200, -0.5, -1500), (100, 0.25, 750), (2600, 6.5, 19500), (2700, 6.5, 19500), (25000, 6.5, 19500), (29000, 7.0, 21000), (31900, 9.9, 29700), (5000, 6.5, 19500)])
def test_vectors(spark, cp, target, raw):
    assert one(spark, C.normalize_target(F.lit(cp))) == pytest.approx(target, abs=1e-6)
    assert one(spark, C.encode_eval_from_cp(F.lit(cp))) == raw


def test_extremes(spark):
    assert -10 <= one(spark, C.normalize_target(F.lit(-(2**31)))) < -6.5
    assert 6.5 < one(spark, C.normalize_target(F.lit(25001))) <= 9.9
    assert one(spark, C.encode_eval(F.lit(12.0))) == 30000 and one(spark, C.encode_eval(F.lit(-12.0))) == -30000
    for bad in (float("nan"), float("inf")):
        assert one(spark, C.encode_eval(F.lit(bad))) is None
    for args in ((0, 10), (3000, float("nan")), (3000, 11)):
        with pytest.raises(S.EncodeError):
            C.encode_eval(F.lit(1.0), *args)


def test_domain_against_float32(spark):
    """All scores of [-33000, 33000] as 32-bit arithmetic has them."""
    f = np.float32
    cp = np.arange(-33000, 33001)
    size = np.abs(cp)
    moves = np.clip(((32000 - size).astype(f) / f(100)).astype(f), f(1), f(30))
    mate = (f(10) - (moves * f(0.1)).astype(f)).astype(f)
    t = np.where(cp < 0, f(-1), f(1)) * np.where(size > 25000, mate, np.minimum((size.astype(f) / f(400)).astype(f), f(6.5)))
    scaled = (np.clip(t, f(-10), f(10)).astype(f) * f(3000)).astype(f).astype(float)
    want = np.where(scaled < 0, -np.floor(-scaled + 0.5), np.floor(scaled + 0.5)).astype(int)
    got = spark.range(-33000, 33001).select(C.encode_eval_from_cp(F.col("id")).alias("x")).toPandas().x.to_numpy()
    assert (got == want).all()


def test_flags(spark):
    df = spark.range(0, 256).select(F.col("id").cast("short").alias("f"))
    for r in df.select("f", C.flags_valid(F.col("f")).alias("ok"), C.decode_stm(F.col("f")).alias("s"), C.decode_count(F.col("f")).alias("n")).collect():
        ok = r.f & 0xC0 == 0 and r.f >> 1 & 31 != 31
        assert r.ok == ok and (r.s, r.n) == ((r.f & 1, (r.f >> 1 & 31) + 2) if ok else (None, None))
    both = spark.range(-1, 3).crossJoin(spark.range(0, 35).withColumnRenamed("id", "n"))
    for r in both.select("id", "n", C.encode_flags(F.col("id").cast("int"), F.col("n").cast("int")).alias("f")).collect():
        assert r.f == ((r.n - 2) << 1 | r.id if r.id in (0, 1) and 2 <= r.n <= 32 else None)


def test_features_are_involutions(spark):
    df = spark.range(768).select(F.col("id").cast("int").alias("f"))
    f = F.col("f")
    for r in df.select("f", X.flipped(f).alias("a"), X.flipped(X.flipped(f)).alias("aa"), X.mirrored(X.mirrored(f)).alias("mm"), X.feature_id(X.feature_color(f), X.feature_piece(f), X.feature_square(f)).alias("again")).collect():
        assert r.f == r.aa == r.mm == r.again
        color, piece, square = r.f // 384, r.f % 384 // 64, r.f % 64
        assert r.a == (1 - color) * 384 + piece * 64 + (square ^ 56)


def test_fen(spark):
    from posframe.sources.positions import from_fen

    df = spark.createDataFrame([("4k3/8/8/8/8/8/8/4KQ2 b - - 0 1",), ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",)], "fen string")
    a, b = from_fen(df).collect()
    assert a.stm == 1 and a.features == [384 + 5 * 64 + 60, 5 * 64 + 4, 4 * 64 + 5] and a.features_black == [5 * 64 + 4, 384 + 5 * 64 + 60, 384 + 4 * 64 + 61]
    assert b.stm == 0 and b.piece_count == 32 and len(set(b.features)) == 32


def test_driver_helpers():
    assert C.align_up(13, 8) == 16 and C.align_up(16, 8) == 16
    assert C.checked_u64("add", 2**64 - 1, 1) == (True, 0) and C.checked_u64("mul", 0, 2**64 - 1) == (False, 0)
    assert C.memory_estimate_gb(10**9, 0) == 20.0
