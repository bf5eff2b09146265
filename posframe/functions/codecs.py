"""Codecs of the packed fields as column expressions, all inside whole-stage codegen.

Quotients and products of floats are cast back to float, for Spark computes
them as doubles; so results are those of 32-bit arithmetic. Values outside a
domain give null; `strict` raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posframe import schema as S


def _f(x) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def strict(value: Column, what: str) -> Column:
    """value, or an error where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(f"out of domain: {what}")).cast("int"))


def encode_flags(stm: Column, count: Column) -> Column:
    return F.when(stm.isin(0, 1) & count.between(S.COUNT_BASE, S.MAX_COUNT), F.shiftleft(count - S.COUNT_BASE, 1).bitwiseOR(stm)).cast("short")


def flags_valid(flags: Column) -> Column:
    return (flags.bitwiseAND(F.lit(0xC0)) == 0) & (F.shiftright(flags, 1).bitwiseAND(F.lit(31)) != 31)


def decode_stm(flags: Column) -> Column:
    return F.when(flags_valid(flags), flags.bitwiseAND(F.lit(1))).cast("byte")


def decode_count(flags: Column, base: int = S.COUNT_BASE) -> Column:
    return F.when(flags_valid(flags), F.shiftright(flags, 1).bitwiseAND(F.lit(31)) + base).cast("byte")


def normalize_target(cp: Column) -> Column:
    """Centipawns to the float target: mate scores lie beyond the normal clip."""
    cp = cp.cast("long")
    size, sign = F.abs(cp), F.when(cp < 0, _f(-1.0)).otherwise(_f(1.0))
    moves = F.least(F.greatest(_f(_f(F.lit(32000) - size) / _f(100.0)), _f(1.0)), _f(30.0))
    mate = _f(_f(10.0) - _f(moves * _f(0.1)))
    normal = F.least(_f(_f(size) / _f(400.0)), _f(S.NORMAL_EVAL_CLIP))
    return _f(sign * F.when(size > 25000, mate).otherwise(normal))


def encode_eval(target: Column, scale: float = S.FIXED_SCALE, clip: float = S.STORAGE_TARGET_CLIP) -> Column:
    """Clamped, scaled and rounded half away from zero; null if not finite."""
    if not (0 < scale < float("inf") and 0 < clip < float("inf")) or clip * scale > 32767:
        raise S.EncodeError(f"scale {scale} and clip {clip} don't fit 16 bits")
    ok = target.isNotNull() & ~F.isnan(target) & (F.abs(target) != float("inf"))
    clamped = F.least(F.greatest(_f(target), _f(-clip)), _f(clip))
    return F.when(ok, F.round(_f(clamped * _f(scale)))).cast("short")


def encode_eval_from_cp(cp: Column, scale: float = S.FIXED_SCALE, clip: float = S.STORAGE_TARGET_CLIP) -> Column:
    return encode_eval(normalize_target(cp), scale, clip)


def decode_eval(raw: Column, scale: float = S.FIXED_SCALE) -> Column:
    return _f(_f(raw) / _f(scale))


def checked_wdl(wdl: Column) -> Column:
    return F.when(wdl.isin(-1, 0, 1), wdl).cast("byte")


def eval_white_pov(eval_stm: Column, stm: Column) -> Column:
    return F.when(stm == 1, -eval_stm).otherwise(eval_stm)


def wdl_stm_pov(wdl: Column, stm: Column) -> Column:
    return F.when(stm == 1, -wdl).otherwise(wdl)


def output_bucket(count: Column) -> Column:
    return F.least(F.greatest(F.floor((count - 2) / 4), F.lit(0)), F.lit(7)).cast("int")


def phase(count: Column) -> Column:
    return F.when(count > 20, "opening").when(count > 10, "middle").otherwise("endgame")


def is_mate(value: Column) -> Column:
    return F.abs(value) > S.MATE_THRESHOLD


def loss_weight(value: Column, count: Column) -> Column:
    by_bucket = F.element_at(F.array(*map(F.lit, S.BUCKET_WEIGHTS)), output_bucket(count) + 1)
    return F.when(F.abs(value) > S.FILTER_THRESHOLD, S.FILTER_WEIGHT).otherwise(1.0) * F.when(F.abs(value) <= S.SKIP_THRESHOLD, 1.0).otherwise(0.0) * by_bucket


def synthetic_wdl(value: Column) -> Column:
    cp = F.when(is_mate(value), F.signum(value) * 32000.0).otherwise(value * S.EVAL_SCALE)
    return 2.0 / (1.0 + F.exp(-cp / S.WDL_TEMPERATURE)) - 1.0


def squashed_cp(raw: Column, stm: Column) -> Column:
    """Centipawns, white's view, from a raw net output."""
    t = F.least(F.greatest(F.tanh(raw), F.lit(-0.9999)), F.lit(0.9999))
    return eval_white_pov(0.5 * F.log((1 + t) / (1 - t)) * S.EVAL_SCALE, stm)


def screlu(x: Column) -> Column:
    return F.pow(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 2)


def quantise(weight: Column, scale: float, bound: int) -> Column:
    """Rounded half to even and clamped."""
    return F.least(F.greatest(F.rint(weight * scale), F.lit(float(-bound))), F.lit(float(bound))).cast("int")


def clamp_weight(weight: Column, bound: float) -> Column:
    return F.least(F.greatest(weight, F.lit(-bound)), F.lit(bound))


def feature_set_name(number: Column) -> Column:
    out = None
    for k, name in S.FEATURE_SETS.items():
        out = F.when(number == k, name) if out is None else out.when(number == k, name)
    return out.otherwise("?")


def align_up(value: int, to: int) -> int:
    return -(-value // to) * to


def checked_u64(op: str, a: int, b: int) -> tuple[bool, int]:
    """(overflow, result or 0) of unsigned 64-bit addition or multiplication."""
    out = a + b if op == "add" else a * b
    return (True, 0) if out >= 1 << 64 else (False, out)


def container_size(positions: int, features: int, metadata: int) -> int:
    from posframe.sources.container import layout

    return layout(positions, features)["metadata_offset"] + metadata


def memory_estimate_gb(positions: int, features: int) -> float:
    return (20 * positions + 2 * features) / 1e9


def decode_evals(raw: Column, scale: float = S.FIXED_SCALE) -> Column:
    """The batch form of decode_eval: times the 32-bit reciprocal of the scale, which
    differs from a division in the last bit."""
    return raw.cast("float") * (F.lit(1.0).cast("float") / F.lit(scale).cast("float")).cast("float")
