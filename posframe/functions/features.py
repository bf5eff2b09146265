"""Feature ids and feature arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posframe import schema as S


def feature_id(color: Column, piece: Column, square: Column) -> Column:
    return (color * 384 + piece * 64 + square).cast("int")


def feature_color(f: Column) -> Column:
    return F.floor(f / 384).cast("int")


def feature_piece(f: Column) -> Column:
    return F.floor((f % 384) / 64).cast("int")


def feature_square(f: Column) -> Column:
    return (f % 64).cast("int")


def flipped(f: Column) -> Column:
    """The id from the other side's point of view; its own inverse."""
    return feature_id(1 - feature_color(f), feature_piece(f), feature_square(f).bitwiseXOR(F.lit(56)))


def mirrored(f: Column) -> Column:
    return f.bitwiseXOR(F.lit(7))


def flip_all(features) -> Column:
    return F.transform(features, flipped)


def mirror_all(features, flag: Column | None = None) -> Column:
    out = F.transform(features, mirrored)
    return out if flag is None else F.when(flag, out).otherwise(F.col(features) if isinstance(features, str) else features)


def streams(features: Column, stm: Column) -> tuple[Column, Column]:
    """(side to move's features, the other side's)."""
    other = flip_all(features)
    return F.when(stm == 1, other).otherwise(features), F.when(stm == 1, features).otherwise(other)


def padded(features: Column, width: int = S.MAX_COUNT, pad: int = S.PAD) -> Column:
    return F.concat(features, F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(features), F.lit(0)).cast("int")))


def unpadded(row: Column, count: Column) -> Column:
    return F.slice(row, F.lit(1), count.cast("int"))


def remap_padding(row: Column, to: int, pad: int = S.PAD) -> Column:
    return F.transform(row, lambda x: F.when(x == pad, to).otherwise(x))


def all_below(features: Column, bound: int) -> Column:
    return F.forall(features, lambda x: (x >= 0) & (x < bound))


def by_square(features: Column) -> Column:
    """Features in the order of their squares."""
    return F.transform(F.array_sort(F.transform(features, lambda f: F.struct(feature_square(f).alias("s"), f.alias("f")))), lambda x: x["f"])


def as_text(features: Column) -> Column:
    return F.array_join(F.transform(features, lambda x: x.cast("string")), ",")


#: The piece letters of a board in their order of type.
LETTERS = "PNBRQK"


def fen_stm(fen: Column) -> Column:
    return F.when(F.split(fen, " ")[1] == "w", 0).otherwise(1)


def fen_features(fen: Column) -> Column:
    """White's feature ids of a FEN string, in board order (a8 first)."""
    board = F.split(fen, " ")[0]
    for n in range(8, 1, -1):
        board = F.replace(board, F.lit(str(n)), F.lit("1" * n))
    cells = F.filter(F.split(F.replace(board, F.lit("/"), F.lit("")), ""), lambda c: c != "")
    cells = F.transform(cells, lambda c, i: F.struct(c.alias("c"), (56 - 8 * F.floor(i / 8) + i % 8).alias("s")))
    pieces = F.filter(cells, lambda x: x["c"] != "1")
    color = lambda x: F.when(x["c"] == F.upper(x["c"]), 0).otherwise(1)
    kind = lambda x: F.array_position(F.array(*map(F.lit, LETTERS)), F.upper(x["c"])) - 1
    return F.transform(pieces, lambda x: feature_id(color(x), kind(x), x["s"]))
