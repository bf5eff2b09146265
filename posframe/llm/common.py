"""Helpers that the operators share: input tables, the shared folder, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only where a
    session of this one machine (tests) names none, it is given one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="posframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Tables written to a folder of their own in the shared folder. A stored table
    cuts the lineage, so a lost executor costs no more than reading files; `kept`
    stores the last one and deletes all that it was made of."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def stored(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{shared_dir(self.spark)}/posframe-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(path)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        out = self.stored(df, codec)
        self.clear(but=1)
        return out

    def clear(self, but: int = 0) -> None:
        """Deletes what was stored, except the `but` last tables."""
        jvm, old = self.spark._jvm, self.made[: len(self.made) - but]
        for path in old:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.made = self.made[len(self.made) - but :]


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet into the shared folder and read again."""
    return Scratch(df.sparkSession).stored(df, codec)


#: Rows of WORDS words of 64 bits in a map of keys: no more than this are broadcast, however many keys there are.
MAP_ROWS, WORDS = 1 << 16, 8


def _place(name: str) -> tuple[str, str, str]:
    """A key's row, word and bit in a map, as SQL."""
    h = f"xxhash64(`{name}`)"
    return f"pmod(shiftright({h}, {6 + WORDS.bit_length() - 1}), {MAP_ROWS}L)", f"pmod(shiftright({h}, 6), {WORDS}L)", f"shiftleft(1L, cast(pmod({h}, 64L) as int))"


def key_map(keys: DataFrame) -> DataFrame:
    """__row and its words __w0, __w1, ..., for the only column of `keys`. Several words a row
    spare the driver most of what a row takes besides its word."""
    row, word, bit = _place(keys.columns[0])
    each = keys.select(F.expr(row).alias("__row"), F.expr(word).alias("__word"), F.expr(bit).alias("__bit"))
    return each.groupBy("__row").agg(*[F.expr(f"bit_or(if(__word = {i}, __bit, 0L))").alias(f"__w{i}") for i in range(WORDS)])


def meeting(df: DataFrame, column: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose `column` may be in the only column of `keys` (of the same
    type), or by how="left_anti" those whose isn't for certain. Keys are hashed to the
    bits of a map, so a few rows that agree with a key's bit alone count as meeting:
    a join that follows decides. The map is broadcast and has at most MAP_ROWS rows;
    with very many keys it is full, and then all rows meet. Neither side may be null."""
    row, word, bit = _place(column)
    own = " ".join(f"when {i} then __w{i}" for i in range(WORDS))
    return df.join(F.broadcast(key_map(keys)), F.expr(f"{row} = __row and ((case {word} {own} end) & {bit}) <> 0"), how)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Broadcast tables and shuffle files of queries that
    have ended go only then; a run of many small queries otherwise gathers them until the
    driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives back to the system what this process has freed. Arrow's pool and the C heap keep
    it otherwise, in a worker for as long as it lives, idle or in later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trimmed(it: Iterator) -> Iterator:
    """it, with what was freed given back after each item."""
    for x in it:
        yield x
        del x
        trim()


def row_key(*columns: str):
    """A 64-bit key of a row, made of the named columns; null is a value of its own."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts)


def row_digest(*columns: str):
    """A 128-bit key of a row (binary), made of the named columns; null is a value of its own."""
    return F.unhex(F.md5(F.concat_ws("\0", *[x.cast("string") for c in columns for x in (F.col(c).isNull(), F.col(c))])))


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def words(text: bytes) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text; bytes.split() parts at just these six."""
    return text.split()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __init__(self, limit: int = 400_000, seed: int = 42):
        super().__init__()
        import xxhash

        self.limit, self.seed, self.hash = limit, seed, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word, self.seed)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        steps = np.full(1 << int(n).bit_length(), 0xC6A4A7935BD1E995, dtype=np.uint64)
        steps[0] = 1
        _POWERS[0] = np.cumprod(steps)
    return _POWERS[0]


def hashed_words(texts: list[bytes], lower: bool = False, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, one text after the other, and each
    text's number of words; with `lower`, of A-Z in lower case. Bytes are hashed
    in windows that end at white space, so memory follows the window and the
    longest word, not the texts."""
    joined = b" ".join(texts)
    raw = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    found, counts, begin = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64), 0
    while begin < len(raw):
        end = min(len(raw), begin + window)
        while end < len(raw) and not len(gap := np.flatnonzero(_SPACE[raw[end : end + 4096]])):
            end = min(len(raw), end + 4096)
        end += int(gap[0]) if end < len(raw) else 0
        part = raw[begin:end]
        space = _SPACE[part]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        if len(starts):
            sizes = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 - starts
            first = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            values = (part[~space].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()) + 1)[at]
            found.append(mix64(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _MIX))
            counts += np.bincount(np.searchsorted(offsets, starts + begin, side="right") - 1, minlength=len(texts))
        begin = end
    return np.concatenate(found), counts


def merged_sum(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if counts is None:
        k, n = np.unique(keys, return_counts=True)
        return k, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts.astype(np.int64), at)
