"""Hierarchical multi-length packing of documents into training windows.

Documents are routed to tiers of context sizes (2048, 1024, 512, 256 tokens):
one longer than the longest window gives whole windows first, and what is left
goes to the least tier that holds it. Tiers are packed from the longest: each
item of a tier opens a window of that size, and the gap is filled from shorter
tiers, whole items first (the longest that fits), then one cut to fit. So each
window is full, and only what is left of a task's last items is not; that is
cut at powers of two and the rest, less than the least tier, padded. Windows of
one size are dealt to step groups so that attention cost is even.

A task packs the documents of its partition in blocks of `block_tokens`, items
that are left over going on to the next block: memory is bounded, nothing is
shuffled, and a lost task makes the same windows again from the same rows.

Nulls and ties: a null text is empty; a document has its end id at least, so
each row, repeated or not, with a null id or not, has a piece. An empty table
gives no pieces. Other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posframe.llm.bpe import encoder, sliced
from posframe.llm.common import table

TIERS = (2048, 1024, 512, 256)


class Packer:
    """Items are (length, number, document, start): `number` makes them differ."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = sorted(tiers, reverse=True), step_tokens
        self.pools = {t: [] for t in self.tiers}
        self.windows: list[tuple[int, list]] = []
        self.number = self.held = 0

    def tier(self, length: int) -> int:
        return next(t for t in reversed(self.tiers) if length <= t)

    def put(self, length: int, doc: int, start: int) -> None:
        if length:
            self.number += 1
            self.held += length
            insort(self.pools[self.tier(length)], (length, self.number, doc, start))

    def take(self, tier: int, at: int) -> tuple:
        item = self.pools[tier].pop(at)
        self.held -= item[0]
        return item

    def route(self, doc: int, length: int) -> None:
        most = self.tiers[0]
        for start in range(0, length - length % most, most):
            self.windows.append((most, [(doc, start, most)]))
        self.put(length % most, doc, length - length % most)

    def fitting(self, gap: int) -> tuple | None:
        """The longest item of no more than gap tokens."""
        for t in self.tiers:
            if at := bisect_right(self.pools[t], (gap, float("inf"))):
                return self.take(t, at - 1)
        return None

    def least(self) -> tuple | None:
        for t in reversed(self.tiers):
            if self.pools[t]:
                return self.take(t, 0)
        return None

    def fill(self, tier: int) -> bool:
        """Opens a window with the tier's longest item; False if it can't be filled."""
        if self.held < tier:
            return False
        length, _, doc, start = self.take(tier, len(self.pools[tier]) - 1)
        window, gap = [(doc, start, length)], tier - length
        while gap:
            item = self.fitting(gap) or self.least()
            length, _, doc, start = item
            used = min(gap, length)
            window.append((doc, start, used))
            self.put(length - used, doc, start + used)
            gap -= used
        self.windows.append((tier, window))
        return True

    def pack(self, last: bool) -> None:
        """Packs what is held; `last` also what fills no window of its tier."""
        for t in self.tiers:
            while self.pools[t] and self.fill(t):
                pass
        if last:
            for size in [t for t in self.tiers if t & (t - 1) == 0] + [self.tiers[0]]:
                while self.held >= size or (size == self.tiers[0] and self.held and self.windows_end(size)):
                    window, gap = [], size
                    while gap and self.held:
                        length, _, doc, start = self.fitting(gap) or self.least()
                        used = min(gap, length)
                        window.append((doc, start, used))
                        self.put(length - used, doc, start + used)
                        gap -= used
                    self.windows.append((size, window))

    def windows_end(self, size: int) -> bool:
        """Whether nothing but less than the least tier is left."""
        return self.held < self.tiers[-1]

    def steps(self) -> list[int]:
        """The step group of each window: windows of one size, dearest first, go
        to and fro over the groups of that size."""
        out = [0] * len(self.windows)
        base = 0
        for t in self.tiers:
            own = sorted((i for i, (size, _) in enumerate(self.windows) if size == t), key=lambda i: -sum(n * n for _, _, n in self.windows[i][1]))
            groups = -(-len(own) * t // self.step_tokens)
            for k, i in enumerate(own):
                lap, at = divmod(k, groups)
                out[i] = base + (at if lap % 2 == 0 else groups - 1 - at)
            base += groups
        return out


def pack(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", tiers: tuple[int, ...] = TIERS, end_id: int = 1, step_tokens: int = 1 << 19, block_tokens: int = 4 << 20) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset, tier int, step_group long."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it):
        model = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 36
        packer, held, made, groups = Packer(tiers, step_tokens), {}, 0, 0
        docs_seen = tokens = 0

        def out(last: bool):
            nonlocal made, groups, tokens
            packer.pack(last)
            steps = packer.steps()
            rows = [[] for _ in schema.names]
            for (tier, window), step in zip(packer.windows, steps, strict=True):
                offset = 0
                for doc, start, length in window:
                    key, ids = held[doc]
                    for column, x in zip(rows, (key, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, base + made, offset, tier, base + groups + step), strict=True):
                        column.append(x)
                    offset += length
                made += 1
                if len(rows[0]) >= 4096:
                    yield rows
                    rows = [[] for _ in schema.names]
            groups += max(steps, default=-1) + 1
            packer.windows = []
            left = {x[2] for pool in packer.pools.values() for x in pool}
            for doc in [d for d in held if d not in left]:
                del held[doc]
            tokens = 0
            if rows[0]:
                yield rows

        key_type = None
        for batch in it:
            key_type = batch.schema.field(0).type
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            as_batch = lambda rows, types=types: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=schema.names)
            for part in sliced(batch):
                keys = part.column(0).to_pylist()
                for key, ids in zip(keys, model.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    held[docs_seen] = (key, ids)
                    packer.route(docs_seen, len(ids) // 4)
                    docs_seen += 1
                    tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield from map(as_batch, out(False))
        if docs_seen:
            yield from map(as_batch, out(True))

    return docs.select(doc_id, F.col(text).alias("__text")).mapInArrow(run, schema)


def op3_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
