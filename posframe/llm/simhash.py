"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits: of three differing
bits one segment has at most one. So two fingerprints within three bits share a
one-wildcard variant of a segment (the segment with one bit masked, and which):
the variants are the index, equal variants meet, and the distance is verified.

Only distinct fingerprints are indexed; rows that share one are linked by it.
Fingerprints that meet under a variant are linked by a spanning forest, never
by all pairs. A bucket of up to `bucket` fingerprints is verified at once;
members of a larger one are keyed again by one-wildcard variants of the halves
of the other segment (16 bits, then 8), for there, too, one half differs by at
most one bit. The last keys leave 11 bits free, so no bucket can hold more than
2048 fingerprints, however many copies or near copies there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm.bpe import sliced
from posframe.llm.common import Scratch, table, texts, words
from posframe.llm.components import components

RADIUS = 3


def shingles(text: bytes, k: int) -> list[bytes]:
    """The k-word shingles of a text with A-Z in lower case, joined by one space;
    all words, if there are fewer; none of a text without words."""
    ws = words(text.lower())
    if len(ws) <= k:
        return [b" ".join(ws)] if ws else []
    return list(map(b" ".join, zip(*(ws[i:] for i in range(k)), strict=False)))


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    import xxhash

    own = shingles(text, k)
    if not own:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, seed) for s in own), dtype="<u8", count=len(own))
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(own), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = 3) -> DataFrame:
    """keep and __fp (the fingerprint's bits as a signed long). A null text has none: zero."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", __fp long"

    def run(it):
        for batch in it:
            for part in sliced(batch):
                fps = np.fromiter((fingerprint(t, k) for t in texts(part.column(len(keep)))), dtype=np.uint64, count=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(fps.view(np.int64))], names=[*keep, "__fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _variants(column, shift: int, width: int):
    """An array of the one-wildcard variants of `width` bits at `shift`, each
    with the place of the wildcard above the bits."""
    segment = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))).bitwiseOR(F.lit(((shift // width) << 6 | i) << 32)) for i in range(width)])


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links values within the radius."""
    left, right, todo = [], [], np.arange(len(fps))
    frontier = []
    while len(todo) or frontier:
        if not frontier:
            frontier, todo = [todo[0]], todo[1:]
        at = frontier.pop()
        near = np.bitwise_count(fps[todo] ^ fps[at]) <= radius
        if near.any():
            reached = todo[near]
            left += [at] * len(reached)
            right += reached.tolist()
            frontier += reached.tolist()
            todo = todo[~near]
    return fps[np.array(left, dtype=int)], fps[np.array(right, dtype=int)]


def _links(keyed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Edges (a, b) of the fingerprints that share all keys and are within the radius."""

    def run(it):
        held: dict[str, np.ndarray] | None = None

        def edges(ks, fps):
            """Whole buckets in key order; buckets of two, nearly all, at once."""
            change = np.zeros(len(fps), dtype=bool)
            change[0] = True
            for k in ks:
                change[1:] |= k[1:] != k[:-1]
            at = np.flatnonzero(change)
            size = np.diff(np.r_[at, len(fps)])
            two = at[size == 2]
            a, b = fps[two], fps[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            out = [(a[near], b[near])]
            for i, n in zip(at[size > 2], size[size > 2], strict=True):
                out.append(_forest(fps[i : i + n], radius))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names=["a", "b"])

        for batch in it:
            ks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            fps = batch.column(len(keys)).to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                ks = [np.concatenate([h, k]) for h, k in zip(held[0], ks, strict=True)]
                fps = np.concatenate([held[1], fps])
            if not len(fps):
                continue
            last = np.ones(len(fps), dtype=bool)
            for k in ks:
                last &= k == k[-1]
            cut = int(np.flatnonzero(last)[0])  # the last bucket may go on in the next batch
            held = ([k[cut:] for k in ks], fps[cut:])
            if cut:
                yield edges([k[:cut] for k in ks], fps[:cut])
        if held is not None and len(held[1]):
            yield edges(*held)

    return keyed.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "__fp").mapInArrow(run, "a long, b long")


def _both(column):
    return F.concat(_variants(column, 0, 32), _variants(column, 32, 32))


def hot_keys(fps: DataFrame, bucket: int, by: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """by and k1 of the variants that more than `bucket` rows of fps (__fp) may share.
    A variant's rows have one of two values of the segment, so whole segments are
    counted, two a row: a variant of more rows has a value with over half as many."""
    low, high = F.col("__fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("__fp", 32)
    parts = fps.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("s"), low.alias("v")), F.struct(F.lit(1).alias("s"), high.alias("v")))).alias("p"))
    often = parts.groupBy(*by, "p.s", "p.v").count().filter(F.col("count") > bucket // 2)
    keys = F.when(F.col("s") == 0, _variants(F.col("v"), 0, 32)).otherwise(_variants(F.shiftleft("v", 32), 32, 32))
    return (scratch or Scratch(fps.sparkSession)).stored(often.select(*by, F.explode(keys).alias("k1")).distinct())


def keyed(fps: DataFrame, hot: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """fps with a row for each of its buckets, numbered by __b: of variants of the
    segments or, where those are hot, of variants of the halves that they leave open."""
    first = fps.withColumn("k1", F.explode(_both(F.col("__fp"))))
    if hot.isEmpty():
        return first.withColumn("__b", F.xxhash64(*by, "k1")).drop("k1")
    rest = first.join(hot, [*by, "k1"], "left_anti").withColumn("__b", F.xxhash64(*by, "k1"))
    dense = first.join(hot, [*by, "k1"], "left_semi")
    # what the key of a level leaves open is the other half than the one whose number stands above the wildcard's place
    other = F.when(F.shiftrightunsigned("k1", 38).bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned("__fp", 32)).otherwise(F.col("__fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    dense = dense.withColumn("__o", other).withColumn("k2", F.explode(F.concat(_variants(F.col("__o"), 0, 16), _variants(F.col("__o"), 16, 16))))
    half = F.when(F.shiftrightunsigned("k2", 38).bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned("__o", 16)).otherwise(F.col("__o")).bitwiseAND(F.lit(0xFFFF))
    dense = dense.withColumn("__h", half).withColumn("k3", F.explode(F.concat(_variants(F.col("__h"), 0, 8), _variants(F.col("__h"), 8, 8))))
    dense = dense.withColumn("__b", F.xxhash64(*by, "k1", "k2", "k3"))
    columns = [*fps.columns, "__b"]
    return rest.select(columns).unionByName(dense.select(columns))


def link(fps: DataFrame, radius: int = RADIUS, bucket: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """Distinct edges (a, b) that join fingerprints (column __fp, distinct)
    within the radius (three at most) into the same components as all pairs would."""
    if radius > RADIUS:
        raise ValueError("two segments promise no more than three differing bits")
    own = fps.select("__fp")
    return _links(keyed(own, hot_keys(own, bucket, scratch=scratch)), ["__b"], radius).distinct()


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3, radius: int = RADIUS, bucket: int = 4096) -> DataFrame:
    """One row per document: doc_id, __fp and component_id, the least doc_id of
    those its fingerprint reaches by links, its own included.

    Null texts and texts without words have fingerprint zero, linked like any
    other. Rows with a null doc_id are linked and get the component's least id,
    null only where no member has one. Repeated rows stay, each with its row. An
    empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.stored(fingerprints(docs, text, (doc_id,), k))
    classes = scratch.stored(own.groupBy("__fp").agg(F.min(doc_id).alias("__least")))
    roots = components(link(classes.select("__fp"), radius, bucket, scratch), scratch=scratch)
    labelled = classes.join(roots.withColumnRenamed("node", "__fp"), "__fp", "left").select("__fp", "__least", F.coalesce("root", "__fp").alias("__root"))
    least = labelled.groupBy("__root").agg(F.min("__least").alias("component_id"))
    named = labelled.join(least, "__root").select("__fp", "component_id")
    return scratch.kept(own.join(named, "__fp"))


def op10_simhash(spark, sf_dir) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
