"""Near-duplicate groups by five-word similarity, found through SimHash.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Texts with equal sets are one class. The first candidates
come from `prints` SimHash fingerprints of a text's distinct words, each with its
own seed: texts within three differing bits in one of them meet under its deletion
variants (see simhash.py). Of the fingerprints that meet under a variant, each is
compared with the bucket's `hubs` least by a fixed hash, the same in all buckets, so
a group of many copies gives a number of candidates in proportion to its size. All
candidates are verified on their whole sets, and the star method joins the links.

What that leaves apart is completed exactly, class by class, so that no link
depends on a fingerprint, a hub or a class that stands for others. In any one order
of all shingles, the first n - 0.8 n + 1 of a set of n and of each set linked to it
have one in common. So the classes that share one of these are compared, if they are
not in one component yet: by size, by the shingle's places in both orders (at the
first common one, enough shingles for the similarity follow in either set, so the
bucket of that one lists the pair and those of later ones needn't) and by a sketch (the
parities of the shingles in 512 cells: no more of them differ than shingles do; of long
sets it says nothing).
In a large bucket a class is paired with its `width` nearest by the sketch; classes
with more are marked, and while there are such, the round is repeated for them, with
eight times the width, over what is still apart and untested. So pairs within a
linked group are never listed, and no pair is left out at the end.

Each pair, of prints or of buckets, is then held against a wider sketch (two to four
cells a shingle) before whole sets are read, for sets are the bulk of the work.

Texts, sketches and sets are shuffled only for the classes that a step compares, and
in the end for the rows that go: others are told by a map of bits (common.meeting).
The maps of ended steps are dropped from the driver after each step (common.release).

The order is that of the hashes with the most frequent shingles of a sample last,
which keeps buckets small; it decides on the work, not on the result.

Nulls and edges: a null text is an empty one; texts without words are one class;
of a text of fewer than five words the whole is the shingle. Null ids count as
greater than others. Repeated rows are one class. An empty table has no groups.
Extra columns stay as they are. Classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm import simhash
from posframe.llm.bpe import sliced
from posframe.llm.common import Scratch, hashed_words, meeting, mix64, release, row_digest, texts, trimmed
from posframe.llm.components import components

PRINTS, HUBS = 2, 4
CELLS, WIDTH = 512, 8
#: Shingles that come last: those of over FREQUENT texts of a SAMPLE-th of all, the most frequent HOT.
SAMPLE, FREQUENT, HOT = 16, 16, 500_000


def sets(docs: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles, and of its distinct words."""
    hashes, counts = hashed_words(docs, lower=True)
    out, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        h = own[: max(n - k + 1, min(n, 1))]
        for i in range(1, min(k, n)):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15 + 2 * i) + own[i : i + len(h)])
        out.append((np.unique(h), np.unique(own)))
    return out


def bits(features: np.ndarray, seed: int) -> np.uint64:
    """The SimHash of distinct features: a bit is 1 if set in over half of their hashes."""
    if not len(features):
        return np.uint64(0)
    h = mix64(features + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        total += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0]


def class_of(own: np.ndarray) -> int:
    """A text's class: a hash of its set, as a signed long."""
    return int(mix64(np.array([np.bitwise_xor.reduce(mix64(own)) + np.uint64(len(own))]))[0].view(np.int64)) if len(own) else 0


def sketch(own: np.ndarray, cells: int) -> bytes:
    """The parities of a set's hashes in a number of cells, a power of two."""
    return np.packbits((np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def wide(own: np.ndarray) -> bytes:
    return sketch(own, max(CELLS, 1 << (2 * len(own)).bit_length()))


def differing(x: bytes, y: bytes) -> int:
    """How many cells of two sketches differ, the longer one folded to the shorter."""
    parts = []
    for z in (x, y):
        z = np.frombuffer(z, np.uint8)
        # cell i of a folded sketch is the sum of those that are i by the lower bits
        parts.append(np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0))
    return int(np.bitwise_count(parts[0] ^ parts[1]).sum(dtype=np.int64))


def most_differing(n, similarity: float):
    """How many shingles two sets of n in all may differ by at the similarity."""
    return n * (1 - similarity) / (1 + similarity) + 1e-6


def prefix(own: np.ndarray, similarity: float, last: np.ndarray) -> np.ndarray:
    """The first of a set's sorted hashes, those in `last` (sorted) after all others, of
    which every set of the similarity has one among its own."""
    if not len(own):
        return own
    size = len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1
    if len(last):
        at = np.minimum(np.searchsorted(last, own), len(last) - 1)
        hot = last[at] == own
        own = np.r_[own[~hot], own[hot]]
    return own[:size]


def _prepared(docs: DataFrame, text: str, k: int, prints: int, similarity: float, last: np.ndarray) -> DataFrame:
    """__key, __n (a null id), __i, __c (the class), __size (of the set), __sketch, __wide, __prefix and __fps."""
    own = docs.select("__key", "__n", "__i", F.col(text).alias("__text"))
    kind = own.schema["__i"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def run(it):
        for batch in it:
            for part in sliced(batch):
                made = sets(list(texts(part.column(3))), k)
                columns = [
                    pa.array([class_of(s) for s, _ in made], pa.int64()), pa.array([len(s) for s, _ in made], pa.int64()), pa.array([sketch(s, CELLS) if len(s) <= 3 * CELLS else b"" for s, _ in made], pa.binary()),
                    pa.array([wide(s) for s, _ in made], pa.binary()),
                    pa.array([prefix(s, similarity, sent.value).tobytes() for s, _ in made], pa.binary()),
                    pa.array([[int(bits(w, i + 1).view(np.int64)) for i in range(prints)] for _, w in made], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *columns], names=["__key", "__n", "__i", "__c", "__size", "__sketch", "__wide", "__prefix", "__fps"])

    return own.mapInArrow(run, f"__key binary, __n boolean, __i {kind}, __c long, __size long, __sketch binary, __wide binary, __prefix binary, __fps array<long>")


def _frequent(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """The sorted hashes of the shingles that come last in the order."""

    def run(it):
        for batch in it:
            for part in sliced(batch):
                made = [s for s, _ in sets(list(texts(part.column(0))), k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], names=["__h"])

    some = docs.select(F.col(text).alias("__text")).filter(F.pmod(F.xxhash64("__text"), F.lit(SAMPLE)) == 0)
    often = some.mapInArrow(run, "__h long").groupBy("__h").count().filter(F.col("count") > FREQUENT)
    found = often.orderBy(F.desc("count"), "__h").limit(HOT).select("__h").toArrow().column("__h").to_numpy()
    return np.sort(found.view(np.uint64))


def _shared(one: DataFrame) -> DataFrame:
    """__h, __c and __p: the classes that have a shingle __h in their prefix, of those
    that several have, and its place there (from 0)."""

    def rows(it):
        for batch in it:
            for part in sliced(batch, 4096):
                own = [np.frombuffer(x.as_py(), np.int64) for x in part.column(1)]
                c = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own])
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(c), pa.array(place)], names=["__h", "__c", "__p"])

    def several(it):
        for h, c, place in _buckets(it):
            again = np.r_[False, h[1:] == h[:-1]]
            keep = again | np.r_[again[1:], False]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, c, place)], names=["__h", "__c", "__p"])

    made = one.select("__c", "__prefix").mapInArrow(rows, "__h long, __c long, __p int")
    return made.repartition("__h").sortWithinPartitions("__h").mapInArrow(several, "__h long, __c long, __p int")


def _buckets(it):
    """The columns of batches sorted by the first as arrays, cut so that no bucket (equal values of the first) is parted."""
    held = None
    for batch in trimmed(it):
        own = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held is not None:
            own = [np.concatenate([a, b]) for a, b in zip(held, own, strict=True)]
        if not len(own[0]):
            continue
        cut = int(np.searchsorted(own[0], own[0][-1]))  # the last bucket may go on in the next batch
        held = [x[cut:] for x in own]
        if cut:
            yield [x[:cut] for x in own]
    if held is not None:
        yield held


def _apart(shared: DataFrame, labelled: DataFrame, one: DataFrame, similarity: float, width: int, marked: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of classes that share a shingle of their prefixes, are not in one
    component and may have the similarity by their sizes and sketches; (a, a) where a
    class has more such partners in a bucket than `width`, the nearest by the sketch.
    Where classes (__c) are marked, only pairs with one of them, for others have no more.
    Buckets of one component are found by an aggregate, before sketches are joined."""

    def near(root, size, place, cells, known, i, j):
        """Of pairs of rows, those that may have the similarity with the bucket's shingle
        as their first common one, and how many cells differ."""
        x, y = size[i], size[j]
        ok = (root[i] != root[j]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)
        both = (x + y) * similarity / (1 + similarity) - 1e-6
        ok &= (place[i] <= x - both) & (place[j] <= y - both)
        i, j = i[ok], j[ok]
        differ = np.bitwise_count(cells[i] ^ cells[j]).sum(axis=1, dtype=np.int64)
        ok = (differ <= most_differing(size[i] + size[j], similarity)) | ~(known[i] & known[j])
        return i[ok], j[ok], differ[ok]

    def run(it):
        for h, root, c, size, place, raw, mark in _buckets(it):
            mark = mark.astype(bool)
            known = np.fromiter((len(x) > 0 for x in raw), dtype=bool, count=len(h))
            cells = np.frombuffer(b"".join(x or bytes(CELLS // 8) for x in raw), np.uint64).reshape(len(h), -1)
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            length = np.diff(np.r_[start, len(h)])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def found(i, j):
                left.append(c[i])  # noqa: B023
                right.append(c[j])  # noqa: B023

            # small buckets all at once, by the distance of the places
            small = np.flatnonzero(np.repeat(length <= 2 * width, length))
            for d in range(1, 2 * width):
                i = small[small + d < len(h)]
                i = i[h[i] == h[i + d]]
                if not len(i):
                    break
                i = i[mark[i] | mark[i + d]]
                for at in range(0, len(i), 1 << 16):
                    part = i[at : at + (1 << 16)]
                    found(*near(root, size, place, cells, known, part, part + d)[:2])
            # of a large one, all but the members of the component that has most are compared with all
            for s, n in zip(start[length > 2 * width], length[length > 2 * width], strict=True):
                back, sizes = np.unique(root[s : s + n], return_inverse=True, return_counts=True)[1:]
                by_size = s + np.argsort(size[s : s + n], kind="stable")
                sorted_sizes = size[by_size]
                for i in s + np.flatnonzero((back != np.argmax(sizes)) & mark[s : s + n]):
                    low, high = np.searchsorted(sorted_sizes, [similarity * size[i] - 1e-6, size[i] / similarity + 1e-6])
                    others = by_size[low : high + 1]
                    _, j, differ = near(root, size, place, cells, known, np.full(len(others), i), others)
                    if len(j) > width:
                        j = np.r_[i, j[np.lexsort((c[j], differ))[:width]]]
                    found(np.full(len(j), i), j)
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, x].copy()) for x in (0, 1)], names=["a", "b"])

    labels = labelled.select("__c", "__root")
    several = scratch.stored(shared.join(labels, "__c").groupBy("__h").agg(F.min("__root").alias("x"), F.max("__root").alias("y")).filter("x <> y").select("__h"))
    rows = scratch.stored(meeting(shared, "__h", several).join(several, "__h", "left_semi"))
    of = rows.select("__c")
    rows = rows.join(meeting(labels, "__c", of), "__c").join(meeting(one.select("__c", "__size", "__sketch"), "__c", of), "__c")
    rows = rows.withColumn("__mark", F.lit(True)) if marked is None else rows.join(marked.withColumn("__mark", F.lit(True)), "__c", "left").fillna(False, "__mark")
    rows = rows.select("__h", "__root", "__c", "__size", "__p", "__sketch", "__mark").repartition("__h").sortWithinPartitions("__h")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _sets_of(docs: DataFrame, k: int) -> DataFrame:
    """__c and __set (sorted distinct hashes, binary) of docs (__c, __text)."""

    def run(it):
        for batch in it:
            for part in sliced(batch):
                made = [s.tobytes() for s, _ in sets(list(texts(part.column(1))), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["__c", "__set"])

    return docs.mapInArrow(run, "__c long, __set binary")


def _candidates(keyed: DataFrame, radius: int, hubs: int) -> DataFrame:
    """Pairs (a, b) of fingerprints (__b, __fp) that meet, each with the hubs of its bucket."""

    def run(it):
        def pairs(key, fp):
            order = np.lexsort((mix64(fp), key))
            key, fp = key[order], fp[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            place = np.arange(len(fp)) - np.repeat(start, np.diff(np.r_[start, len(fp)]))
            first = np.arange(len(fp)) - place
            out = []
            for h in range(hubs):
                at = np.flatnonzero(place > h)
                if not len(at):
                    break
                hub = first[at] + h
                near = np.bitwise_count(fp[at] ^ fp[hub]) <= radius
                out.append(np.stack([fp[hub[near]], fp[at[near]]], axis=1))
            found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64))], names=["a", "b"])

        for key, fp in _buckets(it):
            yield pairs(key, fp.view(np.uint64))

    return keyed.select("__b", "__fp").repartition("__b").sortWithinPartitions("__b").mapInArrow(run, "a long, b long").distinct()


def _passing(pairs: DataFrame, one: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes that may have the similarity by their sizes and wider sketches."""

    def run(it):
        for batch in trimmed(it):
            a, b, m, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ok = np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6
            most = most_differing(m + n, similarity)
            for i in np.flatnonzero(ok):
                ok[i] = differing(batch.column(4)[i].as_py(), batch.column(5)[i].as_py()) <= most[i]
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    joined = pairs.join(one.select(F.col("__c").alias("a"), F.col("__size").alias("m"), F.col("__wide").alias("s")), "a").join(one.select(F.col("__c").alias("b"), F.col("__size").alias("n"), F.col("__wide").alias("t")), "b")
    return joined.select("a", "b", "m", "n", "s", "t").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets_: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have the similarity."""

    def run(it):
        for batch in trimmed(it):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) >= similarity * max(len(s), len(t)) else 0
                keep.append(both >= similarity * (len(s) + len(t) - both) - 1e-9 and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    joined = pairs.join(sets_.select(F.col("__c").alias("a"), F.col("__set").alias("s")), "a").join(sets_.select(F.col("__c").alias("b"), F.col("__set").alias("t")), "b")
    return joined.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, similarity: float = 0.8, prints: int = PRINTS, hubs: int = HUBS, bucket: int = 4096, width: int = WIDTH) -> DataFrame:
    """docs with one row of each group of linked texts: the one of the least id (null
    last), of equal ids that of the least digest of id and text, of equal rows any one."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.withColumn("__key", row_digest(doc_id, text))
    source = keyed.withColumn("__n", F.col(doc_id).isNull()).withColumn("__i", F.col(doc_id))
    own = scratch.stored(_prepared(source, text, k, prints, similarity, _frequent(docs, text, k)))
    least = F.min(F.struct("__n", "__i", "__key")).alias("__first")
    one = scratch.stored(own.groupBy("__c").agg(*[F.first(x).alias(x) for x in ("__fps", "__size", "__sketch", "__wide", "__prefix")], least))

    # the prints share one pool: values that agree by chance are only candidates
    prints_ = one.select("__c", F.explode("__fps").alias("__fp"))
    of = scratch.stored(prints_.groupBy("__fp").agg(F.min("__c").alias("__r")))
    same = prints_.join(of, "__fp").filter(F.col("__c") != F.col("__r")).select(F.col("__r").alias("x"), F.col("__c").alias("y"))
    met = _candidates(simhash.keyed(of.select("__fp"), simhash.hot_keys(of, bucket, scratch=scratch)), simhash.RADIUS, hubs)
    named = met.join(of.select(F.col("__fp").alias("a"), F.col("__r").alias("x")), "a").join(of.select(F.col("__fp").alias("b"), F.col("__r").alias("y")), "b")
    pairs = named.select("x", "y").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()

    def ends(pairs):
        return pairs.select(F.explode(F.array("a", "b")).alias("__c"))

    def passing(pairs):
        pairs = scratch.stored(pairs)
        release(docs.sparkSession)
        return scratch.stored(_passing(pairs, meeting(one, "__c", ends(pairs)), similarity))

    made: list[DataFrame] = []  # the sets of classes, as they are needed

    def verified(pairs):
        """The links of pairs; only the sets of classes that are in a pair are made, and once."""
        wanted = ends(pairs).distinct()
        for x in made:
            wanted = wanted.join(x.select("__c"), "__c", "left_anti")
        keys = scratch.stored(meeting(one, "__c", wanted).join(wanted, "__c", "left_semi").select("__c", F.col("__first.__key").alias("__key")))
        if not made or not keys.isEmpty():
            # texts are shuffled, not sorted, and alike at every size
            some = meeting(keyed.select("__key", F.col(text).alias("__text")), "__key", keys.select("__key")).join(keys.hint("shuffle_hash"), "__key").dropDuplicates(["__c"]).select("__c", "__text")
            made.append(scratch.stored(_sets_of(some, k)))
        links = scratch.stored(_verified(pairs, meeting(reduce(DataFrame.unionByName, made), "__c", ends(pairs)), similarity))
        release(docs.sparkSession)
        return links

    def rooted(links):
        roots = components(links, scratch=scratch).withColumnRenamed("node", "__c")
        labelled = scratch.stored(one.select("__c", "__first").join(roots, "__c", "left").select("__c", "__first", F.coalesce("root", "__c").alias("__root")))
        release(docs.sparkSession)
        return labelled

    shared = scratch.stored(_shared(one))
    # pairs of prints that pass are taken for links to find what is apart beside them, and all are verified at once
    pairs = passing(pairs)
    late = _apart(shared, rooted(pairs), one, similarity, width, None, scratch).filter("a <> b")
    tested = scratch.stored(pairs.unionByName(passing(late)).distinct())
    links = verified(tested)
    labelled = rooted(links)
    # then all pairs that are still apart and weren't tested
    marked, more = None, True
    while more:
        late = scratch.stored(_apart(shared, labelled, one, similarity, width, marked, scratch))
        marked = late.filter("a = b").select(F.col("a").alias("__c"))
        more = not marked.isEmpty()
        late = passing(late.filter("a <> b").join(tested, ["a", "b"], "left_anti"))
        if not late.isEmpty():
            tested = tested.unionByName(late)
            late = verified(late)
            links = links.unionByName(late)
            labelled = rooted(links)
        width *= 8
    stay = labelled.groupBy("__root").agg(F.min("__first").alias("__first")).select(F.col("__first.__key").alias("__key"))
    again = own.groupBy("__key").count().filter("count > 1").select("__key", F.lit(True).alias("__again"))
    stay = scratch.stored(stay.join(again, "__key", "left").select("__key", F.coalesce("__again", F.lit(False)).alias("__again")))
    # rows that neither go nor occur again stay where they are; of the others, those that stay are found by a join
    touched = scratch.stored(own.select("__key").join(stay.filter("not __again"), "__key", "left_anti").distinct())
    scratch.clear(but=2)
    release(docs.sparkSession)
    out = meeting(keyed, "__key", touched).join(stay.hint("shuffle_hash"), "__key")
    alone = meeting(keyed, "__key", touched, "left_anti").select(docs.columns)
    return alone.unionByName(out.filter("not __again").select(docs.columns)).unionByName(out.filter("__again").dropDuplicates(["__key"]).select(docs.columns))
