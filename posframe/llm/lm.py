"""Language-model scores from a log-frequency Bloom filter.

Counting. Tokens are the lower-cased words and an end. Each task sends, to each
shard of the token hashes, its distinct tokens with their training counts and
the documents that hold them, and its distinct longer n-grams with their
counts. Of the `head`, the most frequent tokens of a bounded sample and the end, it
sends the counts alone: their totals go to all tasks, and each adds them up for its own
documents, so no shard lists the documents of a hot token. A shard adds up, answers each task's documents with their sums of
log10(count + 1) (the exact base score), and builds its slice of the filter.

Filter. A count is quantised to a level: 1, 2, ..., 8, then steps of a fifth.
An n-gram of level q is inserted q times, as (n-gram, 1) to (n-gram, q); so it
is read by probing level after level until one is absent, and errors, rarer
with each level, only raise a count. A slice has `bits` bits an insertion, so
the filter grows with the distinct n-grams of the corpus. It is broadcast where
it takes no more than `broadcast_bytes`; beyond that its slices are broadcast in
groups of that size, each pass reading the n-grams of its group and handing the
levels on, which changes no score. Levels are stored, a byte for each token and
length of n-gram, so weights and scores are found without the texts.

Probabilities. P(w | h) = a count(h w) / count(h) + (1 - a) P(w | shorter h),
down to (count + 1) / (N + V + 1), with all counts from the filter. The weight a
depends on the order and on the size of count(h); of a fixed grid it is the one
that makes the training tokens likeliest when each is left out of its counts.

Nulls and edges: a null or empty text is an end alone. A null id counts as
training text. Repeated rows each count, and each is scored. With no training
text N and V are 0 and each token has the same probability. An empty table gives
no rows. Other columns are not read. A task holds `flush` tokens at a time; a
text longer than that is held whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm.bpe import sliced
from posframe.llm.common import hashed_words, merged_sum, mix64, row_key, stored, table, texts
from posframe.llm.quality import remainder

START, END = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
ORDER, BITS, PROBES = 2, 8, 4
#: Tokens whose documents aren't listed, and about how many documents they are taken from.
HEAD, HEAD_SAMPLE = 4096, 4096
GRID = np.r_[0.0, 0.002, 0.01, 0.03, 0.06, np.linspace(0.1, 0.9, 9), 0.95, 0.99]
BUCKETS = 24


def thresholds() -> np.ndarray:
    """The least count of each level from 1 on."""
    out = list(range(1, 9))
    while out[-1] < 1 << 62:
        out.append(-(-out[-1] * 6 // 5))
    return np.array(out, dtype=np.float64)


_LEAST = thresholds()
#: The count that a level stands for: the middle of its range, in logarithms.
_COUNT = np.r_[0.0, np.sqrt(_LEAST[:-1] * np.maximum(_LEAST[1:] - 1, _LEAST[:-1])), _LEAST[-1]]


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LEAST, counts, side="right")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _places(keys: np.ndarray, level: int):
    """Two hashes of (n-gram, level): place i is their sum with i times the second."""
    a = mix64(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return a, mix64(a ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _place(a, b, i, size):
    """A bit below size, which is below 2**32."""
    return ((a + b * np.uint64(i)) >> np.uint64(32)) * size >> np.uint64(32)


def build_slice(keys: np.ndarray, counts: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The bytes of a shard's slice."""
    q = levels(counts)
    size = max(64, -(-int(q.sum()) * bits // 8) * 8)
    if size >= 1 << 32:
        raise ValueError("a shard has too many n-grams; raise the number of shards")
    marked = np.zeros(size, dtype=bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        keys, q = keys[q >= level], q[q >= level]
        a, b = _places(keys, level)
        for i in range(probes):
            marked[_place(a, b, i, np.uint64(size))] = True
    return np.packbits(marked, bitorder="little")


class Filter:
    """The slices of some shards, one after the other; a shard that isn't there has size 0."""

    def __init__(self, slices: dict[int, bytes], shards: int):
        self.sizes = np.array([8 * len(slices.get(s, b"")) for s in range(shards)], dtype=np.uint64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(slices.get(s, b"") for s in range(shards)), dtype=np.uint8)

    def read(self, keys: np.ndarray, probes: int) -> np.ndarray:
        """The level of each n-gram, by probes until one fails."""
        out = np.zeros(len(keys), dtype=np.uint8)
        shard = shard_of(keys, len(self.sizes))
        left = np.flatnonzero(self.sizes[shard])
        for level in range(1, len(_LEAST) + 1):
            a, b = _places(keys[left], level)
            size, base = self.sizes[shard[left]], self.offsets[shard[left]]
            for i in range(probes):
                at = base + _place(a, b, i, size)
                held = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                a, b, size, base, left = a[held], b[held], size[held], base[held], left[held]
            if not len(left):
                break
            out[left] = level
        return out


class Grams:
    """The tokens of some documents, one after the other, each document with a
    start before and an end behind; key(k) are the hashes of its k-grams."""

    def __init__(self, docs: list[bytes], order: int):
        hashes, counts = hashed_words(docs, lower=True)
        self.lens = counts + 2
        ends = np.cumsum(self.lens)
        self.starts = ends - self.lens
        n = int(self.lens.sum())
        self.token = np.empty(n, dtype=np.uint64)
        inside = np.ones(n, dtype=bool)
        inside[self.starts] = inside[ends - 1] = False
        self.token[inside], self.token[self.starts], self.token[ends - 1] = hashes, START, END
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), self.lens)
        self.place = places(self.lens)
        # a start is as frequent as an end, and is read as one where it is a history
        self.keys = [np.where(self.place == 0, END, self.token)]
        for _ in range(1, order):
            before = np.r_[np.uint64(0), self.keys[-1][:-1]]
            self.keys.append(mix64(before * np.uint64(0xD6E8FEB86659FD93) + np.r_[START, self.token[:-1]] * np.uint64(0xA0761D6478BD642F) + self.token))

    def whole(self, k: int) -> np.ndarray:
        return whole(self.place, k)


def places(lens: np.ndarray) -> np.ndarray:
    """0, 1, ... of each document's tokens."""
    return (np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)


def whole(place: np.ndarray, k: int) -> np.ndarray:
    """Where a k-gram lies in one document and predicts a token."""
    return place >= max(1, k - 1)


def _bytes(*arrays):
    return [a.tobytes() for a in arrays]


def frequent(docs: DataFrame, size: int = HEAD, sample: int = HEAD_SAMPLE) -> np.ndarray:
    """The sorted hashes of the `size` most frequent tokens of about `sample` of docs (__key, __text), and the end."""

    def run(it):
        for batch in it:
            for part in sliced(batch):
                keys, n = merged_sum(hashed_words(list(texts(part.column(0))), lower=True)[0])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["token", "n"])

    share = max(1, docs.count() // sample)
    some = docs.filter(F.pmod("__key", F.lit(share)) == 0).select("__text").limit(2 * sample)
    found = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size).toArrow()
    return np.unique(np.r_[found.column("token").to_numpy().astype(np.int64).view(np.uint64), END])


def among(head: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's place in the sorted head, and whether it is there."""
    at = np.minimum(np.searchsorted(head, tokens), len(head) - 1)
    return at, head[at] == tokens


def count(docs: DataFrame, head: np.ndarray, order: int, shards: int, bits: int, probes: int, flush: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """docs: (__key, __learn, __text). Answers (batch, owners, sums, known, tokens,
    types) without the head, slices (shard, size, data), both from one exchange, and the
    training counts of the head."""

    def send(it):
        base, flushes = TaskContext.get().partitionId() << 32, 0
        grams, keys, learn, held = [], [], [], 0

        def out():
            nonlocal flushes
            token = np.concatenate([g.token[g.place > 0] for g in grams])
            shift = np.r_[0, np.cumsum([len(g.lens) for g in grams])[:-1]]
            doc = np.concatenate([g.doc[g.place > 0] + s for g, s in zip(grams, shift, strict=True)]).astype(np.uint32)
            owners, learns = np.concatenate(keys), np.concatenate(learn)
            order_ = np.lexsort((doc, token))
            token, doc = token[order_], doc[order_]
            at = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
            times = np.diff(np.r_[at, len(token)]).astype(np.uint32)
            token, doc = token[at], doc[at]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            posts = np.diff(np.r_[first, len(token)]).astype(np.uint32)
            trained = np.add.reduceat(times.astype(np.int64) * learns[doc], first).astype(np.uint32)
            types = token[first]
            listed = ~among(head, types)[1]
            doc, times = doc[np.repeat(listed, posts)], times[np.repeat(listed, posts)]
            posts = np.where(listed, posts, 0).astype(np.uint32)
            longer = [g.keys[k][g.whole(k + 1) & learns[g.doc + s]] for k in range(1, order) for g, s in zip(grams, shift, strict=True)]
            longer, often = merged_sum(np.concatenate(longer)) if longer else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token_cut = np.searchsorted(shard_of(types, shards), np.arange(shards + 1))
            gram_cut = np.searchsorted(shard_of(longer, shards), np.arange(shards + 1))
            post_cut = np.r_[0, np.cumsum(posts, dtype=np.int64)][token_cut]
            number = base + flushes
            flushes += 1
            columns = [[] for _ in range(9)]
            for s in range(shards):
                t, g, p = slice(token_cut[s], token_cut[s + 1]), slice(gram_cut[s], gram_cut[s + 1]), slice(post_cut[s], post_cut[s + 1])
                row = (s, number, owners.tobytes() if s == 0 else None, len(owners), b"".join(_bytes(types[t], trained[t], posts[t])), int(t.stop - t.start), b"".join(_bytes(doc[p], times[p])), b"".join(_bytes(longer[g], often[g].astype(np.uint32))), int(g.stop - g.start))
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "batch", "owners", "n", "types", "nt", "posts", "grams", "ng"])

        for batch in it:
            for part in sliced(batch, 256):
                grams.append(Grams(list(texts(part.column(2))), order))
                keys.append(part.column(0).to_numpy(zero_copy_only=False))
                learn.append(part.column(1).to_numpy(zero_copy_only=False).astype(bool))
                held += len(grams[-1].token)
                if held >= flush:
                    yield out()
                    grams, keys, learn, held = [], [], [], 0
        if held:
            yield out()

    def reduce(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        token, trained, gram, often = [], [], [], []
        for r in rows:
            n = r["nt"]
            token.append(np.frombuffer(r["types"], np.uint64, n))
            trained.append(np.frombuffer(r["types"], np.uint32, n, 8 * n))
            n = r["ng"]
            gram.append(np.frombuffer(r["grams"], np.uint64, n))
            often.append(np.frombuffer(r["grams"], np.uint32, n, 8 * n))
        types, c = merged_sum(np.concatenate(token), np.concatenate(trained))
        grams, gc = merged_sum(np.concatenate(gram), np.concatenate(often))
        log = np.log10(c + 1.0)
        out = [[] for _ in range(10)]
        for k, (r, own) in enumerate(zip(rows, token, strict=True)):
            at = np.searchsorted(types, own)
            posts = np.frombuffer(r["types"], np.uint32, len(own), 12 * len(own))
            m = int(posts.sum(dtype=np.int64))
            doc = np.frombuffer(r["posts"], np.uint32, m)
            times = np.frombuffer(r["posts"], np.uint32, m, 4 * m).astype(np.float64)
            sums = np.bincount(doc, weights=times * np.repeat(log[at], posts), minlength=r["n"])
            known = np.bincount(doc, weights=times * np.repeat(c[at] > 0, posts), minlength=r["n"])
            total = np.bincount(doc, weights=times, minlength=r["n"])
            row = (r["batch"], r["owners"], sums.tobytes(), known.tobytes(), total.tobytes(), int(c.sum()) if k == 0 else 0, int((c > 0).sum()) if k == 0 else 0, None, None, None)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        keys, counts = np.concatenate([types[c > 0], grams]), np.concatenate([c[c > 0], gc])
        made = build_slice(keys, counts, bits, probes)
        place, there = among(head, types)
        totals = np.stack([place[there], c[there]], axis=1).astype(np.int64)
        for column, x in zip(out, (None, None, None, None, None, 0, 0, rows[0]["shard"], made.tobytes(), totals.tobytes()), strict=True):
            column.append(x)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = ["batch", "owners", "sums", "known", "total", "tokens", "types", "shard", "data", "head"]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    sent = docs.mapInArrow(send, "shard int, batch long, owners binary, n int, types binary, nt int, posts binary, grams binary, ng int")

    def run(it):
        held = list(it)  # one shard
        if held:
            yield from reduce(pa.Table.from_batches(held)).to_batches(max_chunksize=64)

    schema = "batch long, owners binary, sums binary, known binary, total binary, tokens long, types long, shard int, data binary, head binary"
    both = stored(sent.repartitionById(shards, "shard").mapInArrow(run, schema))
    totals = np.zeros(len(head), dtype=np.int64)
    for r in both.filter("head is not null").select("head").toLocalIterator():
        place, c = np.frombuffer(r.head, np.int64).reshape(-1, 2).T
        totals[place] = c
    return both.filter("batch is not null").drop("shard", "data", "head"), both.filter("data is not null").select("shard", "data"), totals


def base_sums(answers: DataFrame) -> DataFrame:
    """(__key, sums, known, n_tokens) of each row of the documents, by its key:
    rows with one key have one answer."""

    def add(t: pa.Table) -> pa.Table:
        owners = next(x.as_py() for x in t.column("owners") if x.is_valid)
        sums, known, total = (np.sum([np.frombuffer(x.as_py()) for x in t.column(c)], axis=0) for c in ("sums", "known", "total"))
        return pa.table({"__key": np.frombuffer(owners, np.int64), "sums": sums, "known": known.astype(np.int64), "n_tokens": total.astype(np.int64)})

    per_row = answers.groupBy("batch").applyInArrow(add, "__key long, sums double, known long, n_tokens long")
    return per_row.groupBy("__key").agg(F.first("sums").alias("sums"), F.first("known").alias("known"), F.first("n_tokens").alias("n_tokens"))


def read_levels(grams: Grams, order: int, filter_: Filter, probes: int, before: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The level of each token's k-gram, for k from 1, as far as the filter tells."""
    out = []
    for k in range(order):
        keys, back = np.unique(grams.keys[k], return_inverse=True)
        found = filter_.read(keys, probes)[back]
        out.append(found if before is None else np.maximum(before[k], found))
    return out


def probabilities(place: np.ndarray, level: list[np.ndarray], n: int, v: int, weights: list[np.ndarray]):
    """P of each token (starts have 1)."""
    p = (_COUNT[level[0]] + 1) / (n + v + 1)
    for k in range(1, len(level)):
        p = np.where(whole(place, k + 1), _mixed(level, k, p, weights[k - 1]), p)
    return np.where(place > 0, np.minimum(p, 1.0), 1.0)


def _history(level: list[np.ndarray], k: int) -> np.ndarray:
    return np.r_[0.0, _COUNT[level[k - 1]][:-1]]


def bucket(history: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(history, 1)).astype(int), BUCKETS - 1)


def _mixed(level, k, p, weights):
    history = _history(level, k)
    seen = _COUNT[level[k]]
    a = np.where(history > 0, weights[bucket(history)], 0.0)
    return a * np.minimum(1.0, seen / np.maximum(history, 1)) + (1 - a) * p


def left_out(place: np.ndarray, level: list[np.ndarray], k: int, n: int, v: int, weights: list[np.ndarray]) -> np.ndarray:
    """Log likelihoods (buckets x grid) of the tokens with each left out of its own counts."""
    p = np.maximum(_COUNT[level[0]], 1) / (n + v + 1)
    for j in range(1, k):
        history = _history(level, j)
        a = np.where(whole(place, j + 1) & (history > 0), weights[j - 1][bucket(history)], 0.0)
        p = a * np.minimum(1.0, np.maximum(_COUNT[level[j]] - 1, 0) / np.maximum(history - 1, 1)) + (1 - a) * p
    at = whole(place, k + 1)
    history = _history(level, k)[at]
    seen = np.minimum(1.0, np.maximum(_COUNT[level[k]][at] - 1, 0) / np.maximum(history - 1, 1))
    own, p = bucket(history), p[at]
    return np.stack([np.bincount(own, weights=np.log(g * seen + (1 - g) * p), minlength=BUCKETS) for g in GRID], axis=1)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", learn=None, order: int = ORDER, bits: int = BITS, probes: int = PROBES, shards: int | None = None, broadcast_bytes: int = 256 << 20, flush: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens (long), base_score, score (double) of
    each row of docs. learn: a boolean column, true for the rows to learn from."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("__id"), row_key(doc_id, text).alias("__key"), F.coalesce(learn if learn is not None else F.lit(True), F.lit(True)).alias("__learn"), F.col(text).alias("__text"))
    if shards is None:
        shards = max(8, -(-docs.count() // 4096))
    head = frequent(source.select("__key", "__text"))
    answers, parts, totals = count(source.select("__key", "__learn", "__text"), head, order, shards, bits, probes, flush)
    n, v = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())

    sizes = [(r.shard, r.n) for r in parts.select("shard", F.length("data").alias("n")).collect()]
    groups, total = [[]], 0
    for s, size in sorted(sizes):
        if total + size > broadcast_bytes and groups[-1]:
            groups.append([])
            total = 0
        groups[-1].append(s)
        total += size
    levelled = source.withColumn("__levels", F.lit(None).cast("array<binary>"))
    for i, g in enumerate(groups):
        sent = _send(spark, parts, g, shards)
        last = i == len(groups) - 1
        # the texts are read no more after the last group
        levelled = stored(_levels(levelled, sent, order, probes, last, head, totals))
        sent.unpersist()

    weights: list[np.ndarray] = []
    for k in range(1, order):

        def tune(it, k=k, weights=tuple(weights)):
            sums = np.zeros((BUCKETS, len(GRID)))
            for batch in it:
                for part in sliced(batch):
                    place, level, _ = _unpacked(part.column(0), order)
                    sums += left_out(place, level, k, n, v, weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BUCKETS), len(GRID)).astype(np.int32)), pa.array(np.tile(np.arange(len(GRID)), BUCKETS).astype(np.int32)), pa.array(sums.ravel())], names=["bucket", "grid", "ll"])

        found = np.zeros((BUCKETS, len(GRID)))
        tuned = levelled.filter("__learn").select("__levels").mapInArrow(tune, "bucket int, grid int, ll double")
        for r in tuned.groupBy("bucket", "grid").agg(F.sum("ll").alias("ll")).collect():
            found[r.bucket, r.grid] = r.ll
        weights.append(GRID[found.argmax(axis=1)])

    def run(it):
        for batch in it:
            for part in sliced(batch):
                place, level, starts = _unpacked(part.column(2), order)
                out = np.add.reduceat(np.log10(probabilities(place, level, n, v, weights)), starts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(part.column(i) for i in (3, 4, 5)), pa.array(out)], names=["__id", "__key", *extra, "score"])

    extra = ["__sums", "__known", "__total"]
    scored = levelled.select("__id", "__key", "__levels", *extra).mapInArrow(run, f"__id {kind}, __key long, __sums double, __known long, __total long, score double")
    both = scored.join(base_sums(answers), "__key").withColumn("n_tokens", F.col("n_tokens") + F.col("__total"))
    return both.select(
        F.col("__id").alias(doc_id), "n_tokens", (F.col("known") + F.col("__known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sums") + F.col("__sums") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
    )


def _unpacked(column: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The places and levels of the tokens of some documents, and each one's first."""
    stacks = column.to_pylist()
    lens = np.array([len(x[0]) for x in stacks], dtype=np.int64)
    level = [np.frombuffer(b"".join(x[k] for x in stacks), np.uint8) for k in range(order)]
    return places(lens), level, np.cumsum(lens) - lens


def _send(spark, parts: DataFrame, group: list[int], shards: int):
    """A broadcast of the slices of some shards, of checked size."""
    rows = parts.filter(F.col("shard").isin(group)).toLocalIterator()
    return spark.sparkContext.broadcast(Filter({r.shard: bytes(r.data) for r in rows}, shards))


def _levels(docs: DataFrame, sent, order: int, probes: int, last: bool, head: np.ndarray, totals: np.ndarray) -> DataFrame:
    """docs with what the broadcast slices tell added to __levels, a byte for each token
    and length of n-gram. With the last slices, __sums, __known and __total of the tokens
    of the head take the place of the texts."""
    names = [c for c in docs.columns if not (last and c == "__text")] + (["__sums", "__known", "__total"] if last else [])
    schema = docs.select([c for c in docs.columns if not (last and c == "__text")]).schema
    if last:
        schema = schema.add("__sums", "double").add("__known", "long").add("__total", "long")
    log = np.log10(totals + 1.0)

    def run(it):
        for batch in it:
            for part in sliced(batch, 1024):
                grams = Grams(list(texts(part.column(3))), order)
                before = part.column(4).to_pylist()
                old = None if before[0] is None else [np.frombuffer(b"".join(x[k] for x in before), np.uint8) for k in range(order)]
                level = read_levels(grams, order, sent.value, probes, old)
                cuts = list(zip(grams.starts.tolist(), (grams.starts + grams.lens).tolist(), strict=True))
                made = [[x[i:j].tobytes() for x in level] for i, j in cuts]
                columns = [*(part.column(i) for i in range(3 if last else 4)), pa.array(made, pa.list_(pa.binary()))]
                if last:
                    at, there = among(head, grams.token)
                    there &= grams.place > 0
                    pairs, times = np.unique(grams.doc[there].astype(np.int64) * len(head) + at[there], return_counts=True)
                    doc, at = np.divmod(pairs, len(head))
                    sums = [np.bincount(doc, weights=times * x[at], minlength=part.num_rows) for x in (log, totals > 0, np.ones(len(head)))]
                    columns += [pa.array(sums[0]), *(pa.array(x.astype(np.int64)) for x in sums[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def op4_lm_scores(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    out = score(docs, learn=~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
