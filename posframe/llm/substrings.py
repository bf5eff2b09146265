"""Repeated word windows removed by relative parsing against indexed blocks.

The corpus is its own reference. It is cut into blocks by the hash of a window's
anchor, so that every document meets, of every block, just what can match it: of
each window of `window` words the anchor is the `anchor`-word sequence with the
least hash in it, and equal windows have equal anchors, so lie in one block.

1. Anchors. Windows whose anchor occurs once in the corpus occur once. Anchors that
   occur twice or more are found by a count in their blocks.
2. Parse. Of each document, the runs of windows with a repeated anchor go to the
   anchor's block, which indexes all its windows by their words (128-bit prints). A
   run is factored greedily from the left: a factor begins at the first window that
   occurs elsewhere, takes an occurrence there as its source, and is extended word by
   word while the words of the source go on alike; then the next factor begins at the
   next window (not after the factor's last word), so windows that cross the border of
   two factors are looked up, too. What is shorter than a window is no factor.
3. Borders. A run ends where the anchor changes, and its factors with it. Factors of
   different blocks that meet are joined where one's source goes on in the other's.
   The words of the factors are the duplicate spans.

So a word goes if and only if it is in a window that occurs elsewhere. The second
step reads only documents that have repeated anchors.

What a task knows it keeps: an anchor or window that occurs twice among the words
a task holds (`flush`) is known to be repeated, and the block is told of it once, not
of each document. A block gets no more than one entry a task and flush for a passage,
however many documents share it.

Documents are told apart by row, not by doc_id: equal rows are copies of each
other. A null text has no words and keeps none; n_words is 0 then. An empty
table gives no rows. A null doc_id is a value like any other. Other columns are
kept only by `dedup`. Rows are matched by 64-bit hashes of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm.bpe import sliced
from posframe.llm.common import Scratch, WordHashes, mix64, row_key, table, texts, trim, trimmed, words

WINDOW, ANCHOR = 35, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = np.uint64(2**64 - 1)


class Rolling:
    """Polynomial hashes of all sequences of k words, modulo 2**64."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n).bit_length()
            for name, x in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, x, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h)
        self._grow(n + 1)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * self.up[:n], out=s[1:])
        return (s[k:] - s[:-k]) * self.down[: n - k + 1]


def sliding(least, x: np.ndarray, w: int) -> np.ndarray:
    """The least (np.minimum) or greatest (np.maximum) of each w values in turn."""
    have = 1
    while 2 * have <= w:
        x = least(x[: len(x) - have], x[have:])
        have *= 2
    return least(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


class Parsed:
    """Some documents, one after the other: their words and windows.

    hashes: of words; doc: each word's document; window: the starts of whole
    windows; anchors: each such window's anchor; grams: all anchor-word hashes.
    """

    rolling = Rolling()
    known = WordHashes(1 << 16)

    def __init__(self, docs: list[bytes], window: int, anchor: int):
        self.window, self.anchor = window, anchor
        self.words = [words(t) for t in docs]
        self.lens = np.fromiter(map(len, self.words), dtype=np.int64, count=len(docs))
        self.starts = np.r_[0, np.cumsum(self.lens)[:-1]]
        n = int(self.lens.sum())
        self.doc = np.repeat(np.arange(len(docs)), self.lens)
        self.hashes = np.concatenate([self.known.of(w) for w in self.words]) if n else np.zeros(0, np.uint64)
        left = np.repeat(self.starts + self.lens, self.lens) - np.arange(n)
        whole = left >= window
        self.at = np.flatnonzero(whole)
        if len(self.at):
            grams = mix64(self.rolling(self.hashes, anchor))
            self.grams = np.where(left[: len(grams)] >= anchor, grams, _LAST)
            span = window - anchor + 1
            least = sliding(np.minimum, self.grams, span)
            self.whole = whole[: len(least)]
            self.least = np.where(self.whole, least, np.uint64(0))
            self.anchors = least[self.at]

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors' places: the hashes there and their documents. A sequence
        that is the anchor of a window at two places is there twice."""
        span = self.window - self.anchor + 1
        most = sliding(np.maximum, np.r_[np.zeros(span - 1, np.uint64), self.least, np.zeros(span - 1, np.uint64)], span)
        chosen = np.flatnonzero(most[: len(self.grams)] == self.grams)
        return self.grams[chosen], self.doc[chosen]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of adjacent windows of a document with one anchor: where each
        begins in `at`, and its number of windows."""
        change = np.ones(len(self.at), dtype=bool)
        change[1:] = (self.anchors[1:] != self.anchors[:-1]) | (np.diff(self.at) != 1) | (self.doc[self.at[1:]] != self.doc[self.at[:-1]])
        begin = np.flatnonzero(change)
        return begin, np.diff(np.r_[begin, len(self.at)])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)) % np.uint64(shards)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts)
    return np.arange(total) + shift


def _by_shard(shard: np.ndarray, shards: int):
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]


def _by_doc(docs: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Each of docs (sorted) once, with its values."""
    if not len(docs):
        return [], []
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    ends = np.r_[at[1:], len(docs)]
    return docs[at].view(np.int64).tolist(), [values[i:j].tobytes() for i, j in zip(at, ends, strict=True)]


def _sent(shards: int, groups: list[tuple[np.ndarray, list[np.ndarray]]], names: list[str]) -> pa.RecordBatch:
    """A row for each shard with what goes there of each group (shard numbers, columns)."""
    rows: dict[int, list] = {}
    first = 0
    for shard, columns in groups:
        for s, i in _by_shard(shard, shards):
            row = rows.setdefault(s, [None] * len(names))
            for j, x in enumerate(columns):
                row[first + j] = x[i].tobytes()
        first += len(columns)
    made = [pa.array(list(rows), pa.int32())] + [pa.array([r[j] for r in rows.values()], pa.binary()) for j in range(len(names))]
    return pa.RecordBatch.from_arrays(made, names=["shard", *names])


def _blocks(sent: DataFrame, shards: int, schema: str, reduce) -> DataFrame:
    """reduce(columns as lists of bytes) of each shard; a task has one."""

    def run(it):
        held: dict[str, list] = {}
        for batch in trimmed(it):
            for c in batch.schema.names[1:]:
                held.setdefault(c, []).extend(x.as_py() for x in batch.column(c) if x.is_valid)
        if held:
            yield from reduce(held).to_batches(max_chunksize=4096)
        held.clear()
        trim()

    return sent.repartitionById(shards, "shard").mapInArrow(run, schema)


def _joined(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=kind)


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (of equal ones by place) and the sizes of the groups in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.diff(np.r_[np.flatnonzero(new), len(order)])


def repeated_anchors(docs: DataFrame, shards: int, window: int, anchor: int, flush: int = 1 << 20) -> DataFrame:
    """(__key, anchors binary) of the rows of docs (__key, __text) that have
    anchors which occur twice or more in all of them. Several rows for a key."""
    names = ["keys", "owners", "many", "own_keys", "own_owners"]

    def send(it):
        keys, owners, held = [], [], 0

        def out():
            k, d = np.concatenate(keys), np.concatenate(owners).view(np.uint64)
            order, size = _repeats(k)
            k, d, first = k[order], d[order], np.cumsum(size) - size
            one, many = first[size == 1], first[size > 1]
            own = np.repeat(size > 1, size)
            return _sent(shards, [(_shard(k[one], shards), [k[one], d[one]]), (_shard(k[many], shards), [k[many]]), (_shard(d[own], shards), [k[own], d[own]])], names)

        for batch in it:
            for part in sliced(batch):
                parsed = Parsed(list(texts(part.column(1))), window, anchor)
                if not len(parsed.at):
                    continue
                k, d = parsed.selected()
                keys.append(k)
                owners.append(part.column(0).to_numpy(zero_copy_only=False)[d])
                held += len(k)
                if held >= flush:
                    yield out()
                    keys, owners, held = [], [], 0
        if held:
            yield out()
            keys, owners = [], []
            trim()

    def reduce(columns):
        keys, owners, many, own_keys, own_owners = (_joined(columns[c], np.uint64) for c in names)
        order, size = _repeats(keys)
        keys, owners = keys[order], owners[order]
        twice = np.repeat(size > 1, size) | np.isin(keys, many)
        keys, owners = np.concatenate([keys[twice], own_keys]), np.concatenate([owners[twice], own_owners])
        order, size = _repeats(owners, keys)
        order = order[np.cumsum(size) - size]
        owner, values = _by_doc(owners[order], keys[order])
        return pa.table({"__key": pa.array(owner, pa.int64()), "anchors": pa.array(values, pa.binary())})

    return _blocks(docs.mapInArrow(send, "shard int" + "".join(f", {c} binary" for c in names)), shards, "__key long, anchors binary", reduce)


#: A factor, or the part of one that a block found: its first window and number of windows,
#: and where its source is: the row's key and the first window there.
FACTOR = np.dtype([("at", "<u4"), ("n", "<u4"), ("source", "<u8"), ("source_at", "<u4")])


def factors(owner: np.ndarray, place: np.ndarray, has: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy factors of windows (owner, place), in runs of adjacent places: each
    begins at a window that has a source and goes on while the next one's source follows."""
    on = np.zeros(len(owner), dtype=bool)
    on[1:] = has[1:] & has[:-1] & (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1) & (source[1:] == source[:-1]) & (source_at[1:] == source_at[:-1] + 1)
    begin = np.flatnonzero(has & ~on)
    out = np.zeros(len(begin), dtype=FACTOR)
    out["at"], out["source"], out["source_at"] = place[begin], source[begin], source_at[begin]
    group = np.cumsum(has & ~on) - 1
    out["n"] = np.bincount(group[has], minlength=len(begin))
    return owner[begin], out


def _sources(order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each member of a group, another one: the first, of the first the second."""
    first = np.cumsum(size) - size
    out = np.repeat(order[first], size)
    several = first[size > 1]
    out[several] = order[several + 1]
    back = np.empty_like(out)
    back[order] = out
    return back


def parsed_windows(docs: DataFrame, shards: int, window: int, anchor: int, flush: int = 1 << 20) -> DataFrame:
    """(__key, factors binary: FACTOR) of the windows, of those of docs (__key, __text,
    anchors: array of binary) with an anchor of the list, whose words occur twice or
    more. Several rows for a key."""
    kinds = {
        "owners": np.uint64, "places": np.uint32, "counts": np.uint32, "marks": np.uint64, "prints": np.uint64,  # runs of windows that the task has once
        "many_marks": np.uint64, "many_prints": np.uint64, "many_owners": np.uint64, "many_places": np.uint32,  # one of those that it has more often
        "own_owners": np.uint64, "own_factors": FACTOR,  # and their factors
    }
    names = list(kinds)

    def send(it):
        rows, held = [], 0

        def out():
            owner, place, count, mark, prints = (np.concatenate(c) for c in zip(*rows, strict=True))
            run = np.repeat(np.arange(len(count)), count)
            at = _spans(place, count)
            order, size = _repeats(prints, mark[run])
            many = np.zeros(len(prints), dtype=bool)
            many[order] = np.repeat(size > 1, size)
            source = _sources(order, size)
            own_owner, own = factors(owner[run], at, many, owner[run][source], at[source])
            first = order[(np.cumsum(size) - size)[size > 1]]
            # runs of windows that are here once
            once = np.flatnonzero(~many)
            new = np.ones(len(once), dtype=bool)
            new[1:] = (np.diff(once) != 1) | (run[once[1:]] != run[once[:-1]])
            begin = np.flatnonzero(new)
            length = np.diff(np.r_[begin, len(once)])
            head = once[begin]
            return _sent(shards, [
                (_shard(mark[run[head]], shards), [owner[run[head]], at[head].astype(np.uint32), length.astype(np.uint32), mark[run[head]]]),
                (_shard(mark[run[once]], shards), [prints[once]]),
                (_shard(mark[run[first]], shards), [mark[run[first]], prints[first], owner[run[first]], at[first].astype(np.uint32)]),
                (_shard(own_owner, shards), [own_owner, own]),
            ], names)

        for batch in it:
            for part in sliced(batch):
                parsed = Parsed(list(texts(part.column(1))), window, anchor)
                if not len(parsed.at):
                    continue
                wanted = []
                for d, found in enumerate(part.column(2).to_pylist()):
                    own = _joined(found or [], np.uint64)
                    wanted.append(mix64(own ^ mix64(np.full(len(own), d + 1, dtype=np.uint64))))
                begin, count = parsed.runs()
                doc = parsed.doc[parsed.at[begin]]
                mark = parsed.anchors[begin]
                chosen = np.isin(mix64(mark ^ mix64((doc + 1).astype(np.uint64))), np.concatenate(wanted))
                begin, count, doc, mark = begin[chosen], count[chosen], doc[chosen], mark[chosen]
                if not len(begin):
                    continue
                prints = parsed.rolling(parsed.hashes, window)[parsed.at[_spans(begin, count)]]
                owners = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[doc]
                rows.append((owners, parsed.at[begin] - parsed.starts[doc], count, mark, prints))
                held += len(prints)
                if held >= flush:
                    yield out()
                    rows, held = [], 0
        if held:
            yield out()
            rows = []
            trim()

    def reduce(columns):
        got = {c: _joined(columns[c], k) for c, k in kinds.items()}
        count = got["counts"].astype(np.int64)
        n = int(count.sum())
        # the task's windows, then those that other tasks have more often
        at = np.r_[_spans(got["places"].astype(np.int64), count), got["many_places"].astype(np.int64)]
        owner = np.r_[np.repeat(got["owners"], count), got["many_owners"]]
        mark = np.r_[np.repeat(got["marks"], count), got["many_marks"]]
        prints = np.r_[got["prints"], got["many_prints"]]
        order, size = _repeats(prints, mark)
        has = np.zeros(len(prints), dtype=bool)
        has[order] = np.repeat(size > 1, size)
        source = _sources(order, size)
        key, found = factors(owner[:n], at[:n], has[:n], owner[source[:n]], at[source[:n]])
        key, found = np.r_[key, got["own_owners"]], np.r_[found, got["own_factors"]]
        order = np.lexsort((found["at"], key))
        key, values = _by_doc(key[order], found[order])
        return pa.table({"__key": pa.array(key, pa.int64()), "factors": pa.array(values, pa.binary())})

    return _blocks(docs.mapInArrow(send, "shard int" + "".join(f", {c} binary" for c in names)), shards, "__key long, factors binary", reduce)


def joined_factors(parts: list[bytes]) -> np.ndarray:
    """A document's factors in order, those that go on in each other joined."""
    found = _joined(parts, FACTOR)
    if not len(found):
        return found
    found = found[np.unique(found["at"], return_index=True)[1]]
    before, after = found[:-1], found[1:]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (before["at"] + before["n"] != after["at"]) | (before["source"] != after["source"]) | (before["source_at"] + before["n"] != after["source_at"])
    begin = np.flatnonzero(new)
    out = found[begin].copy()
    out["n"] = np.add.reduceat(found["n"], begin)
    return out


def kept_words(text: bytes, parts: list[bytes] | None, window: int) -> tuple[int, list[tuple[int, int]], bytes, np.ndarray]:
    """The number of words, the duplicate spans (start, end), the words that stay,
    joined by one space, and the factors."""
    ws = words(text)
    found = joined_factors(parts or [])
    if not len(found):
        return len(ws), [], b" ".join(ws), found
    step = np.zeros(len(ws) + 1, dtype=np.int64)
    np.add.at(step, found["at"].astype(np.int64), 1)
    np.add.at(step, found["at"].astype(np.int64) + found["n"] + window - 1, -1)
    out = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
    return len(ws), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), b" ".join([w for w, gone in zip(ws, out.tolist(), strict=True) if not gone]), found


def dedup(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, anchor: int = ANCHOR, shards: int | None = None, shard_bytes: int = 32 << 20, with_factors: bool = False, flush: int = 1 << 20) -> DataFrame:
    """keep, n_words long, spans (array of start and end, in words) and kept (the
    words that stay, joined by one space; UTF-8 as binary), a row for each of docs;
    if asked for, factors (start, end, source: the key of id and text of a row with the
    same words, source_start) and __key."""
    if not 0 < anchor < window:
        raise ValueError("an anchor is shorter than a window")
    if "__" in text or any(c.startswith("__") for c in keep):
        raise ValueError("column names that begin with __ are the operator's own")
    scratch = Scratch(docs.sparkSession)
    source = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    source = source.withColumn("__key", row_key(*source.columns))
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
        shards = max(8, -(-size // shard_bytes))
    found = repeated_anchors(source.select("__key", "__text"), shards, window, anchor, flush)
    found = found.groupBy("__key").agg(F.collect_list("anchors").alias("anchors"))
    marked = scratch.stored(source.join(found, "__key", "left"))
    some = marked.filter("anchors is not null")
    parsed = parsed_windows(some.select("__key", "__text", "anchors"), shards, window, anchor, flush)
    parsed = parsed.groupBy("__key").agg(F.collect_list("factors").alias("factors"))
    joined = some.drop("anchors").join(parsed, "__key", "left").unionByName(marked.filter("anchors is null").drop("anchors").withColumn("factors", F.lit(None).cast("array<binary>")))
    own = [f"__k{i}" for i in range(len(keep))]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_words long, spans array<struct<start:int,end:int>>, kept binary"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    factors_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
    names = [*keep, "n_words", "spans", "kept"]
    if with_factors:
        schema, names = schema + ", factors array<struct<start:int,end:int,source:long,source_start:int>>, __key long", [*names, "factors", "__key"]

    def run(it):
        for batch in it:
            for part in sliced(batch):
                out = [kept_words(t, p, window) for t, p in zip(texts(part.column(len(own))), part.column(len(own) + 1).to_pylist(), strict=True)]
                columns = [part.column(i) for i in range(len(own))]
                columns += [pa.array([x[0] for x in out], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in out], spans_type), pa.array([x[2] for x in out], pa.binary())]
                if with_factors:
                    shown = [[{"start": int(f["at"]), "end": int(f["at"]) + int(f["n"]) + window - 1, "source": int(f["source"].astype(np.int64)), "source_start": int(f["source_at"])} for f in x[3]] for x in out]
                    columns += [pa.array(shown, factors_type), part.column(len(own) + 2)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*own, "__text", "factors", "__key").mapInArrow(run, schema)


def op5_substring_dedup(spark, sf_dir) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY h) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM twice, (SELECT unnest(range(35)) AS k)
), each AS (
  SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
