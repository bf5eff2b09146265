"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, hashed into 2**bits slots: lower-cased words,
and one to three consecutive word shapes (letters, digits and marks of a word
with runs of a kind shortened; a word equal to the one before it has the shape
of a repeat). Each slot's indicator is scaled by the slot's log-count ratio

    r = log((1 + n1) / (N1 + 2)) - log((1 + n0) / (N0 + 2))

of the number of good and bad training documents that hold it, counted over all
training rows. A linear model of hinge loss is fitted to the scaled indicators
by dual coordinate descent, on a bounded sample: the `sample_rows` training rows
with the least hashes of their ids. The score is a logistic function of the
margin, fitted on margins that models of the other half of the sample gave.

The weights are one array of 2**bits numbers, whatever the size of the corpus,
and are broadcast to score all documents.

Nulls and edges: a null or empty text has no features, and its score comes from
the bias alone. A null id is never a held-out one and has no label. Rows with a
null label teach nothing; a row with several labels teaches each. Without rows of
both classes the score is (good + 1) / (rows + 2) for every text. Repeated rows
are scored alike; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm.bpe import sliced
from posframe.llm.common import WordHashes, mix64, stored, table, texts, words

BITS, SAMPLE_ROWS = 18, 8192
_RUNS = re.compile(rb"(.)\1+", re.S)
_KINDS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_REPEAT = np.uint64(0x243F6A8885A308D3)


class Shapes(WordHashes):
    """Hashes of the shapes of words."""

    def __missing__(self, word: bytes) -> int:
        h = self.hash(_RUNS.sub(rb"\1", word.translate(_KINDS)), self.seed)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h


_SHAPES, _WORDS = Shapes(1 << 16, 1), WordHashes(1 << 16, 2)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """The sorted slots of a text's n-grams."""
    ws = words(text)
    if not ws:
        return np.zeros(0, dtype=np.int32)
    plain = _WORDS.of(words(text.lower()))
    shape = _SHAPES.of(ws)
    shape[1:][plain[1:] == plain[:-1]] = _REPEAT
    one = mix64(shape)
    two = mix64(one[:-1] ^ (shape[1:] * np.uint64(3)))
    three = mix64(two[:-1] ^ (shape[2:] * np.uint64(5)))
    slots = (np.concatenate([mix64(plain), one, two, three]) >> np.uint64(64 - bits)).astype(np.int32)
    slots.sort()
    return slots[np.r_[True, slots[1:] != slots[:-1]]]


def in_one(rows, size: int, dtype) -> list[np.ndarray]:
    """Copies of arrays of `size` numbers in all, as parts of one array. Thousands of arrays of
    a few KB each would leave the driver's heap in pieces that it keeps when they are gone."""
    flat, out, at = np.empty(size, dtype), [], 0
    for x in rows:
        flat[at : at + len(x)] = x
        out.append(flat[at : at + len(x)])
        at += len(x)
    return out


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (the bias last) of the hinge-loss model over the scaled indicators:
    each round visits the rows in a random order and moves each one's dual
    variable to the best place between 0 and cost."""
    w = np.zeros(len(ratios) + 1)
    sign = np.where(labels > 0, 1.0, -1.0)
    weight = np.where(labels > 0, cost, cost * max(1.0, (labels > 0).sum() / max(1, (labels <= 0).sum())))

    def scaled(x):
        v = ratios[x]
        return v / max(1e-9, np.sqrt(v @ v)) if len(v) else v

    values = in_one(map(scaled, rows), sum(map(len, rows)), np.float64)
    norms = np.array([v @ v + 1 for v in values])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            x, v, s = rows[i], values[i], sign[i]
            gradient = s * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), weight[i])
            if step := (new - alpha[i]) * s:
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def margins(rows: list[np.ndarray], w: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), w[-1])
    for i, x in enumerate(rows):
        if len(x):
            v = ratios[x]
            out[i] += (w[x] @ v) / max(1e-9, np.sqrt(v @ v))
    return out


def logistic(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a z + b))) by Newton's method, with smoothed targets."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    t = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-6 * a, (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-6, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, w, ratios, a, b, flat=None):
        self.w, self.ratios, self.a, self.b, self.flat = w, ratios, a, b, flat

    def score(self, docs: list[bytes], bits: int) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(docs), self.flat)
        z = margins([features(t, bits) for t in docs], self.w, self.ratios)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -700, 700)))


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id", bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows. What reaches the driver is bounded: the two
    counts of each of the 2**bits slots, and the features of sample_rows rows."""

    def prepare(it):
        for batch in it:
            for part in sliced(batch):
                made = [features(t, bits).tobytes() for t in texts(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["h", "y", "x"])

    source = labelled.filter(F.col(label).isNotNull()).select(F.xxhash64(doc_id).alias("h"), (F.col(label) > 0).cast("int").alias("y"), F.col(text).alias("__text"))
    rows = stored(source.mapInArrow(prepare, "h long, y int, x binary"))

    def count(it):
        n = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in it:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n[y][np.frombuffer(x.as_py(), np.int32)] += 1
        at = np.flatnonzero(n.any(axis=0))
        for i in range(0, len(at), 1 << 16):
            own = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[0, own]), pa.array(n[1, own])], names=["slot", "n0", "n1"])

    totals = {r.y: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total0, total1 = totals.get(0, 0), totals.get(1, 0)
    if not total0 or not total1:
        return Model(None, None, 0, 0, (total1 + 1) / (total0 + total1 + 2))
    counts = rows.select("y", "x").mapInArrow(count, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n0, n1 = np.zeros(1 << bits), np.zeros(1 << bits)
    n0[counts["slot"].to_numpy()], n1[counts["slot"].to_numpy()] = counts["n0"].to_numpy(), counts["n1"].to_numpy()
    ratios = np.log((1 + n1) / (total1 + 2)) - np.log((1 + n0) / (total0 + 2))

    # the least hashes: a threshold that keeps somewhat more rows, then exactly as many as asked for
    share = min(1.0, 1.2 * sample_rows / (total0 + total1) + 1e-4)
    near = rows.filter((F.shiftrightunsigned("h", 1) < int(share * (2**63 - 1)))) if share < 1 else rows
    sample = near.orderBy(F.shiftrightunsigned("h", 1), "y").limit(sample_rows).select("y", "x").toArrow()
    y = sample["y"].to_numpy()
    x = in_one((np.frombuffer(v.as_py(), np.int32) for v in sample["x"]), sum(len(v.as_buffer()) // 4 for v in sample["x"]), np.int32)
    if len(set(y.tolist())) < 2:
        return Model(None, None, 0, 0, (total1 + 1) / (total0 + total1 + 2))
    w = dual_descent(x, y, ratios)
    half = np.arange(len(y)) % 2
    z = np.zeros(len(y))
    for k in (0, 1):
        own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        part = dual_descent([x[i] for i in other], y[other], ratios) if len(set(y[other].tolist())) == 2 else w
        z[own] = margins([x[i] for i in own], part, ratios)
    return Model(w, ratios, *logistic(z, y))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """keep and __score double, a row for each of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", __score double"

    def run(it):
        for batch in it:
            for part in sliced(batch):
                s = sent.value.score(list(texts(part.column(len(keep)))), bits)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(s, pa.float64())], names=[*keep, "__score"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def remainder(column: str, of: int):
    """crc32 of an id as text, modulo `of`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text and quality of the labelled documents that may be learned from. Labels
    grow with the corpus: texts are shuffled, not sorted, and alike at every size."""
    own = docs.filter(remainder("doc_id", 4) != 2).select("doc_id", "text")
    return own.join(labels.select("doc_id", "quality").filter("quality is not null").hint("shuffle_hash"), "doc_id")


def op9_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training(docs, table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        F.when(F.col("__score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
