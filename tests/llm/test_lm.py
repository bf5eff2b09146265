import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from posframe.llm import lm
from posframe.llm.common import table


def brute(rows, learned):
    split = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = Counter(w for ws, y in zip(split, learned, strict=True) if y for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, split, strict=True)]


def check(out, rows, learned):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=str)
    want = sorted(brute(rows, learned), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-12)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    out = lm.op4_lm_scores(spark, sf_dir).collect()
    check(out, rows, learned)
    assert {r.doc_id for r in out if r.held_out} == {i for (i, _), y in zip(rows, learned, strict=True) if not y}
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges_and_groups(spark, frame):
    rows = [(1, None), (2, ""), (3, "One two ONE"), (3, "One two ONE"), (None, "two three"), (4, "very long text " * 9000), (5, "unseen words only")]
    docs = frame(rows)
    from pyspark.sql import functions as F

    learn = F.coalesce(F.col("doc_id") != 5, F.lit(True))
    one = lm.score(docs, learn=learn, order=3).collect()
    check(one, rows, [i != 5 for i, _ in rows])
    many = lm.score(docs, learn=learn, order=3, broadcast_bytes=1, flush=10).collect()
    key = lambda r: str((r.doc_id, r.n_tokens, round(r.score, 9)))
    assert sorted(map(key, one)) == sorted(map(key, many))
    check(lm.score(docs, learn=F.lit(False)).collect(), rows, [False] * len(rows))
    assert lm.score(frame([])).count() == 0


@pytest.mark.parametrize("window", [1, 7, 1 << 20])
def test_hashed_words(window):
    from posframe.llm.common import hashed_words

    random.seed(window)
    docs = ["".join(random.choices(["a", "b", "Ab", " ", "\n", "\x0b", "\x1c", "é", "\0"], k=random.randrange(60))).encode() for _ in range(300)] + [b"", b" ", b"x" * 9000 + b" y"]
    hashes, counts = hashed_words(docs, lower=True, window=window)
    flat = [w for d in docs for w in d.lower().split()]
    assert counts.tolist() == [len(d.split()) for d in docs] and len(hashes) == len(flat)
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True)) and len(set(of.values())) == len(of)
    assert len(hashed_words([])[0]) == 0


def test_filter_reads_levels():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 20000).astype(np.uint64))
    counts = np.minimum(rng.geometric(0.3, len(keys)) ** 3, 10**6)
    made = lm.Filter({0: lm.build_slice(keys, counts, 8, 5).tobytes()}, 1)
    read, want = made.read(keys, 5), lm.levels(counts)
    assert (read >= want).all() and (read == want).mean() > 0.95
    absent = rng.integers(2**63, 2**64 - 1, 20000, dtype=np.uint64)
    assert (made.read(absent, 5) > 0).mean() < 0.05
    assert (abs(lm._COUNT[lm.levels(counts)] / counts - 1) < 0.2).all()


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_about_one(order):
    random.seed(4)
    docs = [" ".join(random.choices(["a", "b", "c", "d e"], k=20)).encode() for _ in range(50)]
    grams = lm.Grams(docs, order)
    keys, counts = zip(*((lm.merged_sum(grams.keys[k][grams.whole(k + 1)])) for k in range(order)), strict=True)
    made = lm.Filter({0: lm.build_slice(np.concatenate(keys), np.concatenate(counts), 32, 8).tobytes()}, 1)
    n, v = int((grams.place > 0).sum()), len(keys[0])
    weights = [np.full(lm.BUCKETS, 0.6)] * (order - 1)
    total = 0
    for w in [b"a", b"b", b"c", b"d", b"e", None]:
        g = lm.Grams([b"a b" + (b" " + w if w else b"")], order)
        level = lm.read_levels(g, order, made, 8)
        total += lm.probabilities(g.place, level, n, v, weights)[3]
    assert 0.85 < total < 1.15


def test_score_by_brute_force(spark, frame):
    """The smoothed score with exact counts: all are below 8, whose levels are exact, and
    the filter is so large that it doesn't err."""
    random.seed(11)
    rows = [(k, " ".join(random.choices(["v%d" % i for i in range(60)], k=30))) for k in range(7)]
    learned = [k not in (2, 5) for k, _ in rows]
    split = [[0] + t.split() + [1] for _, t in rows]
    one = Counter(w for ws, y in zip(split, learned, strict=True) if y for w in ws[1:])
    two = Counter(p for ws, y in zip(split, learned, strict=True) if y for p in zip(ws, ws[1:], strict=False))
    one[0] = one[1]
    n, v = sum(c for w, c in one.items() if w != 0), len(one) - 1
    assert max(one.values()) < 8
    likely = [[0.0] * len(lm.GRID) for _ in range(lm.BUCKETS)]
    for ws, y in zip(split, learned, strict=True):
        for a, b in zip(ws, ws[1:], strict=False):
            if y:
                seen, p = min(1.0, max(two[a, b] - 1, 0) / max(one[a] - 1, 1)), max(one[b], 1) / (n + v + 1)
                for g, x in enumerate(lm.GRID):
                    likely[int(math.log2(one[a]))][g] += math.log(x * seen + (1 - x) * p)
    weight = [lm.GRID[max(range(len(x)), key=x.__getitem__)] for x in likely]
    want = {}
    for (k, _), ws in zip(rows, split, strict=True):
        want[k] = 0.0
        for a, b in zip(ws, ws[1:], strict=False):
            x = weight[int(math.log2(one[a]))] if one[a] else 0.0
            want[k] += math.log10(x * min(1.0, two[a, b] / max(one[a], 1)) + (1 - x) * (one[b] + 1) / (n + v + 1))
    from pyspark.sql import functions as F

    for shards in (None, 1):
        out = lm.score(frame(rows), learn=~F.col("doc_id").isin(2, 5), bits=256, probes=16, shards=shards).collect()
        assert {r.doc_id: round(r.score, 8) for r in out} == {k: round(x, 8) for k, x in want.items()}


def test_head_is_not_listed(spark, frame, monkeypatch):
    """Base scores are the same whatever is in the head, and the head's documents aren't sent."""
    rows = [(k, "the common words " + " ".join("own%d" % (k % 7 + i) for i in range(5))) for k in range(300)]
    check(lm.score(frame(rows)).collect(), rows, [True] * 300)
    monkeypatch.setattr(lm, "frequent", lambda docs: np.array([lm.END], dtype=np.uint64))
    check(lm.score(frame(rows)).collect(), rows, [True] * 300)
