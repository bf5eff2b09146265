import hashlib
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from posframe.llm import substrings
from posframe.llm.common import table


def brute(rows, window=35):
    split = [((t or "").encode()).split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def got(df):
    out = []
    for r in df.collect():
        out.append((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    out = substrings.op5_substring_dedup(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute(rows)


@pytest.mark.parametrize("window,anchor,shards", [(35, 16, None), (6, 2, 3), (5, 4, 1)])
def test_edges(spark, frame, window, anchor, shards):
    random.seed(window)
    passage = " ".join(random.choices("abcdefgh", k=60))
    rows = [(1, None), (2, ""), (3, "one two"), (4, passage), (4, passage), (None, "x " + passage + " y"), (None, None), (5, "r " * 500), (6, "p q " * 300), (7, " ".join(map(str, range(9000)))), (8, " ".join(map(str, range(4000, 4034)))), (9, " ".join(map(str, range(4000, 4035))))]
    rows += [(k, " ".join(random.choices("abc", k=k))) for k in range(10, 60)]
    out = substrings.dedup(frame(rows), window=window, anchor=anchor, shards=shards)
    assert got(out) == brute(rows, window)
    assert substrings.dedup(frame([])).count() == 0


@pytest.mark.parametrize("flush", [1, 1 << 20])
def test_factors(spark, frame, flush):
    """Each factor has the words of its source, is at another place, and begins as far left
    and goes as far right as its source allows; together they are the repeated windows."""
    random.seed(flush)
    window, passages = 6, [random.choices("abcdefgh", k=40) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [f"own{k}"]
        for x in random.choices(range(4), k=3):
            a = random.randrange(30)
            parts += passages[x][a : a + random.randrange(4, 25)] + [f"cut{k}{x}"] * random.randrange(2)
        rows.append((k, " ".join(parts)))
    out = substrings.dedup(frame(rows), window=window, anchor=3, shards=3, with_factors=True, flush=flush).collect()
    assert got(out_frame(out)) == brute(rows, window)
    ws, key = {r.doc_id: dict(rows)[r.doc_id].split() for r in out}, {r["__key"]: r.doc_id for r in out}
    total = 0
    for r in out:
        covered = set()
        for f in r.factors:
            other, n = ws[key[f.source]], f.end - f.start
            assert n >= window and (key[f.source], f.source_start) != (r.doc_id, f.start)
            assert other[f.source_start : f.source_start + n] == ws[r.doc_id][f.start : f.end]
            covered |= set(range(f.start, f.end))
            total += 1
        assert covered == {i for s in r.spans for i in range(s.start, s.end)}
        for f, g in zip(r.factors, r.factors[1:], strict=False):
            assert g.start > f.start and g.end > f.end
    assert total > 100


class out_frame(list):
    def collect(self):
        return self


@pytest.mark.parametrize("flush", [5, 1 << 20])
def test_hot_passage_sends_one_entry_a_task(spark, frame, flush):
    """What blocks get doesn't grow with the documents that share a passage."""
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(k, f"a{k} {passage} b{k}") for k in range(400)]
    assert got(substrings.dedup(frame(rows), shards=4, flush=flush)) == brute(rows)
    for copies in (100, 400):
        docs = frame(rows[:copies]).coalesce(1).selectExpr("doc_id as __key", "text as __text")
        seen = []
        blocks, substrings._blocks = substrings._blocks, lambda sent, *rest, seen=seen: seen.append(sent)
        try:
            substrings.repeated_anchors(docs, 4, 35, 16)
        finally:
            substrings._blocks = blocks
        sent = seen[0].collect()
        assert sum(len(r["keys"] or b"") + len(r["many"] or b"") for r in sent) // 8 <= 12 + 3 * copies  # those at the borders are each document's own


def test_sliding():
    x = np.random.default_rng(1).integers(0, 50, 200)
    for w in (1, 2, 3, 7, 16, 20):
        assert (substrings.sliding(np.minimum, x, w) == [x[i : i + w].min() for i in range(200 - w + 1)]).all()


WORKER = """
import random, re
import pyarrow as pa
from posframe.llm import substrings

def used():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) / 1024

class Plan:
    def mapInArrow(self, run, schema):
        self.runs = [*getattr(self, "runs", []), run]
        return self
    def repartitionById(self, *args):
        return self

def batches(n):
    for _ in range(n):
        texts = [" ".join(f"{random.randrange(1 << 19):x}" for _ in range(200)) for _ in range(4096)]
        yield pa.RecordBatch.from_arrays([pa.array(range(4096), pa.int64()), pa.array(texts)], names=["k", "t"])
        del texts

random.seed(1)
send = substrings.repeated_anchors(Plan(), 8, 35, 16).runs[0]
before = used()
rows = sum(x.num_rows for x in send(batches(2)))
print(rows, used() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
def test_worker_gives_memory_back():
    """What a worker has freed goes back to the system and the words it remembers are few: it lives
    on, idle or in later stages, and counts as the executor's memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    rows, mb = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, cwd=root).stdout.split()[-2:]
    assert int(rows) and float(mb) < 90
