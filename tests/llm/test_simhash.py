import random

import numpy as np
import pytest

from posframe.llm import simhash
from posframe.llm.common import table


def brute(rows):
    ids, fps = [i for i, _ in rows], np.array([simhash.fingerprint((t or "").encode()) for _, t in rows], dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            root[find(int(j))] = find(i)
    least = {}
    for i, own in enumerate(ids):
        r = find(i)
        if own is not None:
            least[r] = min(least.get(r, own), own)
    return sorted(((ids[i], int(fps[i].view(np.int64)), least.get(find(i))) for i in range(len(rows))), key=str)


def got(df):
    return sorted(((r.doc_id, r["__fp"], r.component_id) for r in df.collect()), key=str)


def slow_fingerprint(text, k=3):
    import xxhash

    ws = [w for w in text.encode().lower().split()]
    sh = [b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) > len(sh))


@pytest.mark.parametrize("text", ["", "One", "one TWO", "a b c d e É f", "x " * 50, "a b c d e\x0bf\x1cg"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.groups(docs)) == brute(rows)


def test_edges(spark, frame):
    rows = [(5, None), (4, ""), (9, " \n"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "lonely words here now"), (7, "w " * 30000), (8, "a b C d")]
    assert got(simhash.groups(frame(rows))) == brute(rows)
    assert simhash.groups(frame([])).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3, 0])
def test_links_of_dense_sets(spark, bucket):
    """Whatever the size from which a bucket is keyed again, the components are those of all pairs."""
    random.seed(3)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        seed = random.getrandbits(64)
        for _ in range(25):
            seed ^= sum(1 << b for b in random.sample(range(64), random.randrange(1, 6)))
            fps.add(seed)
    fps = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "__fp long")
    edges = [(r.a, r.b) for r in simhash.link(df, bucket=bucket).collect()]
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3
        root[find(a)] = find(b)
    at = list(map(int, fps.view(np.int64)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            assert find(at[i]) == find(at[j])


def test_components(spark):
    from posframe.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
