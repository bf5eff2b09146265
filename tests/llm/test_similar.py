import random

import numpy as np
import pytest

from posframe.llm import common, similar
from posframe.llm.common import table


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def close(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def groups(rows):
    """The least id of each document's group, by all pairs that share a shingle."""
    sets, by_one, group = {i: shingles(t) for i, t in rows}, {}, {}
    for i, own in sets.items():
        for s in own or {None}:
            by_one.setdefault(s, []).append(i)
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = i
                todo += {j for s in sets[x] or {None} for j in by_one[s] if j not in group and close(sets[x], sets[j])}
    return group


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [r.doc_id for r in similar.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(groups(rows).values()))


def test_links_between_different_texts(spark):
    """By bands of similarity: of each linked pair of different texts of a whole table one goes."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    least = {}
    for r in docs.orderBy("doc_id").collect():
        own = similar.sets([(r.text or "").encode()])[0][0]
        least.setdefault(own.tobytes(), (r.doc_id, own))
    ids, sets = zip(*least.values(), strict=True)
    size = np.array([len(s) for s in sets])
    h, c = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((c, h))
    h, c, pairs = h[order], c[order], []
    for d in range(1, len(h)):
        at = np.flatnonzero(h[d:] == h[:-d])
        if not len(at):
            break
        pairs.append(c[at] * len(sets) + c[at + d])
    pairs, both = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = pairs // len(sets), pairs % len(sets)
    close_ = both / (size[a] + size[b] - both)
    kept = {r.doc_id for r in similar.one_of_each(docs).select("doc_id").collect()}
    for low, high in [(0.8, 0.85), (0.85, 0.9), (0.9, 1.01)]:
        band = np.flatnonzero((close_ >= low - 1e-9) & (close_ < high - 1e-9))
        stay = sum(ids[a[i]] in kept and ids[b[i]] in kept for i in band)
        print(f"similarity {low} to {min(high, 1)}: {len(band)} links, both texts stay of {stay}")
        assert len(band) and stay == 0


@pytest.mark.parametrize("edits", [1, 3])
def test_planted_copies(spark, frame, edits):
    random.seed(edits)
    words = ["w%d" % k for k in range(4000)]
    rows, n = [], 0
    for _ in range(60):
        own = random.choices(words, k=200)
        rows.append((n, " ".join(own)))
        n += 1
        for _ in range(3):
            copy = list(own)
            for at in random.sample(range(200), edits):
                copy[at] = "edited%d" % n
            rows.append((n, " ".join(copy)))
            n += 1
    kept = sorted(r.doc_id for r in similar.one_of_each(frame(rows)).collect())
    first = [k for k in range(n) if k % 4 == 0]
    assert kept == first


def test_large_group_and_edges(spark, frame):
    random.seed(1)
    base = random.choices("abcdefghijklmnopqrstuvwxyz", k=400)
    rows = [(5, None), (4, ""), (9, " \n"), (3, "a b"), (3, "A b"), (None, "a b"), (2, "lonely words"), (None, "only here")]
    for k in range(100, 400):
        copy = list(base)
        copy[random.randrange(400)] = "x%d" % k
        rows.append((k, " ".join(copy)))
    kept = sorted(((r.doc_id, (r.text or "").lower().strip()) for r in similar.one_of_each(frame(rows), hubs=4).collect()), key=str)
    assert [x for x in kept if x[0] is None or x[0] < 100] == [(2, "lonely words"), (3, "a b"), (4, ""), (None, "only here")]
    assert len([x for x in kept if x[0] is not None and x[0] >= 100]) == 1
    assert similar.one_of_each(frame([])).count() == 0


def test_no_link_is_lost_to_the_hubs(spark, frame):
    """Of a bucket where the hubs are all of one group, the other group's links are found too."""
    random.seed(5)
    rows, want = [], 0
    for g in range(4):
        base = random.choices(["v%d" % k for k in range(50)], k=300)
        for k in range(12):
            copy = list(base)
            copy[random.randrange(300)] = "v%d" % random.randrange(50)
            rows.append((100 * g + k, " ".join(copy)))
        want += 1
    kept = [r.doc_id for r in similar.one_of_each(frame(rows), hubs=1, prints=6).collect()]
    assert sorted(kept) == sorted(r.doc_id for r in similar.one_of_each(frame(rows), hubs=1, prints=6, bucket=4).collect())
    all_pairs = [r.doc_id for r in similar.one_of_each(frame(rows), hubs=100, prints=6).collect()]
    assert sorted(kept) == sorted(all_pairs) and want <= len(kept) < len(rows)


@pytest.mark.parametrize("seed,width", [(1, 8), (2, 1)])
def test_group_linked_through_its_original(spark, frame, seed, width):
    """Copies of one original that are mostly not similar enough to each other."""
    random.seed(seed)
    words = ["w%d" % k for k in range(5000)]
    own = random.choices(words, k=300)
    rows = [(50, " ".join(own))]
    for n in [*range(50), *range(51, 101)]:
        copy = list(own)
        for at in random.sample(range(4, 296, 8), random.choice([5, 6])):
            copy[at] = "edited%d" % random.randrange(10**9)
        rows.append((n, " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    apart = sum(not close(a, b) for i, a in enumerate(sets) for b in sets[:i])
    assert all(close(sets[0], s) for s in sets) and apart > 4000
    assert [r.doc_id for r in similar.one_of_each(frame(rows), width=width).collect()] == [0]


def test_frequent_shingles_come_last(spark, frame, monkeypatch):
    """The order of the shingles doesn't change the groups."""
    random.seed(7)
    line = " ".join("common%d" % k for k in range(40))
    rows = []
    for g in range(40):
        own = random.choices(["w%d" % k for k in range(3000)], k=100)
        for k in range(5):
            copy = list(own)
            for at in random.sample(range(100), k):
                copy[at] = "edited%d" % random.randrange(10**9)
            rows.append((10 * g + k, line + " " + " ".join(copy)))
    want = sorted(set(groups(rows).values()))
    for sample, frequent in [(1, 8), (1, 3), (16, 16)]:
        monkeypatch.setattr(similar, "SAMPLE", sample)
        monkeypatch.setattr(similar, "FREQUENT", frequent)
        assert sorted(r.doc_id for r in similar.one_of_each(frame(rows)).collect()) == want


def test_sets():
    for text in ["", "one", "a b c d", "a b c d e", "a b c d e f g a b c d e"]:
        made, words = similar.sets([text.encode()])[0]
        assert len(made) == len(shingles(text)) and len(words) == len(set(text.split()))


def test_map_of_keys(spark):
    """A map has few rows, however many keys; all keys meet, few others do, and the rest is the anti join."""
    keys, all_ = spark.range(0, 600_000, 2), spark.range(600_000)
    assert common.key_map(keys).count() <= 1 << 16
    met, rest = common.meeting(all_, "id", keys), common.meeting(all_, "id", keys, "left_anti")
    assert met.filter("id % 2 = 0").count() == 300_000 and met.filter("id % 2 = 1").count() < 6000
    assert met.count() + rest.count() == 600_000
    assert common.meeting(all_, "id", keys.limit(0)).count() == 0
