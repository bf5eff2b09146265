import math

import numpy as np
import pytest

from posframe.llm import ann, vafile
from posframe.llm.common import table


def brute(rows, ask, k, score):
    ok = [(i, np.array(v, dtype=np.float32)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ids = np.array([i for i, _ in ok])
    x = np.stack([v for _, v in ok]).astype(float) if ok else np.zeros((0, 1))
    out = {}
    for i, v in ok:
        if ask(i):
            s = score(x, v.astype(float))
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def integer(x, q):
    return np.floor(1024 * x) @ np.floor(1024 * q)


def test_exact_search(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert got(vafile.op2_vafile(spark, sf_dir)) == brute(rows, lambda i: i % 100 == 0, 10, integer)


def test_recall(spark):
    at = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, at, "embeddings").collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20, lambda x, q: (x * q).sum(axis=1))
    found = got(ann.op1_ann(spark, at))
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(exact[q, i] - s) < 1e-12 for q in found for i, s in found[q] if (q, i) in exact)


def odd_rows():
    rng = np.random.default_rng(1)
    same = [0.5, -0.25, 1.0]
    rows = [(k, rng.normal(size=3).round(2).tolist()) for k in range(1, 60)] + [(k, same) for k in range(100, 200)]
    rows += [(0, same), (0, same), (60, None), (80, []), (300, [1.0, None, 2.0]), (400, [math.nan, 1.0, 1.0]), (500, [math.inf, 0.0, 0.0]), (None, same), (600, [0.0, 0.0, 0.0]), (40, [2.0, 2.0, 2.0])]
    return [(i, v, "x") for i, v in rows]


@pytest.mark.parametrize("block,query", [(16384, 4096), (7, 3)])
def test_edges(spark, block, query):
    data = spark.createDataFrame([(*r, 9) for r in odd_rows()], "vec_id long, embedding array<float>, score string, rank int")
    ask = data.filter("vec_id % 20 = 0")
    rows = [(i, v) for i, v, _ in odd_rows()]
    want = brute(rows, lambda i: i % 20 == 0, 10, integer)
    assert got(vafile.search(data, ask.filter("vec_id <> 0"), block_rows=block, query_rows=query)) == {q: v for q, v in want.items() if q}
    zero = [(i, v) for i, v in rows if v != [0.0] * 3]
    want = brute(zero, lambda i: i % 20 == 0, 20, lambda x, q: (x * q).sum(axis=1))
    found = got(ann.search(data, ask.filter("vec_id <> 0"), confidence=1 - 1e-12, block_rows=block, query_rows=query))
    assert found == {q: v for q, v in want.items() if q}
    for search in (vafile.search, ann.search):
        assert search(data.filter("false"), ask).count() == 0 and search(data, ask.filter("false")).count() == 0
        few = search(data.filter("vec_id in (1, 2, 20)"), data.filter("vec_id = 20"))
        assert [i for i, _ in got(few)[20]] and few.count() == 2
        odd = spark.createDataFrame([(900, [1.0], "", 1), (920, [1.0], "", 1), (40, [9.0, 9.0], "", 1)], data.schema)
        both = search(data.unionByName(odd), ask.unionByName(odd.filter("vec_id % 20 = 0")).filter("vec_id <> 0"), block_rows=block)
        assert got(both) == got(search(data, ask.filter("vec_id <> 0"), block_rows=block))


@pytest.mark.parametrize("size", [8000.0, 1e12, 1e30])
def test_large_components(spark, size):
    """Products beyond 2**53 are exact, those beyond a long the nearest long."""
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=64) * size).astype(np.float32).tolist()) for k in range(80)]
    rows.append((80, [x * (1 + 1e-7) for x in rows[20][1]]))
    whole = {i: [max(-(2**63), min(2**63 - 1, math.floor(1024 * float(np.float32(x))))) for x in v] for i, v in rows}
    clip = lambda n: max(1 - 2**63, min(2**63 - 1, n))
    want = {}
    for q in range(0, 80, 20):
        s = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)
        want[q] = [(i, -x) for x, i in s[:10]]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(vafile.search(data, data.filter("vec_id % 20 = 0 and vec_id < 80"), block_rows=30)) == want


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-5)
    assert ann.chi_square_quantile(0.9, 8) == pytest.approx(13.361566, abs=1e-5)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-500, 500, (200, 5)), rng.integers(-500, 500, (20, 5))
    low, high = vafile.Approximation(x, 3).bounds(q.astype(float))
    s = q @ x.T
    assert (low <= s).all() and (s <= high).all()
