import numpy as np
import pytest

from posframe.llm import quality
from posframe.llm.common import table


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    out = quality.op9_quality(spark, at).join(table(spark, at, "labels"), "doc_id")
    rows = out.filter("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean(np.array(good)[:, None] > np.array(bad)[None, :])
    assert len(rows) > 500 and right > 0.97 and auc > 0.98, (right, auc)
    assert np.mean([r.score >= 0.7 for r in rows if r.quality]) > 0.98


def test_ratios_and_descent_agree_with_a_plain_solver():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.5).astype(np.int32) for _ in range(60)]
    labels = np.array([int(0 in r or (3 in r and 4 in r)) for r in rows])
    ratios = rng.normal(size=12)
    w = quality.dual_descent(rows, labels, ratios, rounds=2000)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        v = ratios[r]
        x[i, r] = v / max(1e-9, np.sqrt(v @ v)) if len(v) else 0
    x[:, -1] = 1
    s = np.where(labels > 0, 1.0, -1.0)
    cost = np.where(labels > 0, 1.0, max(1.0, labels.sum() / (1 - labels).sum()))
    objective = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - s * (x @ w))).sum()
    best = objective(w)
    for _ in range(400):
        assert objective(w + rng.normal(size=13) * 0.05) >= best - 1e-2


def test_features():
    assert len(quality.features(b"")) == 0
    f = quality.features(b"One one ONE!! x")
    assert (np.diff(f) > 0).all() and f.max() < 1 << quality.BITS


def test_edges(spark, frame):
    rows = [(k, "good plain words, many of them.") for k in range(40)] + [(k, "BAD!! BAD!! WORSE!! ###") for k in range(40, 60)]
    docs = frame(rows)
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(60)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs.join(labels, "doc_id"))
    odd = frame([(1, None), (2, ""), (None, "WORSE!! BAD!! BAD!!"), (None, "WORSE!! BAD!! BAD!!"), (4, "many good words, plain of them. " * 5000)])
    got = {(r.doc_id, r["__score"]) for r in quality.score(odd, model).collect()}
    by = {k: v for k, v in got}
    assert len(got) == 4 and by[1] == by[2] and by[None] < 0.5 < by[4]
    assert quality.score(frame([]), model).count() == 0
    assert quality.fit(docs.join(labels.filter("quality = 1"), "doc_id")).flat == pytest.approx(41 / 42)
    assert quality.fit(docs.join(labels.filter("false"), "doc_id")).flat == 0.5


def test_arrays_in_one():
    """Rows of features are parts of one array, which goes back as a whole."""
    rows = [np.arange(n, dtype=np.int32) for n in (3, 0, 5)]
    made = quality.in_one(iter(rows), 8, np.int32)
    assert [x.tolist() for x in made] == [x.tolist() for x in rows]
    assert all(x.base is made[0].base for x in made)
