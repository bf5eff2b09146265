from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from posframe.llm import similar  # noqa: E402
from posframe.llm.common import table  # noqa: E402
from tests.llm.test_packing import checked  # noqa: E402
from tests.llm.test_similar import groups  # noqa: E402
from tests.llm.test_substrings import brute as windows  # noqa: E402

AT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, out = table(spark, AT, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, AT).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "packing"]
    for _, _, before, after in stages[:-1]:
        assert before == after == corpus_pipeline.COLUMNS


def test_quality(spark, stages):
    given, kept, _, _ = stages[0]
    kept = {r.doc_id for r in kept}
    labels = {r.doc_id: r.quality for r in table(spark, AT, "labels").collect()}
    bad = [i for i, q in labels.items() if q == 0]
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.99
    assert sum(i in kept for i in bad) / len(bad) < 0.05


def test_near_duplicates(stages):
    given, kept, _, _ = stages[1]
    assert {r.doc_id for r in kept} == set(groups([(r.doc_id, r.text) for r in given]).values())
    assert len(kept) == len({r.doc_id for r in kept})
    texts = {r.doc_id: r for r in given}
    assert all(texts[r.doc_id] == r for r in kept)


def test_substrings(stages):
    given, kept, _, _ = stages[2]
    want = {i: (gone, sha) for i, _, gone, sha in windows([(r.doc_id, r.text) for r in given])}
    texts = {r.doc_id: r.text for r in given}
    import hashlib

    assert len(kept) == len(given) and any(gone for gone, _ in want.values())
    for r in kept:
        gone, sha = want[r.doc_id]
        if gone:
            assert hashlib.sha256(r.text.encode()).hexdigest() == sha and r.n_chars == len(r.text)
        else:
            assert r.text == texts[r.doc_id]


def test_packing(stages):
    given, pieces, _, _ = stages[3]
    checked(pieces, {r.doc_id: r.text for r in given})


def test_run_is_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, AT)
    key = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert key(out.collect()) == key(stages[3][1])


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "words of another kind, all of them"), (4, "long " * 20000)]
    out = similar.one_of_each(frame(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", None), ("3", "a b c d"), ("None", rows[5][1]), ("4", rows[6][1])], key=lambda x: (x[0], x[1] or ""))
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, frame(rows), AT).count() > 0
        assert stage(spark, frame([]), AT).count() == 0
