import pytest
from pyspark.sql import functions as F

from posframe.operators import access, ingest, sampling, scoring, validate
from posframe.sources import positions as P
from posframe.streaming import ingest as stream


def test_cascade_is_disjoint(spark, sf_dir):
    raw = P.events_raw(spark, sf_dir)
    c = ingest.counters(raw).first()
    assert c.read == c.kept + c.captures + c.in_check + c.rejected == raw.count()
    assert ingest.kept(raw).count() == c.kept and ingest.capped(raw, 17).count() == 17
    bad = raw.withColumn("wdl", F.lit(7))
    assert ingest.counters(bad, filters=False).first().rejected == raw.count()


def test_dense_index(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k").repartition(7)
    rows = ingest.dense_index(df, "k").orderBy("k").collect()
    assert [r.idx for r in rows] == list(range(334))


def test_gather(spark, sf_dir):
    pos = P.positions(spark, sf_dir)
    ask = spark.createDataFrame([(0, 5), (1, 3), (2, 5)], "slot long, idx long")
    rows = access.gather_matrix(pos, ask).orderBy("slot").collect()
    one = {r.idx: r.features for r in pos.filter("idx in (3, 5)").collect()}
    assert [r.idx for r in rows] == [5, 3, 5]
    assert all(r.features[: r.piece_count] == one[r.idx] and set(r.features[r.piece_count :]) <= {65535} and len(r.features) == 32 for r in rows)
    with pytest.raises(Exception, match="out of range"):
        access.gather(pos, spark.createDataFrame([(0, 10**9)], "slot long, idx long")).collect()


def test_floyd():
    own = sampling.floyd(1000, 200, 1)
    assert own == sorted(set(own)) and len(own) == 200 and own == sampling.floyd(1000, 200, 1) != sampling.floyd(1000, 200, 2)
    assert sampling.floyd(5, 5, 3) == list(range(5))
    with pytest.raises(ValueError):
        sampling.floyd(2, 3, 0)


@pytest.mark.parametrize("drop", [True, False])
def test_batches_partition_the_epoch(spark, sf_dir, drop):
    pos = P.positions(spark, sf_dir)
    rows = sampling.epoch_batches(pos, 64, 10, 3, 1, 3, drop_last=drop).collect()
    seen = [r.idx for r in rows]
    assert len(seen) == len(set(seen)) and len(seen) > 960 and (drop or len(seen) == 1000)
    by = {}
    for r in rows:
        by.setdefault((r.worker, r.batch_id), []).append(r.pos)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert not drop or all(len(v) == 10 for v in by.values())
    again = sampling.epoch_batches(pos, 64, 10, 3, 2, 3, drop_last=drop).collect()
    assert sorted(map(tuple, rows)) != sorted(map(tuple, again))


def test_train_and_val_are_apart(spark, sf_dir):
    pos, val = P.positions(spark, sf_dir), sampling.val_index(spark, 1000, 100, 5)
    train = sampling.excluded(pos, val)
    assert train.count() == 900 and train.join(val, "idx").count() == 0
    assert sampling.index_checks(val, 1000).first().ok


def test_no_violations_in_good_rows(spark, sf_dir):
    assert validate.violations(P.positions(spark, sf_dir), validate.row_rules()).isEmpty()
    assert validate.violations(P.events_raw(spark, sf_dir), validate.input_rules()).isEmpty()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    raw = P.events_raw(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("idx")))
    raw.write.parquet(str(tmp_path / "in"))
    source = stream.read(spark, str(tmp_path / "in"), raw.schema)
    stream.write(stream.positions(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.idx for r in got.select("idx").collect()) == sorted(r.idx for r in ingest.kept(raw).select("idx").collect())
    q = stream.rates(source).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == raw.count()


def test_forward_shuffles_nothing(spark, sf_dir):
    """Each row is scored where it is read: two sums a row shuffled were many times the input."""
    from posframe.plans import catalog

    plan = catalog.forward_pass(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_forward_by_hand(spark):
    """Odd rows: null, empty and repeated features, ids without a vector, a null idx, null components, repeated vectors."""
    rows = [(0, 0, 2, [3, 5]), (1, 1, 30, [3, 700]), (2, 0, 2, []), (3, 1, 9, None), (4, 0, 40, [5, 5, 701]), (None, 0, 2, [3]), (5, None, None, [3]), (6, 0, 7, [-9, 2000])]
    pos = spark.createDataFrame(rows, "idx long, stm int, piece_count int, features array<int>")
    vectors = [(3, [0.25, None]), (3, [0.25, 0.5]), (5, [0.125, -0.5]), (443, [0.5, 0.75]), (700, None), (2000, [0.5, 0.5]), (10**12, [9.0, 9.0])]
    weights = spark.createDataFrame(vectors, "f long, w array<double>")
    head = scoring.Head([[0.5, 0.25, -0.5, 0.125], [0.25] * 4], [[1.0 + b, -0.5] for b in range(8)], [0.125, 0.0], [b / 8 for b in range(8)], [0.0625, 0.125])
    act = lambda x: min(max(x, 0.0), 1.0) ** 2
    flip = lambda f: (1 - f // 384) * 384 + (f % 384) // 64 * 64 + (f % 64 ^ 56)
    want = {}
    for i, stm, n, fs in rows:
        fs = fs or []
        sides = [fs, [flip(f) for f in fs if 0 <= f < 768]]
        x = [act(b + sum(w[j] or 0.0 for f in s for g, w in vectors if w and g == f)) for s in (sides[::-1] if stm == 1 else sides) for j, b in enumerate(head.feature_bias)]
        hidden = [act(sum(a * b for a, b in zip(x, row, strict=True)) + bias) for row, bias in zip(head.hidden, head.hidden_bias, strict=True)]
        bucket = 0 if n is None else min(max((n - 2) // 4, 0), 7)
        want[i] = (bucket, sum(a * b for a, b in zip(hidden, head.out[bucket], strict=True)) + head.out_bias[bucket])
    got = {r.idx: (r.bucket, r.out) for r in scoring.forward(pos, weights, head).collect()}
    assert set(got) == set(want) - {None}
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in got)
    assert scoring.forward(pos.limit(0), weights, head).count() == 0
