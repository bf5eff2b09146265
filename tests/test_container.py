import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from posframe import schema as S
from posframe.operators import access
from posframe.sources import container as K
from posframe.sources import positions as P


def golden(spark):
    rows = [(i, cp, w, s, 4, list(range(4 * i + 1, 4 * i + 5))) for i, (cp, w, s) in enumerate([(100, 1, 0), (-50, 0, 1), (300, -1, 0), (0, 1, 1)])]
    return P.encoded(spark.createDataFrame(rows, "idx long, score_cp int, wdl int, stm int, piece_count int, features array<int>"))


@pytest.fixture
def path(spark, tmp_path):
    out = str(tmp_path / "golden.bin")
    K.write(golden(spark), out)
    return out


def test_golden_bytes(path):
    data = open(path, "rb").read()
    h = K.parse_header(data)
    assert [h[f"{s}_offset"] for s in K.SECTIONS] == [256, 260, 268, 272, 280, 2330] and h["metadata_offset"] == 2362 and h["metadata_length"] == 50 and len(data) == 2412
    assert data[256:260] == bytes([4, 5, 4, 5])
    assert struct.unpack("<4h", data[260:268]) == (750, -375, 2250, 0)
    assert struct.unpack("<4b", data[268:272]) == (1, 0, -1, 1)
    prefix = np.frombuffer(data, "<u2", 1025, 280).tolist()
    assert prefix == [0, 4, 8, 12, 16] + [16] * 1020
    assert np.frombuffer(data, "<u2", 16, 2330).tolist() == list(range(1, 17))
    assert K.serialize_header(h) == data[:256]
    assert os.listdir(os.path.dirname(path)) == ["golden.bin"]


def test_read(spark, path):
    K.check_metadata(K.Container(path).metadata())
    rows = K.read(spark, path).orderBy("idx").collect()
    assert [r.eval_raw for r in rows] == [750, -375, 2250, 0] and rows[2].features == [9, 10, 11, 12] and rows[1].stm == 1
    assert K.read(spark, path, columns="idx,wdl", validate="header").columns == ["idx", "wdl"]
    assert K.header_frame(spark, path).first().num_positions == 4
    lines = [r.line for r in access.dump(K.read(spark, path), 0, 2).collect()]
    assert lines[0] == "[0] stm=0 pc=4 wdl=1 eval=0.25 features=[1,2,3,4]"
    assert {r.name: r.value for r in K.inspect(spark, path).collect()}["wdl 1"] == "2 (50.00%)"


def test_many_blocks(spark, sf_dir, tmp_path):
    out = str(tmp_path / "many.bin")
    pos = P.positions(spark, "/root/testdata/sf0.01").limit(3500).filter("idx < 2500")
    pos = spark.createDataFrame(pos.orderBy("idx").collect(), S.POSITION)
    K.write(pos, out)
    back = K.read(spark, out, block_rows=1024)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, pos.collect()), key=str)
    for i in (0, 1, 1023, 1024, 2047, 2048, pos.count() - 1):
        assert access.at(back, i).first().features == access.at(pos, i).first().features
    with pytest.raises(S.WriteError):
        K.WriteOptions(metadata="{}")
    with pytest.raises(Exception, match="not dense|is not dense"):
        K.write(pos.filter("idx <> 5"), str(tmp_path / "gap.bin"))
    assert not os.path.exists(tmp_path / "gap.bin")


@pytest.mark.parametrize("name,value", [("magic", b"XXXX"), ("version", 1), ("header_size", 128), ("endian", 1), ("layout_kind", 1), ("feature_set", 9), ("count_semantics", 1), ("eval_encoding", 0), ("mate_encoding", 2), ("flags_encoding", 1), ("reserved15", 1), ("shard_id", 1), ("num_shards", 2), ("global_position_start", 1), ("block_size", 512), ("max_count", 16), ("count_base", 1), ("has_eval_global", 0), ("has_wdl_global", 0), ("header_flags", 1), ("reserved76", 1)])
def test_bad_headers(path, name, value):
    h = K.parse_header(open(path, "rb").read()) | {name: value}
    with pytest.raises(S.ParseError):
        K.parse_header(K.serialize_header(h))


def test_header_rules(path):
    h, size = K.parse_header(open(path, "rb").read()), os.path.getsize(path)
    assert K.header_violations(h, size) == []
    cases = {
        "fixed_scale": {"fixed_scale": float("nan")}, "normal_eval_clip": {"normal_eval_clip": 0.0}, "storage_target_clip": {"storage_target_clip": float("inf")}, "num_positions": {"num_positions": 0},
        "num_blocks": {"num_blocks": 0}, "block_count": {"num_blocks": 2}, "eval_range": {"fixed_scale": 4000.0}, "block_sum": {"max_count": 64}, "eval_alignment": {"eval_offset": 261},
        "block_anchors_alignment": {"block_anchors_offset": 276}, "flags_offset": {"flags_offset": 10}, "w_flat_offset": {"w_flat_offset": 10**9}, "metadata_range": {"metadata_length": 51},
        "flags_overlap": {"num_positions": 5}, "w_flat_overlap": {"num_features_total": 17}, "blocks_overflow": {"num_positions": 2**63},
    }
    for rule, change in cases.items():
        assert rule in K.header_violations(h | change, size), rule
    with pytest.raises(S.ParseError):
        K.parse_header(b"CNN2")
    data = bytearray(K.serialize_header(h))
    data[200] = 1
    with pytest.raises(S.ParseError):
        K.parse_header(bytes(data))


@pytest.mark.parametrize("at,value,rule", [(256, 0x44, "flags_reserved_bits"), (256, 62, "flags_count_sentinel|count_is_nnz"), (261, 0x7F, "eval_bound"), (268, 3, "wdl_domain"), (2331, 9, "feature_bound"), (256, 6, "count_is_nnz"), (272, 1, "first_anchor"), (280, 1, "prefix_first"), (284, 3, "prefix_monotone"), (2328, 15, "prefix_monotone"), (300, 17, "prefix_monotone")])
def test_corruption(spark, path, at, value, rule):
    data = bytearray(open(path, "rb").read())
    data[at] = value
    open(path, "wb").write(data)
    with pytest.raises(S.ValidationError, match=rule + "|" + "feature_total|prefix"):
        K.check(spark, path)


def test_trailer():
    for bad in (b"", b"[1]", b"{", b'{"format":"x","layout":"single_file"}', b'{"format":"' + S.FORMAT_NAME.encode() + b'"}'):
        with pytest.raises(S.ValidationError):
            K.check_metadata(bad)


def test_cli(spark, path, capsys):
    from posframe import cli

    assert cli.main(["help"]) == 0 and cli.main([]) == 2 and cli.main(["dump", path, "3:1"]) == 2
    assert cli.main(["validate", path + ".none"]) == 3
    assert cli.main(["dump", path, "9:12"]) == 2
    data = bytearray(open(path, "rb").read())
    data[0] = 0
    open(path, "wb").write(data)
    assert cli.main(["validate", path]) == 1
    assert F.col("x") is not None and "magic" in capsys.readouterr().err
