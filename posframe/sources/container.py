"""The block-indexed binary container: header codec, a Spark data source, a sink.

Read: spark.read.format("positions").option("path", ...).load(), a partition for
each run of blocks; options validate (full, header), block_rows and columns.
Write: df.write.format("positions").mode(...).save(path): tasks write fragments
of each section beside the target, the commit joins them in the order of idx.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from posframe import schema as S
from posframe.functions.codecs import align_up, checked_u64

# Fixed values of the format: each header field, its offset and its type.
FIELDS = [
    ("magic", 0, "4s"), ("version", 4, "H"), ("header_size", 6, "H"), ("endian", 8, "B"), ("layout_kind", 9, "B"), ("feature_set", 10, "B"), ("count_semantics", 11, "B"),
    ("eval_encoding", 12, "B"), ("mate_encoding", 13, "B"), ("flags_encoding", 14, "B"), ("reserved15", 15, "B"), ("shard_id", 16, "I"), ("num_shards", 20, "I"),
    ("global_position_start", 24, "Q"), ("num_positions", 32, "Q"), ("num_features_total", 40, "Q"), ("max_feature_id", 48, "I"), ("num_blocks", 52, "I"),
    ("block_size", 56, "H"), ("max_count", 58, "B"), ("count_base", 59, "B"), ("fixed_scale", 60, "f"), ("normal_eval_clip", 64, "f"), ("storage_target_clip", 68, "f"),
    ("has_eval_global", 72, "B"), ("has_wdl_global", 73, "B"), ("header_flags", 74, "H"), ("reserved76", 76, "I"), ("flags_offset", 80, "Q"), ("eval_offset", 88, "Q"),
    ("wdl_offset", 96, "Q"), ("block_anchors_offset", 104, "Q"), ("block_prefix_offset", 112, "Q"), ("w_flat_offset", 120, "Q"), ("metadata_offset", 128, "Q"), ("metadata_length", 136, "Q"),
]
#: The values that a header may have.
ALLOWED = {
    "version": {2}, "header_size": {256}, "endian": {0}, "layout_kind": {0}, "feature_set": {1, 2, 3}, "count_semantics": {0}, "eval_encoding": {1}, "mate_encoding": {0, 1}, "flags_encoding": {0},
    "reserved15": {0}, "shard_id": {0}, "num_shards": {1}, "global_position_start": {0}, "block_size": {1024}, "max_count": {32}, "count_base": {2}, "has_eval_global": {1}, "has_wdl_global": {1},
    "header_flags": {0}, "reserved76": {0},
}
SECTIONS = ["flags", "eval", "wdl", "block_anchors", "block_prefix", "w_flat"]
ALIGNMENT = {"eval": 2, "block_anchors": 8, "block_prefix": 2, "w_flat": 2}


def parse_header(data: bytes) -> dict:
    """The header's fields; ParseError if one has a value that it may not have."""
    if len(data) < S.HEADER_SIZE:
        raise S.ParseError(f"{len(data)} bytes are no header")
    h = {name: struct.unpack_from("<" + kind, data, at)[0] for name, at, kind in FIELDS}
    if h["magic"] != S.MAGIC:
        raise S.ParseError(f"magic {h['magic']!r}")
    for name, allowed in ALLOWED.items():
        if h[name] not in allowed:
            raise S.ParseError(f"{name} is {h[name]}")
    if any(data[144 : S.HEADER_SIZE]):
        raise S.ParseError("reserved bytes are not zero")
    return h


def serialize_header(h: dict) -> bytes:
    out = bytearray(S.HEADER_SIZE)
    for name, at, kind in FIELDS:
        struct.pack_into("<" + kind, out, at, h[name])
    return bytes(out)


def section_bytes(h: dict) -> dict[str, int]:
    n, b = h["num_positions"], h["num_blocks"]
    return {"flags": n, "eval": 2 * n, "wdl": n, "block_anchors": 8 * b, "block_prefix": 2 * b * (h["block_size"] + 1), "w_flat": 2 * h["num_features_total"]}


def header_violations(h: dict, file_size: int) -> list[str]:
    """The names of the consistency rules that a header breaks, in order."""
    out = [name for name, allowed in ALLOWED.items() if h[name] not in allowed]
    for name in ("fixed_scale", "normal_eval_clip", "storage_target_clip"):
        if not (math.isfinite(h[name]) and h[name] > 0):
            out.append(name)
    n, b, size = h["num_positions"], h["num_blocks"], h["block_size"] or 1
    out += ["num_positions"] * (n == 0) + ["num_blocks"] * (b == 0)
    wanted = n // size + (n % size > 0)
    out += ["blocks_overflow"] * (wanted >= 1 << 32) + ["block_count"] * (wanted != b)
    if math.isfinite(h["storage_target_clip"]) and math.isfinite(h["fixed_scale"]) and h["storage_target_clip"] * h["fixed_scale"] > 32767:
        out.append("eval_range")
    out += ["block_sum"] * (size * h["max_count"] > 65535)
    out += [f"{s}_alignment" for s, a in ALIGNMENT.items() if h[f"{s}_offset"] % a]
    out += [f"{s}_offset" for s in SECTIONS if not S.HEADER_SIZE <= h[f"{s}_offset"] < file_size]
    over, end = checked_u64("add", h["metadata_offset"], h["metadata_length"])
    out += ["metadata_range"] * (h["metadata_offset"] < S.HEADER_SIZE or over or end > file_size)
    order = [*SECTIONS, "metadata"]
    for (s, size_), after in zip(section_bytes(h).items(), order[1:], strict=True):
        over, end = checked_u64("add", h[f"{s}_offset"], size_)
        if over or end > h[f"{after}_offset"]:
            out.append(f"{s}_overlap")
    return out


def layout(positions: int, features: int) -> dict[str, int]:
    """The canonical offsets."""
    blocks, at, out = -(-positions // S.BLOCK_SIZE), S.HEADER_SIZE, {}
    sizes = section_bytes({"num_positions": positions, "num_blocks": blocks, "block_size": S.BLOCK_SIZE, "num_features_total": features})
    for s in SECTIONS:
        out[f"{s}_offset"] = at = align_up(at, ALIGNMENT.get(s, 1))
        at += sizes[s]
    return out | {"metadata_offset": at}


@dataclass
class WriteOptions:
    """Options of the sink."""

    metadata: str = ""
    max_feature_id: int = S.MAX_FEATURE_ID
    feature_set: int = 1
    mate_encoding: int = 0
    fixed_scale: float = S.FIXED_SCALE
    normal_eval_clip: float = S.NORMAL_EVAL_CLIP
    storage_target_clip: float = S.STORAGE_TARGET_CLIP
    validate: bool = True
    max_bytes: int = 0
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, options) -> WriteOptions:
        """The options of a writer, whose names come in lower case and whose values as text."""
        kinds = {"metadata": str, "max_feature_id": int, "feature_set": int, "mate_encoding": int, "fixed_scale": float, "normal_eval_clip": float, "storage_target_clip": float, "max_bytes": int, "validate": lambda x: str(x).lower() == "true"}
        given = {k.lower(): v for k, v in dict(options).items()}
        if unknown := given.keys() - kinds.keys() - {"path"}:
            raise S.WriteError(f"unknown options {sorted(unknown)}")
        return cls(**{k: kinds[k](v) for k, v in given.items() if k in kinds})

    def __post_init__(self):
        if self.feature_set != 1:
            raise S.WriteError("only feature set 1 is written")
        if self.max_feature_id <= 0 or self.max_feature_id > 65536:
            raise S.WriteError(f"max_feature_id {self.max_feature_id}")
        for x in (self.fixed_scale, self.normal_eval_clip, self.storage_target_clip):
            if not (math.isfinite(x) and x > 0):
                raise S.WriteError("scale and clips are finite and positive")
        if self.fixed_scale * self.storage_target_clip > 32767:
            raise S.WriteError("scale and clip don't fit 16 bits")
        if self.validate and self.metadata:
            try:
                own = json.loads(self.metadata)
            except ValueError as e:
                raise S.WriteError("metadata is no JSON") from e
            if not isinstance(own, dict) or own.get("format") != S.FORMAT_NAME or own.get("layout") != S.LAYOUT_NAME:
                raise S.WriteError("metadata lacks format or layout")

    def header(self, positions: int, features: int) -> dict:
        h = {name: 0 for name, _, _ in FIELDS} | {
            "magic": S.MAGIC, "version": S.VERSION, "header_size": S.HEADER_SIZE, "feature_set": self.feature_set, "eval_encoding": 1, "mate_encoding": self.mate_encoding, "num_shards": 1,
            "num_positions": positions, "num_features_total": features, "max_feature_id": self.max_feature_id, "num_blocks": -(-positions // S.BLOCK_SIZE), "block_size": S.BLOCK_SIZE,
            "max_count": S.MAX_COUNT, "count_base": S.COUNT_BASE, "fixed_scale": self.fixed_scale, "normal_eval_clip": self.normal_eval_clip, "storage_target_clip": self.storage_target_clip,
            "has_eval_global": 1, "has_wdl_global": 1,
        }
        return h | layout(positions, features) | {"metadata_length": len(self.text)}

    @property
    def text(self) -> bytes:
        return (self.metadata or S.DEFAULT_METADATA).encode()


class Container:
    """A file opened for reading parts of it."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.header = parse_header(f.read(S.HEADER_SIZE))
        self.size = os.path.getsize(path)

    def array(self, section: str, kind: str, start: int, count: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.fromfile(self.path, dtype=kind, count=count, offset=self.header[f"{section}_offset"] + start * width)

    def metadata(self) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(self.header["metadata_offset"])
            return f.read(self.header["metadata_length"])

    def blocks(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        per = self.header["block_size"] + 1
        return self.array("block_anchors", "<u8", first, count), self.array("block_prefix", "<u2", first * per, count * per).reshape(-1, per)

    def rows(self, first_block: int, blocks: int, columns: list[str]) -> pa.RecordBatch:
        """The positions of some blocks; only the sections that columns need are read."""
        h = self.header
        start = first_block * h["block_size"]
        n = min(blocks * h["block_size"], h["num_positions"] - start)
        flags = self.array("flags", "u1", start, n) if {"flags", "stm", "piece_count"} & {*columns} else None
        out = {}
        for c in columns:
            if c == "idx":
                out[c] = pa.array(np.arange(start, start + n))
            elif c == "flags":
                out[c] = pa.array(flags.astype(np.int16))
            elif c == "stm":
                out[c] = pa.array((flags & 1).astype(np.int8))
            elif c == "piece_count":
                out[c] = pa.array(((flags >> 1 & 31) + h["count_base"]).astype(np.int8))
            elif c == "wdl":
                out[c] = pa.array(self.array("wdl", "i1", start, n))
            elif c in ("eval_raw", "eval_norm"):
                raw = self.array("eval", "<i2", start, n)
                out[c] = pa.array(raw if c == "eval_raw" else raw.astype(np.float32) / np.float32(h["fixed_scale"]))
            elif c == "features":
                anchors, prefix = self.blocks(first_block, blocks)
                ends = (anchors[:, None] + prefix[:, 1:]).ravel()[:n].astype(np.int64)
                base = int(anchors[0])
                offsets = np.r_[base, ends] - base
                if (np.diff(offsets) < 0).any() or base + offsets[-1] > h["num_features_total"]:
                    raise S.ValidationError("feature slices are out of bounds")
                flat = self.array("w_flat", "<u2", base, int(offsets[-1])).astype(np.int32)
                out[c] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_pydict(out)


@dataclass
class Blocks(InputPartition):
    path: str
    first: int
    count: int


class PositionReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = schema.fieldNames()
        self.path = options.get("path")
        self.per = max(1, int(options.get("block_rows", 1 << 20)) // S.BLOCK_SIZE)
        own = Container(self.path)
        if options.get("validate", "full") != "none" and (bad := header_violations(own.header, own.size)):
            raise S.ValidationError(f"header: {bad}")
        self.total = own.header["num_blocks"]

    def partitions(self):
        return [Blocks(self.path, at, min(self.per, self.total - at)) for at in range(0, self.total, self.per)]

    def read(self, partition):
        own = Container(partition.path)
        for at in range(partition.first, partition.first + partition.count, 16):
            yield own.rows(at, min(16, partition.first + partition.count - at), self.columns)


@dataclass
class Fragment(WriterCommitMessage):
    first: int
    rows: int
    features: int
    name: str | None


class PositionWriter(DataSourceArrowWriter):
    """Each task's rows are a run of idx that begins at a block's border (see `write`)."""

    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.options = WriteOptions.of(options)
        if os.path.exists(self.path) and not overwrite:
            raise S.WriteError(f"{self.path} exists")
        self.folder = f"{self.path}.{uuid.uuid4().hex}"
        os.makedirs(self.folder)

    def write(self, iterator):
        name = f"{self.folder}/{uuid.uuid4().hex}"
        files, rows, features, first, last, counts = {}, 0, 0, None, None, []
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                files = files or {s: open(f"{name}.{s}", "wb") for s in ("flags", "eval", "wdl", "w_flat")}  # noqa: SIM115
                idx = batch.column("idx").to_numpy()
                if first is None:
                    first = int(idx[0])
                if (np.diff(np.r_[last if last is not None else idx[0] - 1, idx]) != 1).any():
                    raise S.WriteError("idx is not dense and in order")
                last = int(idx[-1])
                lists = batch.column("features")
                nnz = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                flags = batch.column("flags").to_numpy(zero_copy_only=False)
                wdl = batch.column("wdl").to_numpy(zero_copy_only=False)
                if ((flags >> 1 & 31) + S.COUNT_BASE != nnz).any() or (flags & 0xC0).any() or not np.isin(wdl, (-1, 0, 1)).all() or len(flat) and not (0 <= flat.min() and flat.max() < self.options.max_feature_id):
                    raise S.WriteError("rows break the format; see operators.validate")
                flags.astype("u1").tofile(files["flags"])
                batch.column("eval_raw").to_numpy(zero_copy_only=False).astype("<i2").tofile(files["eval"])
                wdl.astype("i1").tofile(files["wdl"])
                flat.astype("<u2").tofile(files["w_flat"])
                counts.append(nnz)
                rows += len(idx)
                features += int(nnz.sum())
        finally:
            for f in files.values():
                f.close()
        if not rows:
            return Fragment(0, 0, 0, None)
        np.concatenate(counts).astype("u1").tofile(f"{name}.nnz")
        return Fragment(first, rows, features, name)

    def commit(self, messages):
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        positions, features = sum(m.rows for m in parts), sum(m.features for m in parts)
        try:
            if not positions:
                raise S.WriteError("no positions")
            if any(a.first + a.rows != b.first for a, b in zip(parts, parts[1:], strict=False)) or parts[0].first != 0:
                raise S.WriteError("idx is not dense from 0")
            h = self.options.header(positions, features)
            if 0 < self.options.max_bytes < h["metadata_offset"] + h["metadata_length"]:
                raise S.WriteError("the file would exceed max_bytes")
            target = f"{self.folder}/whole"
            with open(target, "wb") as out:
                out.write(serialize_header(h))
                for s in ("flags", "eval", "wdl", "w_flat"):
                    out.seek(h[f"{s}_offset"])
                    for m in parts:
                        with open(f"{m.name}.{s}", "rb") as f:
                            while data := f.read(1 << 22):
                                out.write(data)
                self._index(out, h, parts)
                out.seek(h["metadata_offset"])
                out.write(self.options.text)
            if bad := header_violations(h, os.path.getsize(target)):
                raise S.WriteError(f"header: {bad}")
            os.replace(target, self.path)
        finally:
            self.abort(messages)

    @staticmethod
    def _index(out, h, parts):
        block, carry, anchor = 0, np.zeros(0, np.int64), 0
        for k, m in enumerate(parts):
            nnz = np.r_[carry, np.fromfile(f"{m.name}.nnz", "u1").astype(np.int64)]
            end = len(nnz) if k == len(parts) - 1 else len(nnz) // S.BLOCK_SIZE * S.BLOCK_SIZE
            carry = nnz[end:]
            for at in range(0, end, S.BLOCK_SIZE):
                own = nnz[at : min(at + S.BLOCK_SIZE, end)]
                prefix = np.r_[0, np.cumsum(own), np.full(S.BLOCK_SIZE - len(own), own.sum())]
                out.seek(h["block_anchors_offset"] + 8 * block)
                out.write(struct.pack("<Q", anchor))
                out.seek(h["block_prefix_offset"] + 2 * block * (S.BLOCK_SIZE + 1))
                out.write(prefix.astype("<u2").tobytes())
                block, anchor = block + 1, anchor + int(own.sum())

    def abort(self, messages):
        import shutil

        shutil.rmtree(self.folder, ignore_errors=True)


class PositionSource(DataSource):
    @classmethod
    def name(cls):
        return "positions"

    def schema(self):
        wanted = self.options.get("columns")
        if not wanted:
            return S.POSITION
        from pyspark.sql.types import StructType

        return StructType([S.POSITION[c.strip()] for c in wanted.split(",")])

    def reader(self, schema):
        return PositionReader(schema, self.options)

    def writer(self, schema, overwrite):
        return PositionWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PositionSource)


def read(spark: SparkSession, path: str, validate: str = "full", **options) -> DataFrame:
    """The positions of a container; validate: full (all rules), header, none."""
    register(spark)
    df = spark.read.format("positions").options(path=path, validate=validate, **options).load()
    if validate == "full":
        check(spark, path)
    return df


def write(pos: DataFrame, path: str, overwrite: bool = False, **options) -> None:
    """Writes positions with idx 0, 1, ... as a container on a folder that all executors
    share. Rows are range-partitioned by idx, so a task has one run of them. Options are
    those of WriteOptions; unless validate is false, the file is checked after the write."""
    register(pos.sparkSession)
    ordered = pos.select("idx", "flags", "eval_raw", "wdl", "features").repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.write.format("positions").options(path=path, **{k: str(v) for k, v in options.items()}).mode("overwrite" if overwrite else "append").save()
    if WriteOptions.of(options).validate:
        check(pos.sparkSession, path)


def header_frame(spark: SparkSession, path: str) -> DataFrame:
    own = Container(path)
    values = {k: v.decode() if isinstance(v, bytes) else v for k, v in own.header.items()} | {"metadata": own.metadata().decode("utf-8", "replace"), "file_size": own.size}
    return spark.createDataFrame([values])


def block_frame(spark: SparkSession, path: str) -> DataFrame:
    """The block index (block_id, anchor, prefix) as stored."""
    own = Container(path)

    def load(it):
        for batch in it:
            for b in batch.column(0).to_pylist():
                anchors, prefix = Container(path).blocks(b, min(256, own.header["num_blocks"] - b))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(b, b + len(anchors))), pa.array(anchors.astype(np.int64)), pa.array(list(prefix.astype(np.int32)), pa.list_(pa.int32()))], names=["block_id", "anchor", "prefix"])

    return spark.range(0, own.header["num_blocks"], 256).mapInArrow(load, S.BLOCK)


def check(spark: SparkSession, path: str) -> None:
    """ParseError or ValidationError for the first rule that a container breaks."""
    from posframe.operators import validate as V

    own = Container(path)
    if bad := header_violations(own.header, own.size):
        raise S.ValidationError(f"header: {bad}")
    h = own.header
    last = h["num_positions"] - (h["num_blocks"] - 1) * h["block_size"]
    V.checked(V.block_violations(block_frame(spark, path), h["num_features_total"], h["block_size"], h["max_count"], last))
    register(spark)
    rows = spark.read.format("positions").options(path=path, validate="header").load()
    V.checked(V.violations(rows, V.row_rules(h["max_feature_id"], h["fixed_scale"], h["storage_target_clip"])))


def check_metadata(text: bytes) -> None:
    """ValidationError unless a trailer is a JSON object that names format and layout."""
    try:
        own = json.loads(text)
    except ValueError as e:
        raise S.ValidationError("metadata is no JSON") from e
    if not isinstance(own, dict):
        raise S.ValidationError("metadata is no object")
    for k, v in (("format", S.FORMAT_NAME), ("layout", S.LAYOUT_NAME)):
        if own.get(k) != v:
            raise S.ValidationError(f"metadata: {k}")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """name, value lines of a report on a container, after full validation."""
    pos = read(spark, path)
    row = {c.name: F.col(c.name) for c in header_frame(spark, path).schema}
    facts = [(k, str(v)) for k, v in header_frame(spark, path).select(*row.values()).first().asDict().items()]
    n = Container(path).header["num_positions"]
    shares = pos.groupBy("wdl").count().collect()
    facts += [(f"wdl {r.wdl}", f"{r['count']} ({100 * r['count'] / n:.2f}%)") for r in sorted(shares)]
    facts.append(("avg_features", f"{Container(path).header['num_features_total'] / max(n, 1):.2f}"))
    return spark.createDataFrame(facts, "name string, value string")
