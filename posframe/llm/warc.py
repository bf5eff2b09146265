"""WARC archives in Zstandard with a dictionary, written and read.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; then each record is one frame, compressed
with that dictionary and with its content size and checksum. An archive is a
row (archive, data) of a Parquet table, of bounded size, so that Spark alone
reads and writes it, on whatever store; `to_files` and `read_files` exchange
the same bytes with .warc.zst files.

Of pages with equal payloads of at least `revisit_bytes` bytes, the one with the
largest id is a response record and the others are revisit records, which have
the HTTP headers only and refer to the response; all shorter ones are responses.

Nulls and ties: a null payload is empty. A null id takes no part in the choice
of the response but refers to it like others; if all ids of a group are null,
all are responses. Rows that repeat the response's id and payload are responses
too. A null url is written without a target. An empty table gives no archives.
Other columns are not read. Reading checks the magic numbers, that each frame
holds one whole record, the version line, the named fields that a record needs,
Content-Length against the block, the HTTP length and the payload's digest; what
fails is raised as ArchiveError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm.common import stored, table

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_IDS = uuid.UUID("6f1dd2b4-6b6d-4c53-9d0f-0a4a3f0c7a11")
FIELDS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, str(page_id))}>"


def to_record(page_id, url, payload: bytes, digest: bytes, refers_to) -> bytes:
    """One WARC record. A revisit has no payload, but its length in the HTTP header."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []),
        *([("X-Page-Id", page_id)] if page_id is not None else []),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", refers_to)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; without enough of them, none (empty)."""
    import zstandard

    if len(samples) < 16 or sum(map(len, samples)) < 16 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=3, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def open_archive(words: bytes) -> tuple[bytes, object]:
    """The leading frame for a dictionary, and the compressor of the records."""
    import zstandard

    packed = zstandard.ZstdCompressor(level=3).compress(words) if words else b""
    trained = zstandard.ZstdCompressionDict(words) if words else None
    return struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed, zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each record's frame of an archive."""
    import zstandard

    if len(data) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ArchiveError(f"the leading frame has magic {magic:#x}")
    if 8 + size > len(data):
        raise ArchiveError("the dictionary is cut off")
    packed = data[8 : 8 + size]
    trained = None
    if packed:
        words = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == ZSTD_MAGIC else packed
        trained = zstandard.ZstdCompressionDict(words)
    reader = zstandard.ZstdDecompressor(dict_data=trained)
    view, at = memoryview(data), 8 + size
    while at < len(data):
        if view[at : at + 4] != ZSTD_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        one = reader.decompressobj()
        try:
            made = [one.decompress(view[at : at + (1 << 16)])]
            fed = min(len(data), at + (1 << 16))
            while not one.eof and fed < len(data):
                made.append(one.decompress(view[fed : fed + (1 << 20)]))
                fed = min(len(data), fed + (1 << 20))
        except zstandard.ZstdError as e:
            raise ArchiveError(f"bad frame at byte {at}: {e}") from e
        if not one.eof:
            raise ArchiveError(f"the frame at byte {at} is cut off")
        at = fed - len(one.unused_data)
        yield b"".join(made)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line {line[:60]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def _length(fields: dict[str, str]) -> int:
    if not (text := fields.get("content-length", "")).isdigit():
        raise ArchiveError("no valid Content-Length")
    return int(text)


def parse(record: bytes) -> dict:
    """The fields FIELDS of a record; ArchiveError, if it isn't whole or doesn't agree with itself."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ArchiveError(f"no record: {record[:40]!r}")
    fields = _fields(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest"} - fields.keys():
        raise ArchiveError(f"fields are missing: {sorted(missing)}")
    size = _length(fields)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"the block has {len(rest) - 4} bytes, not {size}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("the block has no HTTP header")
    length = _length(_fields(http.split(b"\r\n")[1:]))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    try:
        digest = base64.b32decode(digest)
    except ValueError as e:
        raise ArchiveError(f"bad digest {digest!r}") from e
    page = fields.get("x-page-id")
    out = {"page_id": None if page is None else int(page), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": None, "payload_bytes": length, "payload_digest": digest.hex(), "payload": None}
    if kind == "response":
        if len(payload) != length or hashlib.sha1(payload).digest() != digest:
            raise ArchiveError(f"the payload of {fields['warc-record-id']} doesn't agree with its length or digest")
        return out | {"payload": payload}
    if kind != "revisit" or payload or "warc-refers-to" not in fields or "x-refers-to-page-id" not in fields:
        raise ArchiveError(f"bad record of type {kind!r}")
    out["refers_to"] = int(fields["x-refers-to-page-id"])
    if record_id(out["refers_to"]) != fields["warc-refers-to"]:
        raise ArchiveError("a revisit refers to another record than it names")
    return out


def revisits(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another. Ids and
    digests alone are shuffled, and combined by digest before that."""
    own = pages.filter(F.length("payload") >= revisit_bytes).select("page_id", F.unhex(F.sha1("payload")).alias("digest"))
    groups = own.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 and refers_to is not null").drop("n")
    return own.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000, archive_bytes: int = 32 << 20, sample: int = 256, dictionary_bytes: int = 16 << 10) -> DataFrame:
    """The archives (archive, data) of the pages. A dictionary is trained, for each
    archive, on its first `sample` payloads (their first 16 KiB)."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.unhex(F.sha1("payload")))
    repeats = stored(revisits(own, revisit_bytes))
    if not repeats.isEmpty():
        again = repeats.withColumnRenamed("page_id", "__p").withColumnRenamed("digest", "__d")
        own = own.join(again, own.page_id.eqNullSafe(again["__p"]) & (own.digest == again["__d"]), "left").drop("__p", "__d")
    else:
        own = own.withColumn("refers_to", F.lit(None).cast("long"))

    def run(it):
        part, made = TaskContext.get().partitionId(), 0
        waiting, out, size, compressor = [], None, 0, None

        def row():
            nonlocal made
            name = f"{part:06d}-{made:06d}.warc.zst"
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], names=["archive", "data"])

        def begin():
            nonlocal out, size, compressor, waiting
            lead, compressor = open_archive(dictionary([r[2][: 16 << 10] for r in waiting if r[2]], dictionary_bytes))
            out, size = [lead], len(lead)
            for r in waiting:
                put(r)
            waiting = []

        def put(r):
            nonlocal size
            out.append(compressor.compress(to_record(*r)))
            size += len(out[-1])

        for batch in it:
            for r in zip(*(batch.column(i) for i in range(5)), strict=True):
                r = tuple(x.as_py() for x in r)
                if out is None:
                    waiting.append(r)
                    if len(waiting) >= sample:
                        begin()
                else:
                    put(r)
                if out is not None and size >= archive_bytes:
                    yield row()
                    out = None
        if waiting:
            begin()
        if out is not None:
            yield row()

    return own.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, data binary")


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(archives: DataFrame, data: str = "data") -> DataFrame:
    """The records of archives, with the columns FIELDS (a revisit's payload is null)."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(it):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], k) for f, k in zip(FIELDS, kinds, strict=True)], names=FIELDS)

        for b in it:
            for x in b.column(0):
                rows, size = [], 0
                for record in frames(x.as_py()):
                    rows.append(parse(record))
                    size += len(record)
                    if size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return archives.select(data).mapInArrow(run, SCHEMA)


def read_files(spark, path: str) -> DataFrame:
    """The records of .warc.zst files; each must fit into a task's memory."""
    return read(spark.read.format("binaryFile").load(path), "content")


def to_files(archives: DataFrame, folder: str) -> int:
    """Writes each archive as a file into a folder that all executors have mounted."""

    def run(it):
        import os

        for batch in it:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with open(os.path.join(folder, f".{name}.part"), "wb") as f:
                    f.write(data.as_py())
                os.replace(f.name, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return archives.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def op7_warc(spark, sf_dir) -> DataFrame:
    # binary data is compressed already
    archives = stored(write(table(spark, sf_dir, "pages")), codec="none")
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
     d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM g
"""
