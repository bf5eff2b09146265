import hashlib
import struct

import pytest
import zstandard

from posframe.llm import warc
from posframe.llm.common import table


def brute(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = last.get(b) if len(b) >= 1000 and last.get(b) != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    assert got(warc.op7_warc(spark, sf_dir)) == brute(rows)


def test_edges(spark, tmp_path):
    big = "<p>é" * 400
    rows = [(1, "u", big), (5, "v", big), (5, "v", big), (3, None, big), (None, "n", big), (2, "a\r\nb", "x" * 999), (4, "w", "x" * 999), (6, "e", None), (7, "e", ""), (8, "long", "\r\n\r\nWARC/1.1 " * 300000)]
    rows += [(None, "q", "y" * 2000), (None, "q", "y" * 2000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    archives = warc.write(pages, archive_bytes=1 << 12, sample=2)
    assert got(warc.read(archives)) == brute(rows)
    assert warc.to_files(archives, str(tmp_path)) == archives.count() > 1
    assert got(warc.read_files(spark, str(tmp_path))) == brute(rows)
    urls = {r.page_id: r.url for r in warc.read(archives).collect()}
    assert urls[3] is None and urls[2] == "a%0D%0Ab"
    assert warc.read(warc.write(pages.filter("false"))).count() == 0


def archive(records, words=b""):
    lead, compressor = warc.open_archive(words)
    return lead + b"".join(map(compressor.compress, records))


def test_dictionary_frame():
    samples = [b"".join(hashlib.sha1(b"%d" % (k % 40 + j)).digest() for j in range(40)) for k in range(400)]
    words = warc.dictionary(samples, 4096)
    assert words
    data = archive(samples, words)
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE_MAGIC
    assert list(warc.frames(data)) == samples
    plain = struct.pack("<II", warc.SKIPPABLE_MAGIC, len(words)) + words + archive(samples, words)[len(warc.open_archive(words)[0]) :]
    assert list(warc.frames(plain)) == samples


def test_broken_archives():
    record = warc.to_record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None)
    assert warc.parse(record)["payload"] == b"abc"
    whole = archive([record])
    for bad in (b"", whole[:-3], b"\0" + whole[1:], whole[:8] + b"xxxx" + whole[12:], struct.pack("<II", warc.SKIPPABLE_MAGIC, 10**6)):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(bad))
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"abc", b"abd"), (b"Content-Length: 3", b"Content-Length: 4"), (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Date", b"No-Date"), (b"\r\n\r\n", b"\r\n"), (b"sha1:", b"sha1:!"), (b"WARC-Type:", b"WARC-Type")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(record.replace(old, new))
    with pytest.raises(warc.ArchiveError):
        warc.parse(record[:-1])
    revisit = warc.to_record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), 9)
    assert warc.parse(revisit)["refers_to"] == 9 and warc.parse(revisit)["payload_bytes"] == 3
    with pytest.raises(warc.ArchiveError):
        warc.parse(revisit.replace(b"X-Refers-To-Page-Id: 9", b"X-Refers-To-Page-Id: 8"))
    assert zstandard.__version__
