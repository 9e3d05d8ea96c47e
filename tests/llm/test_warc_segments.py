"""Archives that the writer here would not make: small segments, lost and repeated ones, other kinds of records."""

import gzip
import os
import tempfile

import pytest

from tapal.llm import warc


def archive(records: list[bytes], zipped: bool = True) -> str:
    path = tempfile.mkdtemp()
    with (gzip.open if zipped else open)(f"{path}/a.warc{'.gz' if zipped else ''}", "wb") as f:
        f.write(b"".join(records))
    return path


def read(spark, records, zipped=True):
    return {r.record_id: (r.kind, r.complete, None if r.payload is None else bytes(r.payload)) for r in warc.reassembled(warc.scan(spark, archive(records, zipped))).collect()}


def segments(page_id, payload, size, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(warc, "SEGMENT_BYTES", size)
        return warc.records_of(page_id, 0, "u", payload, "response", None, warc.sha1_base32(payload))


@pytest.mark.parametrize("zipped", [True, False])
def test_small_segments(spark, monkeypatch, zipped):
    """Records in segments far below 64 KB are put together, as the segment number says, in any order."""
    one, two = segments(1, b"abc" * 100, 128, monkeypatch), segments(2, b"short", 128, monkeypatch)
    assert len(one) > 3
    got = read(spark, [*one[::-1], *two], zipped)
    assert got == {"<urn:page:1:0>": ("response", True, b"abc" * 100), "<urn:page:2:0>": ("response", True, b"short")}


def test_lost_segments(spark, monkeypatch):
    """Each lost or repeated segment makes its record incomplete; none vanishes."""
    parts = [segments(k, bytes([65 + k]) * 300, 128, monkeypatch) for k in range(5)]
    got = read(spark, [*parts[0][1:], *parts[1][:1], *parts[2][:-1], *parts[3], parts[3][1], *parts[4]])
    own = lambda k: f"<urn:page:{k}:0>"
    assert got == {own(0): ("continuation", False, None), own(1): ("response", False, None), own(2): ("response", False, None), own(3): ("response", False, None), own(4): ("response", True, b"E" * 300)}


def test_declared_lengths_and_kinds(spark):
    """A wrong total or digest is told; blocks that are not HTTP are payloads themselves; other digests are not checked."""
    make = lambda kind, name, block, *more: warc.record([("WARC-Type", kind), ("WARC-Record-ID", name), *more], block)
    cut = [make("response", "<a>", b"HTTP/1.1 200 OK\r\n\r\nhel", ("WARC-Segment-Number", "1")), make("continuation", "<a2>", b"lo", ("WARC-Segment-Number", "2"), ("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Total-Length", "99"))]
    whole = [make("response", "<b>", b"HTTP/1.1 200 OK\r\n\r\nhel", ("WARC-Segment-Number", "1")), make("continuation", "<b2>", b"lo", ("WARC-Segment-Number", "2"), ("WARC-Segment-Origin-ID", "<b>"), ("WARC-Segment-Total-Length", "24"))]
    others = [make("warcinfo", "<c>", b"a: b\r\n\r\nc"), make("response", "<d>", b"HTTP/1.1 200 OK\r\n\r\nx", ("WARC-Payload-Digest", "sha256:abc")), make("response", "<e>", b"HTTP/1.1 200 OK\r\n\r\nx", ("WARC-Payload-Digest", "sha1:WRONG"))]
    others.append(make("response", "<f>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n-1\r\n\r\n"))
    got = read(spark, [*cut, *whole, *others])
    assert got == {"<a>": ("response", False, None), "<b>": ("response", True, b"hello"), "<c>": ("warcinfo", True, b"a: b\r\n\r\nc"), "<d>": ("response", True, b"x"), "<e>": ("response", False, None), "<f>": ("response", False, None)}


def test_empty_table(spark):
    path = f"{tempfile.mkdtemp()}/none"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    os.makedirs(path, exist_ok=True)
    assert warc.reassembled(warc.scan(spark, path)).count() == 0


def made(kind, name, block, *more):
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", name), *more], block)


GOOD = made("response", "<good>", b"HTTP/1.1 200 OK\r\n\r\nfine")


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize(
    "bad,expected",
    [
        (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\nX: \xff\xfe\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n", {"<bad>": ("response", True, b"abc")}),
        (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\n\r\nno length\r\n\r\n", {"<bad>": ("response", False, None)}),
        (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\nContent-Length: many\r\n\r\nx\r\n\r\n", {"<bad>": ("response", False, None)}),
        (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\nContent-Length: -5\r\n\r\nx\r\n\r\n", {"<bad>": ("response", False, None)}),
        (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <bad>\r\n", {"<bad>": ("response", False, None)}),
        (b"noise before\r\nmore noise\r\n", {}),
        (b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", {None: ("unknown", False, None)}),
        (made("response", "<bad>", b"HTTP/1.1 200 OK\r\n\r\nx", ("WARC-Segment-Number", "one")), {"<bad>": ("response", False, None)}),
        (made("response", "<bad>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding:chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"), {"<bad>": ("response", True, b"abc")}),
        (made("response", "<bad>", b"HTTP/1.1 200 OK\r\ntransfer-encoding:  gzip , Chunked\r\n\r\n" + warc.chunked(gzip.compress(b"packed"))), {"<bad>": ("response", True, b"packed")}),
        (made("response", "<bad>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: br, chunked\r\n\r\n0\r\n\r\n"), {"<bad>": ("response", False, None)}),
        (made("response", "<bad>", b"HTTP/1.1 200 OK\r\nX-Note: transfer-encoding: chunked\r\n\r\nplain"), {"<bad>": ("response", True, b"plain")}),
    ],
)
def test_no_record_stops_the_job(spark, bad, expected, zipped):
    """Broken and foreign records are rows, and the records around them are read."""
    assert read(spark, [GOOD, bad, GOOD.replace(b"<good>", b"<next>")], zipped) == {"<good>": ("response", True, b"fine"), "<next>": ("response", True, b"fine"), **expected}


def test_cut_archives(spark):
    """A record or a compressed stream that breaks off gives a broken row behind the whole ones."""
    cut = GOOD.replace(b"<good>", b"<cut>")[:-9]
    assert read(spark, [GOOD, cut], False) == {"<good>": ("response", True, b"fine"), "<cut>": ("response", False, None)}
    path = archive([])
    with open(f"{path}/a.warc.gz", "wb") as f:
        f.write(gzip.compress(GOOD) + gzip.compress(made("response", "<lost>", os.urandom(5000)))[:-900])
    got = [(r.record_id, r.complete) for r in warc.reassembled(warc.scan(spark, path)).collect()]
    assert ("<good>", True) in got and all(not c for i, c in got if i != "<good>") and len(got) >= 2
