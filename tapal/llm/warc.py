"""WARC archives: records are written in segments with chunked transfer framing, read back and put together again."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import SLICE_BYTES, shared_dir, small_batches

#: Bytes of a record's block that one segment takes; longer blocks go on in continuation records.
SEGMENT_BYTES = 1 << 16
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 4096
#: Records of an archive file; with SEGMENT_BYTES this bounds what a task reads at once.
FILE_RECORDS = 1000
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[a : a + CHUNK_BYTES] for a in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if n < 0:
            raise ValueError("a chunk has no size")
        at = end + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(framed[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, row: int) -> str:
    """A record's id: the page's and a number of its row, as page ids may be null or come again."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{row}>"


def records_of(page_id: int | None, row: int, url: str, payload: bytes, kind: str, refers_to: tuple | None, digest: str) -> list[bytes]:
    """The records of one page: a revisit without payload, or a response in as many segments as it needs."""
    own = record_id(page_id, row)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id(*refers_to)), profile, *common], HEAD)]
    block = HEAD + chunked(payload)
    parts = [block[a : a + SEGMENT_BYTES] for a in range(0, len(block), SEGMENT_BYTES)]
    out = []
    for k, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", own if k == 1 else f"{own[:-1]}:{k}>")]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(k)))
        if k > 1:
            fields.append(("WARC-Segment-Origin-ID", own))
        if 1 < k == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record([*fields, *(common if k == 1 else common[:2])], part))
    return out


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(fields, block, broken) of each record of an archive.

    A record that is cut short, or whose length is missing or no number, is broken; reading goes on at the next line
    that begins a record, as it does behind anything that is none. Header bytes that are no UTF-8 are replaced. Where
    the compression itself breaks off, one broken record without fields is the last.
    """
    try:
        line = stream.readline()
        while line:
            if not line.startswith(b"WARC/"):
                line = stream.readline()
                continue
            fields: dict[str, str] = {}
            while (line := stream.readline()).strip() and not line.startswith(b"WARC/"):
                k, _, v = line.decode(errors="replace").partition(":")
                fields.setdefault(k.strip().lower(), v.strip())
            length = fields.get("content-length", "")
            if line.startswith(b"WARC/") or not (length.isascii() and length.isdigit()):
                yield fields, b"", True
                continue
            block = stream.read(int(length))
            yield fields, block, len(block) != int(length)
            line = stream.readline()
    except (EOFError, OSError, zlib.error):
        yield {}, b"", True


def with_kinds(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, row, url, payload, sha1, record_type, first_id, first_row) for each row of pages, row a number of its own.

    Of rows with equal payloads of least_bytes or more the smallest page_id is the response, the others revisit it.
    Payloads are equal if their SHA-1, their SHA-256 and their size are.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    same = [F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha2"), F.octet_length("payload").alias("n")]
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first")
    first = own.select("page_id", "row", *same).groupBy("sha1", "sha2", "n").agg(least)
    both = own.select("*", *same).join(first, ["sha1", "sha2", "n"])
    again = (F.col("n") >= least_bytes) & (F.col("page_id") > F.col("first.page_id"))
    return both.select("page_id", "row", "url", "payload", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.page_id")).alias("first_id"), F.when(again, F.col("first.row")).alias("first_row"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of the pages in the folder path, gzipped files of FILE_RECORDS records at most.

    Spark's text writer takes each record as a line: a record ends with a line feed anyway, which the writer adds.
    """
    needed = ("page_id", "row", "url", "payload", "record_type", "first_id", "first_row")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for page_id, row, url, payload, kind, first_id, first_row in zip(*(batch.column(c).to_pylist() for c in needed)):
                for x in records_of(page_id, row, url, payload, kind, (first_id, first_row), sha1_base32(payload)):
                    held.append(x[:-1])
                    size += len(x)
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    records = with_kinds(pages, least_bytes).mapInArrow(each, "record binary")
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def scan(spark, path: str) -> DataFrame:
    """(record_id, kind, origin, segment, total, refers_to, digest, payload_bytes, block, segmented, broken) for each record of the archives; segmented if it has a segment number.

    Files are gzipped or plain and are read whole, one at a time in a task. Whatever a file holds, no record stops the
    job: broken ones come with broken true, of kind unknown and with a null id if their header does not say.
    """
    names = ["record_id", "kind", "origin", "segment", "total", "refers_to", "digest", "payload_bytes", "block", "segmented", "broken"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                raw = io.BytesIO(content.as_py())
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                for f, block, broken in read_records(gzip.open(raw) if zipped else raw):
                    own = f.get("warc-record-id")
                    numbers = [_number(f.get(k), most) for k, most in (("warc-segment-number", 31), ("warc-segment-total-length", 63), ("x-payload-length", 63))]
                    broken = broken or own is None or "warc-type" not in f or any(n is None for n in numbers)
                    segment, total, length = (None if n is None or n < 0 else n for n in numbers)
                    held.append((own, f.get("warc-type", "unknown"), f.get("warc-segment-origin-id", own), 1 if segment is None else segment, total, f.get("warc-refers-to"), f.get("warc-payload-digest", ""), length, block, "warc-segment-number" in f, broken))
                    size += len(block)
                    if size > SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(each, "record_id string, kind string, origin string, segment int, total long, refers_to string, digest string, payload_bytes long, block binary, segmented boolean, broken boolean")


def _number(text: str | None, bits: int) -> int | None:
    """A header's number; -1 if there is none, None if it is no number of that many bits."""
    if text is None:
        return -1
    return int(text) if text.isascii() and text.isdigit() and len(text) < 20 and int(text) < 1 << bits else None


def transfer_codings(head: bytes) -> list[bytes]:
    """The transfer codings of an HTTP header, in the order in which they were applied."""
    fields = [line.partition(b":") for line in head.split(b"\n")[1:]]
    named = [v for k, _, v in fields if k.strip().lower() == b"transfer-encoding"]
    return [x for v in named for x in (y.split(b";")[0].strip().lower() for y in v.split(b",")) if x and x != b"identity"]


def uncoded(body: bytes, coding: bytes) -> bytes:
    """A body without one transfer coding; ValueError if it is broken or unknown."""
    if coding == b"chunked":
        return unchunked(body)
    if coding in (b"gzip", b"x-gzip", b"deflate"):
        try:
            return zlib.decompress(body, 47)
        except zlib.error as error:
            raise ValueError("a compressed body is broken") from error
    raise ValueError("a transfer coding is unknown")


def payload_of(parts: list[tuple[int, int | None, bytes]], segmented: bool = False) -> bytes:
    """The payload of a record from its segments (number, total, block); ValueError if one is missing or the total length is not met."""
    parts = sorted(parts, key=lambda x: x[0])
    if [k for k, *_ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(x for *_, x in parts)
    if (segmented or len(parts) > 1) and parts[-1][1] != len(block):
        raise ValueError("segments do not add up to the total length")
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    for coding in reversed(transfer_codings(head)):
        body = uncoded(body, coding)
    return body


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, kind, refers_to, digest, payload_bytes, payload, complete) for each record that is no continuation, and for continuations without one.

    Segments meet by their origin's id. A record without a segment number is decoded where it is read, so that only
    segmented ones are sent. complete is false, and payload null, if segments are missing or come twice, if the total
    length, the declared length of the payload or its SHA-1 do not agree, or if the record or the framing is broken. Continuations
    whose first segment is nowhere give one row with their origin's id, of kind continuation.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, [None if broken else [(1, None, b)] for b, broken in zip(batch.column("block").to_pylist(), batch.column("broken").to_pylist())], False)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, [None if any(p["broken"] for p in x) else [(p["segment"], p["total"], p["block"]) for p in x] for x in batch.column("parts").to_pylist()], True)

    schema = "record_id string, kind string, refers_to string, digest string, payload_bytes long, payload binary, complete boolean"
    own = records.withColumn("segmented", ((F.col("kind") == "continuation") | F.col("segmented")) & F.col("origin").isNotNull())
    head = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c)
    groups = own.where("segmented").groupBy("origin").agg(
        head("kind"), head("refers_to"), head("digest"), head("payload_bytes"), F.collect_list(F.struct("segment", "total", "block", "broken")).alias("parts")
    )
    groups = groups.select(F.col("origin").alias("record_id"), F.coalesce("kind", F.lit("continuation")).alias("kind"), "refers_to", "digest", "payload_bytes", "parts")
    plain = own.where("not segmented").select("record_id", "kind", "refers_to", "digest", "payload_bytes", "block", "broken")
    return plain.mapInArrow(single, schema).unionByName(groups.mapInArrow(joined, schema))


def _decoded(batch: pa.RecordBatch, parts: list, segmented: bool) -> pa.RecordBatch:
    names = ["record_id", "kind", "refers_to", "digest", "payload_bytes"]
    payloads: list[bytes | None] = []
    for kind, digest, size, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "digest", "payload_bytes")), parts):
        if x is None:
            payloads.append(None)
            continue
        try:
            payload = b"" if kind == "revisit" else payload_of(x, segmented)
            declared = digest.removeprefix("sha1:") if digest and digest.startswith("sha1:") else None
            if kind == "response" and (declared and sha1_base32(payload) != declared.upper() or size is not None and size != len(payload)):
                payload = None
        except ValueError:
            payload = None
        payloads.append(payload)
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(payloads, pa.binary()), pa.array([p is not None for p in payloads])], names=[*names, "payload", "complete"])


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder, read back: one row for each page.

    A null html is an empty payload, a null page_id comes back null; repeated rows give a record each.
    """
    small_batches(spark)
    path = f"{shared_dir(spark)}/tapal-warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = reassembled(scan(spark, path))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]+):[0-9]+>$', 1), '') as bigint)")
    size = F.when(F.col("kind") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"), "complete")
