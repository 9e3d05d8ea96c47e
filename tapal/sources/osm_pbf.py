"""OpenStreetMap PBF files as nodes and ways, and back.

The name of a data blob's type ends one blob's header bytes and begins the next, so that Spark's text reader can split a
file there: ranges of one file are read by many tasks, from any store that Spark reads, and memory is bounded by a blob.
Dense ids and coordinates are running sums of the stored differences.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id long, lat double, lon double, tags map<string,string>"
WAYS = "id long, node_ids array<long>, tags map<string,string>"
#: The types of blobs.
HEADER_TYPE, DATA_TYPE = b"OSMHeader", b"OSMData"
#: Where files are split: the first field of a data blob's header.
SPLIT = b"\n" + bytes([len(DATA_TYPE)]) + DATA_TYPE
#: Nodes or ways of a block that is written.
BLOCK_ROWS = 8000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: varints as numbers, everything else as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                n, at = _varint(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value = data[at : at + n]
            if len(value) != n:
                raise ValueError("a field is cut short")
            at += n
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """Packed varints as unsigned numbers, all at once."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    first = np.r_[0, last[:-1] + 1]
    group = np.repeat(np.arange(len(last)), last - first + 1)
    shift = (np.arange(len(b)) - first[group]) * 7
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << shift.astype(np.uint64), first)


def packed_each(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed varints of many messages: all numbers, and where each message's begin, with the end."""
    held = b"".join(parts)
    ends = np.cumsum([0, *map(len, parts)])
    last = np.r_[0, np.cumsum(np.frombuffer(held, np.uint8) < 128)]
    if any(x and x[-1] > 127 for x in parts):
        raise ValueError("a field is cut short")
    return packed(held), last[ends]


def signed(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def one(message: dict[int, list], number: int, default):
    return message[number][-1] if number in message else default


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def unpacked(body: bytes) -> bytes:
    """What a blob holds."""
    blob = message(body)
    if 1 in blob:
        return blob[1][-1]
    if 3 in blob:
        return zlib.decompress(blob[3][-1])
    raise ValueError("a blob is compressed by LZMA" if 4 in blob else "a blob is neither raw nor zlib")


def blocks(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """The decoded data blocks of a file that is one stream; header blocks are left out, other types are an error."""
    while head := stream.read(4):
        if len(head) < 4:
            raise ValueError("a blob's length is cut short")
        size = struct.unpack(">I", head)[0]
        held = stream.read(size)
        if len(held) != size:
            raise ValueError("a blob's header is cut short")
        header = message(held)
        if 1 not in header or 3 not in header:
            raise ValueError("a blob's header has no type or no size")
        body = stream.read(header[3][-1])
        if len(body) != header[3][-1]:
            raise ValueError("a blob is cut short")
        kind = header[1][-1]
        if kind == DATA_TYPE:
            yield unpacked(body)
        elif kind != HEADER_TYPE:
            raise ValueError(f"a blob of the type {kind!r}")


def _ends_with_length(piece: bytes) -> bool:
    """Whether whole blobs and then four bytes make up the piece."""
    at = 0
    while len(piece) - at > 4:
        size = struct.unpack(">I", piece[at : at + 4])[0]
        at += 4 + size + one(message(piece[at + 4 : at + 4 + size]), 3, 0)
    return len(piece) - at == 4


def block_of(piece: bytes) -> bytes | None:
    """The decoded block of what stands between two SPLITs of a file; None for what stands before the first.

    That is the rest of a blob's header, the blob, and the length of the next header. Anything else is an error, so
    that a piece that is cut inside a blob cannot pass; read such a file with whole=True. Only a file that is cut right
    behind a header's length reads as if it ended there.
    """
    if piece[:1] == b"\0":  # no field begins like this, but a header's length does
        if list(blocks(io.BytesIO(piece[: len(piece) - 4] if _ends_with_length(piece) else piece))):
            raise ValueError("a data blob before the first split")
        return None
    at = 0
    while at < len(piece):
        key, at = _varint(piece, at)
        n, at = _varint(piece, at)
        if key >> 3 == 3:
            break
        at += n if key & 7 == 2 else 0
    else:
        raise ValueError("a blob's header has no size")
    if len(piece) - at - n not in (0, 4):
        raise ValueError("a blob of another type or size than its header says, or its type's name inside it")
    return unpacked(piece[at : at + n])


def _tags(keys: np.ndarray, values: np.ndarray, strings: list[str]) -> list[tuple[str, str]]:
    return list({strings[k]: strings[v] for k, v in zip(keys.tolist(), values.tolist())}.items())


def way_parts(way: bytes) -> tuple[int, bytes, bytes, bytes]:
    """A way's id and its packed keys, values and steps between nodes."""
    i, parts = None, {2: b"", 3: b"", 8: b""}
    at, size = 0, len(way)
    while at < size:
        key = way[at]
        if key == 8:
            i, at = _varint(way, at + 1)
        elif key in (18, 26, 66):
            n = way[at + 1]
            n, at = (n, at + 2) if n < 128 else _varint(way, at + 1)
            value = way[at : at + n]
            if len(value) != n:
                raise ValueError("a field is cut short")
            parts[key >> 3] = value
            at += n
        else:  # another field, or one in another form
            found = message(way)
            i, parts = one(found, 1, None), {k: one(found, k, b"") for k in parts}
            break
    if i is None:
        raise ValueError("a way without id")
    return i, parts[2], parts[3], parts[8]


def way_arrays(ways: list[bytes], strings: list[str]) -> list[pa.Array]:
    """Ids, node ids and tags of a block's ways, the numbers of all of them unpacked at once."""
    ids, keys, values, steps = ([], [], [], []) if not ways else map(list, zip(*map(way_parts, ways)))
    moved, at = packed_each(steps)
    sums = np.r_[0, np.cumsum(signed(moved))]
    nodes = sums[1:] - np.repeat(sums[at[:-1]], np.diff(at))
    k, k_at = packed_each(keys)
    v, v_at = packed_each(values)
    first: dict[str, int] = {}
    same = np.array([first.setdefault(x, i) for i, x in enumerate(strings)] or [0])
    plain = (k_at == v_at).all() and (not len(k) or max(k.max(), v.max()) < len(strings))
    if plain:
        owner = np.repeat(np.arange(len(ways)), np.diff(k_at))
        plain = len(np.unique(owner * len(same) + same[k.astype(np.int64)])) == len(k)
    if plain:
        text = pa.array(strings, pa.string())
        tags = pa.MapArray.from_arrays(pa.array(k_at, pa.int32()), text.take(pa.array(k.astype(np.int64))), text.take(pa.array(v.astype(np.int64))))
    else:  # a key twice, or as many keys as values are not
        tags = pa.array([_tags(packed(x), packed(y), strings) for x, y in zip(keys, values)], pa.map_(pa.string(), pa.string()))
    return [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(nodes, pa.int64())), tags]


def decode_block(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(nodes, ways) of a block as (id, lat, lon, tags) and (id, node ids, tags)."""
    return nodes_of(data), list(zip(*(x.to_pylist() for x in ways_of(data))))


def _strings(block: dict[int, list]) -> list[str]:
    return [s.decode("utf-8", "replace") for s in message(block[1][-1]).get(1, [])] if 1 in block else [""]


def ways_of(data: bytes) -> list[pa.Array]:
    """The ways of a block as columns of WAYS."""
    block = message(data)
    return way_arrays([way for group in block.get(2, []) for way in message(group).get(3, [])], _strings(block))


def nodes_of(data: bytes) -> list[tuple]:
    """The nodes of a block as (id, lat, lon, tags)."""
    block = message(data)
    strings = _strings(block)
    grain, lat0, lon0 = one(block, 17, 100), unzigzag(one(block, 19, 0)), unzigzag(one(block, 20, 0))
    place = lambda base, v: 1e-9 * (base + grain * v)
    nodes = []
    for group in map(message, block.get(2, [])):
        for node in map(message, group.get(1, [])):
            if not {1, 8, 9} <= node.keys():
                raise ValueError("a node without id or place")
            i, lat, lon = (unzigzag(node[n][-1]) for n in (1, 8, 9))
            nodes.append((i, place(lat0, lat), place(lon0, lon), _tags(packed(one(node, 2, b"")), packed(one(node, 3, b"")), strings)))
        for dense in map(message, group.get(2, [])):
            ids, lats, lons = (np.cumsum(signed(packed(one(dense, n, b"")))) for n in (1, 8, 9))
            mixed = packed(one(dense, 10, b"")).tolist()
            at = 0
            for i, lat, lon in zip(ids.tolist(), lats.tolist(), lons.tolist()):
                tags = {}
                while at < len(mixed) and mixed[at]:
                    tags[strings[mixed[at]]] = strings[mixed[at + 1]]
                    at += 2
                at += 1
                nodes.append((i, place(lat0, lat), place(lon0, lon), list(tags.items())))
    return nodes


def read(spark: SparkSession, path: str, kind: str, whole: bool = False) -> DataFrame:
    """The nodes or the ways of PBF files, in ranges of spark.sql.files.maxPartitionBytes.

    With whole a file is one row of one task, 2 GB at most: for files whose data blobs hold the bytes of SPLIT or whose
    headers have their fields in another order, which are an error otherwise.
    """
    tags = pa.map_(pa.string(), pa.string())
    if kind == "nodes":
        schema, types, names = NODES, [pa.int64(), pa.float64(), pa.float64(), tags], ["id", "lat", "lon", "tags"]
    else:
        schema, types, names = WAYS, None, ["id", "node_ids", "tags"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = content.as_py()
                for data in blocks(io.BytesIO(held)) if whole else filter(None, [block_of(held)]):
                    if kind == "ways":
                        columns = ways_of(data)
                    else:
                        columns = [pa.array(x, t) for x, t in zip(zip(*nodes_of(data)), types)]
                    if columns and len(columns[0]):
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    if whole:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, schema)
    return spark.read.option("lineSep", SPLIT.decode()).text(path).select(F.col("value").cast("binary")).mapInArrow(each, schema)


def varint_of(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field_of(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint_of(number << 3) + varint_of(value)
    return varint_of(number << 3 | 2) + varint_of(len(value)) + value


def differences(values: list[int]) -> bytes:
    """Packed zigzag differences of values."""
    steps = np.diff(np.array(values, dtype=np.int64), prepend=0)
    return b"".join(map(varint_of, ((steps << 1) ^ (steps >> 63)).view(np.uint64).tolist()))


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The varints of unsigned numbers one after the other, and where each begins, with the end."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(at[-1], dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[:-1][some] + k] = (values[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | ((size[some] > k + 1) * np.uint8(128))
    return out.tobytes(), at


def encode_ways(batch: pa.RecordBatch) -> bytes:
    """encode_block() of ways, the steps of all of them packed at once."""
    ids, lists, tags = (batch.column(c) for c in ("id", "node_ids", "tags"))
    if lists.null_count or lists.flatten().null_count:
        return encode_block(batch.to_pylist(), "ways")
    nodes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    steps = np.diff(nodes, prepend=0)
    starts = at[:-1][np.diff(at) > 0]
    steps[starts] = nodes[starts]
    held, edges = varints(((steps << 1) ^ (steps >> 63)).view(np.uint64))
    edges = edges[at].tolist()
    codes = {"": b"\0"}

    def place(text: str | None) -> bytes:
        code = codes.get(text or "")
        if code is None:
            code = codes[text] = varint_of(len(codes))
        return code

    ways = []
    for i, (own, pairs) in enumerate(zip(ids.to_pylist(), tags.to_pylist())):
        placed = [(place(k), place(v)) for k, v in pairs or []]
        ways.append(field_of(3, field_of(1, own) + field_of(2, b"".join([k for k, _ in placed])) + field_of(3, b"".join([v for _, v in placed])) + field_of(8, held[edges[i] : edges[i + 1]])))
    return field_of(1, b"".join(field_of(1, s.encode()) for s in codes)) + field_of(2, b"".join(ways))


def framed(kind: bytes, block: bytes) -> bytes:
    """A blob with its header, without its last byte, which is a line feed: an extra field that readers pass over ends it."""
    body = field_of(2, len(block)) + field_of(3, zlib.compress(block)) + field_of(15, 10)
    header = field_of(1, kind) + field_of(3, len(body))
    return (struct.pack(">I", len(header)) + header + body)[:-1]


def encode_block(rows: list[dict], kind: str) -> bytes:
    """A block of nodes (dense) or ways; null tags are none, coordinates are in 1e-7 degrees."""
    strings: dict[str, int] = {"": 0}
    place = lambda s: strings.setdefault(s or "", len(strings))
    tagged = [[(place(k), place(v)) for k, v in row["tags"] or []] for row in rows]
    if kind == "nodes":
        mixed = b"".join(varint_of(x) for tags in tagged for x in (*(y for pair in tags for y in pair), 0))
        group = field_of(2, b"".join(field_of(n, differences(v)) for n, v in ((1, [r["id"] for r in rows]), (8, [round(r["lat"] * 1e7) for r in rows]), (9, [round(r["lon"] * 1e7) for r in rows]))) + field_of(10, mixed))
    else:
        packs = lambda ids: b"".join(map(varint_of, ids))
        group = b"".join(field_of(3, field_of(1, r["id"]) + field_of(2, packs(k for k, _ in tags)) + field_of(3, packs(v for _, v in tags)) + field_of(8, differences(r["node_ids"]))) for r, tags in zip(rows, tagged))
    return field_of(1, b"".join(field_of(1, s.encode()) for s in strings)) + field_of(2, group)


def write(df: DataFrame, path: str, kind: str) -> None:
    """Nodes or ways (columns of NODES or WAYS) added to a folder as PBF files, one of each partition.

    Spark's text writer ends each blob with the line feed that is its last byte. A key of tags is not empty.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = field_of(4, b"OsmSchema-V0.6") + field_of(4, b"DenseNodes")
        out = [framed(HEADER_TYPE, features)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                out.append(framed(DATA_TYPE, encode_ways(part) if kind == "ways" else encode_block(part.to_pylist(), kind)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["blob"])
            out = []

    columns = ["id", "lat", "lon", "tags"] if kind == "nodes" else ["id", "node_ids", "tags"]
    df.select(*columns).mapInArrow(each, "blob binary").select(F.col("blob").cast("string")).write.mode("append").option("lineSep", "\n").text(path)


def landmarks(nodes: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """(id, lat, lon, name, category, address): nodes in the box with an amenity, a place or an address."""
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    address = F.map_filter("tags", lambda k, v: k.startswith("addr:"))
    return nodes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).where(tag("amenity").isNotNull() | tag("place").isNotNull() | (F.size(address) > 0)).select("id", "lat", "lon", tag("name").alias("name"), F.coalesce(tag("amenity"), tag("place")).alias("category"), address.alias("address"))


def streets(ways: DataFrame) -> DataFrame:
    """(way_id, name, highway, node_ids): ways with a highway or an address and at least one node."""
    address = F.map_filter("tags", lambda k, v: k.startswith("addr:"))
    return ways.where(((F.coalesce(F.col("tags")["highway"], F.lit("")) != "") | (F.size(address) > 0)) & (F.size("node_ids") > 0)).select(F.col("id").alias("way_id"), F.col("tags")["name"].alias("name"), F.col("tags")["highway"].alias("highway"), "node_ids")
