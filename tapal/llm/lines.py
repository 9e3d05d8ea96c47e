"""Line dedup by content-defined chunks of lines: of every run of lines that comes again, whatever its place, the first one stays.

Line hashes choose where chunks begin, so that boundaries move with the content and any run of MIN_LINES lines holds
one that the run alone decides. Chunks whose first line comes again are extended to either side line by line, with a
rolling hash over the line hashes; extensions that come again are compared by bytes, and together they cover the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import binary, cut, slices, small_batches, text_key

#: Lines that a run has at least.
MIN_LINES = 2
#: Factor of the rolling hash, and what tells an extension to the left from one to the right.
FACTOR, LEFT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1


def boundaries(lines: list[bytes]) -> tuple[list[int], list[bool], list[bool]]:
    """Hashes of the lines, which of them have words, and which begin a chunk.

    A line with words begins a chunk if its hash is not above that of a neighbour; a line of white space is above all
    others. Of two neighbours that have words between them at least one begins a chunk, and nothing else decides it,
    so that a line put in or taken out moves no boundary but those next to it. About two lines of three begin one:
    a run of two lines leaves no room for longer chunks that are whole within it.
    """
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    full = [bool(x.strip()) for x in lines]
    order = [h if f else MASK + 1 for h, f in zip(hashes, full)]
    begins = [f and ((i > 0 and order[i - 1] >= order[i]) or (i + 1 < len(order) and order[i + 1] >= order[i])) for i, f in enumerate(full)]
    return hashes, full, begins


def chunks_of(text: bytes) -> list[list[bytes]]:
    """The chunks of a text, as lists of lines."""
    lines = text.split(b"\n")
    starts = [i for i, x in enumerate(boundaries(lines)[2]) if x and i]
    return [lines[a:b] for a, b in zip([0, *starts], [*starts, len(lines)])]


def extensions(lines: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(start, end, first, side): the least runs about chunks' first lines that may go, in order of the two hashes' owners.

    first is the hash of the line that begins a chunk, side the rolling hash of the lines by which the run goes on to
    one side. A line is in a run that comes again, of MIN_LINES lines or more and not of white space alone, if and
    only if it is in such an extension. Each pair of neighbours with words between them is one, of the line with the
    lesser hash; a line of white space further away from the nearest lines with words is in those from either of them.
    """
    hashes, full, begins = boundaries(lines)
    out = []
    for i in range(len(lines) - 1):
        right = begins[i] and (not begins[i + 1] or hashes[i] <= hashes[i + 1])
        if right:
            out.append((i, i + 2, hashes[i], hashes[i + 1]))
        elif begins[i + 1]:
            out.append((i, i + 2, hashes[i + 1], hashes[i] ^ LEFT))
    for step in (1, -1):
        at, roll = None, 0
        for i in range(len(lines)) if step > 0 else range(len(lines) - 1, -1, -1):
            if full[i]:
                at, roll = i, 0
            elif at is not None:
                roll = (roll * FACTOR + hashes[i]) & MASK
                if abs(i - at) > 1:
                    out.append((at, i + 1, hashes[at], roll) if step > 0 else (i, at + 1, hashes[at], roll ^ LEFT))
    return out


def chunk_table(docs: DataFrame) -> DataFrame:
    """(first, known, places): for each first line of chunks of the texts that a task has at once, its extensions.

    A place is (_id, _th, at, end, side). known: the same bytes stand earlier among these texts, so the lines go
    whatever else there is. Only the first of them has to be compared with other tasks', and a first line has one row
    for all its places here, so that no hash is in many rows.
    """
    kinds = {"_id": pa.int64(), "_th": pa.int64(), "at": pa.int32(), "end": pa.int32(), "side": pa.int64()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                earliest: dict[tuple, tuple] = {}
                texts = {}
                for i, th, text in zip(part.column("_id").to_pylist(), part.column("_th").to_pylist(), binary(part.column("text")).to_pylist()):
                    if b"\n" not in text:
                        continue
                    lines = texts[i, th] = text.split(b"\n")
                    for a, b, first, side in extensions(lines):
                        rows.append((first, side, i, th, a, b))
                        old = earliest.get((first, side))
                        if old is None or (i, th, a, b) < old:
                            earliest[first, side] = (i, th, a, b)
                if not rows:
                    continue
                known = []
                for first, side, i, th, a, b in rows:
                    k, kh, at, end = earliest[first, side]
                    known.append((i, th, a) > (k, kh, at) and texts[i, th][a:b] == texts[k, kh][at:end])
                hashes = np.array([r[:2] for r in rows], dtype=np.uint64).view(np.int64)
                order = np.lexsort((hashes[:, 0], known))
                key, told = hashes[order, 0], np.array(known)[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (told[1:] != told[:-1])]))
                rest = np.array([r[2:] for r in rows], dtype=np.int64)[order]
                values = [pa.array(x).cast(t) for x, t in zip([*rest.T, hashes[order, 1]], kinds.values())]
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)).astype(np.int32)), pa.StructArray.from_arrays(values, names=list(kinds)))
                for at in range(0, len(new), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[new[at : at + 10_000]]), pa.array(told[new[at : at + 10_000]]), places.slice(at, 10_000)], names=["first", "known", "places"])

    return docs.select(*text_key(), F.col("text").cast("string").alias("text")).mapInArrow(each, "first long, known boolean, places array<struct<_id: long, _th: long, at: int, end: int, side: long>>")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(_row, text, _id, _th): each row of docs, its other columns in _row."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), F.col("text").cast("string").alias("text"), *text_key())


def unit_bytes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(_id, _th, at, end, h0, h1, chunk) for each row of places (all but chunk), with the bytes of its lines.

    The join takes the same columns as that of rewritten, so that Spark sends the texts once for both.
    """
    found = places.groupBy("_id", "_th").agg(F.collect_set(F.struct("at", "end", "h0", "h1")).alias("units"))
    texts = keyed_texts(docs).join(found, ["_id", "_th"])
    names = ["_id", "_th", "at", "end", "h0", "h1", "chunk"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for i, th, text, units in zip(part.column("_id").to_pylist(), part.column("_th").to_pylist(), binary(part.column("text")).to_pylist(), part.column("units").to_pylist()):
                    lines = text.split(b"\n")
                    rows = [(i, th, u["at"], u["end"], u["h0"], u["h1"], b"\n".join(lines[u["at"] : u["end"]])) for u in units]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return texts.mapInArrow(each, "_id long, _th long, at int, end int, h0 long, h1 long, chunk binary")


def repeated(docs: DataFrame) -> DataFrame:
    """(_id, _th, gone): for each text with lines to remove, their places (at, end).

    Only chunks whose first line comes more than once are extended, and only extensions whose hashes come more than
    once have their bytes sent; they are grouped by these bytes, which is the byte comparison. The first place in
    order of (doc_id, text hash, place) stays.
    """
    chunks = cut(chunk_table(docs))
    own = chunks.where(~F.col("known")).drop("known")
    firsts = own.groupBy("first").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("first")
    place = F.explode("places").alias("p")
    near = cut(own.join(firsts, "first", "left_semi").select("first", place).select("p._id", "p._th", "p.at", "p.end", F.col("first").alias("h0"), F.col("p.side").alias("h1")))
    twice = near.groupBy("h0", "h1").count().where("count > 1").select("h0", "h1")
    again = cut(near.join(twice, ["h0", "h1"], "left_semi"))
    # A hash that stands for two different runs has two rows here, each with its own first place.
    texts = unit_bytes(docs, again).groupBy("h0", "h1", "chunk").agg(F.min(F.struct("_id", "_th", "at")).alias("keep"))
    first = texts.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("texts"), F.first("keep").alias("keep")).where("texts = 1")
    gone = again.join(first, ["h0", "h1"]).where(F.struct("_id", "_th", "at") != F.col("keep")).select("_id", "_th", "at", "end")
    gone = gone.unionByName(chunks.where("known").select(place).select("p._id", "p._th", "p.at", "p.end"))
    return gone.groupBy("_id", "_th").agg(F.collect_set(F.struct("at", "end")).alias("gone"))


def without(lines: list[bytes], units: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The lines outside the units, and the number of unbroken runs of lines that go."""
    lost = bytearray(len(lines))
    for a, b in units:
        lost[a:b] = b"\1" * (b - a)
    return [x for x, gone in zip(lines, lost) if not gone], len([x for x in bytes(lost).split(b"\0") if x])


def rewritten(docs: DataFrame) -> DataFrame:
    """(_row, _text, _lines, _lines_gone, _chunks_gone): the other columns of each row of docs, its text without repeated runs of lines, and counts.

    A line goes if it is in a run of MIN_LINES lines or more, not of white space alone, that comes earlier, in order
    of doc_id (null first), then of a hash of the text, then of place; so the first of equal lines always stays. Null
    and empty texts and texts of one line are left as they are. A text whose lines all go becomes empty. Rows with
    equal doc_id and text are the same document and are treated alike. Other columns are kept.
    """
    gone = repeated(docs)
    joined = keyed_texts(docs).join(gone, ["_id", "_th"], "left").select("_row", "text", "gone")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, counts = [], [[], [], []]
                for text, out, lost in zip(binary(part.column("text")).to_pylist(), part.column("gone").to_pylist(), part.column("text").is_null().to_pylist()):
                    n = text.count(b"\n") + 1 if text else 0
                    lines = runs = 0
                    if out:
                        kept, runs = without(text.split(b"\n"), [(u["at"], u["end"]) for u in out])
                        text, lines = b"\n".join(kept), n - len(kept)
                    texts.append(None if lost else text.decode())
                    for to, x in zip(counts, (n, lines, runs)):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in counts]], names=["_row", "_text", "_lines", "_lines_gone", "_chunks_gone"])

    row = joined.schema["_row"].dataType.simpleString()
    return joined.mapInArrow(each, f"_row {row}, _text string, _lines long, _lines_gone long, _chunks_gone long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with its own columns; n_chars, if there is one, is that of the text that is left."""
    own = {c: F.col("_text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rewritten(docs).select(*[v.alias(c) for c, v in own.items()])


def brute_force(texts: dict[int, str]) -> dict[int, str]:
    """The same for a few texts by id, in one process, over all runs of lines; for tests."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for i in sorted(texts):
        lines = texts[i].encode().split(b"\n")
        lost: set[int] = set()
        for a in range(len(lines)):
            runs = {tuple(lines[a:b]): b for b in range(a + MIN_LINES, len(lines) + 1) if any(x.strip() for x in lines[a:b])}
            for run, b in runs.items():
                if run in seen:
                    lost.update(range(a, b))
            seen |= runs.keys()
        out[i] = b"\n".join(x for k, x in enumerate(lines) if k not in lost).decode()
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op5_lines(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = rewritten(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("_row.doc_id", F.col("_lines").alias("n_lines"), F.col("_lines_gone").alias("n_lines_removed"), F.col("_chunks_gone").alias("n_chunks_removed"), F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
