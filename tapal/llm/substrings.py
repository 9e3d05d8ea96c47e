"""Exact removal of long repeated byte strings by a blockwise suffix sort with a difference cover.

A suffix matters here by its first LENGTH bytes, its window. Windows go to buckets by the least hash among the
K-byte strings inside, so equal windows meet and no bucket needs the rest of the corpus. A bucket's suffixes are sorted
in blocks: the ranks of a difference-cover sample of the block's positions are worked out first, by doubling, and a
suffix is then placed by the few bytes up to its next sample position and that sample's rank. Neighbours in the sorted
order are compared byte by byte. A bucket of too many suffixes for one task is split by more of the bytes about the
anchor, in halves of the windows' distances to it, until its parts fit; they are sorted in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import binary, cut, slices, small_batches, sorted_groups, stored, text_key

LENGTH = 200
#: Bytes of the strings whose least hash is a window's anchor, a multiple of 8.
K = 64
#: A difference cover: every residue modulo PERIOD is a difference of two of its members. Fixed values.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Segments of a bucket that are sorted in one task; larger buckets are split by more bytes.
BUCKET_ROWS = 2000
#: Rows of whole buckets that make a block.
BLOCK_ROWS = 8000
#: Places of a task that are looked at for equal segments before any are sent.
PACK_ROWS = 20_000
#: Positions worked on at once; a longer text is cut, with LENGTH - 1 bytes of overlap.
PIECE = 8 << 20
PLACE_BITS = 24
#: Keys of texts that are broadcast at most, 16 bytes each.
BROADCAST_ROWS = 500_000


def words_at(data: np.ndarray) -> np.ndarray:
    """For each position the next eight bytes as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor, over texts that end at ends: (first start, count, anchor's place, anchor's hash).

    The anchor is the leftmost least hash of the window's K-byte strings, so it depends on the window's bytes alone.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none
    at = words_at(data)
    m = len(data) - K + 1
    h = np.zeros(m, dtype=np.uint64)
    for j in range(K // 8):
        h += at[8 * j : 8 * j + m] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3) ** 5 | 1) & (2**64 - 1))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(m, dtype=np.uint64)
    width, span = LENGTH - K + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        rest = width - span
        low = np.minimum(low[:-rest], low[rest:])
    place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    valid = np.ones(n, dtype=bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - LENGTH + 1) : e] = False
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    first, final = np.flatnonzero(new), np.flatnonzero(last)
    return first, final - first + 1, place[first], h[place[first]].view(np.int64)


def _pieces(ids: list, hashes: list, texts: list[bytes]) -> Iterator[tuple[list, list, list, list]]:
    """Groups of (ids, hashes, base positions, texts) of PIECE bytes at most, long texts cut with overlap."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for i, th, text in zip(ids, hashes, texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), PIECE - LENGTH + 1):
            part = text[a : a + PIECE]
            if len(part) < LENGTH:
                continue
            if size and size + len(part) > PIECE:
                yield out
                out, size = ([], [], [], []), 0
            for to, x in zip(out, (i, th, a, part)):
                to.append(x)
            size += len(part)
    if size:
        yield out


def segments(docs: DataFrame) -> DataFrame:
    """(_id, _th, s, n, a, bucket): n windows from byte s on have their anchor a bytes after s."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for ids, hashes, bases, texts in _pieces(part.column("_id").to_pylist(), part.column("_th").to_pylist(), binary(part.column("text")).to_pylist()):
                    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                    ends = np.cumsum([len(x) for x in texts])
                    first, count, place, h = anchors(data, ends)
                    row = np.searchsorted(ends, first, "right")
                    start = first - np.r_[0, ends[:-1]][row] + np.array(bases)[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(ids, np.int64)[row]), pa.array(np.array(hashes, np.int64)[row]), pa.array(start), pa.array(count.astype(np.int16)), pa.array((place - first).astype(np.int16)), pa.array(h)],
                        names=["_id", "_th", "s", "n", "a", "bucket"],
                    )

    return docs.mapInArrow(each, "_id long, _th long, s long, n short, a short, bucket long")


def digests(pieces: list[tuple[int, bytes]]) -> np.ndarray:
    """The 128-bit BLAKE2 hash of each (bytes before the anchor, bytes), a cryptographic one: two columns of int64."""
    raw = b"".join([hashlib.blake2b(x, digest_size=16, salt=a.to_bytes(2, "big")).digest() for a, x in pieces])
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with the list of places of each text."""
    lists = places.groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "n", "a", "bucket", "c")).alias("places"))
    return docs.join(lists, ["_id", "_th"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.StructArray, list[tuple[int, bytes]]]]:
    """(_id, _th, places, segments) of each text, PACK_ROWS places at most at once; a segment is (bytes before the anchor, bytes)."""
    for batch in batches:
        for part in slices(batch, "text"):
            for i, th, text, own in zip(part.column("_id").to_pylist(), part.column("_th").to_pylist(), binary(part.column("text")).to_pylist(), part.column("places")):
                for at in range(0, len(own.values), PACK_ROWS):
                    some = own.values.slice(at, PACK_ROWS)
                    columns = (some.field(c).to_pylist() for c in ("s", "n", "a"))
                    yield i, th, some, [(a, text[s : s + n + LENGTH - 1]) for s, n, a in zip(*columns)]


def pieces_of(texts: DataFrame) -> DataFrame:
    """(i0, i1, key, c, lo, hi, a, piece, times): the segments of texts, those that are equal among a task's neighbours as one row.

    key is the bucket, c how many places it has, lo and hi bound the distance from a window's start to its anchor.
    """
    names = ["i0", "i1", "key", "c", "lo", "hi", "a", "piece", "times"]

    def packed(held: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        ids = digests(list(held))
        key, c, times = zip(*held.values())
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(key), pa.array(c), pa.array(np.zeros(n, np.int16)), pa.array(np.full(n, LENGTH - K, np.int16)), pa.array([a for a, _ in held], pa.int16()), pa.array([x for _, x in held], pa.binary()), pa.array(times)],
            names=names,
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        for _, _, own, segs in _cut(batches):
            for seg, bucket, c in zip(segs, own.field("bucket").to_pylist(), own.field("c").to_pylist()):
                held.setdefault(seg, [bucket, c, 0])[2] += 1
            if len(held) >= PACK_ROWS:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    return texts.mapInArrow(each, "i0 long, i1 long, key long, c long, lo short, hi short, a short, piece binary, times long")


def placed(texts: DataFrame) -> DataFrame:
    """(_id, _th, known, rest) for each text: spans (b, e) of segments that come again among a task's neighbours, so that
    all of their windows do, and (p, i0, i1) of the others, p the anchor's place and i0, i1 the segment."""
    span = pa.struct([("b", pa.int64()), ("e", pa.int64())])

    def packed(held: list[tuple]) -> pa.RecordBatch:
        ids = np.concatenate([x[2] for x in held])
        _, back, counts = np.unique(ids[:, 0] ^ (ids[:, 1] * 31), return_inverse=True, return_counts=True)
        # The shortened hash only picks those that are looked at.
        again = counts[back] > 1
        seen: dict[tuple, int] = {}
        for x in map(tuple, ids[again].tolist()):
            seen[x] = seen.get(x, 0) + 1
        again[again] = [seen[x] > 1 for x in map(tuple, ids[again].tolist())]
        s, a, size = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
        row = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        ends = lambda mask: pa.array(np.r_[0, np.cumsum(np.bincount(row[mask], minlength=len(held)))].astype(np.int32))
        known = pa.ListArray.from_arrays(ends(again), pa.StructArray.from_arrays([pa.array(s[again]), pa.array((s + size)[again])], fields=list(span)))
        left = pa.StructArray.from_arrays([pa.array((s + a)[~again]), pa.array(ids[~again, 0]), pa.array(ids[~again, 1])], names=["p", "i0", "i1"])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array([x[1] for x in held]), known, pa.ListArray.from_arrays(ends(~again), left)], names=["_id", "_th", "known", "rest"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for i, th, own, segs in _cut(batches):
            held.append((i, th, digests(segs), own.field("s").to_numpy(), own.field("a").to_numpy().astype(np.int64), np.array([len(x) for _, x in segs])))
            n += len(segs)
            if n >= PACK_ROWS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return texts.mapInArrow(each, "_id long, _th long, known array<struct<b:long,e:long>>, rest array<struct<p:long,i0:long,i1:long>>")


def sample_ranks(data: np.ndarray, at: np.ndarray, residue: np.ndarray, owner_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks) of the cover sample among positions whose residues are given.

    The first ranks are by PERIOD bytes; they are doubled with the rank that many bytes on, which is a sample position
    too, until they reach past a window. Bytes behind a segment's end are zeros and its own length decides.
    """
    taken = np.isin(residue, COVER)
    pos, end = at[taken], owner_end[taken]
    words = words_at(data)
    rank = np.zeros(len(pos), np.int64)
    for k in range(0, PERIOD, 8):
        left = np.clip(end - pos - k, 0, min(8, PERIOD - k))
        w = np.where(pos + k < len(words), words[np.minimum(pos + k, len(words) - 1)], 0)
        w = np.where(left > 0, w >> ((8 - left) * 8).astype(np.uint64) << ((8 - left) * 8).astype(np.uint64), np.uint64(0))
        _, w = np.unique(w, return_inverse=True)
        _, rank = np.unique(rank * (int(w.max(initial=0)) + 1) + w, return_inverse=True)
    where = np.full(len(data) + 1, -1, np.int64)
    where[pos] = np.arange(len(pos))
    step = PERIOD
    while step < LENGTH + PERIOD and len(pos):
        on = pos + step
        other = np.where(on < end, where[np.minimum(on, len(data))], -1)
        after = np.where(other >= 0, rank[other] + 1, 0)
        _, rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)
        step *= 2
    return pos, rank


def equal_windows(bucket: np.ndarray, anchor: np.ndarray, segs: list[bytes]) -> list[np.ndarray]:
    """For each segment, which of its windows are in another of the distinct segments of its bucket.

    Segments are laid out with their anchors at residue 0, so equal windows have equal residues and one cover sample
    serves both of any two.
    """
    sizes = np.array([len(x) for x in segs])
    lead = (-anchor) % PERIOD
    room = lead + sizes
    room += (-room) % PERIOD
    base = np.r_[0, np.cumsum(room)[:-1]] + lead
    data = np.zeros(int(room.sum()), np.uint8)
    seg_of = np.repeat(np.arange(len(segs)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes) + base[seg_of]
    data[at] = np.frombuffer(b"".join(segs), np.uint8)
    end = base + sizes
    pos, rank = sample_ranks(data, at, at % PERIOD, end[seg_of])
    rank_at = np.full(len(data) + PERIOD + 1, -1, np.int64)
    rank_at[pos] = rank
    # How far each residue's next sample is.
    ahead = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    many = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(segs)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many) + base[owner]
    offset = anchor[owner] - (start - base[owner])
    words = words_at(data)
    gap = ahead[start % PERIOD]
    head = []
    for k in (0, 8):
        left = np.clip(gap - k, 0, 8)
        w = words[np.minimum(start + k, len(words) - 1)]
        head.append(np.where(left > 0, w >> ((8 - left) * 8).astype(np.uint64) << ((8 - left) * 8).astype(np.uint64), np.uint64(0)))
    _, kind = np.unique(bucket[owner], return_inverse=True)
    order = np.lexsort((rank_at[start + gap], head[1], head[0], kind * LENGTH + offset))
    x, y = start[order[:-1]], start[order[1:]]
    same = np.flatnonzero((kind[order[:-1]] == kind[order[1:]]) & (offset[order[:-1]] == offset[order[1:]]))
    for k in range(0, LENGTH, 8):
        same = same[words[x[same] + k] == words[y[same] + k]]
    marked = np.zeros(len(start), bool)
    marked[order[same]] = True
    marked[order[same + 1]] = True
    return np.split(marked, np.cumsum(many)[:-1])


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.r_[0, marked.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sorted_blocks(pieces: DataFrame) -> DataFrame:
    """(i0, i1, runs) for pieces with windows that come again: runs (d0, d1) of their distances to the anchor. Whole keys are sorted, block by block."""
    run = pa.struct([("d0", pa.int64()), ("d1", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["key"], BLOCK_ROWS):
            columns = [part.column(c).to_pylist() for c in ("key", "a", "piece", "i0", "i1", "times")]
            # Equal pieces are one, and all of its windows come again.
            number: dict[tuple, list] = {}
            for key, a, piece, i0, i1, times in zip(*columns):
                number.setdefault((key, a, piece), [i0, i1, 0])[2] += times
            keys, anchor, distinct = (list(x) for x in zip(*number))
            keys, anchor = np.array(keys), np.array(anchor)
            _, back, kinds = np.unique(keys, return_inverse=True, return_counts=True)
            own = list(number.values())
            marks = [np.full(len(x) - LENGTH + 1, times > 1) for x, (_, _, times) in zip(distinct, own)]
            mixed = np.flatnonzero(kinds[back] > 1)
            if len(mixed):
                for i, found in zip(mixed.tolist(), equal_windows(keys[mixed], anchor[mixed], [distinct[i] for i in mixed])):
                    marks[i] |= found
            rows, runs = [], []
            for (i0, i1, _), a, marked in zip(own, anchor.tolist(), marks):
                first, last = _runs(marked)
                if len(first):
                    rows.append((i0, i1))
                    runs.append([{"d0": a - int(q) + 1, "d1": a - int(p)} for p, q in zip(first, last)])
            ids = np.array(rows, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(runs, pa.list_(run))], names=["i0", "i1", "runs"])

    sent = pieces.select("key", "a", "piece", "i0", "i1", "times").repartition("key").sortWithinPartitions("key")
    return sent.mapInArrow(each, "i0 long, i1 long, runs array<struct<d0:long,d1:long>>")


def halved(pieces: DataFrame) -> DataFrame:
    """Each piece in two, by the distance of its windows from the anchor: (i0, i1) and its half's (j0, j1), key, lo, hi, a, piece, times.

    All windows of a half hold the same bytes about the anchor, more of them than those of the whole piece do; a hash
    of these bytes is the half's key. Where lo is hi they are the whole window, so that a key has one piece.
    """
    names = ["i0", "i1", "j0", "j1", "key", "lo", "hi", "a", "piece", "times"]
    types = [pa.int64(), pa.int16(), pa.int16(), pa.int16(), pa.binary(), pa.int64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(at, PACK_ROWS)
                rows, of = [], []
                for r, (lo, hi, a, piece, times) in enumerate(zip(*(part.column(c).to_pylist() for c in ("lo", "hi", "a", "piece", "times")))):
                    middle = (lo + hi) // 2
                    for x, y in ((lo, middle), (middle + 1, hi)):
                        before = min(a, y)
                        half = piece[a - before : a + LENGTH - x]
                        if len(half) >= LENGTH and before >= x:
                            core = half[before - x : before + LENGTH - y]
                            rows.append((xxhash.xxh3_64_intdigest(core, x << 8 | y) - (1 << 63), x, y, before, half, times))
                            of.append(r)
                ids = digests([(x[3], x[4]) for x in rows])
                own = [pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 6, types)]
                yield pa.RecordBatch.from_arrays([part.column("i0").take(pa.array(of, pa.int64())), part.column("i1").take(pa.array(of, pa.int64())), pa.array(ids[:, 0]), pa.array(ids[:, 1]), *own], names=names)

    return pieces.mapInArrow(each, "i0 long, i1 long, j0 long, j1 long, key long, lo short, hi short, a short, piece binary, times long")


def marks_of(pieces: DataFrame, crowded: bool) -> DataFrame:
    """(i0, i1, runs): see sorted_blocks. Keys of more than BUCKET_ROWS pieces (crowded: there are some) are first split by more bytes about the anchor, as often as it takes."""
    fits = (F.col("c") <= BUCKET_ROWS) | (F.col("lo") == F.col("hi"))
    own = sorted_blocks(pieces.where(fits))
    if not crowded:
        return own
    halves = stored(halved(pieces.where(~fits)), "halves")
    distinct = halves.groupBy("j0", "j1", "key", "lo", "hi", "a", "piece").agg(F.sum("times").alias("times"))
    distinct = distinct.select(F.col("j0").alias("i0"), F.col("j1").alias("i1"), "key", "lo", "hi", "a", "piece", "times")
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("times").alias("all")).where("all > 1").drop("all")
    below = stored(distinct.join(sizes, "key"), "pieces")
    found = marks_of(below, not below.where(~fits).isEmpty())
    links = halves.select("i0", "i1", "j0", "j1").distinct()
    up = found.select(F.col("i0").alias("j0"), F.col("i1").alias("j1"), "runs").join(links, ["j0", "j1"]).select("i0", "i1", "runs")
    return own.unionByName(up)


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_id, _th, e) of texts with exact copies, e their size, and (_id, _th) of those copies that need not be looked at.

    Every window of such a text starts elsewhere too. One of each group stays in the search for the sake of other texts.
    """
    own = docs.select("_id", "_th", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("e"))
    groups = own.groupBy("_th", "h", "e").agg(F.count(F.lit(1)).alias("times"), F.min("_id").alias("first")).where("times > 1")
    all_of = cut(own.join(groups.drop("times"), ["_th", "h", "e"]).select("_id", "_th", "e", "first").distinct())
    return all_of.select("_id", "_th", "e"), all_of.where("_id <> first").select("_id", "_th")


def covered(docs: DataFrame) -> DataFrame:
    """(_id, _th, spans): for each text with bytes to remove the runs that cover them; docs has doc_id, _id, _th and text.

    The texts are sent by key once: with_places and without_repeats join the same columns of all docs.
    """
    long = docs.select("_id", "_th", "text").where(F.octet_length("text") >= LENGTH)
    whole, spare = copies(long)
    spare = cut(spare)
    own = segments(long).join(F.broadcast(spare) if spare.count() <= BROADCAST_ROWS else spare, ["_id", "_th"], "left_anti")
    again = cut(own.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    places = stored(own.join(again, "bucket"), "places")
    texts = with_places(docs, places)
    marks = marks_of(pieces_of(texts), not again.where(F.col("c") > BUCKET_ROWS).isEmpty())
    at = placed(texts)
    open_ = at.select("_id", "_th", F.explode("rest").alias("r")).select("_id", "_th", "r.*")
    found = open_.join(marks, ["i0", "i1"]).select("_id", "_th", F.transform("runs", lambda r: F.struct((F.col("p") - r.d1).alias("b"), (F.col("p") - r.d0 + LENGTH).alias("e"))).alias("spans"))
    known = at.where(F.size("known") > 0).select("_id", "_th", F.col("known").alias("spans"))
    every = found.unionByName(known).unionByName(whole.select("_id", "_th", F.array(F.struct(F.lit(0).cast("long").alias("b"), "e")).alias("spans")))
    return every.groupBy("_id", "_th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs; kept is what is left of the text's bytes.

    A byte goes if a LENGTH-byte string over it also starts anywhere else, in the same text or another, judged on the
    whole input. Null texts count as empty; texts under LENGTH bytes are left as they are. Repeated rows are texts of
    their own, so each covers the other. Other columns are not looked at.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.col("text").cast("string").alias("text"))
    both = keyed.join(covered(keyed), ["_id", "_th"], "left").select("doc_id", "text", "spans")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, kept = [[], [], []], []
                for text, own in zip(binary(part.column("text")).to_pylist(), part.column("spans").to_pylist()):
                    runs = merged([(x["b"], x["e"]) for x in own or ()])
                    edges = [0, *[x for r in runs for x in r], len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    for to, x in zip(counts, (len(text), len(text) - len(kept[-1]), len(runs))):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in counts], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of a few texts, in one process; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        runs = merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        edges = [0, *[x for r in runs for x in r], len(t)]
        kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
