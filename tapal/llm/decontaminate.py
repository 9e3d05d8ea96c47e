"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import binary, slices, small_batches, stored

#: Lower-cases A-Z and makes ASCII punctuation a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Word edits allowed: a fifth of an item's words, rounded down.
EDIT_SHARE = 5
#: Embeddings of each window from either end, LSH tables for each embedding and places that a table samples.
#: Edits that stand together leave the walk from one end at least unchanged for two fifths of the words or more, so that
#: half of its steps agree; a table finds such a window with 1/4, and the 24 tables from that end with 0.999.
EMBEDDINGS, TABLES, PLACES = 4, 6, 2
SEED = 20240229
#: Items whose lengths are within this factor share tables; their windows have the length of the shortest.
LENGTH_STEP = 1.25
#: Benchmark text that goes to the tasks at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20
#: Words of windows that are embedded at once.
WINDOW_WORDS = 1 << 20


def edits_allowed(n: int) -> int:
    return n // EDIT_SHARE


def run_length(n: int) -> int:
    """The longest word run, of three at most, of which an item of n words keeps one after all edits that are allowed."""
    return next(q for q in (3, 2, 1) if n - q + 1 - q * edits_allowed(n) >= 1)


def fitting_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least word edit distance between the item and any part of the text, and where the first such part ends."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    at = int(np.argmin(row))
    return int(row[at]), at


def walk_bits(k: int, step: int, symbols: np.ndarray) -> np.ndarray:
    """The random bit of embedding k for each symbol at a step; a hash, so that it needs no table."""
    x = (symbols.astype(np.uint64) + np.uint64((step * EMBEDDINGS + k + 1) * 0xD1B54A32D192ED03 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(40) & np.uint64(1)).astype(np.int64)


def embed(windows: np.ndarray, k: int, steps: int, after: int) -> np.ndarray:
    """CGK: at each step the current word is put out, and a random bit of (step, word) says whether to move on; after stands behind a window's end."""
    n = windows.shape[1]
    padded = np.concatenate([windows, np.full((len(windows), 1), after)], axis=1)
    at, rows = np.zeros(len(windows), dtype=np.int64), np.arange(len(windows))
    out = np.empty((len(windows), steps), dtype=np.int64)
    for step in range(steps):
        out[:, step] = padded[rows, at]
        at = np.minimum(at + walk_bits(k, step, out[:, step]), n)
    return out


class Tables:
    """The LSH tables of items of about one length, whose first n words stand for them, or their last n words from the end on."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], n: int, size: int, backward: bool):
        self.n, self.steps, self.size, self.backward = n, max(1, n * 3 // 2), size, backward  # in that many steps few walks reach the end
        self.sampled = (np.random.default_rng(SEED).random((EMBEDDINGS, TABLES, PLACES)) * self.steps).astype(np.int64)
        self.sorted = []
        own = np.stack([items[i][::-1][:n] if backward else items[i][:n] for i in numbers])
        for k in range(EMBEDDINGS):
            for keys in self.keys(own, k):
                order = np.argsort(keys, kind="stable")
                self.sorted.append((keys[order], np.array(numbers, dtype=np.int64)[order]))

    def places(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places of each window's words in the order of the walk, for windows by where the item would begin and end."""
        return ends[:, None] - 1 - np.arange(self.n) if self.backward else starts[:, None] + np.arange(self.n)

    def keys(self, windows: np.ndarray, k: int) -> list[np.ndarray]:
        """For each table of embedding k the key of each window: the words at the sampled places."""
        out = embed(windows, k, self.steps, self.size + 1).astype(np.uint64)
        found = []
        for places in self.sampled[k]:
            key = np.zeros(len(windows), dtype=np.uint64)
            for place in places:
                key = (key + out[:, place]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            found.append(key)
        return found

    def candidates(self, windows: np.ndarray) -> np.ndarray:
        """Distinct (window, item) of windows and items that share a bucket of some table."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for k in range(EMBEDDINGS):
            for keys, (own, items) in zip(self.keys(windows, k), self.sorted[k * TABLES :]):
                lo, hi = np.searchsorted(own, keys), np.searchsorted(own, keys, "right")
                which, at = _ranges(lo, hi)
                found.append(np.stack([which, items[at]], axis=1))
            found = [np.unique(np.concatenate(found), axis=0)]
        return found[0]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) for all places of the ranges lo to hi."""
    many = hi - lo
    which = np.repeat(np.arange(len(lo)), many)
    return which, lo[which] + np.arange(int(many.sum())) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many) if len(lo) else which


class Index:
    """What a task needs to search for a block of items; its size is a small multiple of BLOCK_BYTES.

    Windows are embedded and looked up in the tables where a run of words of some item stands in the text: an item that
    is there within its edits has run_length words in a row unchanged, so this loses nothing. The tables then say which
    items a window is compared with.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        split = [(i, text.translate(PLAIN).split()) for i, text in items]
        split = [(i, words) for i, words in split if words]
        self.words: dict[bytes, int] = {}
        for _, words in split:
            for w in words:
                self.words.setdefault(w, len(self.words))
        self.size = len(self.words)
        self.ids = [i for i, _ in split]
        self.items = [np.array([self.words[w] for w in words], dtype=np.int64) for _, words in split]
        #: For each q the sorted numbers of what q words in a row the items have; a run of q is that of q - 1 and a word.
        self.known: dict[int, np.ndarray] = {}
        most = max((run_length(len(x)) for x in self.items), default=0)
        so_far = self.items
        for q in range(2, most + 1):
            pairs = [run[:-1] * self.size + x[q - 1 :] if len(x) >= q else np.zeros(0, dtype=np.int64) for run, x in zip(so_far, self.items)]
            self.known[q] = np.unique(np.concatenate(pairs))
            so_far = [np.searchsorted(self.known[q], x) for x in pairs]
        runs: dict[int, list] = {}
        classes: dict[int, list[int]] = {}
        for k, x in enumerate(self.items):
            q = run_length(len(x))
            runs.setdefault(q, []).append((self.codes(x, q), np.full(len(x) - q + 1, k), np.arange(len(x) - q + 1)))
            classes.setdefault(int(np.log(len(x)) / np.log(LENGTH_STEP)), []).append(k)
        self.runs = {}
        for q, parts in runs.items():
            codes, owners, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(codes, kind="stable")
            self.runs[q] = codes[order], owners[order], places[order]
        #: Runs that an item's allowed edits leave at least.
        self.least = np.array([len(x) - run_length(len(x)) + 1 - run_length(len(x)) * edits_allowed(len(x)) for x in self.items], dtype=np.int64)
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        self.tables = [[Tables(self.items, own, min(len(self.items[k]) for k in own), self.size, backward) for backward in (False, True)] for own in classes.values()]
        self.table_of = np.zeros(len(self.items), dtype=np.int64)
        for t, own in enumerate(classes.values()):
            self.table_of[own] = t

    def codes(self, words: np.ndarray, q: int) -> np.ndarray:
        """A number for each q words in a row; -1 if no item has them. Numbers stay under the items' words times their distinct words, whatever q is."""
        out = words
        for k in range(2, q + 1):
            last = words[k - 1 :]
            pair = np.where((out[:-1] >= 0) & (last >= 0), out[:-1] * self.size + last, -1)
            at = np.minimum(np.searchsorted(self.known[k], pair), len(self.known[k]) - 1)
            out = np.where((pair >= 0) & (self.known[k][at] == pair), at, -1)
        return out

    def seeds(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item, start) of windows at which a run of an item stands, and the pairs row * items + item that have enough runs, sorted."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for q, (codes, owners, places) in self.runs.items():
            if len(words) < q:
                continue
            code = self.codes(words, q)
            hits = np.flatnonzero(code >= 0)
            which, at = _ranges(np.searchsorted(codes, code[hits]), np.searchsorted(codes, code[hits], "right"))
            at_word = hits[which]
            found.append(np.stack([np.searchsorted(ends, at_word, "right"), owners[at], at_word - places[at]], axis=1))
        every = np.concatenate(found)
        pairs, back, counts = np.unique(every[:, 0] * len(self.items) + every[:, 1], return_inverse=True, return_counts=True)
        enough = counts[back] >= self.least[every[:, 1]]
        return every[enough], pairs[counts >= self.least[pairs % len(self.items)]]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, first word) of the best match of each item in each text."""
        split = [x.translate(PLAIN).split() for x in texts]
        get, missing = self.words.get, -1
        lengths = np.array([len(x) for x in split], dtype=np.int64)
        ends = np.cumsum(lengths + 1)
        words = np.full(int(ends[-1]) if len(ends) else 0, -1, dtype=np.int64)
        for x, end in zip(split, ends.tolist()):
            if x:
                words[end - 1 - len(x) : end - 1] = [get(w, missing) for w in x]
        if not self.items or not len(words):
            return []
        seeds, likely = self.seeds(words, ends)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for t, both in enumerate(self.tables):
            own = seeds[self.table_of[seeds[:, 1]] == t]
            windows = np.stack([own[:, 0], own[:, 2], own[:, 2] + self.sizes[own[:, 1]]], axis=1)
            for tables in both:
                # Windows that begin, or end, at one place are one.
                _, first_of = np.unique(windows[:, [0, 2 if tables.backward else 1]], axis=0, return_index=True)
                step = max(1, WINDOW_WORDS // tables.n)
                for c in range(0, len(first_of), step):
                    row, start, end = windows[first_of[c : c + step]].T
                    first, after = ends[row] - 1 - lengths[row], ends[row] - 1
                    places = tables.places(start, end)
                    inside = (places >= first[:, None]) & (places < after[:, None])
                    taken = np.where(inside, words[np.clip(places, 0, len(words) - 1)], -1)
                    for q, k in tables.candidates(np.where(taken < 0, self.size, taken)).tolist():
                        r, x, spare = int(row[q]), self.items[k], edits_allowed(len(self.items[k]))
                        at = np.searchsorted(likely, r * len(self.items) + k)
                        if at == len(likely) or likely[at] != r * len(self.items) + k or best.get((r, k), (1,))[0] == 0:
                            continue
                        # A window that ends with the item begins where an item of this length would.
                        begin = int(end[q]) - len(x) if tables.backward else int(start[q])
                        if (r, k, begin) in seen:
                            continue
                        seen.add((r, k, begin))
                        lower, upper = max(int(first[q]), begin - spare), min(int(after[q]), begin + len(x) + spare)
                        d, stop = fitting_distance(x, words[lower:upper])
                        if d <= spare:
                            got = (d, max(0, lower + stop - len(x) - int(first[q])))
                            best[(r, k)] = min(best.get((r, k), got), got)
        return [(r, k, d, s) for (r, k), (d, s) in sorted(best.items())]


def blocks_of(benchmark: DataFrame) -> Iterator[Index]:
    """The items, a stated query set, in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index(sorted((-1 if r.item_id is None else r.item_id, r.text.encode()) for r in part))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word) for each row of docs and item that it holds.

    A document holds an item if some part of it is within edits_allowed word edits of the item, letter case and ASCII
    punctuation aside. Null and empty texts hold nothing; null items are skipped and a null item_id is -1. Repeated
    rows each get their matches, repeated items one for each; other columns are not looked at.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, item_words int, first_word long"
    out = spark.createDataFrame([], schema)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    found = index.search(binary(part.column("text")).to_pylist())
                    rows = [(ids[r], index.ids[k], d, len(index.items[k]), s) for r, k, d, s in found]
                    columns = list(zip(*rows)) or [()] * 5
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["doc_id", "item_id", "distance", "item_words", "first_word"])

        out = out.union(own.mapInArrow(each, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with their own columns."""
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    searched = False
    for index in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "_text"):
                    bad = {r for r, *_ in shared.value.search(binary(part.column("_text")).to_pylist())}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)]))

        # A block's tasks are over before the next one's, so that one index is in memory.
        held = (stored(held, "docs") if searched else held).mapInArrow(each, held.schema)
        searched = True
    return held.select("_row.*")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
