"""Ranked lexical search over an index of shards, each a dual-sorted wavelet tree.

A shard's posting lists stand one after the other, each in order of falling impact. A wavelet tree over the documents
of that sequence (laid out level by level, zeros before ones) leads from a list to any range of documents and keeps
the order inside, so that the first posting of a list's range at a node is the largest impact below that node.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapal.llm.common import binary, small_batches, stored

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Bytes of item texts that are searched in one pass over the index, and that the driver and each task hold.
BLOCK_BYTES = 8 << 20
#: (node, term) pairs that one step of a search takes at once.
STEP_PAIRS = 4096
#: Stands for a null doc_id: it ranks before all others.
MISSING = -(1 << 63)
#: Everything that is part of no term becomes a space, A-Z become a-z.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = "doc_ids array<long>, terms array<binary>, starts array<int>, zeros array<int>, bits binary, impacts binary"


def terms_of(data: bytes) -> list[bytes]:
    """The terms of UTF-8 text, repeats included."""
    return data.translate(TERMS).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms_of(x.as_py())) for x in binary(batch.column(0))]
            yield pa.RecordBatch.from_pydict({"docs": [sum(n > 0 for n in sizes)], "terms": [sum(sizes)]})

    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


class Building:
    """Documents that are becoming a shard."""

    def __init__(self, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.docs: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        words = terms_of(data)
        self.bytes += len(data)
        if words:
            terms, tf = np.unique(np.fromiter(map(self.ids.__getitem__, words), dtype=np.int32, count=len(words)), return_counts=True)
            self.docs.append(MISSING if doc_id is None else doc_id)
            self.parts.append((terms, tf, 10 + 90 * len(words) * self.n_docs // self.n_terms))

    def row(self) -> dict:
        """The shard: documents in order of doc_id, lists by falling impact, and the tree's levels as packed bits."""
        order = np.argsort(np.array(self.docs, dtype=np.int64), kind="stable")
        parts = [self.parts[i] for i in order.tolist()]
        sizes = [len(p[0]) for p in parts]
        term = np.concatenate([p[0] for p in parts])
        tf = np.concatenate([p[1] for p in parts])
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array([p[2] for p in parts], dtype=np.int64), sizes))
        at = np.lexsort((doc, -impact, term))
        sequence, zeros, bits = doc[at], [], []
        for bit in range(height(len(parts)) - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            bits.append(np.packbits(ones, bitorder="little").tobytes().ljust(8 * words_of(len(at)), b"\0"))
            zeros.append(int(len(at) - ones.sum()))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.ids)))]
        return {"doc_ids": [self.docs[i] for i in order.tolist()], "terms": list(self.ids), "starts": starts.tolist(), "zeros": zeros, "bits": b"".join(bits), "impacts": impact[at].astype(np.int32).tobytes()}


def height(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def words_of(n: int) -> int:
    """64-bit words of a level of n bits, and one more place to ask for the rank at the end."""
    return n // 64 + 1


def indexed(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each shard of docs (SCHEMA). Documents come as they are read, without a shuffle; those without a term are in none."""
    small_batches(docs.sparkSession)
    arrow = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("starts", pa.list_(pa.int32())), ("zeros", pa.list_(pa.int32())), ("bits", pa.binary()), ("impacts", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Building(n_docs, n_terms)
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                text = data.as_py()
                if shard.docs and shard.bytes + len(text) > SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema=arrow)
                    shard = Building(n_docs, n_terms)
                shard.add(doc_id, text)
        if shard.docs:
            yield pa.RecordBatch.from_pylist([shard.row()], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, SCHEMA)


class Shard:
    """A shard that is searched: ranks at the words' starts, and impacts in the order of each level."""

    def __init__(self, doc_ids: np.ndarray, starts: np.ndarray, zeros: list[int], bits: bytes, impacts: bytes) -> None:
        self.docs, self.starts = doc_ids, starts
        self.height, self.n = len(zeros), int(starts[-1])
        self.zeros = np.array([*zeros, 0], dtype=np.int64)
        self.width = words_of(self.n)
        self.words = np.frombuffer(bits, dtype=np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32).reshape(self.height, self.width)
        self.ranks = (np.cumsum(ones, axis=1, dtype=np.int32) - ones).ravel()
        self.impacts = np.empty((self.height + 1, self.n), dtype=np.int32)
        self.impacts[0] = np.frombuffer(impacts, dtype=np.int32)
        for k in range(self.height):
            one = np.unpackbits(self.words[k * self.width : (k + 1) * self.width].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            self.impacts[k + 1, : zeros[k]], self.impacts[k + 1, zeros[k] :] = self.impacts[k][~one], self.impacts[k][one]
        self.impacts = self.impacts.ravel()

    def ones_before(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The set bits of the levels before the places."""
        word = level * self.width + (at >> 6)
        held = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[word] + np.bitwise_count(held)

    def bounds(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that a document below each node can score: the sum over the lists of the weighted first impact."""
        some = lo < hi
        first = self.impacts[np.where(some, level[:, None] * self.n + lo, 0)]
        return (np.where(some, first, 0) * weights).sum(axis=1)


class Best:
    """The k best (score, doc_id) so far, equal scores by doc_id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def may_hold(self, bounds: np.ndarray, least_doc: np.ndarray) -> np.ndarray:
        """Whether documents of these bounds and doc_ids, or larger ones, can still come in."""
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | (bounds == self.scores[-1]) & (bounds > 0) & (least_doc < self.docs[-1])

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.r_[self.scores, scores], np.r_[self.docs, docs]
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]


def search_shard(shard: Shard, lists: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the shard's documents that are among the best; returns how many nodes were opened.

    The open nodes with the largest bounds go first, several at once; each one's lists are cut to the two halves of its
    documents, and a half stays open while its bound lets it in. A node of one document has its score as bound.
    """
    lo, hi = shard.starts[lists][None, :].astype(np.int64), shard.starts[lists + 1][None, :].astype(np.int64)
    level, node = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    bound = shard.bounds(level, lo, hi, weights)
    at_once, opened = max(1, STEP_PAIRS // len(lists)), 0
    while len(bound):
        go = np.argpartition(-bound, at_once)[:at_once] if len(bound) > at_once else np.arange(len(bound))
        rest = np.ones(len(bound), dtype=bool)
        rest[go] = False
        up = level[go][:, None]
        ones_lo, ones_hi = shard.ones_before(up, lo[go]), shard.ones_before(up, hi[go])
        first = shard.zeros[up]
        new_lo, new_hi = np.concatenate([lo[go] - ones_lo, first + ones_lo]), np.concatenate([hi[go] - ones_hi, first + ones_hi])
        new_level = np.tile(level[go] + 1, 2)
        new_node = np.concatenate([node[go] * 2, node[go] * 2 + 1])
        new_bound = shard.bounds(new_level, new_lo, new_hi, weights)
        opened += len(go)
        leaf = (new_level == shard.height) & (new_bound > 0)
        if leaf.any():
            best.add(new_bound[leaf], shard.docs[new_node[leaf]])
        inner = (new_level < shard.height) & (new_bound > 0)
        level, node, bound = np.r_[level[rest], new_level[inner]], np.r_[node[rest], new_node[inner]], np.r_[bound[rest], new_bound[inner]]
        lo, hi = np.concatenate([lo[rest], new_lo[inner]]), np.concatenate([hi[rest], new_hi[inner]])
        live = best.may_hold(bound, shard.docs[np.minimum(node << (shard.height - level), len(shard.docs) - 1)])
        if not live.all():
            level, node, bound, lo, hi = level[live], node[live], bound[live], lo[live], hi[live]
    return opened


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _frequencies(index: DataFrame, vocabulary: list[bytes]) -> list[int]:
    """In how many documents each term of the vocabulary is; only the shards' term lists are read."""
    held = index.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(held.value, pa.binary())
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                found = pc.index_in(terms.values.cast(pa.binary()), value_set=values)
                sizes = np.diff(starts.values.to_numpy(zero_copy_only=False))
                there = found.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([found.drop_null().cast(pa.int64()), pa.array(sizes[there].astype(np.int64))], names=["term", "n"])

    out = [0] * len(vocabulary)
    for row in index.select("terms", "starts").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    held.unpersist()
    return out


def _block(index: DataFrame, items: list[tuple[int | None, set[bytes]]], n_docs: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): of each task's shards each item's k best documents."""
    vocabulary = sorted(set().union(*(terms for _, terms in items)))
    place = {t: i for i, t in enumerate(vocabulary)}
    weights = np.array([weight(n_docs, df) for df in _frequencies(index, vocabulary)], dtype=np.int64)
    asked = [(item, np.array(sorted(place[t] for t in terms), dtype=np.int64)) for item, terms in items]
    held = index.sparkSession.sparkContext.broadcast((vocabulary, weights, asked))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, asked = held.value
        values = pa.array(vocabulary, pa.binary())
        best = [Best(k) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                shard = Shard(row["doc_ids"].values.to_numpy(), row["starts"].values.to_numpy(), row["zeros"].as_py(), row["bits"].as_py(), row["impacts"].as_py())
                lists = np.full(len(vocabulary), -1, dtype=np.int64)
                found = pc.index_in(values, value_set=row["terms"].values.cast(pa.binary()))
                lists[found.is_valid().to_numpy(zero_copy_only=False)] = found.drop_null().to_numpy()
                for (_, terms), top in zip(asked, best):
                    there = terms[(lists[terms] >= 0) & (weights[terms] > 0)]
                    if len(there):
                        search_shard(shard, lists[there], weights[there], top)
        ids = [item for (item, _), top in zip(asked, best) for _ in top.scores]
        if ids:
            docs, scores = np.concatenate([t.docs for t in best]), np.concatenate([t.scores for t in best])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, mask=docs == MISSING), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(each, "item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0.

    Equal scores are in order of doc_id, null first; rows of documents that repeat a doc_id are documents of their own.
    Rows of items with one item_id (null is one) are one item with the terms of them all; a null text has none. items
    are asked in blocks of BLOCK_BYTES (or one item), each in one pass; a task keeps the k best of all its shards, so
    that later shards open fewer nodes, and gives k rows an item. index should be a stored table.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        terms: dict[int | None, set[bytes]] = defaultdict(set)
        for row in own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator():
            terms[row["item_id"]].update(terms_of(row["text"].encode()))
        part = _block(index, [x for x in terms.items() if x[1]], n_docs, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_wavelet(spark, sf_dir: str) -> DataFrame:
    """The ten documents that each benchmark item ranks highest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs, n_terms = totals(docs)
    index = stored(indexed(docs, n_docs, n_terms), "wavelet")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n_docs)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, len(terms) AS n, t AS term, count(*) AS tf FROM (SELECT r, doc_id, terms, unnest(terms) AS t FROM d) GROUP BY r, doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
g AS (SELECT q.item_id, p.doc_id, p.r, sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS score
  FROM q JOIN p ON q.term = p.term JOIN f ON f.term = q.term, s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM
  (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM g WHERE score > 0) WHERE rank <= 10
"""
