"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

A text is counts of hashed terms: its words, the shapes of its tokens alone and in pairs, and how much of it comes again.
A truncated singular value decomposition of labelled texts gives the space; a document's score is the share of label 1
among the labelled texts of largest cosine, each weighted by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import binary, cut, slices, small_batches
from tapal.llm.lexical import terms_of

#: Buckets of hashed terms: the first half for shapes and repeats, the second for words.
BUCKETS = 4096
#: Dimensions of the space.
DIMENSIONS = 64
#: Labelled documents that vote, those with the least hashes of doc_id; the bound of what is fitted on, held by the driver and broadcast.
VOTERS = 4096
#: Neighbours that are asked, and the power of the cosine that weights them.
NEIGHBOURS, SHARPNESS = 25, 8
#: The part of a vector's square length that its words have.
WORD_SHARE = 0.25
THRESHOLD = 0.7
#: Terms whose hash a task keeps.
CACHED = 500_000
#: What a byte is in a shape: A upper case, a other letters, 0 a digit, white space, and marks as they are.
SHAPES = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256)], dtype=np.uint8)


class Hashes(dict):
    """The hash of each term, made when it is first asked for."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        found = self[term] = xxhash.xxh64_intdigest(term, 13)
        return found

    def of(self, terms: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, terms), dtype=np.uint64, count=len(terms))


def shapes_of(data: bytes) -> list[bytes]:
    """The shapes of the tokens between white space, runs of one class as one character."""
    classes = SHAPES[np.frombuffer(data, dtype=np.uint8)]
    return classes[np.r_[True, classes[1:] != classes[:-1]]].tobytes().split() if len(classes) else []


def step_of(share: float) -> int:
    """A share from 0 to 1 as one of 8 steps, finer where it is small."""
    return 0 if share <= 0 else max(1, 8 + math.ceil(math.log2(share)))


def counts(data: bytes, hashes: Hashes) -> np.ndarray:
    """The terms of a text, counted by bucket. Every text has some: its length and how much of it comes again are terms."""
    tokens, own = shapes_of(data), terms_of(data)
    words, shapes = hashes.of(own), hashes.of(tokens)
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = {b"words": len(own) and 1 - len(np.unique(words)) / len(own), b"next": np.count_nonzero(words[1:] == words[:-1]) / max(1, len(own)), b"lines": len(lines) and 1 - len(set(lines)) / len(lines)}
    whole = hashes.of([b"%s %d" % (name, step_of(share)) for name, share in again.items()] + [b"size %d" % len(own).bit_length()])
    half = np.uint64(BUCKETS // 2)
    # A pair's hash is that of its shapes, mixed in order; the upper bits are the better mixed ones.
    pairs = (shapes[:-1] * np.uint64(0x9E3779B97F4A7C15) + shapes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    ids = np.concatenate([shapes % half, pairs % half, np.repeat(whole % half, max(1, len(tokens) // 8)), words % half + half])
    return np.bincount(ids.astype(np.int64), minlength=BUCKETS)


def rows_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, each with its texts' counts, a row a text."""
    hashes = Hashes()
    for batch in batches:
        for part in slices(batch, text):
            yield part, np.array([counts(x.as_py(), hashes) for x in binary(part.column(text))])


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: roots of the counts' shares times idf, words and the rest each with their part."""
    out, half = np.sqrt(found, dtype=np.float32) * idf.astype(np.float32), BUCKETS // 2
    for block, part in ((slice(0, half), 1 - WORD_SHARE), (slice(half, BUCKETS), WORD_SHARE)):
        length = np.sqrt((out[:, block] ** 2).sum(axis=1, keepdims=True))
        out[:, block] *= math.sqrt(part) / np.where(length > 0, length, 1)
    return out


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weight of each bucket from the number of documents that have it, counted over all of docs (column text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for part, found in rows_of(batches, "text"):
            has += (found > 0).sum(axis=0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.r_[n, has])], names=["bucket", "n"])

    n, has = 0, np.zeros(BUCKETS)
    for row in docs.select("text").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if row["bucket"] < 0:
            n = row["n"]
        else:
            has[row["bucket"]] = row["n"]
    return np.log((n + 1) / (has + 1)) + 1


def voters(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts, label) of at most VOTERS documents of docs (doc_id, text) that labels (doc_id, label) names.

    Those with the least hashes are taken, before any text moves: labels are joined to keys, and the chosen keys to
    texts. A doc_id with several labels has their mean; rows of one doc_id with one text are one.
    """
    own = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(VOTERS)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_th"), "text")
    chosen = keyed.drop("text").join(F.broadcast(own), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_th").limit(VOTERS)
    held = keyed.join(F.broadcast(cut(chosen)), ["doc_id", "_th"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_th"), part.column("label"), pa.array([x.astype(np.int32).tobytes() for x in found])], names=["doc_id", "_th", "label", "counts"])

    rows = held.mapInArrow(each, "doc_id long, _th long, label double, counts binary").dropDuplicates(["doc_id", "_th"]).orderBy("doc_id", "_th").collect()
    if not rows:
        return np.zeros((0, BUCKETS), dtype=np.int32), np.zeros(0)
    labels, found = np.array([r["label"] for r in rows]), np.empty((len(rows), BUCKETS), dtype=np.int32)
    for i in range(len(rows)):
        found[i], rows[i] = np.frombuffer(rows[i]["counts"], dtype=np.int32), None
    return found, labels


def latent(rows: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(BUCKETS, dimensions): the leading right singular vectors of rows, by subspace iteration from a fixed start."""
    start = np.random.default_rng(17).standard_normal((rows.shape[1], min(dimensions + 16, rows.shape[1]))).astype(np.float32)
    basis = start
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dimensions])


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def votes(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The weighted share of label 1 among the known unit vectors of largest cosine to each vector; without any positive cosine, among all."""
    cosines = vectors @ known.T
    k = min(neighbours, len(known))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    score = (weight * labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.clip(np.where(total > 0, score, labels.mean()), 0, 1)


class Model:
    """What a task needs to score texts; its size hangs on the parameters alone."""

    def __init__(self, idf: np.ndarray, found: np.ndarray, labels: np.ndarray) -> None:
        self.idf, self.labels = idf, labels
        # Some rows at once, so that the driver holds the counts and the vectors, and nothing else of that size.
        rows = np.empty(found.shape, dtype=np.float32)
        for at in range(0, len(found), 256):
            rows[at : at + 256] = weighted(found[at : at + 256], idf)
        self.basis = latent(rows) if len(rows) else None
        self.known = unit(rows @ self.basis) if len(rows) else None

    def scores(self, found: np.ndarray) -> np.ndarray:
        if self.known is None:
            return np.full(len(found), 0.5)
        return votes(unit(weighted(found, self.idf) @ self.basis), self.known, self.labels)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, label); bucket weights come from all of docs."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return Model(inverse_frequencies(own), *voters(own, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label"))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text), from its whole text alone; a null text counts as empty.

    An empty text is near to short texts and has a score as any other; without labelled documents all scores are 0.5.
    Equal texts have equal scores but for rounding. Other columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(held.value.scores(found), 6))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: a quarter of them, by doc_id; false for a null one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_voting(spark, sf_dir: str) -> DataFrame:
    """Each document's quality as the labels of the others tell it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
