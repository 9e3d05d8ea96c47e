"""SentencePiece encoding and decoding, and token counts, over DataFrames of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapal.llm import unigram
from tapal.llm.common import binary, slices, small_batches

#: The vocabulary that the registered queries use; every operator takes a path.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct pre-tokens that a task remembers; beyond that it forgets all and goes on.
REMEMBERED = 300_000
#: Sorted pre-tokens that share one trie, which bounds its memory.
TRIE_WORDS = 16_384


def load(path: str = PIECES, zipf: bool = True) -> unigram.Model:
    """The pieces of a model file. Scores that are merge ranks are no log scores: zipf puts those of Zipf's law in their place."""
    with open(path, "rb") as f:
        pieces = unigram.read_pieces(f.read())
    return unigram.Model(unigram.zipf_scores(pieces) if zipf else pieces)


class Memory:
    """What is known of pre-tokens in a task: each new distinct one is computed once, new ones of a slice in tries of neighbours in order."""

    def __init__(self, compute: Callable[[list[bytes]], list], alone: Callable[[bytes], object]):
        self.compute, self.alone, self.known = compute, alone, {}

    def of(self, words: list[list[bytes]]) -> dict:
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*words)
        short = sorted(w for w in new if len(w) <= unigram.LONG)
        for part in (short[at : at + TRIE_WORDS] for at in range(0, len(short), TRIE_WORDS)):
            self.known.update(zip(part, self.compute(part)))
        # Long ones are not remembered beyond the slice: there is no bound to their size.
        long = {w: self.alone(w) for w in new if len(w) > unigram.LONG}
        return {**self.known, **long} if long else self.known


def _passed(df: DataFrame, column: str, added: str, value: Callable[[unigram.Model], Callable[[pa.RecordBatch], pa.Array]], model: unigram.Model) -> DataFrame:
    """df with one more column that is made from one of its own, slice by slice."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    name, kind = added.split(" ", 1)
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    at = names.index(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = value(shared.value)
        for batch in batches:
            rows = batch.column(0)
            both = pa.RecordBatch.from_arrays([rows, rows.flatten()[at]], names=["_row", "_in"])
            for part in slices(both, "_in") if not pa.types.is_nested(both.column(1).type) else [both]:
                yield pa.RecordBatch.from_arrays([part.column(0), make(part)], names=["_row", name])

    out = held.mapInArrow(each, f"_row {held.schema['_row'].dataType.simpleString()}, {name} {kind}")
    return out.select(*[F.col(f"_row.`{c}`") for c in names if c != name], name)


def encode(df: DataFrame, model: unigram.Model, column: str = "text") -> DataFrame:
    """df with ids, the piece ids of the best segmentation of each whole text.

    Spaces count as the mark and a text starts with one; nothing is normalized. A null text has null ids, an empty one
    none. Rows are independent, so repeated rows have equal ids; an own column ids is replaced.
    """

    def value(model: unigram.Model):
        memory = Memory(lambda words: [np.array(x, dtype=np.int32).tobytes() for x in unigram.encode_words(model, words)], lambda word: unigram.long_ids(model, word).tobytes())

        def make(part: pa.RecordBatch) -> pa.Array:
            lost = part.column(1).is_null().to_numpy(zero_copy_only=False)
            words = [unigram.pretokens(x, splits=model.splits) for x in binary(part.column(1)).to_pylist()]
            known = memory.of(words)
            joined = [b"".join([known[w] for w in x]) for x in words]
            ends = np.cumsum([0] + [len(x) // 4 for x in joined]).astype(np.int32)
            ids = np.frombuffer(b"".join(joined), dtype=np.int32)
            offsets = pa.array(ends, mask=np.r_[lost, False]) if lost.any() else pa.array(ends)
            return pa.ListArray.from_arrays(offsets, pa.array(ids))

        return make

    return _passed(df.withColumn(column, F.col(f"`{column}`").cast("string")), column, "ids array<int>", value, model)


def decode(df: DataFrame, model: unigram.Model, column: str = "ids") -> DataFrame:
    """df with decoded, the text of the ids: marks become spaces, the first one goes, byte pieces join to UTF-8. Null ids give null."""

    def value(model: unigram.Model):
        def make(part: pa.RecordBatch) -> pa.Array:
            ids = part.column(1)
            flat, ends, lost = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist(), ids.is_null().to_pylist()
            get = model.output.__getitem__
            out = []
            for a, b, none in zip(ends, ends[1:], lost):
                text = b"".join(map(get, flat[a:b].tolist()))
                out.append(None if none else (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
            return pa.array(out, pa.string())

        return make

    return _passed(df, column, "decoded string", value, model)


def count(df: DataFrame, model: unigram.Model, column: str = "text") -> DataFrame:
    """df with n_tokens, the number of pieces of each whole text; a null text has null.

    Distinct pre-tokens go into one trie, whose nodes have their forward score computed once and whose terminals hold
    their counts; a text's count is the sum over its pre-tokens. A pre-token of over LONG bytes shares no more than its
    first bytes with others and is walked by itself.
    """

    def value(model: unigram.Model):
        memory = Memory(lambda words: unigram.count_words(model, words).tolist(), lambda word: unigram.walk_long(model, word)[1])

        def make(part: pa.RecordBatch) -> pa.Array:
            words = [unigram.pretokens(x, splits=model.splits) for x in binary(part.column(1)).to_pylist()]
            known = memory.of(words)
            counts = np.array([sum([known[w] for w in x]) for x in words], dtype=np.int64)
            return pa.array(counts, mask=part.column(1).is_null().to_numpy(zero_copy_only=False))

        return make

    return _passed(df.withColumn(column, F.col(f"`{column}`").cast("string")), column, "n_tokens long", value, model)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = load()
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = decode(encode(docs, model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count(docs, load()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")
