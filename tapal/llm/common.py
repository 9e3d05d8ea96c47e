"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a Python task turns into numpy arrays at once, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: ASCII lower-casing, and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tapal-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again; for tables that hold texts."""
    path = f"{shared_dir(df.sparkSession)}/tapal-{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows: rows are whole texts, and a batch is in a worker's memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def binary(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes, nulls as empty."""
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have SLICE_BYTES at most, or one row."""
    if not batch.num_rows:
        return
    sizes = np.array([len(x) for x in binary(batch.column(column)).to_pylist()], dtype=np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > SLICE_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    yield batch.slice(first)


def text_key() -> list:
    """The key of a row of documents: its doc_id and a hash of its text, both null-safe (see row_key)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.col("text")).alias("_th")]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by keys, at_least rows at once; without keys any rows are a group.

    Memory is bounded by that or the largest group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        if not keys:
            yield whole
            held, rows = [], 0
            continue
        differs = np.zeros(whole.num_rows, dtype=bool)
        for key in keys:
            values = whole.column(key).to_numpy(zero_copy_only=False)
            differs[1:] |= values[1:] != values[:-1]
        last = int(np.flatnonzero(differs)[-1]) if differs.any() else 0
        if last:
            yield whole.slice(0, last)
            held, rows = whole.slice(last).to_batches(), whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (u, v): rows (u, label), label the least u reachable.

    Label minima go along the edges and then along the labels, so that the rounds grow with the logarithm of a
    component's diameter. Each round only groups with partial sums and joins on keys that Spark can split.
    """
    once = edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    # Each edge (u, v) becomes (m, v) with m the least neighbour of u, and (u, m): many edges of a dense group become one.
    least = once.union(once.select(F.col("v"), F.col("u"))).groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    fewer = once.join(least, "u").select(F.col("m").alias("u"), "v").union(least.select(F.col("m"), F.col("u"))).where("u != v").distinct()
    both = cut(fewer.union(fewer.select(F.col("v"), F.col("u"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        seen = labels.join(near, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("u").alias("label"), F.col("label").alias("up"))
        new = cut(seen.join(up, "label").select("u", F.least("label", "up").alias("label"), "was"))
        moved = new.where("label != was").limit(1).count()
        labels = new.select("u", "label")
        if not moved:
            return labels
