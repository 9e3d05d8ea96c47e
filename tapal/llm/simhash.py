"""SimHash near-duplicates: 64-bit fingerprints, a binary trie self-join under a Hamming budget, and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import LOWER, binary, components, cut, small_batches, sorted_groups, stored

#: Rows of the trie join that one step of a task takes, unless a group is larger.
STEP_ROWS = 100_000
#: Near-duplicates by similarity: bins of a sketch of the shingles, of which BAND agree in a pair that is looked at;
#: texts of a similarity of 0.8 share one of the 16 bands with 0.9998.
BINS, BAND = 64, 4
#: The least exact Jaccard similarity of the shingle sets, as a fraction, and the share of equal bins (its estimate,
#: of a standard error of 0.05 there) from which a pair is compared exactly.
SIMILARITY, CANDIDATE = (4, 5), 0.6
#: Texts of a band's key that one task compares at once, with their shingles; a larger group is compared block by block.
HOT_ROWS = 1024
#: Stands for a null doc_id in keys.
MISSING = -(1 << 63)


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """The XXH64 hashes (seed 42) of the word shingles of UTF-8 text, repeats included."""
    words = data.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip((ends - lengths).tolist(), (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, shingle: int = 3) -> int:
    return majority(shingle_hashes(data, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, key: list | None = None) -> DataFrame:
    """The key columns (doc_id, unless others are given, all long) and fp of each row of docs; a null text counts as empty and has fingerprint 0."""
    held = docs.select(*(key or [F.col("doc_id").cast("long").alias("doc_id")]), F.col("text").cast("string").alias("text"))
    names = held.columns[:-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in binary(batch.column(len(names))).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found.view(np.int64))], names=[*names, "fp"])

    return held.mapInArrow(each, ", ".join(f"{x} long" for x in [*names, "fp"]))


def trie_pairs(values: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sorted distinct values whose lowest `width` bits differ in `budget` bits at most and whose higher bits agree.

    A node of the binary trie is a range of the sorted values. Node pairs go down one bit at a time; a pair's count
    of differing bits is kept, and the pair is dropped once it exceeds the budget or a side has no values.
    """
    top = values >> np.uint64(width)
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)
    last = np.r_[first[1:], len(values)].astype(np.int64)
    many = last - first > 1
    a0, a1 = first[many], last[many]
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), dtype=np.int8)
    left, right = [], []
    for bit in range(width - 1, -1, -1):
        if not len(a0):
            break
        mask = np.uint64(1) << np.uint64(bit)
        low = ~(mask | (mask - np.uint64(1)))
        mid_a = np.searchsorted(values, (values[a0] & low) | mask)
        mid_b = np.searchsorted(values, (values[b0] & low) | mask)
        same = a0 == b0
        other = ~same
        parts = [(a0, mid_a, b0, mid_b, err), (mid_a, a1, mid_b, b1, err), (a0, mid_a, mid_b, b1, err + 1)]
        parts.append((mid_a[other], a1[other], b0[other], mid_b[other], err[other] + 1))
        a0, a1, b0, b1, err = (np.concatenate([p[k] for p in parts]) for k in range(5))
        live = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, err = a0[live], a1[live], b0[live], b1[live], err[live]
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = np.bitwise_count(values[x] ^ values[y]) <= budget
            left.append(x[near])
            right.append(y[near])
            a0, a1, b0, b1, err = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], err[~leaf]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the links."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def links(fps: DataFrame, budget: int = 2, blocks: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints, enough to join all that differ in `budget` bits at most.

    Of `blocks` equal blocks at least blocks - budget agree in such a pair, so each fingerprint goes once to each
    choice of agreeing blocks; there the trie join runs over the other bits. A task emits one link for each
    fingerprint and its group's least, not all pairs.
    """
    size = 64 // blocks
    chosen = list(combinations(range(blocks), blocks - budget))
    moved = []
    for k, agree in enumerate(chosen):
        order = [*agree, *(b for b in range(blocks) if b not in agree)]
        bits = [F.shiftleft(F.shiftrightunsigned("fp", size * b).bitwiseAND(F.lit((1 << size) - 1)), size * (blocks - 1 - at)) for at, b in enumerate(order)]
        word = bits[0]
        for x in bits[1:]:
            word = word.bitwiseOR(x)
        moved.append(F.struct(F.lit(k).alias("k"), word.alias("w")))
    width = size * budget

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["k", "top"], STEP_ROWS):
            kinds, words, fp = (part.column(c).to_numpy() for c in ("k", "w", "fp"))
            for k in np.unique(kinds):
                at = np.flatnonzero(kinds == k)
                values = words[at].view(np.uint64)
                order = np.argsort(values, kind="stable")
                values, own = values[order], fp[at][order]
                label = spanning(len(values), *trie_pairs(values, width, budget))
                u = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(own[u]), pa.array(own[label[u]])], names=["u", "v"])

    dealt = fps.select("fp", F.explode(F.array(*moved)).alias("m")).select("fp", "m.k", "m.w").withColumn("top", F.shiftrightunsigned("w", width))
    return dealt.repartition("k", "top").sortWithinPartitions("k", "top").mapInArrow(join, "u long, v long").distinct()


def components_of(own: DataFrame, budget: int = 2, blocks: int = 4) -> DataFrame:
    """(fp, label, component_id) for the distinct fingerprints of own (doc_id, fp); the label names the component."""
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(nodes.select("fp"), budget, blocks))
    named = nodes.join(labels.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return cut(named.select("fp", "label").join(least, "label").select("fp", "label", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, blocks: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id reachable over links of fingerprints at `budget` or fewer differing bits,
    the row's own included. Null texts count as empty; all texts without words share fingerprint 0 and link like any
    other. Repeated rows each get their row. A null doc_id is no candidate for component_id, which is null only if
    no member has a doc_id. An empty table gives an empty result; other columns are not looked at.
    """
    own = cut(fingerprints(docs, shingle))
    return own.join(components_of(own, budget, blocks), "fp").select("doc_id", "fp", "component_id")


def sketch(h: np.ndarray) -> np.ndarray:
    """The least hash of each of BINS bins, shortened to 32 bits; an empty bin takes that of the next one that is not."""
    if not len(h):
        return np.zeros(BINS, dtype=np.uint32)
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed)
    bins = (mixed[order] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58)).astype(np.int64)
    own, first = np.unique(bins, return_index=True)
    value = (mixed[order[first]] >> np.uint64(16)).astype(np.uint32)
    at = np.searchsorted(own, np.arange(BINS)) % len(own)
    return value[at] + (own[at] != np.arange(BINS)) * np.uint32(7)


def bands(sketches: np.ndarray) -> np.ndarray:
    """The key of each band of each sketch."""
    out = np.zeros((len(sketches), BINS // BAND), dtype=np.uint64)
    for k in range(BAND):
        out = (out ^ sketches[:, k::BAND].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sketched(docs: DataFrame, shingle: int, key: list) -> DataFrame:
    """The key columns, node (a hash of the set of shingles), fp (the fingerprint, repeats included) and sketch of each row of docs."""
    held = docs.select(*key, F.col("text").cast("string").alias("text"))
    names = held.columns[:-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sketches = [], [], []
            for text in binary(batch.column(len(names))).to_pylist():
                h = shingle_hashes(text, shingle)
                own = np.unique(h)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                fps.append(majority(h))
                sketches.append(sketch(own).tobytes())
            told = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *told, pa.array(sketches, pa.binary())], names=[*names, "node", "fp", "sketch"])

    return held.mapInArrow(each, ", ".join(f"{x} long" for x in [*names, "node", "fp"]) + ", sketch binary")


def fingerprint_links(own: DataFrame, budget: int = 2, blocks: int = 4) -> DataFrame:
    """Links (u, v) between nodes of own (node, fp) that join all whose fingerprints differ in `budget` bits at most, by the trie join."""
    held = cut(own.select("node", "fp").distinct())
    least = cut(held.groupBy("fp").agg(F.min("node").alias("least")))
    same = held.join(least, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    side = lambda a, b: least.select(F.col("fp").alias(a), F.col("least").alias(b))
    near = links(least.select("fp"), budget, blocks).toDF("a", "b").join(side("a", "u"), "a").join(side("b", "v"), "b").where("u <> v").select("u", "v")
    return cut(same.union(near).distinct())


def banded(nodes: DataFrame) -> DataFrame:
    """(node, band) for each band of each node."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, BINS)).view(np.int64)
                own = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(keys.ravel())], names=["node", "band"])

    return nodes.select("node", "sketch").mapInArrow(each, "node long, band long").distinct()


def _filtered(pairs: DataFrame, sides: DataFrame, keep) -> DataFrame:
    """The pairs (u, v) whose two values, of the column x of sides (node, x), keep lets pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [keep(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    both = pairs.join(sides.select(F.col("node").alias("u"), "x"), "u").join(sides.select(F.col("node").alias("v"), F.col("x").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(each, "u long, v long")


def _agree(x: bytes, y: bytes) -> bool:
    return (np.frombuffer(x, dtype=np.uint32) == np.frombuffer(y, dtype=np.uint32)).mean() >= CANDIDATE


def _similar(x: bytes, y: bytes) -> bool:
    a, b = len(x) // 8, len(y) // 8
    if min(a, b) * SIMILARITY[1] < max(a, b) * SIMILARITY[0]:
        return False
    shared = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
    return shared * SIMILARITY[1] >= (a + b - shared) * SIMILARITY[0]


def shingle_sets(used: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, key: list) -> DataFrame:
    """(node, x) for the nodes of used: the bytes of their sets of shingles, made of one text of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingle_hashes(x, shingle)).tobytes() for x in binary(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(held, pa.binary())], names=["node", "x"])

    where = nodes.join(used, "node").select("node", "one._id", "one._th")
    texts = docs.select(*key, F.col("text").cast("string").alias("text")).join(where, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    return stored(texts.select("node", "text").mapInArrow(sets, "node long, x binary"), "shingles")


def exact_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, key: list) -> DataFrame:
    """The distinct pairs (u, v) of nodes whose sets of shingles have a Jaccard similarity of SIMILARITY or more."""
    likely = cut(_filtered(pairs.distinct(), nodes.select("node", F.col("sketch").alias("x")), _agree))
    used = likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()
    return cut(_filtered(likely, shingle_sets(used, nodes, docs, shingle, key), _similar))


def joining(labels: list[int], sketches: np.ndarray, sets: list[bytes], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of what has the labels, by all pairs whose sets are similar.

    Two that are in one component by then need not be compared. With side only pairs of different sides are looked at.
    """
    names, root = np.unique(np.array(labels), return_inverse=True)
    out = []
    for i in range(len(labels) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if side is not None:
            rest = rest[side[rest] != side[i]]
        for j in rest[(sketches[rest] == sketches[i]).mean(axis=1) >= CANDIDATE].tolist() if len(rest) else ():
            if root[i] != root[j] and _similar(sets[i], sets[j]):
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def links_in_bands(members: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, key: list) -> DataFrame:
    """Links (u, v) that join the labels of each band's key, all pairs of different labels told exactly.

    members: node, band, n (texts of the key) and label. A key goes to one task with its sketches and shingles; one of
    more than HOT_ROWS texts is cut into blocks by a hash, and each two of these go to a task, so that memory is bounded
    and no pair is left out.
    """
    several = members.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band")
    own = cut(members.join(several, "band"))
    sets = shingle_sets(own.select("node").distinct(), nodes, docs, shingle, key)
    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    block = F.pmod(F.xxhash64(F.lit(7), "node"), parts.cast("long")).cast("int")
    rows = own.select("node", "band", "label", parts.alias("parts"), block.alias("block"))
    # Block b meets each other block o in the task (least, most); one of a single block is alone.
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("node", "band", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    rows = rows.withColumn("task", F.xxhash64("band", "p", "q")).join(sets, "node").join(nodes.select("node", "sketch"), "node")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["task"], 1):
            task = part.column("task").to_numpy()
            edges = np.r_[0, np.flatnonzero(task[1:] != task[:-1]) + 1, len(task)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = part.slice(a, b - a)
                node, block = own.column("node").to_pylist(), own.column("block").to_numpy()
                sketches = np.frombuffer(b"".join(own.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, BINS)
                crossing = own.column("p")[0].as_py() != own.column("q")[0].as_py()
                found = joining(own.column("label").to_pylist(), sketches, own.column("x").to_pylist(), block if crossing else None)
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], names=["u", "v"])

    dealt = rows.select("task", "node", "label", "block", "p", "q", "sketch", "x").repartition("task").sortWithinPartitions("task")
    return cut(dealt.mapInArrow(each, "u long, v long").distinct())


def similar_components(own: DataFrame, docs: DataFrame, shingle: int, key: list) -> DataFrame:
    """(node, label) for the distinct nodes of own (_id, _th, node, fp, sketch): components over links of two kinds.

    Nodes whose fingerprints differ in two bits at most are linked by the trie join. It finds few of the pairs that are
    alike but for a fifth, so texts of a similarity of SIMILARITY or more are linked too: first each node of a band's key
    is compared with the least node there, so that a group of copies has one pair for each node. Then all pairs of a key
    that are not in one component by then are compared, within tasks: other pairs add no link.
    """
    near = fingerprint_links(own)
    nodes = cut(own.groupBy("node").agg(F.first("sketch").alias("sketch"), F.min(F.struct("_id", "_th")).alias("one")))
    dealt = cut(banded(nodes))
    sizes = dealt.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(dealt.join(sizes, "band"))
    first = exact_links(shared.where("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")), nodes, docs, shingle, key)
    first = near.union(first)
    labels = components(first).withColumnRenamed("u", "node")
    labelled = shared.join(labels, "node", "left").select("node", "band", "n", F.coalesce("label", "node").alias("label"))
    found = components(first.union(links_in_bands(labelled, nodes, docs, shingle, key)))
    return cut(nodes.select("node").join(found.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def representatives(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of docs for each component of texts with near fingerprints or similar shingles, with its columns unchanged: the smallest doc_id, nulls last.

    Of several texts with that doc_id the one with the least hash stays, and of rows with equal doc_id and text one.
    Texts without words, null ones too, are one component.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th")]
    own = cut(sketched(docs, shingle, key))
    names = similar_components(own, docs, shingle, key)
    best = F.min(F.struct((F.col("_id") == MISSING).alias("no_id"), "_id", "_th")).alias("best")
    keep = cut(own.select("_id", "_th", "node").join(names, "node").groupBy("label").agg(best).select("best._id", "best._th"))
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *key)
    return rows.join(keep, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_row.*")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")
