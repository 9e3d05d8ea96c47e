"""Merkle manifest of a dataset: a tree of digests for each group, a tree over their roots, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import cut
from tapal.operators.ranking import numbered

#: Consecutive nodes that become one.
FANOUT = 8
#: Groups whose first numbers are broadcast at most, some 100 bytes each; more of them are joined by key.
BROADCAST_GROUPS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length before it, so that neighbours cannot trade bytes; null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """The levels of the trees whose leaves are nodes: (tree, i, n, digest), i from 0 and n the tree's nodes on the level.

    Parents also have children, the digests that they are made of. Each level is an eighth of the one below and is
    checkpointed; a key of the grouping has FANOUT rows at most, whatever the tree's size.
    """
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.floor(F.col("i") / FANOUT).alias("i")
        runs = levels[-1].where("n > 1").groupBy("tree", run).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "digest"))).alias("run"))
        parents = runs.withColumn("children", F.transform("run", lambda x: x["digest"]))
        levels.append(cut(parents.select("tree", "i", F.ceil(F.col("n") / FANOUT).alias("n"), digest(_joined(F.col("children"))).alias("digest"), "children")))
        most = -(-most // FANOUT)
    return levels


def descended(levels: list[DataFrame], tops: DataFrame | None) -> DataFrame:
    """The lowest level's rows with subroot, root and path, the steps from the row's own level up to the root.

    A step has the digests of the run's other nodes before and after. tops gives the steps above each tree's top as
    (tree, above, root); without it the only tree's top is the root. Steps are appended level by level from the top,
    so that each join takes a table to one of an eighth of its rows.
    """
    up = None
    for level in reversed(levels):
        top = level.where("n = 1").withColumn("subroot", F.col("digest"))
        if tops is None:
            found = top.withColumn("root", F.col("digest")).withColumn("path", F.expr("cast(array() as array<struct<before:string,after:string>>)"))
        else:
            found = top.join(tops, "tree").withColumnRenamed("above", "path")
        if up is not None:
            over = up.select("tree", F.col("i").alias("_run"), F.col("children").alias("_run_of"), F.col("path").alias("_above"), "subroot", "root")
            inner = level.where("n > 1").withColumn("_run", F.floor(F.col("i") / FANOUT)).join(over, ["tree", "_run"])
            at = (F.col("i") % FANOUT).cast("int")
            step = F.struct(_joined(F.slice("_run_of", F.lit(1), at)).alias("before"), _joined(F.slice("_run_of", at + 2, F.lit(FANOUT))).alias("after"))
            inner = inner.withColumn("path", F.concat(F.array(step), F.col("_above"))).drop("_run", "_run_of", "_above")
            found = found.unionByName(inner)
        up = found
    return up


def indexed(rows: DataFrame) -> DataFrame:
    """rows with i, the place from 0 in their tree by (doc_id, digest), and n, the tree's rows.

    Rows are numbered by ranges of the whole order, so that a tree with most rows is no single task; the first number
    of each tree is then taken off. Rows that agree in all of these are told apart by where they were checkpointed.
    """
    held = cut(rows.withColumn("_u", F.monotonically_increasing_id()))
    placed = numbered(held, [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("_u")], "_number")
    first = cut(placed.groupBy("tree").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("n")))
    few = first.count() <= BROADCAST_GROUPS
    return cut(placed.join(F.broadcast(first) if few else first, "tree").withColumn("i", F.col("_number") - F.col("_first")).drop("_number", "_first", "_u"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, altered) for each row of docs: its digest, its group's and the whole root, and its steps.

    A row's digest is over the named columns, each with its length; other columns are ignored, whatever their names. Groups are in bytewise
    order with null first, rows of a group in order of doc_id with null first, then of their digest. Repeated rows are
    leaves of their own with equal digests. altered is the digest of the row with the columns in changed put in place of
    its own, null where it is the same. An empty table has no rows and no root.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in columns])
    leaf = digest(*[framed(F.col(c)) for c in columns])
    other = digest(*[framed((changed or {}).get(c, F.col(c))) for c in columns]) if changed else F.lit(None).cast("string")
    tree = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = own.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("digest"), other.alias("altered"))
    leaves = leaves.withColumn("altered", F.when(F.col("altered") != F.col("digest"), F.col("altered")))
    levels = levels_of(indexed(leaves))
    tops = [level.where("n = 1").select("tree", "digest") for level in levels]
    subroots = tops[0]
    for x in tops[1:]:
        subroots = subroots.unionByName(x)
    above = levels_of(indexed(subroots.select(F.col("tree").alias("group"), F.lit("").alias("tree"), "digest").withColumn("doc_id", F.col("group"))))
    over = descended(above, None).select(F.col("group").alias("tree"), F.col("path").alias("above"), "root")
    return descended(levels, cut(over)).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "altered")


def folded(start: Column, path: Column) -> Column:
    """The root that a digest and its steps lead to."""
    return F.aggregate(path, start, lambda h, step: digest(step["before"], h, step["after"]))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Each document's leaf, roots and proof, and what its proof says of it after a third of the texts are lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    found = manifest(docs, changed={"text": tampered})
    siblings = _joined(F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    out = found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FRAMED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))
_BODY = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0})) || ':' || {0} END"
_C = "xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1)) ELSE 0 END)"
_CRC = f"xor(list_reduce(range(8 * length(CAST(doc_id AS VARCHAR))), lambda c, k: xor({_C} >> 1, 3988292384 * ({_C} & 1)), 4294967295), 4294967295)"
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents),
l AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, sha256({_FRAMED} || {_BODY.format("text")}) AS h, sha256({_FRAMED} || {_BODY.format("other")}) AS f FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
v AS (SELECT tree, 0 AS k, i, n, h FROM p UNION ALL SELECT tree, k + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM v WHERE n > 1 GROUP BY tree, k, i // 8),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM v WHERE n = 1),
u AS (SELECT 0 AS k, i, n, subroot AS h FROM s UNION ALL SELECT k + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 8),
vr AS (SELECT tree, k, i // 8 AS run, list(h ORDER BY i) AS hs FROM v WHERE n > 1 GROUP BY ALL),
ur AS (SELECT k, i // 8 AS run, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY ALL),
w AS (SELECT doc_id, h AS leaf, tree, 0 AS k, i, n, f AS acc, '' AS proof, row_number() OVER () AS id FROM p
  UNION ALL SELECT doc_id, leaf, w.tree, w.k + 1, i // 8, (n + 7) // 8, sha256(array_to_string(hs[:i % 8], '') || acc || array_to_string(hs[i % 8 + 2:], '')), proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], ''), id
  FROM w JOIN vr ON w.tree = vr.tree AND w.k = vr.k AND w.i // 8 = vr.run WHERE n > 1),
x AS (SELECT doc_id, leaf, subroot, 0 AS k, s.i, s.n, acc, proof, id FROM w JOIN s ON w.tree = s.tree WHERE w.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, x.k + 1, i // 8, (n + 7) // 8, sha256(array_to_string(hs[:i % 8], '') || acc || array_to_string(hs[i % 8 + 2:], '')), proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], ''), id
  FROM x JOIN ur ON x.k = ur.k AND x.i // 8 = ur.run WHERE n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM x, (SELECT h AS root FROM u WHERE n = 1) WHERE n = 1
"""
