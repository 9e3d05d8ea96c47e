"""Chat formatting: snapshots of a conversation that a longer one begins with are dropped, the rest is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapal.llm.common import cut

#: Turns whose running hash one task adds up; a longer conversation is several blocks.
BLOCK_TURNS = 1024
#: Turn numbers that a piece of a rendered conversation spans.
PART_TURNS = 256
#: What opens a mark of the chat format, and what stands for it in texts and roles, so that no text forges a turn.
MARK, PLAIN = "<|", "< |"
#: Two independent 64-bit sums stand for a prefix.
SEEDS = (0x51ED270B, 0x2545F491)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, p0, p1, n): for each turn the hash and number of all turns up to it.

    A prefix's hash is a sum over its turns, so it goes on turn by turn, and in blocks: sums of whole blocks come
    first, then the running sums within each. No conversation has to be in one task.
    """
    hashes = [F.xxhash64(F.lit(s), F.col("turn"), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()) for s in SEEDS]
    # Repeated rows of a turn count as one; different rows of one turn add up, in any order. Sums stay within 42 bits a part.
    own = turns.select("conv_id", "turn", *[h.alias(f"h{k}") for k, h in enumerate(hashes)]).distinct()
    part = {f"s{k}{j}": F.sum(F.shiftrightunsigned(f"h{k}", 32 * j).bitwiseAND(F.lit(0xFFFFFFFF))) for k in (0, 1) for j in (0, 1)}
    each = own.groupBy("conv_id", "turn").agg(*[v.alias(k) for k, v in part.items()], F.count(F.lit(1)).alias("rows"))
    each = each.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    sums = [*part, "rows"]
    blocks = each.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in sums])
    upto = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.select("conv_id", "block", "turn", *[F.sum(c).over(upto).alias(c) for c in sums]).join(base, ["conv_id", "block"])
    total = {c: F.col(c) + F.col(f"b_{c}") for c in sums}
    mixed = [F.xxhash64(F.lit(k), total[f"s{k}0"], total[f"s{k}1"], total["rows"]).alias(f"p{k}") for k in (0, 1)]
    return run.select("conv_id", "turn", *mixed, total["rows"].alias("n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, last_turn, kept): kept is false for a snapshot of a conversation that goes on elsewhere.

    A conversation is a snapshot if another has the same rows up to its last turn and then more, or is equal to it and
    has a smaller conv_id. Rows without conv_id or turn belong to no conversation and are left out. Null roles and
    texts are values of their own, repeated rows count once, and other columns are not looked at.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    prefixes = cut(prefix_hashes(turns.where("conv_id is not null and turn is not null")))
    ends = prefixes.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    last = prefixes.join(ends, "conv_id")
    whole = cut(last.where("turn = last_turn").select("conv_id", "last_turn", "n", "p0", "p1"))
    inner = last.where("turn < last_turn").select("p0", "p1").distinct()
    # Equal conversations become one before they meet the prefixes, so that no key is in many rows.
    maximal = whole.groupBy("p0", "p1").agg(F.min("conv_id").alias("conv_id")).join(inner, ["p0", "p1"], "left_anti").select("conv_id", F.lit(True).alias("kept"))
    return whole.join(maximal, "conv_id", "left").select("conv_id", F.col("n").alias("n_turns"), "last_turn", F.coalesce("kept", F.lit(False)).alias("kept"))


def rendered(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered) for the turns of the kept conversations, one piece of chat markup a turn.

    A null role is user, a null text empty; MARK in either becomes PLAIN. Repeated rows of a turn count once.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("turn is not null").distinct()
    own = turns.join(kept.where("kept").select("conv_id"), "conv_id", "left_semi")
    safe = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit(MARK), F.lit(PLAIN))
    piece = F.concat(F.lit("<|im_start|>"), safe("role", "user"), F.lit("\n"), safe("text", ""), F.lit("<|im_end|>\n"))
    return own.select("conv_id", "turn", "role", "text", piece.alias("rendered"))


def joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, rendered): whole conversations, in pieces of PART_TURNS turn numbers that follow each other.

    Turns are in order of turn, then of role and text. A conversation of fewer turns is one row; a longer one is its
    rows in order of part, so that none has to fit in one row.
    """
    part = F.floor(F.col("turn") / PART_TURNS).alias("part")
    own = pieces.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns"))
    return own.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("rendered"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kept = collapse(conversations)
    return joined(rendered(conversations, kept)).join(kept.select("conv_id", "n_turns"), "conv_id").select("conv_id", "part", "n_turns", "rendered")


OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT conv_id, turn, role, text, md5(concat_ws('|', turn, coalesce(role, '~'), coalesce(text, '~'))) AS h FROM t),
p AS (SELECT conv_id, turn, string_agg(h, '' ORDER BY turn, h) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre FROM r),
e AS (SELECT conv_id, max(turn) AS last_turn, count(*) AS n_turns FROM t GROUP BY conv_id),
w AS (SELECT DISTINCT p.conv_id, e.n_turns, p.pre FROM p JOIN e ON p.conv_id = e.conv_id AND p.turn = e.last_turn),
i AS (SELECT DISTINCT p.pre FROM p JOIN e ON p.conv_id = e.conv_id AND p.turn < e.last_turn),
k AS (SELECT min(conv_id) AS conv_id, n_turns FROM w WHERE pre NOT IN (SELECT pre FROM i) GROUP BY pre, n_turns)
SELECT t.conv_id, CAST(floor(t.turn / 256) AS BIGINT) AS part, k.n_turns, string_agg('<|im_start|>' || replace(coalesce(t.role, 'user'), '<|', '< |') || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.turn, t.role NULLS FIRST, t.text NULLS FIRST) AS rendered
FROM t JOIN k ON t.conv_id = k.conv_id GROUP BY ALL
"""
