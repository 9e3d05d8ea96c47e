"""Numbers over a whole table without one task for all of it, and splits and samples made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapal.sources.documents import checkpointed

_IN_PART = 33


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the place of each row in the whole order, from 1 on.

    Rows are dealt to parts by ranges of the order and sorted there; the parts' sizes, as many as there are parts, give
    where each begins. The sorted parts are checkpointed, so that a lost one comes back the same.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _IN_PART).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_part", part)
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _IN_PART) - 1)) + 1).drop("_part", "_before", "_at")


def cumulated(df: DataFrame, order: list[Column], weight: str, name: str = "upto") -> DataFrame:
    """df with the sum of weight over the whole order up to each row, itself included; parts as in numbered."""
    part = F.shiftrightunsigned("_at", _IN_PART)
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", part)
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_at")


def ranked(df: DataFrame, strata: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in its stratum, from 1 on, and _size, the stratum's; a stratum may hold most rows."""
    out = numbered(df, [*map(F.col, strata), *order], "_number")
    first = out.groupBy(*strata).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_size"))
    return out.join(first, strata).withColumn(name, F.col("_number") - F.col("_first") + 1).drop("_number", "_first")


def exact_split(df: DataFrame, strata: list[str], order: list[Column], target: int, names: tuple[str, str] = ("dev", "sealed")) -> DataFrame:
    """df with split: of each stratum its half-even share of target is the first, the others the second; all in all exactly target are.

    Where the shares do not add up, the last rows in order of strata change sides.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    sizes = sizes.withColumn("share", F.least(F.bround(F.col("n") * target / F.sum("n").over(every)).cast("long"), F.col("n")))
    sizes = sizes.withColumn("drift", F.lit(target) - F.sum("share").over(every))
    behind = Window.orderBy(*strata).rowsBetween(1, Window.unboundedFollowing)
    spare = F.when(F.col("drift") > 0, F.col("n") - F.col("share")).otherwise(F.col("share"))
    sizes = sizes.withColumn("spare", spare).withColumn("after", F.coalesce(F.sum("spare").over(behind), F.lit(0)))
    sizes = sizes.withColumn("moved", F.greatest(F.least(F.abs("drift") - F.col("after"), F.col("spare")), F.lit(0)))
    shares = sizes.select(*strata, F.col("share").alias("_share"), F.col("moved").alias("_moved"), F.col("drift").alias("_drift"))
    out = ranked(df, strata, order, "_rank").join(shares, strata)
    first = F.when(F.col("_drift") > 0, (F.col("_rank") <= F.col("_share")) | (F.col("_rank") > F.col("_size") - F.col("_moved"))).otherwise(F.col("_rank") <= F.col("_share") - F.col("_moved"))
    return out.withColumn("split", F.when(first, names[0]).otherwise(names[1])).drop("_rank", "_size", "_share", "_moved", "_drift")


def flagged_first(df: DataFrame, flag: str, order: list[Column], target: int) -> DataFrame:
    """All flagged rows, filled up to target with others in order; more flagged ones than that all stay."""
    return numbered(df, [F.desc(flag), *order], "_number").where(F.col(flag) | (F.col("_number") <= target)).drop("_number")


def study_design(tasks: DataFrame, order: list[Column], participants: int, each: int) -> DataFrame:
    """tasks with participant and condition: disjoint slices of the order, conditions in turn, the first one by participant."""
    out = numbered(tasks, order, "_r").withColumn("_r", F.col("_r") - 1).where(F.col("_r") < participants * each)
    who = F.floor(F.col("_r") / each)
    return out.withColumn("participant", who + 1).withColumn("condition", F.when((F.col("_r") % each + who) % 2 == 0, "assisted").otherwise("manual")).drop("_r")
