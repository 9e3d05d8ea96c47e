"""A sealed evaluation: what must hold before the examples are opened, and the metrics of all slices in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import evaluation as E
from tapal.operators import sinks
from tapal.operators.ranking import numbered
from tapal.sources.documents import checkpointed

#: Digests that one digest is made of.
RANGE = 1000


class NotAllowed(ValueError):
    """A run that must not go on."""


def ordered_digest(items: DataFrame, order: list[Column], digest: str) -> str:
    """The digest of a whole table from its rows' digests, in order.

    RANGE neighbours become one digest, and so on until one is left, so that no task reads the whole table. The
    digest of no rows is that of the empty text.
    """
    level = checkpointed(numbered(items, order, "_n").select((F.col("_n") - 1).alias("i"), F.col(digest).alias("h")))
    left = level.count()
    if not left:
        return "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
    while True:
        runs = level.groupBy(F.floor(F.col("i") / RANGE).alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "h"))).alias("run"))
        level = checkpointed(runs.select("i", F.sha2(F.array_join(F.transform("run", lambda x: x["h"]), "").cast("binary"), 256).alias("h")))
        left = -(-left // RANGE)
        if left == 1:
            return level.head()["h"]


def item_problems(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, problem) of items whose digests or places are not as declared; both have key, place and sha256.

    repeated (a key that either side has more than once, which is not compared), missing, unlisted, digest_differs, out_of_order.
    """
    one = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.min("place").alias(f"{name}_place"), F.min("sha256").alias(f"{name}_sha"))
    both = one(found, "f").join(one(declared, "d"), key, "full_outer")
    checks = {
        "repeated": (F.col("f_n") > 1) | (F.col("d_n") > 1), "missing": F.col("f_n").isNull(), "unlisted": F.col("d_n").isNull(),
        "digest_differs": (F.col("f_n") == 1) & (F.col("d_n") == 1) & (F.col("f_sha") != F.col("d_sha")), "out_of_order": (F.col("f_n") == 1) & (F.col("d_n") == 1) & (F.col("f_place") != F.col("d_place")),
    }
    return both.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))).alias("problem"))


def file_problems(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, problem) of files that are not as a manifest (path, bytes, sha256) says: missing, unlisted, bytes_differ, sha256_differs."""
    f = found.select("path", F.col("bytes").alias("fb"), F.col("sha256").alias("fs"))
    d = declared.select("path", F.col("bytes").alias("db"), F.col("sha256").alias("ds"))
    checks = {"missing": F.col("fb").isNull(), "unlisted": F.col("db").isNull(), "bytes_differ": F.col("fb") != F.col("db"), "sha256_differs": F.lower("fs") != F.lower("ds")}
    return f.join(d, "path", "full_outer").select("path", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))).alias("problem"))


def release_manifest(spark: SparkSession, path: str, versions: dict[str, str], openings: int = 1) -> tuple[DataFrame, DataFrame]:
    """(files, declared): the files under a folder as (path, bytes, sha256) with paths from the folder on, and (name, value)
    of the declared versions and the openings that are allowed."""
    root = F.lit(f"{path.rstrip('/').rsplit('/', 1)[-1]}/")
    files = sinks.manifest(spark, path).withColumn("path", F.element_at(F.split("path", root, 2), -1))
    return files, spark.createDataFrame([*sorted(versions.items()), ("authorized_openings", str(openings))], "name string, value string")


def version_problems(found: dict[str, str], declared: DataFrame) -> DataFrame:
    """(name, problem) of versions in use that are not the declared ones."""
    used = declared.sparkSession.createDataFrame(sorted(found.items()), "name string, used string")
    both = used.join(declared.where("name <> 'authorized_openings'"), "name", "full_outer")
    problem = F.when(F.col("used").isNull(), "not_in_use").when(F.col("value").isNull(), "undeclared").when(F.col("used") != F.col("value"), "differs")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def required(**problems: DataFrame) -> None:
    """NotAllowed unless every table of problems is empty; the message names the tables and one row of each."""
    first = {name: df.head() for name, df in problems.items()}
    if wrong := {name: row for name, row in first.items() if row is not None}:
        raise NotAllowed("; ".join(f"{name}: {row.asDict()}" for name, row in wrong.items()))


def opened(examples: DataFrame, items: DataFrame, declared: DataFrame, key: str, digests: dict[str, str], openings: int) -> DataFrame:
    """examples, if everything agrees: each item's digest and place, the digest of the whole in every manifest of
    digests (name to declared digest), and at least one opening; NotAllowed otherwise, before any row is given out.

    items has key, place and sha256 of the examples.
    """
    if openings < 1:
        raise NotAllowed("no opening is allowed")
    required(items=item_problems(items, declared, key))
    whole = ordered_digest(items, [F.col("place"), F.col(key)], "sha256")
    if wrong := sorted(name for name, value in digests.items() if value != whole):
        raise NotAllowed(f"the examples are not those of {', '.join(wrong)}")
    return examples


def published(report: DataFrame, path: str) -> None:
    """Writes a run's report; where there is one already, nothing is written and NotAllowed is raised."""
    from pyspark.errors import AnalysisException

    try:
        report.write.mode("error").json(path)
    except AnalysisException as error:
        raise NotAllowed(f"a report is at {path} already") from error


def slice_metrics(examples: DataFrame, gold: str, predicted: str, by: str) -> DataFrame:
    """(slice, name, examples, tp, fp, fn, precision, recall, f1, exact, exact_rate) over all examples, by span type and by a column.

    Both span lists are told within the row and meet there, so that the only shuffles are those of two grouping sets:
    one over the spans, one over the examples. exact counts examples whose spans of critical types are the same; it and
    the number of examples are null for types. Types without spans have zeros; a null value of the column is a slice of its own.
    """
    g, p = E.span_structs(gold, S.FIELDS), E.span_structs(predicted, S.FIELDS)
    name = F.coalesce(F.col(by).cast("string"), F.lit("(null)"))
    rows = examples.select(name.alias("_by"), g.alias("_g"), p.alias("_p"))
    spans = rows.select("_by", "_g", "_p", F.explode(F.array_union("_g", "_p")).alias("s")).select("_by", F.col("s.type").alias("_type"), F.array_contains("_g", F.col("s")).alias("_in_g"), F.array_contains("_p", F.col("s")).alias("_in_p"))
    by_col, type_col = F.col("_by"), F.col("_type")
    counts = [F.count_if(F.col("_in_g") & F.col("_in_p")).alias("tp"), F.count_if(~F.col("_in_g")).alias("fp"), F.count_if(~F.col("_in_p")).alias("fn")]
    kind = lambda t: F.when(F.grouping("_by") == 0, by).when(t, "type").otherwise("all")
    found = spans.groupingSets([[], [by_col], [type_col]], by_col, type_col).agg(*counts, kind(F.grouping("_type") == 0).alias("slice")).select("slice", F.coalesce("_by", "_type", F.lit("all")).alias("name"), "tp", "fp", "fn")
    critical = lambda x: F.array_sort(F.filter(x, lambda s: s["type"].isin(S.CRITICAL_FIELDS)))
    each = rows.select("_by", (critical("_g") == critical("_p")).alias("_same")).groupingSets([[], [by_col]], by_col).agg(F.count(F.lit(1)).alias("examples"), F.count_if("_same").alias("exact"), kind(F.lit(False)).alias("slice"))
    each = each.select("slice", F.coalesce("_by", F.lit("all")).alias("name"), "examples", "exact")
    types = examples.sparkSession.createDataFrame([("type", t) for t in S.FIELDS], "slice string, name string")
    slices = each.unionByName(types, allowMissingColumns=True)
    out = slices.join(found, ["slice", "name"], "left").na.fill(0, ["tp", "fp", "fn"])
    return E._scores(out).withColumn("exact_rate", S.ratio(F.col("exact"), F.col("examples"))).select("slice", "name", "examples", "tp", "fp", "fn", "precision", "recall", "f1", "exact", "exact_rate")


def outcome_counts(processed: DataFrame) -> DataFrame:
    """(kind, name, n): how many processed addresses have each gate status and how many issues each reason code, in one pass."""
    status = F.array(F.struct(F.lit("status").alias("kind"), F.col("gate_status").alias("name")))
    codes = F.transform("issues", lambda x: F.struct(F.lit("reason").alias("kind"), x["reason_code"].alias("name")))
    return processed.select(F.explode(F.concat(status, codes)).alias("o")).groupBy("o.kind", "o.name").agg(F.count(F.lit(1)).alias("n"))


def shared_bases(rows: DataFrame, base: str, split: str, apart: list[tuple[str, str]]) -> DataFrame:
    """(base, one, other): bases that two splits share which are to be kept apart; one pass over all splits."""
    pairs = F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("other")) for a, b in apart])
    held = rows.groupBy(base).agg(F.collect_set(split).alias("_splits"))
    both = F.filter(pairs, lambda x: F.array_contains("_splits", x["one"]) & F.array_contains("_splits", x["other"]))
    return held.select(base, F.explode(both).alias("x")).select(base, "x.one", "x.other")


def boundary_problems(rows: DataFrame, path: str, split: str, base: str, allowed: str = "real_dev") -> DataFrame:
    """(base, problem) of a payload that may be looked at only if it is of one split: sealed_path, no_examples, other_split, no_base, repeated_base."""
    spark = rows.sparkSession
    whole = [(None, "sealed_path")] if "sealed" in path.replace("\\", "/").casefold() else []
    whole += [(None, "no_examples")] if rows.isEmpty() else []
    each = rows.select(F.col(base).cast("string").alias(base), F.explode(F.array_compact(F.array(F.when(~F.col(split).eqNullSafe(F.lit(allowed)), F.lit("other_split")), F.when(F.col(base).isNull(), F.lit("no_base"))))).alias("problem"))
    twice = rows.where(F.col(base).isNotNull()).groupBy(base).count().where("count > 1").select(F.col(base).cast("string").alias(base), F.lit("repeated_base").alias("problem"))
    return spark.createDataFrame(whole, f"{base} string, problem string").unionByName(each).unionByName(twice)
