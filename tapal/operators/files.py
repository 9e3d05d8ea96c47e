"""Files of a folder as rows: which are worth reading, what a policy says of them, and the hierarchy as one document and as a table by code."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators.ranking import numbered
from tapal.sources.documents import checkpointed

#: Folders and suffixes without source to review, and the most bytes of a file that is read.
SKIPPED_PARTS = ["node_modules", ".next", "__pycache__", ".git", "coverage"]
SKIPPED_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".xls", ".xlsx", ".pbf", ".safetensors", ".bin", ".pt", ".onnx", ".woff", ".woff2"]
SCANNED_BYTES = 6 * 1024 * 1024
#: Folders that must not be there, the most bytes of a file, and forms of secrets.
FORBIDDEN_PARTS = ["raw", "private", "checkpoints", "models", "secrets"]
ALLOWED_BYTES = 10 * 1024 * 1024
SECRETS = ["(?i)(?:api[_-]?key|secret|token)\\s*=\\s*['\"][^'\"\\s]{8,}", "-----BEGIN (?:RSA|OPENSSH|EC) PRIVATE KEY-----", "gh" + "p_[A-Za-z0-9]{20,}", "sk" + "-[A-Za-z0-9]{20,}"]
#: The version that a hierarchy document has, and the buckets of the table by code.
DOCUMENT_VERSION, BUCKETS = "1.0.0", 16


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def suffix(path: Column) -> Column:
    """The last suffix of a path's name in lower case, empty without one; a leading full stop begins none."""
    return F.lower(F.regexp_extract(F.element_at(_parts(path), -1), "[^.](\\.[^.]+)$", 1))


def scannable(path: Column, size: Column, most: int = SCANNED_BYTES) -> Column:
    """Whether a file, by its path from the root on and its size, is source that is to be read."""
    skipped = F.arrays_overlap(_parts(path), F.array(*map(F.lit, SKIPPED_PARTS)))
    return ~skipped & ~suffix(path).isin(SKIPPED_SUFFIXES) & (size <= most)


def read_scannable(spark: SparkSession, root: str, most: int = SCANNED_BYTES) -> DataFrame:
    """(path, size, text) of the files under root that scannable() names; paths are from root on.

    The choice is made of the files' metadata, so that Spark prunes the others from the list and never opens them.
    Bytes that are no UTF-8 are left to the caller (is_valid_utf8).
    """
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root)
    tail = re.escape(quote(root.split("://")[-1].rstrip("/")) + "/")
    relative = F.element_at(F.split(F.col("_metadata.file_path"), tail, 2), -1)
    return files.where(scannable(relative, F.col("_metadata.file_size"), most)).select(relative.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def policy_problems(files: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(path, problem): forbidden_location, too_large, possible_secret, missing; files has path, size and text.

    A file may be at a forbidden place and have another problem too. One that is too large is not searched, nor is one
    that is no UTF-8, and of several secrets the first is enough. A required path is there if it is a file or a folder with one.
    """
    parts = F.transform(_parts(F.col("path")), lambda p: F.lower(p))
    forbidden = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, FORBIDDEN_PARTS)))
    large = F.col("size") > ALLOWED_BYTES
    secret = ~large & F.coalesce(F.expr("is_valid_utf8(text)"), F.lit(False)) & F.coalesce(F.col("text").rlike("|".join(f"(?:{x})" for x in SECRETS)), F.lit(False))
    found = F.array_compact(F.array(F.when(forbidden, F.lit("forbidden_location")), F.when(large, F.lit("too_large")), F.when(secret, F.lit("possible_secret"))))
    out = files.select("path", F.explode(found).alias("problem"))
    if required:
        wanted = files.sparkSession.createDataFrame([(p,) for p in required], "path string")
        heads = F.transform(F.sequence(F.lit(1), F.size(_parts(F.col("path")))), lambda n: F.array_join(F.slice(_parts(F.col("path")), F.lit(1), n), "/"))
        there = files.select(F.explode(heads).alias("path")).distinct()
        out = out.unionByName(wanted.join(there, "path", "left_anti").select("path", F.lit("missing").alias("problem")))
    return out


# --- the hierarchy as a document and as a table ---------------------------------------------------------------------------


def document_lines(rows: DataFrame, exceptions: DataFrame, build: dict[str, str], order: list[str], exception_order: list[str]) -> DataFrame:
    """(section, number, line): the lines of the JSON document {schema_version, build, rows, exceptions}, in their order.

    Every row of either table is a line of its own; ValueError without rows.
    """
    spark = rows.sparkSession
    out = None
    for section, df, by in ((1, rows, order), (3, exceptions, exception_order)):
        placed = numbered(df, [F.col(c) for c in by], "_number")
        n = placed.count()
        if section == 1 and not n:
            raise ValueError("the hierarchy is empty")
        body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        lines = placed.select(F.lit(section).alias("section"), F.col("_number").alias("number"), F.concat(body, F.when(F.col("_number") < n, ",").otherwise("")).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    build_json = spark.range(1).select(F.to_json(F.create_map(*[F.lit(x) for k in sorted(build) for x in (k, build[k])]))).head()[0] if build else "{}"
    frame = [(0, 1, f'{{"schema_version":"{DOCUMENT_VERSION}","build":{build_json},"rows":['), (2, 1, '],"exceptions":['), (4, 1, "]}")]
    return out.unionByName(spark.createDataFrame(frame, "section int, number long, line string"))


def write_document(lines: DataFrame, path: str) -> None:
    """A folder whose part files, in order of their names, are one JSON document; no task holds more than its range of lines.

    Spark's committer makes the folder appear at once, or not at all.
    """
    lines.repartitionByRange("section", "number").sortWithinPartitions("section", "number").select("line").write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, row: str, exception: str = "exception_id string") -> tuple[DataFrame, DataFrame]:
    """(rows, exceptions) of a document that write_document wrote, with the given schemas; ValueError for another version.

    The lines are read in any order: which table a line is of is told by the frame's places, file by file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    held = checkpointed(lines)
    head = held.where(F.col("value").startswith('{"schema_version":')).select(F.get_json_object(F.concat(F.col("value"), F.lit("]}")), "$.schema_version")).head()
    if head is None or head[0] != DOCUMENT_VERSION:
        raise ValueError(f"a document of version {head[0] if head else None}, not {DOCUMENT_VERSION}")
    cut = held.where(F.col("value") == '],"exceptions":[').select("_f", "_i").head()
    behind = (F.col("_f") > cut["_f"]) | (F.col("_f") == cut["_f"]) & (F.col("_i") > cut["_i"])
    body = held.where(~F.col("value").startswith('{"schema_version":') & ~F.col("value").isin('],"exceptions":[', "]}"))
    parsed = lambda df, schema: df.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("r")).select("r.*")
    return parsed(body.where(~behind), row), parsed(body.where(behind), exception)


def write_by_code(hierarchy: DataFrame, table: str, path: str, key: str = "village_code") -> None:
    """A table in BUCKETS buckets of the code, sorted by it: a lookup reads one bucket, and a join on the code moves only its other side."""
    hierarchy.write.mode("overwrite").option("path", path).bucketBy(BUCKETS, key).sortBy(key).saveAsTable(table)


def by_code(table: DataFrame, code: str, key: str = "village_code") -> DataFrame:
    """The row of one code, written with or without full stops; no rows for an unknown one or what is no code."""
    found = table.sparkSession.range(1).select(S.region_code(F.lit(code), "village")).head()[0]
    return table.where(F.col(key) == F.lit(found)) if found else table.limit(0)
