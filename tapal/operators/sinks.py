"""Writers: ordered CSV, JSON documents, sheets as folders, map columns, and a manifest of written files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV folder with these columns in this order; Spark's committer makes it appear at once."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line with sorted keys and nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook as a folder: one CSV folder for each sheet, so that no sheet goes through the driver."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}", df.columns)


def tag_columns(df: DataFrame, keys: list[str], column: str = "tags") -> DataFrame:
    """df with tag_<key> for each listed key of a map column, empty where it is missing."""
    return df.select("*", *[F.coalesce(F.col(column)[k], F.lit("")).alias("tag_" + k.replace(":", "_")) for k in keys]).drop(column)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files under a folder, empty ones too, which Spark lists but does not scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    out = listed.select(plain("path").alias("path")).join(found.withColumn("path", plain("path")), "path", "left")
    return out.select("path", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def quality_summary(tables: dict[str, DataFrame], key: str = "village_code") -> DataFrame:
    """(table, rows, distinct_keys, blank_keys) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys"), F.count_if(F.coalesce(F.trim(key), F.lit("")) == "").alias("blank_keys"))
        out = one if out is None else out.unionByName(one)
    return out


def quality_rows(tables: dict[str, DataFrame], key: str, filled: list[str]) -> DataFrame:
    """(table, metric, value) of each table: rows, distinct, blank and repeated keys, and blank cells of the filled columns it has.

    Each table is read once; its keys are counted by groups, so that no set of keys has to fit in one task.
    """
    out = None
    for name, df in tables.items():
        blank = [c for c in filled if c in df.columns]
        own = df.select(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_k"), *[(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in blank])
        by = own.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(c) for c in blank])
        real = F.col("_k") != ""
        one = by.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(real).alias("distinct_keys"), F.coalesce(F.sum(F.when(~real, F.col("_n"))), F.lit(0)).alias("blank_keys"), F.count_if(real & (F.col("_n") > 1)).alias("repeated_keys"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"blank_{c}") for c in blank])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in one.columns])).alias("m")
        rows = one.select(F.lit(name).alias("table"), each).select("table", "m.metric", "m.value")
        out = rows if out is None else out.unionByName(rows)
    return out
