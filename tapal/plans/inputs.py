"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and the oracle both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels"]

_SEGMENT = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '01' WHEN 'BUILDING' THEN '02' WHEN 'FURNITURE' THEN '03' WHEN 'HOUSEHOLD' THEN '04' WHEN 'MACHINERY' THEN '05' ELSE '09' END"
#: A hierarchy: region, nation, market segment and customer are province, city, district and village.
HIERARCHY = f"""
SELECT lpad(cast(31 + r_regionkey AS string), 2, '0') AS province_code,
 lpad(cast(31 + r_regionkey AS string), 2, '0') || '.' || lpad(cast(n_nationkey + 1 AS string), 2, '0') AS city_code,
 lpad(cast(31 + r_regionkey AS string), 2, '0') || '.' || lpad(cast(n_nationkey + 1 AS string), 2, '0') || '.' || {_SEGMENT} AS district_code,
 lpad(cast(31 + r_regionkey AS string), 2, '0') || '.' || lpad(cast(n_nationkey + 1 AS string), 2, '0') || '.' || {_SEGMENT} || '.' || lpad(cast(c_custkey AS string), 7, '0') AS village_code,
 r_name AS province_name, CASE WHEN n_nationkey % 2 = 0 THEN 'KOTA ' ELSE 'KABUPATEN ' END || n_name AS city_name, c_mktsegment AS district_name,
 'DESA W' || cast(c_custkey % 613 AS string) AS village_name, CASE WHEN c_custkey % 5 = 0 THEN 'W' || cast(c_custkey % 613 AS string) || ' LAMA' ELSE '' END AS village_alias,
 lpad(cast(10000 + c_custkey % 80000 AS string), 5, '0') AS postal_code, c_custkey
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey"""
#: Addresses given as components, one for each order, with all kinds of faults.
ADDRESSES = f"""
SELECT o_orderkey AS address_id,
 CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'Desa Tiada ' || cast(o_orderkey AS string) WHEN o_orderkey % 17 = 0 THEN 'Kel.' WHEN o_orderkey % 3 = 0 AND village_alias <> '' THEN 'kel. ' || lower(village_alias) ELSE 'Desa W' || cast(c_custkey % 613 AS string) END AS KELURAHAN,
 CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'Kec. Salah' ELSE 'Kec. ' || lower(district_name) END AS KECAMATAN,
 CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN 'Kota Salah' WHEN o_orderkey % 2 = 0 THEN lower(city_name) ELSE city_name END AS KOTA_KABUPATEN,
 CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'Prov. ' || province_name END AS PROVINSI,
 CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN '99999' ELSE postal_code END AS KODEPOS, village_code, city_name, postal_code
FROM ({HIERARCHY}) h JOIN {{orders}} ON o_custkey = c_custkey"""
#: Three postal sources that disagree by rule, keyed by village.
SOURCES = f"""
SELECT village_code, village_name, city_code, district_code, city_name, district_name, c_custkey,
 CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '2' || substring(postal_code, 2, 4) ELSE postal_code END AS d,
 CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN '3' || substring(postal_code, 2, 4) WHEN c_custkey % 35 = 14 THEN '2' || substring(postal_code, 2, 4) ELSE postal_code END AS o,
 CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN '4' || substring(postal_code, 2, 4) ELSE postal_code END AS k
FROM ({HIERARCHY}) h"""
#: The outcome of the consensus in plain SQL, for oracles of what comes after it.
CONSENSUS = f"""
SELECT *, CASE WHEN d <> '' AND d = o AND o = k THEN d ELSE '' END AS postal_code,
 CASE WHEN d <> '' AND d = o AND o = k THEN '' WHEN k <> '' AND k = o AND k <> d THEN k WHEN k <> '' AND k = d AND k <> o THEN k ELSE '' END AS postal_code_candidate,
 CASE WHEN d <> '' AND d = o AND o = k THEN 'verified_consensus' WHEN k <> '' AND ((k = o AND k <> d) OR (k = d AND k <> o)) THEN 'corroborated_candidate' ELSE 'review_required' END AS verification_status
FROM ({SOURCES}) s"""
PATTERN = """CASE WHEN d <> '' AND d = o AND k <> d THEN 'government_sources_agree_api_differs' WHEN d <> '' AND o <> '' AND k <> '' AND d <> o AND d <> k AND o <> k THEN 'all_three_different'
 WHEN d = '' AND o <> '' AND k <> o THEN 'diskominfo_missing_api_odj_different' WHEN o = '' AND d <> '' AND k <> d THEN 'open_data_jabar_missing_api_diskominfo_different'
 WHEN k = '' AND d <> '' AND o <> d THEN 'api_missing_local_sources_different' END"""
#: Reviews and observations by rule.
REVIEWS = f"""
SELECT village_code, CASE c_custkey % 4 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'no_exact_match' WHEN 2 THEN 'multiple_exact_codes' ELSE 'no_exact_match' END AS observation,
 CASE WHEN c_custkey % 8 = 0 THEN '5' || substring(k || '00000', 2, 4) WHEN k <> '' THEN k ELSE '61234' END AS official_code, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '71234' END AS corrected_code, c_custkey % 5 <> 0 AS second_approval
FROM ({SOURCES}) s"""
#: Gold and predicted BIO labels of eight tokens for each part.
LABELS = """
SELECT p_partkey AS id, {array}('B-JALAN', CASE WHEN p_partkey % 2 = 0 THEN 'I-JALAN' ELSE 'O' END, 'O', 'B-RT', CASE WHEN p_partkey % 3 = 0 THEN 'I-RT' ELSE 'O' END, 'B-KELURAHAN', 'I-KELURAHAN', 'B-KODEPOS') AS gold,
 {array}('B-JALAN', CASE WHEN p_partkey % 5 = 0 THEN 'O' WHEN p_partkey % 2 = 0 THEN 'I-JALAN' ELSE 'O' END, CASE WHEN p_partkey % 7 = 0 THEN 'I-RT' ELSE 'O' END, 'B-RT', CASE WHEN p_partkey % 3 = 0 THEN 'I-RT' ELSE 'O' END, CASE WHEN p_partkey % 11 = 0 THEN 'O' ELSE 'B-KELURAHAN' END, CASE WHEN p_partkey % 13 = 0 THEN 'B-KECAMATAN' ELSE 'I-KELURAHAN' END, 'B-KODEPOS') AS predicted
FROM {part}"""
RAW = f"""
SELECT o_orderkey AS address_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Penerima: Budi Santoso, ' ELSE '' END || 'Jl. Mawar No. ' || cast(o_orderkey % 90 + 1 AS string) || ', RT 0' || cast(o_orderkey % 9 + 1 AS string) || ', Kel. W' || cast(c_custkey % 613 AS string) || ', Kec. ' || district_name || ', ' || postal_code
 || CASE WHEN o_orderkey % 6 = 0 THEN ', HP: 0812' || lpad(cast(1000000 + o_orderkey % 8000000 AS string), 7, '0') ELSE '' END AS text, c_custkey, district_name, postal_code
FROM ({HIERARCHY}) h JOIN {{orders}} ON o_custkey = c_custkey"""


def spark_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived input over the Parquet tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{array}", "array"), **used)


def dealt(df: DataFrame, sf_dir: str, table: str, key: str) -> DataFrame:
    """The rows of df dealt out by their key, for steps that compute much row by row: as many tasks as there are cores, and up to four times as many for a table of several parts.

    A small file, or one of few row groups, is read by few tasks however many rows it has.
    """
    spark = df.sparkSession
    parts, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return df.repartition(max(parts, cores * min(4, parts)), key)


def addresses(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The same for tables of addresses, one for each order, with their rows dealt out."""
    return dealt(spark_table(spark, sf_dir, sql), sf_dir, "orders", "address_id")


def oracle_table(sql: str) -> str:
    """The same as a subquery for the oracle."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return "(" + sql.replace("{array}", "list_value") + ")"
