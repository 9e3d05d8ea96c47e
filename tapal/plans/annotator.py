"""Registered queries of the automatic annotator and of the words that make error categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import annotation as N
from tapal.plans import inputs as I
from tapal.plans.registry import joined, query

#: Addresses whose district and city are written exactly, with a letter missing, glued to a marker, bare, unknown, or not at all.
_WRITTEN = f"""
SELECT o_orderkey AS address_id, district_name AS district, city_name AS city, cast(o_orderkey % 6 AS int) AS v, cast(o_orderkey % 5 AS int) AS w, postal_code,
 'Jl. Mawar No. ' || cast(o_orderkey % 90 + 1 AS string) || ', RT 0' || cast(o_orderkey % 9 + 1 AS string) || CASE WHEN o_orderkey % 7 = 0 THEN 'b' ELSE '' END || ' rw.' || cast(o_orderkey % 4 + 1 AS string) || CASE WHEN o_orderkey % 7 = 0 THEN 'c' ELSE '' END || ', ' AS head,
 CASE o_orderkey % 6 WHEN 0 THEN 'Kec. ' || district_name WHEN 1 THEN 'kc. ' || lower(substring(district_name, 1, length(district_name) - 1)) WHEN 2 THEN 'kec' || lower(district_name) WHEN 3 THEN 'Kecamatan Zzqq' WHEN 4 THEN district_name ELSE 'Dekat Vvkk' END || '; ' AS middle,
 CASE o_orderkey % 5 WHEN 0 THEN 'Kab. ' || n_name WHEN 1 THEN 'kbupatn ' || substring(n_name, 2, 20) || 'x' WHEN 2 THEN n_name || ' 40123' WHEN 3 THEN 'kta Zzqqvv' ELSE 'Jawa Barat 40123' END AS tail
FROM (SELECT *, substring(city_name, strpos_space(city_name) + 1, 40) AS n_name FROM ({I.HIERARCHY}) g) h JOIN {{orders}} ON o_custkey = c_custkey"""
_SPARK = _WRITTEN.replace("strpos_space(city_name)", "locate(' ', city_name)")
_t = I.oracle_table(_WRITTEN.replace("strpos_space(city_name)", "strpos(city_name, ' ')"))
_NAME = "array_to_string(list_transform(range(len(string_split({0}, ' ')) - {1}), lambda i: ' I-KOTA_KABUPATEN'), '')"


@query("annotated_addresses", f"""WITH t AS (SELECT *, CASE WHEN w < 4 THEN substr(city, strpos(city, ' ') + 1) END AS n_name FROM {_t} t)
 SELECT address_id, 'B-JALAN I-JALAN B-NOMOR I-NOMOR O B-RT I-RT B-RW O ' || CASE v WHEN 2 THEN 'B-KECAMATAN' WHEN 4 THEN 'B-KECAMATAN' WHEN 5 THEN 'B-DETAIL_LOKASI I-DETAIL_LOKASI' ELSE 'B-KECAMATAN I-KECAMATAN' END || ' O '
 || CASE w WHEN 0 THEN 'B-KOTA_KABUPATEN' || {_NAME.format("n_name", 0)} WHEN 1 THEN 'B-KOTA_KABUPATEN' || {_NAME.format("n_name", 0)} WHEN 2 THEN 'B-KOTA_KABUPATEN' || {_NAME.format("n_name", 1)} || ' B-KODEPOS' WHEN 3 THEN 'B-KOTA_KABUPATEN I-KOTA_KABUPATEN' ELSE 'B-PROVINSI I-PROVINSI B-KODEPOS' END AS labels,
 concat_ws(';', CASE WHEN address_id % 7 = 0 THEN 'rw_token_has_trailing_noise:''rw.' || address_id % 4 + 1 || 'c''' END, CASE WHEN v = 3 THEN 'unmatched_kecamatan_designator:''KecamatanZzqq''' END, CASE WHEN w = 3 THEN 'unmatched_kabupaten_designator:''ktaZzqqvv''' END) AS flags FROM t""")
def _(spark, sf_dir):
    texts = I.addresses(spark, sf_dir, _SPARK).select("address_id", "district", "city", S.tokens(F.concat("head", "middle", "tail")).alias("tokens"))
    return N.annotated(texts, "tokens", "district", "city").select("address_id", F.array_join("labels", " ").alias("labels"), joined("flags").alias("flags"))


#: Words of the two tables and others that are in neither.
_WORDS = ["jl", "jln", "kp", "kpg", "gg", "no", "ds", "kel", "kec", "kecmtn", "kcmtn", "kab", "kb", "kota", "rt", "rw", "dekat", "sebelah", "depan", "belakang", "samping", "masjid", "gereja", "pasar", "sekolah", "kantor", "jembatan", "gang", "patokan", "seberang", "prov", "jalan", "kecamatan"]
_PREFIXED = ["Kec.", "Kecamatan", "KECMTN", "kcmtn."]


@query("error_categories", """WITH t AS (SELECT p_partkey AS id, list_extract(['jl', 'jln', 'kp', 'kpg', 'gg', 'no', 'ds', 'kel', 'kec', 'kecmtn', 'kcmtn', 'kab', 'kb', 'kota', 'rt', 'rw', 'dekat', 'sebelah', 'depan', 'belakang', 'samping', 'masjid', 'gereja', 'pasar', 'sekolah', 'kantor', 'jembatan', 'gang', 'patokan', 'seberang', 'prov', 'jalan', 'kecamatan'], CAST(p_partkey % 33 + 1 AS INT)) AS w, p_partkey // 33 % 2 = 1 AS placed, p_partkey // 66 % 4 AS prefix FROM part),
 c AS (SELECT id, w, placed OR w IN ('kec', 'kecmtn', 'kcmtn', 'jl', 'jln', 'kp', 'kpg', 'gg', 'no', 'ds', 'kel', 'kab', 'kb', 'kota', 'rt', 'rw') AS a, placed, prefix, w IN ('rt', 'rw') AS r, w IN ('dekat', 'sebelah', 'depan', 'belakang', 'samping', 'masjid', 'gereja', 'pasar', 'sekolah', 'kantor', 'jembatan', 'gang', 'gg') AS l FROM t)
 SELECT id, coalesce(nullif(concat_ws(';', CASE WHEN placed AND prefix IN (1) AND w NOT IN ('kec', 'kecmtn', 'kcmtn', 'jl', 'jln', 'kp', 'kpg', 'gg', 'no', 'ds', 'kel', 'kab', 'kb', 'kota', 'rt', 'rw') THEN NULL WHEN a THEN 'abbreviation' END, CASE WHEN r THEN 'rt_rw' END, CASE WHEN l THEN 'landmark' END), ''), 'other_surface_form') AS categories FROM c""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    words, prefixes = (F.array(*map(F.lit, x)) for x in (_WORDS, _PREFIXED))
    placed = F.floor(k / 33) % 2 == 1
    word = F.initcap(F.get(words, (k % 33).cast("int")))
    # A district behind one of its opening words is the source's district without it: neither typo nor conflict.
    district = F.when(placed, F.array(F.get(prefixes, (F.floor(k / 66) % 4).cast("int")), F.lit("Cibeunying"))).otherwise(F.array().cast("array<string>"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.concat(F.array(F.lit("Mawar"), F.concat(word, F.lit("."))), district).alias("tokens"), placed.alias("placed"))
    labels = lambda first: F.concat(F.array(F.lit(first), F.lit("I-JALAN")), F.when(F.col("placed"), F.array(F.lit("B-KECAMATAN"), F.lit("I-KECAMATAN"))).otherwise(F.array().cast("array<string>")))
    part = part.withColumns({"gold": labels("B-JALAN"), "predicted": F.transform(labels("B-JALAN"), lambda x: F.lit("O")), "street": F.lit("Mawar"), "district": F.when(F.col("placed"), "CIBEUNYING").otherwise(""), "city": F.lit("")})
    return N.error_cases(part, "id").select("id", joined("categories").alias("categories"))
