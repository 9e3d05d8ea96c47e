"""More registered queries: personal data and documents, preconditions and exceptions, search observations, annotation, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import address as A
from tapal.operators import annotation as N
from tapal.operators import contract as C
from tapal.operators import evaluation as E
from tapal.operators import exceptions as X
from tapal.operators import governance as G
from tapal.operators import pii as P
from tapal.operators import ranking as R
from tapal.operators import sealed
from tapal.plans import inputs as I
from tapal.plans.registry import _ADJ, _BOTH, _adjudicated, _consensus, _spans, hierarchy, joined, query
from tapal.sources import documents as D

_h, _s, _c, _raw, _l = (I.oracle_table(x) for x in (I.HIERARCHY, I.SOURCES, I.CONSENSUS, I.RAW, I.LABELS))

# --- personal data and documents ---------------------------------------------------------------------------------------

#: Texts with names after markers, titles, mobile numbers and landlines, identifiers that are no phones, and labels.
_PERSONAL = """
SELECT o_orderkey AS address_id, initcap_name AS who,
 CASE o_orderkey % 5 WHEN 0 THEN 'Penerima: Ibu ' || initcap_name || ', ' WHEN 1 THEN 'a.n. - ' || initcap_name || ' ' WHEN 2 THEN 'Nama Penerima = ' || initcap_name || '; ' WHEN 3 THEN 'Untuk ' || initcap_name || ', ' ELSE '' END AS head,
 'Jl. Melati No. ' || cast(o_orderkey % 90 + 1 AS string) || ', Kota ' || initcap_name AS middle,
 CASE o_orderkey % 7 WHEN 0 THEN ', HP 0812-3456-' WHEN 1 THEN ', Telp: 0221' WHEN 2 THEN ', NPSN: 08123456' WHEN 3 THEN ', +62 812 345 ' WHEN 4 THEN ', kode hp 08123456' ELSE ', blok ' END AS mark, lpad(cast(1000 + o_orderkey % 9000 AS string), 4, '0') || CASE WHEN o_orderkey % 7 = 1 THEN '21' ELSE '' END AS number
FROM (SELECT o_orderkey, 'Sari' || chr(cast(97 + c_nationkey AS int)) || CASE WHEN o_orderkey % 3 = 0 THEN ' Dewi-Ayu' ELSE '' END AS initcap_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey) x"""
_p = I.oracle_table(_PERSONAL)
_PHONED, _NAMED = "address_id % 7 IN (0, 1, 3, 4)", "address_id % 5 IN (0, 1, 2)"


def _personal(spark, sf_dir: str) -> DataFrame:
    return P.redact(I.addresses(spark, sf_dir, _PERSONAL).select("address_id", F.concat("head", "middle", "mark", "number").alias("text")))


@query("pii_entities", f"""WITH t AS (SELECT *, head || middle || mark || number AS text, CASE address_id % 5 WHEN 0 THEN 'Ibu ' || who ELSE who END AS name FROM {_p} p)
 SELECT address_id, 'RECIPIENT_NAME' AS type, CAST(strpos(text, name) - 1 AS INT) AS start, CAST(strpos(text, name) - 1 + length(name) AS INT) AS "end", '[NAME_REDACTED]' AS redacted_value FROM t WHERE {_NAMED}
 UNION ALL SELECT address_id, 'PHONE', CAST(length(head || middle) + length(regexp_extract(mark, '^, [A-Za-z:]*( hp)? ?')) AS INT), CAST(length(text) AS INT), '[PHONE_REDACTED]' FROM t WHERE {_PHONED}""")
def _(spark, sf_dir):
    return S.each(_personal(spark, sf_dir), "pii_entities", "e", "address_id").select("address_id", "e.*")


@query("pii_views", f"""WITH t AS (SELECT *, CASE WHEN {_NAMED} THEN '' ELSE head END || middle AS kept FROM {_p} p)
 SELECT address_id, CASE WHEN {_PHONED} THEN kept || CASE WHEN address_id % 7 = 4 THEN ', kode' ELSE '' END ELSE kept || mark || number END AS address_text, {_NAMED} OR {_PHONED} AS has_pii FROM t""")
def _(spark, sf_dir):
    return _personal(spark, sf_dir).select("address_id", "address_text", (F.size("pii_codes") > 0).alias("has_pii"))


@query("pii_name_failure", f"SELECT address_id, {_PHONED} AS has_phone, 'RECIPIENT_NAME_EXTRACTION_FAILED' AS warnings FROM {_p} p")
def _(spark, sf_dir):
    def failing(text: str):
        raise ValueError("no names today")

    texts = I.addresses(spark, sf_dir, _PERSONAL).select("address_id", F.concat("head", "middle", "mark", "number").alias("text"))
    out = P.redact(texts, names=P.named_by(failing))
    return out.select("address_id", (F.size("pii_entities") > 0).alias("has_phone"), joined("pii_warnings").alias("warnings"))


def _documents(spark, sf_dir: str) -> DataFrame:
    return A.document(A.process(I.addresses(spark, sf_dir, I.RAW).select("address_id", "text"), A.lookup(hierarchy(spark, sf_dir))))


#: What a summary takes out of a document.
_SUMMED = "struct<quality_gate:struct<status:string,issues:array<struct<reason_code:string>>>,normalized_address:struct<value:string>,components:array<struct<field:string>>,audit_trail:array<struct<action:string>>>"


def summary(docs: DataFrame) -> DataFrame:
    """docs with status, first reason_code, normalized, pii_action, n_components and n_events of each document.

    The text is parsed once for all of them: a path of its own for each took over a third of the whole query.
    """
    first = lambda x: F.get(x, F.lit(0))
    told = lambda d: F.struct(
        d["quality_gate"]["status"].alias("status"), first(d["quality_gate"]["issues"])["reason_code"].alias("reason_code"), d["normalized_address"]["value"].alias("normalized"),
        first(d["audit_trail"])["action"].alias("pii_action"), F.size(d["components"]).cast("long").alias("n_components"), F.size(d["audit_trail"]).cast("long").alias("n_events"),
    )
    # A step of its own: inside a lambda nothing is compiled, the making of the document included.
    return S.held(docs, "_d", F.from_json("document", _SUMMED)).select(*docs.columns, told(F.col("_d")).alias("_s")).select("*", "_s.*").drop("_s")


@query("document_summary", f"""WITH h AS (SELECT village_name, district_name, postal_code, count(*) AS n FROM {_h} h GROUP BY ALL)
 SELECT address_id, 'PERLU_KONFIRMASI' AS status, CASE WHEN n > 1 THEN 'AMBIGUOUS_ADMINISTRATIVE_CANDIDATES' ELSE 'MISSING_ADMINISTRATIVE_FIELDS' END AS reason_code,
 'Jalan Mawar, No. ' || cast(address_id % 90 + 1 AS string) || ', RT 00' || cast(address_id % 9 + 1 AS string) || ', Kelurahan W' || cast(c_custkey % 613 AS string) || ', Kecamatan ' || r.district_name[1] || lower(r.district_name[2:]) || ', ' || r.postal_code AS normalized,
 CASE WHEN address_id % 4 = 0 OR address_id % 6 = 0 THEN 'PII_DETECTED' ELSE 'no_pii_detected' END AS pii_action, 6::BIGINT AS n_components, 9::BIGINT AS n_events
 FROM {_raw} r JOIN h ON h.village_name = 'DESA W' || cast(c_custkey % 613 AS string) AND h.district_name = r.district_name AND h.postal_code = r.postal_code""")
def _(spark, sf_dir):
    return summary(_documents(spark, sf_dir)).select("address_id", "status", "reason_code", "normalized", "pii_action", "n_components", "n_events")


@query("contract_violations", f"""SELECT address_id, '$.confidence' AS path, 'additionalProperties' AS rule FROM {_raw} r WHERE address_id % 10 = 0 UNION ALL SELECT address_id, '$', 'forbidden_key' FROM {_raw} r WHERE address_id % 10 = 0
 UNION ALL SELECT address_id, '$.schema_version', 'const' FROM {_raw} r WHERE address_id % 9 = 0 UNION ALL SELECT address_id, '$.components[0].result', 'confirmed_by_user' FROM {_raw} r WHERE address_id % 11 = 0
 UNION ALL SELECT address_id, '$.audit_trail', 'contiguous_sequence' FROM {_raw} r WHERE address_id % 7 = 0 AND address_id % 10 <> 0 AND address_id % 9 <> 0 AND address_id % 11 <> 0
 UNION ALL SELECT address_id, '$.quality_gate.status', 'status_agrees' FROM {_raw} r WHERE address_id % 13 = 0 AND address_id % 10 <> 0 AND address_id % 9 <> 0 AND address_id % 11 <> 0""")
def _(spark, sf_dir):
    k, broken = F.col("address_id"), F.col("document")
    broken = F.when(k % 10 == 0, F.concat(F.lit('{"confidence":1,'), F.substring(broken, 2, 1 << 30))).otherwise(broken)
    for m, old, new in ((7, '"sequence":2,', '"sequence":9,'), (9, '"schema_version":"1.0.0"', '"schema_version":"2"'), (11, '(components":\\[\\{"field":"JALAN","result":\\{"value":"[^"]*","source":"[a-z_]*","confirmed":)false', "$1true"), (13, '"status":"PERLU_KONFIRMASI","issues"', '"status":"SIAP_DIPROSES","issues"')):
        broken = F.when(k % m == 0, F.regexp_replace(broken, old, new)).otherwise(broken)
    return C.violations(_documents(spark, sf_dir).withColumn("document", broken))


@query("geocode_blocks", "SELECT o_orderkey AS address_id, CASE o_orderkey % 4 WHEN 0 THEN 'NOT_REQUESTED' WHEN 1 THEN 'EXTERNAL_FAILURE' WHEN 2 THEN 'AMBIGUOUS' ELSE 'SUCCESS' END AS status, o_orderkey % 4 > 0 AS consent, CASE WHEN o_orderkey % 4 > 1 THEN o_totalprice END AS latitude, CASE WHEN o_orderkey % 4 = 1 THEN 'GEOCODE_TIMEOUT' END AS error_code, CASE WHEN o_orderkey % 4 > 1 THEN 'KODEPOS' ELSE '' END AS fields FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("address_id"), (k > 0).alias("consent"), F.when(k == 1, "timeout").alias("failure"), F.lit("p").alias("provider"), F.when(k > 1, F.when(k == 2, "street").otherwise("rooftop")).alias("precision"), F.col("o_totalprice").alias("lat"), F.lit(1.0).alias("lon"), F.lit("40111").alias("geo_KODEPOS"))
    results = o.drop("consent")
    own = o.select("address_id", "consent", *[F.lit("").alias(f) for f in ("KOTA_KABUPATEN", "PROVINSI", "KODEPOS")])
    for f in S.FIELDS:
        if f != "KODEPOS":
            results = results.withColumn(f"geo_{f}", F.lit(""))
    out = A.geocode(own, results).withColumn("g", A.geocoding_block())
    return out.select("address_id", "g.status", "g.consent", F.col("g.latitude.value").alias("latitude"), "g.error_code", F.array_join(F.transform("g.components", lambda c: c["field"]), ";").alias("fields"))


@query("confirmed_corrections", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Kota ' || p_brand ELSE p_brand END AS city, CASE WHEN p_partkey % 3 = 0 THEN 'confirmed_by_user' ELSE 'rule_extracted' END AS source, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n_changes, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'CORRECTION_REQUIRES_CONFIRMATION' ELSE '' END AS open_issue FROM part")
def _(spark, sf_dir):
    none = F.array().cast("array<struct<field:string,before:string,before_source:string,after:string,after_source:string,rule_id:string,decision:string,applied:boolean>>")
    k = F.col("p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("KOTA_KABUPATEN"), F.lit("rule_extracted").alias("KOTA_KABUPATEN_source"), none.alias("changes"))
    out = A.propose(part, "KOTA_KABUPATEN", F.when((k % 2 == 0) | (k % 3 == 0), F.concat(F.lit("Kota "), "KOTA_KABUPATEN")), "hierarchy_v1")
    out = A.confirm(out, "KOTA_KABUPATEN", k % 3 == 0)
    empty = F.array().cast("array<string>")
    gated = A.gate(out.withColumns({"status": F.lit("valid"), "reason_code": F.lit(""), "affected_fields": empty, "missing_fields": empty}))
    return gated.select("p_partkey", F.col("KOTA_KABUPATEN").alias("city"), F.col("KOTA_KABUPATEN_source").alias("source"), F.size("changes").alias("n_changes"), F.coalesce(F.get("issues", F.lit(0))["reason_code"], F.lit("")).alias("open_issue"))


# --- preconditions and exceptions -----------------------------------------------------------------------------------------


@query("source_coverage_gaps", f"""SELECT village_code, 'd' AS "table" FROM {_s} s WHERE c_custkey % 10 = 1 UNION ALL SELECT village_code, 'o' FROM {_s} s WHERE c_custkey % 10 IN (2, 4) UNION ALL SELECT village_code, 'k' FROM {_s} s WHERE c_custkey % 10 = 4""")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES)
    return X.coverage({"d": s.where("c_custkey % 10 <> 1"), "o": s.where("c_custkey % 10 not in (2, 4)"), "k": s.where("c_custkey % 10 <> 4")})


@query("indexed_source", f"SELECT village_code, c_custkey FROM (SELECT '32.' || lpad(cast(c_custkey // 1000000 AS string), 2, '0') || '.01.' || lpad(cast(c_custkey % 10000 AS string), 4, '0') AS village_code, c_custkey FROM {_s} s) x WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.concat(F.when(k % 7 == 0, "33").otherwise("32"), F.lpad(F.floor(k / 1000000).cast("string"), 2, "0"), F.lit("01"), F.lpad((k % 10000).cast("string"), 4, "0"))
    s = I.spark_table(spark, sf_dir, I.SOURCES).select("c_custkey", F.when(k % 5 == 0, "00.00.00.0000").when(k % 11 == 0, "32.1").otherwise(code).alias("village_code"))
    return X.indexed(s)


@query("consensus_outputs", f"""SELECT output, count(*) AS n FROM (SELECT CASE verification_status WHEN 'verified_consensus' THEN 'accepted' ELSE 'review' END AS output FROM {_c} c UNION ALL SELECT CASE verification_status WHEN 'corroborated_candidate' THEN 'corroborated' ELSE 'unresolved' END FROM {_c} c WHERE verification_status <> 'verified_consensus') x GROUP BY output""")
def _(spark, sf_dir):
    return X.consensus_outputs(_consensus(spark, sf_dir)).groupBy("output").agg(F.count(F.lit(1)).alias("n"))


@query("section_problems", f"""SELECT village_code, 1 AS section, 'overlap' AS problem FROM {_s} s WHERE c_custkey % 6 = 0 UNION ALL SELECT village_code, 2, 'overlap' FROM {_s} s WHERE c_custkey % 6 = 0
 UNION ALL SELECT village_code, 1, 'bad_postal_code' FROM {_s} s WHERE c_custkey % 2 = 0 AND d = '' UNION ALL SELECT village_code, 2, 'bad_postal_code' FROM {_s} s WHERE c_custkey % 3 = 0 AND k = ''""")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES)
    part = lambda c, m: s.where(F.col("c_custkey") % m == 0).select("village_code", F.col(c).alias("postal_code"))
    return X.section_problems({1: part("d", 2), 2: part("k", 3)})


@query("primary_exceptions", """WITH r AS (SELECT o_orderkey AS line, 'V' || cast(o_custkey AS string) AS village_code, cast(10000 + o_orderkey % 4 AS string) AS p, o_orderkey % 50 = 0 AS diff, o_orderkey % 30 = 0 AS bps FROM orders),
 f AS (SELECT village_code, p, min(line) AS line FROM r GROUP BY village_code, p), n AS (SELECT *, row_number() OVER (PARTITION BY village_code ORDER BY line) AS i FROM f),
 x AS (SELECT n.village_code, 'postal_code_conflict' AS kind, 'postal_code' AS field, '["primary","' || (SELECT string_agg(m.p, ',' ORDER BY m.p) FROM n m WHERE m.village_code = n.village_code AND m.i < n.i) || '"],["primary:row-' || cast(n.line AS string) || '","' || p || '"]' AS vals FROM n WHERE i > 1
 UNION ALL SELECT village_code, 'name_difference', 'village_name', '["BPS","Other"],["Kemendagri","Name"]' FROM r WHERE diff UNION ALL SELECT village_code, 'hierarchy_code_conflict', 'city_code', '["BPS","32.99"],["Kemendagri","32.01"]' FROM r WHERE bps)
 SELECT village_code, kind, field, 'REF-' || upper(substring(sha256('["' || kind || '","' || village_code || '","' || field || '",[' || vals || ']]'), 1, 12)) AS exception_id FROM x""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    name = lambda x: F.lit(x)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("line"), F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias("village_code"), F.lit("32.01").alias("city_code"), F.when(k % 30 == 0, "32.99").otherwise("32.01").alias("bps_city_code"), (k % 4 + 10000).cast("string").alias("postal_code"),
        name("JAWA BARAT").alias("province_name"), name("Jawa  Barat").alias("bps_province_name"), name("D").alias("district_name"), name("").alias("bps_district_name"), name("Name").alias("village_name"), F.when(k % 50 == 0, "Other").otherwise("NAME").alias("bps_village_name"),
    )
    return X.primary_exceptions(rows).select("village_code", "kind", "field", "exception_id")


@query("crosscheck_exceptions", f"""WITH x AS (SELECT *, c_custkey % 9 = 0 AS gone, c_custkey % 4 = 0 AS dn, c_custkey % 6 = 0 AS dc, c_custkey % 10 = 3 AS pc FROM {_h} h)
 SELECT village_code, 'missing_primary_row' AS kind, 'village_code' AS field FROM x WHERE gone UNION ALL SELECT village_code, 'name_difference', 'district_name' FROM x WHERE NOT gone AND dn
 UNION ALL SELECT village_code, 'hierarchy_code_conflict', 'district_code' FROM x WHERE NOT gone AND dc UNION ALL SELECT village_code, 'postal_code_conflict', 'postal_code' FROM x WHERE NOT gone AND pc""")
def _(spark, sf_dir):
    h, k = hierarchy(spark, sf_dir), F.col("c_custkey")
    cross = h.select(F.lit("s1").alias("source_id"), "village_code", *[(F.when(k % 6 == 0, "99").otherwise(F.col(f"{x}_code")) if x == "district" else F.col(f"{x}_code")).alias(f"x_{x}_code") for x in X.LEVELS], *[(F.concat(f"{x}_name", F.when(k % 4 == 0, " BARU").otherwise("")) if x == "district" else F.lower(f"{x}_name")).alias(f"x_{x}_name") for x in X.LEVELS], F.when(k % 10 == 3, "99999").otherwise(F.col("postal_code")).alias("x_postal_code"))
    entries = h.where(k % 9 != 0).select("village_code", *[f"{x}_code" for x in X.LEVELS if x != "village"], *[f"{x}_name" for x in X.LEVELS], "postal_codes")
    return X.crosscheck_exceptions(entries, cross).select("village_code", "kind", "field")


@query("promoted_aliases", f"SELECT village_code, 'district' AS level, district_name || ' BARU' AS alias FROM {_h} h WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 0")
def _(spark, sf_dir):
    h, k = hierarchy(spark, sf_dir), F.col("c_custkey")
    cross = h.select(F.when(k % 3 == 0, "used").otherwise("held").alias("source_id"), "village_code", *[(F.concat(f"{x}_name", F.when(k % 4 == 0, " BARU").otherwise("")) if x == "district" else F.lower(f"{x}_name")).alias(f"x_{x}_name") for x in X.LEVELS])
    return X.promoted_aliases(h.select("village_code", *[f"{x}_name" for x in X.LEVELS]), cross, ["used"])


@query("district_codes", f"SELECT district_code, coalesce(array_to_string(list_sort(list_distinct(list(cast(c_custkey % 17 AS string)) FILTER (c_custkey % 5 <> 0))), ';'), '') AS codes FROM {_s} s GROUP BY district_code")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    s = I.spark_table(spark, sf_dir, I.SOURCES).withColumn("x", F.when(k % 5 == 0, "n/a").otherwise(F.concat((k % 17).cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))))
    return X.codes_of(s, ["district_code"], "x").withColumn("codes", joined("codes"))


@query("village_code_list", "SELECT DISTINCT '32.01.01.' || cast(1000 + p_partkey % 500 AS string) AS village_code FROM part WHERE p_partkey % 3 <> 0")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(k % 3 == 0, "# comment").when(k % 6 == 1, F.concat(F.lit("320101"), (k % 500 + 1000).cast("string"))).otherwise(F.concat(F.lit(" 32.01.01."), (k % 500 + 1000).cast("string"), F.lit(" # note"))).alias("value"))
    return X.code_list(lines.unionByName(spark.createDataFrame([("",)], "value string")))


@query("source_codes", f"SELECT village_code, 'd' AS source, d AS code FROM {_s} s UNION ALL SELECT village_code, 'k', k FROM {_s} s")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES).withColumn("x", F.concat(F.lit("d:"), "d", F.lit(";k:"), "k"))
    return X.source_codes(s, "village_code", "x")


@query("adjudication_counts", _ADJ + " SELECT decision, CASE WHEN code <> '' THEN 'verified_adjudicated' WHEN decision = 'remain_unresolved' THEN 'blocked' ELSE 'error' END AS adjudication_status, count(*) AS n FROM y GROUP BY ALL")
def _(spark, sf_dir):
    return _adjudicated(spark, sf_dir).groupBy("decision", "adjudication_status").agg(F.count(F.lit(1)).alias("n"))


@query("stray_observations", f"SELECT village_code FROM {_s} s WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES)
    observed = s.where("c_custkey % 3 = 0").select("village_code")
    return G.key_differences(observed, s.where("c_custkey % 2 = 0").select("village_code")).where("side = 'left'").select("village_code")


@query("crosscheck_rows", "SELECT p_partkey, 'c' || cast(p_partkey AS string) AS village_code, CASE p_partkey % 4 WHEN 3 THEN '' ELSE 'd1' END AS district_code, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_brand END AS district_name, p_brand AS city_name, '40111' AS postal_code FROM part")
def _(spark, sf_dir):
    k, b = F.col("p_partkey"), F.col("p_brand")
    head = F.concat(F.lit('{"code":"c'), k.cast("string"), F.lit('","postalCode":"40111","city":{"code":"1","name":"'), b, F.lit('"},'))
    district = F.when(k % 4 == 0, F.concat(F.lit('"district":{"code":"d1","name":"'), b, F.lit('"}}'))).when(k % 4 == 1, F.concat(F.lit('"district":{"code":"d0"},"districtCode":"d1","districtName":"'), b, F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit('"district_code":"d1","district_name":"'), b, F.lit('"}'))).otherwise(F.lit('"district":{"name":"x"}}'))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(head, district).alias("j")).withColumn("r", X.crosscheck_row("j"))
    return part.select("p_partkey", "r.village_code", F.col("r.district.code").alias("district_code"), F.col("r.district.name").alias("district_name"), F.col("r.city.name").alias("city_name"), "r.postal_code")


_POS = f"""WITH x AS (SELECT *, c_custkey % 5 AS m FROM {_s} s)"""


def _pos(spark, sf_dir: str) -> DataFrame:
    s = I.spark_table(spark, sf_dir, I.SOURCES).withColumn("village_name", F.concat("village_name", F.lit(" "), F.col("c_custkey").cast("string"))).withColumn("province_name", F.lit("P"))
    k = F.col("c_custkey") % 5
    queries = s.where(k != 0).select(F.col("village_name").alias("query"))
    found = s.where(k > 1).select(F.col("village_name").alias("query"), F.upper("village_name").alias("village_name"), F.concat(F.lit(" "), "district_name").alias("district_name"), F.when(k == 2, "elsewhere").otherwise(F.lower("city_name")).alias("city_name"), "province_name", F.lit("40111").alias("postal_code"), "c_custkey")
    again = found.where(k == 4).withColumn("postal_code", F.lit("40112"))
    return X.pos_observations(s, queries, found.unionByName(again).drop("c_custkey"))


@query("pos_observations", _POS + " SELECT village_code, CASE m WHEN 0 THEN 'not_queried' WHEN 1 THEN 'no_exact_match' WHEN 2 THEN 'no_exact_match' WHEN 3 THEN 'exact_match' ELSE 'multiple_exact_codes' END AS observation_status, CASE m WHEN 3 THEN '40111' ELSE '' END AS official_postal_code, CASE m WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS search_result_count, CASE m WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS exact_result_count FROM x")
def _(spark, sf_dir):
    return _pos(spark, sf_dir)


@query("pos_summary", _POS + " SELECT CASE m WHEN 0 THEN 'not_queried' WHEN 1 THEN 'no_exact_match' WHEN 2 THEN 'no_exact_match' WHEN 3 THEN 'exact_match' ELSE 'multiple_exact_codes' END AS observation_status, count(*) AS n, count(*) FILTER (m = 3 AND c_custkey % 2 = 0) AS matching FROM x GROUP BY 1")
def _(spark, sf_dir):
    expected = I.spark_table(spark, sf_dir, I.SOURCES).select("village_code", F.when(F.col("c_custkey") % 2 == 0, "40111").otherwise("1").alias("postal_code"))
    return X.pos_summary(_pos(spark, sf_dir), expected)


@query("benchmark_candidates", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "short").otherwise("long enough").alias("address"), F.lit("p").alias("parent"))
    return X.benchmark_candidates(o, "o_orderkey", "o_custkey", "address", ["parent"]).select("o_custkey", "o_orderkey")


@query("unclassified_triplets", f"SELECT village_code, d, o, k FROM {_c} c WHERE verification_status = 'review_required' AND ({I.PATTERN}) IS NULL")
def _(spark, sf_dir):
    return G.unclassified(_consensus(spark, sf_dir))


@query("review_gaps", f"SELECT village_code, 'reviews' AS \"table\" FROM {_c} c WHERE verification_status <> 'verified_consensus' AND c_custkey % 8 = 0")
def _(spark, sf_dir):
    rows = _consensus(spark, sf_dir).where("verification_status <> 'verified_consensus'")
    return X.coverage({"rows": rows, "reviews": rows.where("cast(right(village_code, 7) as int) % 8 <> 0")})


@query("cases_by_category", "SELECT category, doc_id FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'typo' END, 'landmark'], lambda y: y IS NOT NULL)) AS category FROM labels WHERE quality = 0) x")
def _(spark, sf_dir):
    cases = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("typo")), F.lit("landmark"))).alias("categories"), (F.col("quality") == 0).alias("failed"))
    return E.cases_by_category(cases, "doc_id")


# --- annotation ----------------------------------------------------------------------------------------------------------


def _pool(spark, sf_dir: str) -> DataFrame:
    return I.spark_table(spark, sf_dir, I.LABELS).select("id", F.array(*[F.lit(f"t{i}") for i in range(8)]).alias("tokens"), F.col("gold").alias("labels"))


def _worksheet(spark, sf_dir: str) -> DataFrame:
    """Spans as an annotator writes them: most as the gold labels have them, some other, some rows with faults."""
    k = F.col("id")
    jalan = F.when(k % 2 == 0, "JALAN:0-2").otherwise("JALAN:0-1")
    rest = F.concat(F.lit(";RT:3-"), F.when(k % 3 == 0, "5").otherwise("4"), F.when(k % 7 == 0, ";KECAMATAN:5-7").otherwise(";KELURAHAN:5-7"), F.lit("; KODEPOS:7-8"))
    spans = F.when(k % 19 == 0, "JALAN 0-1").when(k % 23 == 0, "STREET:0-1").when(k % 29 == 0, "JALAN:7-9").when(k % 31 == 0, "").otherwise(F.concat(jalan, rest))
    return _pool(spark, sf_dir).select("id", spans.alias("spans"), F.when(k % 31 == 0, "").when(k % 37 == 0, " ").otherwise("ann").alias("annotator_id"))


@query("review_problems", "SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 AND p_partkey % 19 <> 0 AND p_partkey % 23 <> 0 AND p_partkey % 29 <> 0 THEN 'not_reviewed' WHEN p_partkey % 31 = 0 OR p_partkey % 37 = 0 THEN 'no_annotator' WHEN p_partkey % 19 = 0 THEN 'unparseable' WHEN p_partkey % 23 = 0 THEN 'unknown_type' ELSE 'out_of_range' END AS problem FROM part WHERE p_partkey % 19 = 0 OR p_partkey % 23 = 0 OR p_partkey % 29 = 0 OR p_partkey % 31 = 0 OR p_partkey % 37 = 0")
def _(spark, sf_dir):
    return N.reviewed(_pool(spark, sf_dir), _worksheet(spark, sf_dir), "id").where("problem is not null").select("id", "problem")


_FAULT = "p_partkey % 19 = 0 OR p_partkey % 23 = 0 OR p_partkey % 29 = 0 OR p_partkey % 31 = 0 OR p_partkey % 37 = 0"


def _reviewed(spark, sf_dir: str) -> DataFrame:
    return N.reviewed(_pool(spark, sf_dir), _worksheet(spark, sf_dir), "id").where("problem is null")


@query("annotation_disagreements", f"""SELECT p_partkey AS id, 5::BIGINT AS start, 7::BIGINT AS "end", 't5 t6' AS span_text, unnest(['O', 'KELURAHAN']) AS automated_label, unnest(['KECAMATAN', 'O']) AS human_label FROM part WHERE p_partkey % 7 = 0 AND NOT ({_FAULT})""")
def _(spark, sf_dir):
    return N.disagreements(_reviewed(spark, sf_dir), "id")


@query("annotation_agreement", f"""WITH x AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 = 0) AS m FROM part WHERE NOT ({_FAULT})) SELECT n AS reviewed, m AS disagreeing, n - m AS exact_match, 4 * n - m AS tp, m AS fp, m AS fn, (4 * n - m) / (4 * n) AS precision, (4 * n - m) / (4 * n) AS recall, (4 * n - m) / (4 * n) AS f1 FROM x""")
def _(spark, sf_dir):
    return N.agreement(_reviewed(spark, sf_dir), "id")


@query("gold_assembly", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 OR ({_FAULT}) THEN 'automated_accepted' WHEN p_partkey % 7 = 0 THEN 'double_annotated_adjudicated' ELSE 'double_annotated_agreed' END AS provenance, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 7 = 0 AND NOT ({_FAULT}) AND p_partkey % 2 = 0 THEN 'B-KECAMATAN' ELSE 'B-KELURAHAN' END AS fifth FROM part""")
def _(spark, sf_dir):
    rows = _reviewed(spark, sf_dir).where("id % 5 = 0")
    decisions = N.disagreements(rows, "id").where("human_label <> 'O'").select("id", "start", "end", F.when(F.col("id") % 2 == 0, "O").otherwise("KELURAHAN").alias("adjudicated_label"))
    out = N.assembled(_pool(spark, sf_dir), rows.select("id", "human", "annotator_id"), decisions, "id").where("problem is null")
    return out.select("id", "provenance", F.col("labels")[5].alias("fifth"))


@query("indexed_tokens", "SELECT p_partkey, '0:' || split_part(p_name, ' ', 1) || ' 1:' || p_brand AS t FROM part")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("x"))
    return part.select("p_partkey", N.indexed_tokens("x").alias("t"))


@query("token_segments", "SELECT p_partkey, 0::BIGINT AS segment, 0::BIGINT AS start, 1::BIGINT AS \"end\" FROM part UNION ALL SELECT p_partkey, 1, 2, 4 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, 3, 4 FROM part WHERE p_partkey % 2 = 1")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(F.lit("a"), F.lit(","), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise(";"), F.lit("c"), F.lit("-")).alias("t"))
    return N.segments(part, "p_partkey", "t")


@query("component_spans", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1 END AS start, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 3 END AS \"end\" FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 3
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(*map(F.lit, ["Jl.", "Kota:", "BANDUNG", "x"])).alias("t"), F.when(k == 0, "nowhere").when(k == 1, "kota").otherwise("kota  bandung").alias("c")).withColumn("s", N.component_span("t", "c"))
    return part.select("p_partkey", "s.start", "s.end")


@query("stripped_values", f"SELECT village_code, lower(regexp_replace(district_name, '[^A-Za-z0-9]', '', 'g')) AS key, 'Bandung' AS bare FROM {_h} h")
def _(spark, sf_dir):
    h = hierarchy(spark, sf_dir).select("village_code", F.concat(F.lit("Kec. "), "district_name").alias("v"))
    return h.select("village_code", N.value_key("v", "KECAMATAN").alias("key"), N.strip_prefix(F.lit("kotaBandung"), ["ko", "kota"]).alias("bare"))


@query("worksheet_problems", "SELECT p_partkey, 'blank' AS problem FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'identical' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 'long_digit_run' FROM part WHERE p_partkey % 4 = 2")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 4
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("a"), F.when(k == 0, " ").when(k == 1, F.concat(F.lit(" "), F.upper("p_name"))).when(k == 2, "no 1234567").otherwise("fine").alias("b"))
    return N.worksheet_problems(part, "p_partkey", "a", "b")


@query("error_cases", """WITH x AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS conflict, p_partkey % 3 = 1 AS typo, p_partkey % 5 = 0 AS crit, p_partkey % 7 = 0 AS orphan FROM part)
 SELECT id, array_to_string(list_filter([CASE WHEN typo THEN 'typo' END, 'abbreviation', 'rt_rw', CASE WHEN conflict THEN 'conflict' END], lambda y: y IS NOT NULL), ';') AS categories, array_to_string(list_filter([CASE WHEN crit OR orphan THEN 'model' END, CASE WHEN orphan THEN 'validator' END, 'generator'], lambda y: y IS NOT NULL), ';') AS components, CASE WHEN crit THEN 'P0' ELSE 'P1' END AS severity FROM x WHERE crit OR orphan""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    array = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"), array("Jl.", "Mawar", "RT", "Kec.", "Cibeunying", "x").alias("tokens"), array("B-JALAN", "I-JALAN", "B-RT", "B-KECAMATAN", "I-KECAMATAN", "O").alias("gold"),
        array("B-JALAN", F.when(k % 5 == 0, "O").otherwise("I-JALAN"), "B-RT", "B-KECAMATAN", "I-KECAMATAN", F.when(k % 7 == 0, "I-RW").otherwise("O")).alias("predicted"),
        F.lit("Jl. Mawar").alias("street"), F.when(k % 3 == 0, "Lengkong").when(k % 3 == 1, "Cibeuning").otherwise("CIBEUNYING").alias("district"), F.lit("").alias("city"),
    )
    return N.error_cases(part, "id").select("id", joined("categories").alias("categories"), joined("components").alias("components"), "severity")


@query("grouped_metrics", _BOTH + """ SELECT "group", tp, fp, fn FROM (SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS "group", count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM b GROUP BY 1) y""")
def _(spark, sf_dir):
    t = I.spark_table(spark, sf_dir, I.LABELS).withColumn("group", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return sealed.slice_metrics(t, "gold", "predicted", "group").where("slice = 'group'").select(F.col("name").alias("group"), "tp", "fp", "fn")


# --- sampling and splits -----------------------------------------------------------------------------------------------------


def _by_hash(key: str):
    return [F.md5(F.col(key).cast("string").cast("binary")), F.col(key)]


@query("exact_split", """WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(cast(doc_id AS string)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents),
 g AS (SELECT DISTINCT lang, n, CAST(round_even(n * 70 / total, 0) AS BIGINT) AS share FROM t), d AS (SELECT *, 70 - sum(share) OVER () AS drift FROM g),
 e AS (SELECT *, CASE WHEN drift > 0 THEN n - share ELSE share END AS spare FROM d), f AS (SELECT *, coalesce(sum(spare) OVER (ORDER BY lang ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS behind FROM e),
 m AS (SELECT *, greatest(least(abs(drift) - behind, spare), 0) AS moved FROM f)
 SELECT t.doc_id, t.lang, CASE WHEN m.drift > 0 AND (rn <= share OR rn > t.n - moved) OR m.drift <= 0 AND rn <= share - moved THEN 'dev' ELSE 'sealed' END AS split FROM t JOIN m USING (lang)""")
def _(spark, sf_dir):
    return R.exact_split(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), ["lang"], _by_hash("doc_id"), 70)


@query("flagged_sample", "WITH r AS (SELECT doc_id, quality = 0 AS flagged, row_number() OVER (ORDER BY CASE WHEN quality = 0 THEN 0 ELSE 1 END, md5(cast(doc_id AS string)), doc_id) AS rn FROM labels) SELECT doc_id, flagged FROM r WHERE flagged OR rn <= 100")
def _(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 0).alias("flagged"))
    return R.flagged_first(labels, "flagged", _by_hash("doc_id"), 100)


@query("study_design", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(cast(p_partkey AS string)), p_partkey) - 1 AS r FROM part) SELECT p_partkey, r // 20 + 1 AS participant, CASE WHEN (r % 20 + r // 20) % 2 = 0 THEN 'assisted' ELSE 'manual' END AS condition FROM r WHERE r < 100")
def _(spark, sf_dir):
    return R.study_design(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), _by_hash("p_partkey"), 5, 20)


@query("category_sample", "WITH e AS (SELECT p_partkey, unnest(['brand ' || p_brand, 'size ' || cast(p_size % 3 AS string)]) AS c, md5(cast(p_partkey AS string)) AS h FROM part), f AS (SELECT DISTINCT first(p_partkey ORDER BY h, p_partkey) OVER (PARTITION BY c) AS p_partkey FROM e), r AS (SELECT p_partkey, row_number() OVER (ORDER BY f.p_partkey IS NULL, md5(cast(p.p_partkey AS string)), p.p_partkey) AS rn FROM part p LEFT JOIN f USING (p_partkey)) SELECT p_partkey FROM r WHERE rn <= 60")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(F.concat(F.lit("brand "), "p_brand"), F.concat(F.lit("size "), (F.col("p_size") % 3).cast("string"))).alias("c"))
    return E.one_per_category(part, "p_partkey", "c", F.md5(F.col("p_partkey").cast("string").cast("binary")), 60).select("p_partkey")


@query("failure_signatures", "WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_orderstatus, o_orderpriority FROM r WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 4")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return E.failure_signatures(o, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "o_orderkey", 4).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("contiguous_runs", "WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3), g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM t) SELECT l_orderkey, min(l_linenumber) AS start, max(l_linenumber) + 1 AS \"end\" FROM g GROUP BY l_orderkey, g")
def _(spark, sf_dir):
    return E.contiguous_runs(spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <> 3").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("namespace_collisions", "SELECT 'a-' || cast(c_custkey AS string) AS id FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def _(spark, sf_dir):
    own = lambda t, k: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.concat(F.lit("a-"), F.col(k).cast("string")).alias("id"), F.lit(t).alias("split"))
    return sealed.shared_bases(own("customer", "c_custkey").unionByName(own("supplier", "s_suppkey")), "id", "split", [("customer", "supplier")]).select("id")


@query("subword_labels", "SELECT p_partkey, '-100;B-RT;-100;I-RT;-100' AS labels, 'x;z' AS words FROM part")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("array(null, 0, 0, 1, null)").alias("w"), F.array(F.lit("B-RT"), F.lit("I-RT")).alias("l"), F.array(*map(F.lit, "_xyz_")).alias("p"))
    return part.select("p_partkey", F.array_join(E.first_subword("w", "l"), ";").alias("labels"), F.array_join(E.word_predictions("w", "p"), ";").alias("words"))


@query("binary_rates", "SELECT count(*) FILTER (quality = 0) AS positives, count(*) FILTER (quality = 0 AND toxic = 1) AS hits, count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (quality = 0) AS recall, count(*) FILTER (toxic = 1) / count(*) AS false_rate FROM labels")
def _(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("quality") == 0).alias("g"), (F.col("toxic") == 1).alias("p"), (F.col("toxic") == 0).alias("ok"))
    return E.recall(x, "g", "p").crossJoin(E.false_correction_rate(x, "ok").select(F.col("rate").alias("false_rate")))  # one row each


@query("region_codes", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '32.' || lpad(cast(c_custkey % 100 AS string), 2, '0') END AS city, sha256('{\"a\":\"' || c_mktsegment || '\",\"b\":null}') AS hash FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(k % 3 == 0, "32-1").otherwise(F.concat(F.lit("32"), F.when(k % 2 == 0, ".").otherwise(""), F.lpad((k % 100).cast("string"), 2, "0"))).alias("x"), F.lit(None).cast("string").alias("b"), F.col("c_mktsegment").alias("a"))
    return c.select("c_custkey", S.region_code("x", "city").alias("city"), S.canonical_hash("b", "a").alias("hash"))


@query("unicode_forms", "SELECT p_partkey, 'Jalan ' || cast(p_partkey AS string) AS composed, 1.0 AS same FROM part")
def _(spark, sf_dir):
    from tapal.functions.matching import matching_ratio
    from tapal.functions.text_udfs import compose

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("Ｊａｌａｎ　　"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "０１２３４５６７８９")).alias("x"), "p_name")
    return part.select("p_partkey", compose("x").alias("composed"), matching_ratio("p_name", "p_name").alias("same"))


@query("search_results", "SELECT p_partkey, p_name AS village, '40111' AS code FROM part WHERE p_partkey % 2 = 0")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    row = F.concat(F.lit("<tr><td>1</td><td>"), "p_name", F.lit("</td><td>d</td><td>c</td><td>p</td><td> 40111 </td></tr>"))
    html = F.concat(F.lit("<table><tr><td>1</td><td>x</td><td>d</td><td>c</td><td>p</td><td>9</td></tr></table><table id='"), F.when(k % 2 == 0, "list-data").otherwise("other"), F.lit("'><tr><th>h</th></tr>"), row, F.lit("<tr><td>short</td></tr></table>"))
    part = I.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), sf_dir, "part", "p_partkey").select("p_partkey", html.alias("h"))
    return D.search_results(part, "p_partkey", "h").select("p_partkey", F.col("values")[0].alias("village"), F.col("values")[4].alias("code"))
