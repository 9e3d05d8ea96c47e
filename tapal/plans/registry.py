"""Every query of the library outside tapal.llm, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import address as A
from tapal.operators import evaluation as E
from tapal.operators import governance as G
from tapal.plans import inputs as I
from tapal.sources import documents as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


def joined(x: str) -> F.Column:
    return F.array_join(x, ";")


_h, _a, _s, _c, _r, _l, _raw = (I.oracle_table(x) for x in (I.HIERARCHY, I.ADDRESSES, I.SOURCES, I.CONSENSUS, I.REVIEWS, I.LABELS, I.RAW))
_KINDS = ", ".join(f"'{k}'" for k in S.KINDS)


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z]+', ' ', 'g'))"


def _word(x: str) -> str:
    return f"regexp_extract({_norm(x)}, '^([0-9a-z]+)', 1)"


def _base(x: str) -> str:
    return f"CASE WHEN {_word(x)} IN ({_KINDS}) THEN trim(regexp_replace({_norm(x)}, '^[0-9a-z]+', '')) ELSE {_norm(x)} END"


def _kind(x: str) -> str:
    return f"CASE {_word(x)} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.KINDS.items()) + " END"


# --- validation and gate -------------------------------------------------------------------------------------------


def hierarchy(spark, sf_dir: str) -> DataFrame:
    h = I.dealt(I.spark_table(spark, sf_dir, I.HIERARCHY), sf_dir, "customer", "c_custkey")
    none = F.array().cast("array<string>")
    h = h.withColumn("village_aliases", F.filter(F.array("village_alias"), lambda x: x != "")).withColumn("postal_codes", F.array("postal_code"))
    return h.withColumn("district_aliases", none).withColumn("city_aliases", none).withColumn("province_aliases", none)


def validated(spark, sf_dir: str) -> DataFrame:
    return A.gate(A.validate(I.addresses(spark, sf_dir, I.ADDRESSES), A.lookup(hierarchy(spark, sf_dir))))


def _match(field: str, name: str) -> str:
    a, r = f"a.{field}", f"r.{name}"
    return f"(trim({a}) = '' OR (({_base(r)}) <> '' AND ({_base(r)}) = ({_base(a)}) AND coalesce(({_kind(r)}) = ({_kind(a)}), true)))"


_OTHERS = ["KECAMATAN", "KOTA_KABUPATEN", "PROVINSI", "KODEPOS"]
_VALID = f"""
WITH a AS (SELECT * FROM {_a} x), r AS (SELECT *, village_name AS v FROM {_h} x UNION ALL SELECT *, village_alias AS v FROM {_h} y WHERE village_alias <> ''),
j AS (SELECT a.*, r.village_code AS code, {_match('KECAMATAN', 'district_name')} AS m1, {_match('KOTA_KABUPATEN', 'city_name')} AS m2, {_match('PROVINSI', 'province_name')} AS m3, (trim(a.KODEPOS) = '' OR a.KODEPOS = r.postal_code) AS m4
 FROM a JOIN r ON ({_base('a.KELURAHAN')}) <> '' AND ({_base('a.KELURAHAN')}) = ({_base('r.v')}) AND coalesce(({_kind('a.KELURAHAN')}) = ({_kind('r.v')}), true)),
g AS (SELECT address_id, count(DISTINCT code) AS b, count(DISTINCT code) FILTER (m1 AND m2 AND m3 AND m4) AS c, bool_or(m1) AS a1, bool_or(m2) AS a2, bool_or(m3) AS a3, bool_or(m4) AS a4,
 bool_or(m2 AND m3 AND m4) AS r1, bool_or(m1 AND m3 AND m4) AS r2, bool_or(m1 AND m2 AND m4) AS r3, bool_or(m1 AND m2 AND m3) AS r4 FROM j GROUP BY address_id),
v AS (SELECT a.*, coalesce(b, 0) AS b, coalesce(c, 0) AS c, concat_ws(';', CASE WHEN a.KELURAHAN = '' THEN 'KELURAHAN' END, {', '.join(f"CASE WHEN a.{f} = '' THEN '{f}' END" for f in _OTHERS)}) AS missing,
 concat_ws(';', {', '.join(f"CASE WHEN a.{f} <> '' AND (NOT a{i} OR r{i}) THEN '{f}' END" for i, f in enumerate(_OTHERS, 1))}) AS hit, concat_ws(';', {', '.join(f"CASE WHEN a.{f} <> '' THEN '{f}' END" for f in _OTHERS)}) AS given FROM a LEFT JOIN g USING (address_id)),
w AS (SELECT *, CASE WHEN KELURAHAN = '' THEN 'incomplete' WHEN b = 0 THEN 'not_found' WHEN c = 0 THEN 'invalid' WHEN c > 1 THEN 'ambiguous' WHEN missing <> '' THEN 'incomplete' ELSE 'valid' END AS status FROM v),
z AS (SELECT *, CASE WHEN status = 'invalid' THEN CASE WHEN hit <> '' THEN hit ELSE given END ELSE '' END AS affected_fields, CASE WHEN status = 'invalid' THEN 'TIDAK_VALID' WHEN status = 'valid' THEN 'SIAP_DIPROSES' ELSE 'PERLU_KONFIRMASI' END AS gate_status FROM w)
"""


@query("gate_status_counts", _VALID + "SELECT gate_status, status, count(*) AS n FROM z GROUP BY gate_status, status")
def _(spark, sf_dir):
    return validated(spark, sf_dir).groupBy("gate_status", "status").agg(F.count(F.lit(1)).alias("n"))


@query("validate_components", _VALID + """SELECT address_id, status, CASE status WHEN 'incomplete' THEN 'MISSING_ADMINISTRATIVE_FIELDS' WHEN 'not_found' THEN 'REFERENCE_COVERAGE_GAP' WHEN 'invalid' THEN 'ADMINISTRATIVE_CONFLICT' WHEN 'ambiguous' THEN 'AMBIGUOUS_ADMINISTRATIVE_CANDIDATES' ELSE 'VALID_ADMINISTRATIVE_CHAIN' END AS reason_code,
 affected_fields, missing AS missing_fields, CASE WHEN KELURAHAN = '' THEN 0 WHEN status = 'invalid' THEN b ELSE c END AS n_candidates FROM z""")
def _(spark, sf_dir):
    return validated(spark, sf_dir).select("address_id", "status", "reason_code", joined("affected_fields").alias("affected_fields"), joined("missing_fields").alias("missing_fields"), "n_candidates")


@query("gate_issues", _VALID + """, i AS (SELECT 'KODEPOS_TIDAK_COCOK' AS reason_code, 'high' AS severity FROM z WHERE status = 'invalid' AND contains(affected_fields, 'KODEPOS')
 UNION ALL SELECT 'ADMINISTRATIVE_CONFLICT', 'high' FROM z WHERE status = 'invalid' AND affected_fields <> 'KODEPOS' UNION ALL SELECT 'MISSING_ADMINISTRATIVE_FIELDS', 'medium' FROM z WHERE status = 'incomplete'
 UNION ALL SELECT 'AMBIGUOUS_ADMINISTRATIVE_CANDIDATES', 'medium' FROM z WHERE status = 'ambiguous' UNION ALL SELECT 'KELURAHAN_TIDAK_DITEMUKAN', 'medium' FROM z WHERE status = 'not_found')
 SELECT reason_code, severity, count(*) AS n FROM i GROUP BY reason_code, severity""")
def _(spark, sf_dir):
    return S.each(validated(spark, sf_dir), "issues", "i").groupBy("i.reason_code", "i.severity").agg(F.count(F.lit(1)).alias("n"))


@query("hierarchy_lookup_status", f"""WITH r AS (SELECT *, village_name AS v FROM {_h} x UNION ALL SELECT *, village_alias FROM {_h} y WHERE village_alias <> ''),
 n AS (SELECT a.address_id, count(DISTINCT r.village_code) AS n_rows FROM {_a} a LEFT JOIN r ON {_norm('a.KELURAHAN')} = {_norm('r.v')} AND ({_norm('a.KOTA_KABUPATEN')} = '' OR {_norm('a.KOTA_KABUPATEN')} = {_norm('r.city_name')}) GROUP BY a.address_id)
 SELECT address_id, CASE n_rows WHEN 0 THEN 'not_found' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS lookup_status, n_rows FROM n""")
def _(spark, sf_dir):
    wanted = I.addresses(spark, sf_dir, I.ADDRESSES).withColumn("KECAMATAN", F.lit("")).withColumn("PROVINSI", F.lit(""))
    return A.exact_lookup(wanted, hierarchy(spark, sf_dir))


@query("hierarchy_integrity", f"""WITH h AS (SELECT *, CASE WHEN c_custkey % 97 = 0 THEN '9' || district_code ELSE district_code END AS dc, CASE WHEN c_custkey % 89 = 0 THEN 'abc' ELSE postal_code END AS pc FROM {_h} x)
 SELECT village_code AS code, 'district_parent' AS reason FROM h WHERE NOT starts_with(village_code, dc || '.') UNION ALL SELECT village_code, 'city_parent' FROM h WHERE NOT starts_with(dc, city_code || '.') UNION ALL SELECT village_code, 'postal_codes' FROM h WHERE NOT regexp_matches(pc, '^[0-9]{{5}}$')""")
def _(spark, sf_dir):
    h = hierarchy(spark, sf_dir).withColumn("district_code", F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit("9"), "district_code")).otherwise(F.col("district_code")))
    return G.hierarchy_violations(h.withColumn("postal_codes", F.when(F.col("c_custkey") % 89 == 0, F.array(F.lit("abc"))).otherwise(F.col("postal_codes"))))


# --- scalar functions ----------------------------------------------------------------------------------------------


@query("normalize_names", f"""SELECT p_partkey, {_norm("p_name || ' / ' || p_brand || 'É'")} AS workbook, trim(regexp_replace(lower(strip_accents(p_name || ' / ' || p_brand || 'É')), '[^0-9a-z]+', ' ', 'g')) AS hierarchy, lower(trim(regexp_replace('  ' || p_name || '   ' || p_brand, '\\s+', ' ', 'g'))) AS pos FROM part""")
def _(spark, sf_dir):
    x = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("É"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", S.normalize_workbook(x).alias("workbook"), S.normalize_hierarchy(x).alias("hierarchy"), S.normalize_pos(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand")).alias("pos"))


@query("canonical_codes", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '12' ELSE lpad(cast(3200000000 + o_orderkey AS string), 10, '0') END AS c, CASE WHEN o_orderkey % 7 = 0 THEN '00000' ELSE cast(10000 + o_orderkey % 95000 AS string) || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END END AS p FROM orders)
 SELECT o_orderkey, CASE WHEN length(c) = 10 THEN c[1:2] || '.' || c[3:4] || '.' || c[5:6] || '.' || c[7:10] ELSE '' END AS village_code, CASE WHEN length(c) = 10 THEN c[1:2] || '.' || c[3:4] ELSE '' END AS city_code, CASE WHEN regexp_matches(regexp_replace(p, '\\.0$', ''), '^[0-9]{5}$') AND p <> '00000' THEN regexp_replace(p, '\\.0$', '') ELSE '' END AS postal FROM x""")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    code = F.when(k % 9 == 0, "12").otherwise((k + 3200000000).cast("string"))
    postal = F.when(k % 7 == 0, "00000").otherwise(F.concat((k % 95000 + 10000).cast("string"), F.when(k % 2 == 0, ".0").otherwise("")))
    out = o.select("o_orderkey", S.village_code(code).alias("village_code"), S.clean_postal(postal).alias("postal"))
    return out.withColumn("city_code", S.parent_code("village_code", 2))


@query("tokenize_documents", """SELECT doc_id, len(regexp_extract_all(text, '[,;/:]|[^\\s,;/:]+')) AS n_tokens, md5(array_to_string(regexp_extract_all(text, '[,;/:]|[^\\s,;/:]+'), ' ')) AS tokens_md5 FROM documents""")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", S.tokens("text"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def _components(spark, sf_dir: str) -> DataFrame:
    df = I.addresses(spark, sf_dir, I.ADDRESSES).select("address_id", F.concat(F.lit("jl.  mawar "), F.col("address_id").cast("string")).alias("JALAN"), F.concat(F.lit("nomor "), (F.col("address_id") % 90).cast("string")).alias("NOMOR"), F.concat(F.lit("rt. "), (F.col("address_id") % 9).cast("string")).alias("RT"), F.col("KELURAHAN"), F.concat(F.substring("KODEPOS", 1, 2), F.lit(" "), F.substring("KODEPOS", 3, 3)).alias("KODEPOS"))
    return A.normalize(df, ["JALAN", "NOMOR", "RT", "KELURAHAN", "KODEPOS"])


_NORMAL = f"""SELECT address_id, 'Jalan Mawar ' || cast(address_id AS string) AS JALAN, 'No. ' || cast(address_id % 90 AS string) AS NOMOR, 'RT ' || lpad(cast(address_id % 9 AS string), 3, '0') AS RT,
 CASE WHEN KELURAHAN = 'Kel.' THEN 'Kelurahan' WHEN starts_with(KELURAHAN, 'kel. ') THEN 'Kelurahan ' || array_to_string(list_transform(string_split(KELURAHAN[6:], ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE KELURAHAN END AS KELURAHAN, KODEPOS FROM {_a} a"""


@query("normalize_components", _NORMAL)
def _(spark, sf_dir):
    return _components(spark, sf_dir).select("address_id", "JALAN", "NOMOR", "RT", "KELURAHAN", "KODEPOS")


@query("normalization_changes_by_rule", f"""WITH a AS (SELECT * FROM {_a} x)
 SELECT field, rule_id, count(*) AS n FROM (SELECT 'JALAN' AS field, unnest(['unicode_whitespace_v1', 'designator_dictionary_v1', 'component_capitalization_v1']) AS rule_id FROM a
 UNION ALL SELECT 'NOMOR', 'designator_dictionary_v1' FROM a UNION ALL SELECT 'RT', 'rt_rw_three_digit_v1' FROM a UNION ALL SELECT 'KELURAHAN', 'designator_dictionary_v1' FROM a WHERE KELURAHAN LIKE 'kel.%' OR KELURAHAN = 'Kel.' UNION ALL SELECT 'KELURAHAN', 'component_capitalization_v1' FROM a WHERE KELURAHAN LIKE 'kel.%'
 UNION ALL SELECT 'KODEPOS', 'postcode_spacing_v1' FROM a WHERE KODEPOS <> '' UNION ALL SELECT 'KODEPOS', 'unicode_whitespace_v1' FROM a WHERE KODEPOS = '') GROUP BY field, rule_id""")
def _(spark, sf_dir):
    return S.each(_components(spark, sf_dir), "changes", "c").groupBy("c.field", "c.rule_id").agg(F.count(F.lit(1)).alias("n"))


# --- raw addresses -------------------------------------------------------------------------------------------------

_CLEAN = "regexp_replace(regexp_replace(text, '^Penerima: Budi Santoso, ', ''), ', HP: [0-9]+$', '')"


@query("pii_redaction", f"SELECT address_id, regexp_replace(replace(text, 'Budi Santoso', '[NAME_REDACTED]'), 'HP: [0-9]+$', 'HP: [PHONE_REDACTED]') AS redacted_text, {_CLEAN} AS address_text, text <> {_CLEAN} AS has_pii FROM {_raw} r")
def _(spark, sf_dir):
    return A.redact(I.addresses(spark, sf_dir, I.RAW)).select("address_id", "redacted_text", "address_text", (F.size("pii_codes") > 0).alias("has_pii"))


@query("bio_decode", f"SELECT address_id, 'Jl. Mawar' AS JALAN, 'No. ' || cast(address_id % 90 + 1 AS string) AS NOMOR, 'RT 0' || cast(address_id % 9 + 1 AS string) AS RT, 'Kel. W' || cast(c_custkey % 613 AS string) AS KELURAHAN, 'Kec. ' || district_name AS KECAMATAN, postal_code AS KODEPOS FROM {_raw} r")
def _(spark, sf_dir):
    return A.decode(A.tag(A.redact(I.addresses(spark, sf_dir, I.RAW)))).select("address_id", "JALAN", "NOMOR", "RT", "KELURAHAN", "KECAMATAN", "KODEPOS")


@query("address_documents")
def _(spark, sf_dir):
    raw = I.addresses(spark, sf_dir, I.RAW).select("address_id", "text")
    return A.document(A.process(raw, A.lookup(hierarchy(spark, sf_dir))))


# --- governance ----------------------------------------------------------------------------------------------------


def _sources(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = I.spark_table(spark, sf_dir, I.SOURCES)
    names = ["village_code", "village_name", "city_code", "district_code", "city_name", "district_name"]
    return s.select(*names, F.col("d").alias("postal_code")), s.select("village_code", "village_name", F.col("o").alias("postal_code"), "c_custkey"), s.select("village_code", F.col("k").alias("postal_code"), "c_custkey")


def _consensus(spark, sf_dir: str) -> DataFrame:
    return G.consensus(*_sources(spark, sf_dir))


@query("consensus_rows", f"SELECT village_code, d, o, k, postal_code, postal_code_candidate, verification_status, CASE verification_status WHEN 'verified_consensus' THEN 'high' WHEN 'corroborated_candidate' THEN 'medium' ELSE 'unresolved' END AS confidence, CASE WHEN verification_status = 'verified_consensus' THEN 'no' ELSE 'yes' END AS review_required FROM {_c} c")
def _(spark, sf_dir):
    return _consensus(spark, sf_dir).select("village_code", "d", "o", "k", "postal_code", "postal_code_candidate", "verification_status", "confidence", "review_required")


@query("consensus_counts", f"SELECT verification_status, count(*) AS n FROM {_c} c GROUP BY verification_status")
def _(spark, sf_dir):
    return _consensus(spark, sf_dir).groupBy("verification_status").agg(F.count(F.lit(1)).alias("n"))


@query("code_remap", f"SELECT CASE WHEN c_custkey % 10 = 0 THEN 'X' || village_code ELSE village_code END AS village_code, c_custkey % 10 <> 0 AND c_custkey % 15 = 5 AS remap_conflict FROM {_s} s")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES)
    known = s.where("c_custkey % 10 = 0 or c_custkey % 15 = 5")
    res = known.select(F.col("village_code").alias("former_village_code"), F.concat(F.lit("X"), "village_code").alias("current_village_code"), F.when(F.col("c_custkey") % 10 == 0, F.col("village_name")).otherwise("OTHER").alias("resolved_name"))
    return G.remap(s, res).select("village_code", "remap_conflict")


@query("source_comparison", f"""WITH s AS (SELECT village_code, c_custkey % 10 <> 1 AS hd, c_custkey % 10 <> 2 AND c_custkey % 10 <> 4 AS ho, c_custkey % 10 <> 3 AS hk, CASE WHEN c_custkey % 10 <> 1 THEN d ELSE '' END AS d, CASE WHEN c_custkey % 10 <> 2 AND c_custkey % 10 <> 4 THEN o ELSE '' END AS o, CASE WHEN c_custkey % 10 <> 3 THEN k ELSE '' END AS k FROM {_s} x)
 SELECT village_code, d, o, k, CASE WHEN NOT hk THEN 'missing_in_api' WHEN NOT hd AND NOT ho THEN 'api_extra' WHEN k <> '' AND d = k AND o = k THEN 'all_match' WHEN k <> '' AND d = k THEN 'api_matches_diskominfo' WHEN k <> '' AND o = k THEN 'api_matches_odj' WHEN d = '' AND o = '' THEN 'api_only' ELSE 'api_differs_available_sources' END AS status,
 CASE WHEN NOT hk THEN 'missing_in_api' WHEN d = '' THEN 'source_postal_missing' WHEN d = k THEN 'match' ELSE 'different' END AS d_relation, CASE WHEN NOT hk THEN 'missing_in_api' WHEN o = '' THEN 'source_postal_missing' WHEN o = k THEN 'match' ELSE 'different' END AS o_relation, CASE WHEN d = '' AND o = '' THEN 'both_missing' WHEN d = '' THEN 'diskominfo_missing' WHEN o = '' THEN 'odj_missing' WHEN d = o THEN 'match' ELSE 'different' END AS local_relation FROM s""")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES)
    side = lambda c, where: s.where(where).select("village_code", F.col(c).alias("postal_code"))
    return G.compare(side("d", "c_custkey % 10 <> 1"), side("o", "c_custkey % 10 not in (2, 4)"), side("k", "c_custkey % 10 <> 3"))


@query("merged_decisions", f"""SELECT village_code, d, o, k, array_to_string(list_sort(list_distinct(list_filter([d, o, k], lambda x: x <> ''))), ';') AS candidates,
 CASE WHEN d = '' AND o = '' AND k = '' THEN 'unresolved' WHEN len(list_distinct(list_filter([d, o, k], lambda x: x <> ''))) = 1 THEN CASE WHEN d <> '' AND o <> '' THEN 'agree' WHEN d = '' AND o = '' THEN 'kodepos_only' WHEN d <> '' THEN 'diskominfo_only' ELSE 'odj_only' END
 WHEN d <> '' AND o <> '' AND d <> o THEN CASE WHEN k = d THEN 'conflict_api_supports_diskominfo' WHEN k = o THEN 'conflict_api_supports_odj' WHEN k <> '' THEN 'conflict_api_third_value' ELSE 'conflict' END
 WHEN d <> '' AND k <> d THEN 'conflict_api_vs_diskominfo' ELSE 'conflict_api_vs_odj' END AS decision FROM {_s} s""")
def _(spark, sf_dir):
    return G.merge(*_sources(spark, sf_dir)).select("village_code", "d", "o", "k", "candidates", "decision")


_UNRESOLVED = f"""WITH u AS (SELECT *, {I.PATTERN} AS unresolved_pattern FROM {_c} c WHERE verification_status = 'review_required'),
 t AS (SELECT *, count(*) OVER (PARTITION BY city_code, district_code, unresolved_pattern) AS district_cluster_size, count(*) OVER (PARTITION BY city_code, district_code, unresolved_pattern, d, o, k) AS triplet_cluster_size,
 'DIST-' || upper(substring(sha256('["' || city_code || '","' || district_code || '","' || unresolved_pattern || '"]'), 1, 12)) AS district_cluster_id, 'TRIP-' || upper(substring(sha256('["' || city_code || '","' || district_code || '","' || unresolved_pattern || '","' || d || '","' || o || '","' || k || '"]'), 1, 12)) AS triplet_cluster_id FROM u WHERE unresolved_pattern IS NOT NULL)"""


@query("unresolved_detail", _UNRESOLVED + " SELECT village_code, unresolved_pattern, district_cluster_id, district_cluster_size, triplet_cluster_id, triplet_cluster_size, CASE WHEN contains(unresolved_pattern, 'missing') THEN 'highest' ELSE 'high' END AS review_priority FROM t")
def _(spark, sf_dir):
    return G.group_unresolved(_consensus(spark, sf_dir)).select("village_code", "unresolved_pattern", "district_cluster_id", "district_cluster_size", "triplet_cluster_id", "triplet_cluster_size", "review_priority")


@query("unresolved_clusters", _UNRESOLVED + """, g AS (SELECT district_cluster_id, city_code, district_code, unresolved_pattern, count(*) AS row_count, count(DISTINCT triplet_cluster_id) AS triplet_count, coalesce(string_agg(DISTINCT nullif(d, ''), ';' ORDER BY nullif(d, '')), '') AS d_values, coalesce(string_agg(DISTINCT nullif(o, ''), ';' ORDER BY nullif(o, '')), '') AS o_values, coalesce(string_agg(DISTINCT nullif(k, ''), ';' ORDER BY nullif(k, '')), '') AS k_values,
 array_to_string(list(village_code ORDER BY village_code)[1:5], ';') AS sample_codes FROM t GROUP BY district_cluster_id, city_code, district_code, unresolved_pattern)
 SELECT *, row_number() OVER (ORDER BY row_count DESC, city_code, district_code, unresolved_pattern) AS cluster_rank FROM g""")
def _(spark, sf_dir):
    return G.clusters(G.group_unresolved(_consensus(spark, sf_dir)))


_QUEUE = _UNRESOLVED + """, q AS (SELECT *, row_number() OVER (PARTITION BY triplet_cluster_id ORDER BY village_code) AS rn, CASE WHEN contains(unresolved_pattern, 'missing') THEN 'P0_missing_source' WHEN triplet_cluster_size >= 10 THEN 'P1_high_impact' WHEN triplet_cluster_size >= 5 THEN 'P2_medium_impact' ELSE 'P3_targeted' END AS priority FROM t)"""


@query("spotcheck_queue", _QUEUE + f""", e AS (SELECT *, CASE WHEN CAST(right(village_code, 7) AS BIGINT) % 3 = 0 THEN o WHEN CAST(right(village_code, 7) AS BIGINT) % 3 = 1 THEN '81234' ELSE '' END AS observed FROM q WHERE rn = 1)
 SELECT village_code, priority, row_number() OVER (ORDER BY priority, triplet_cluster_size DESC, district_cluster_size DESC, city_code, district_code, triplet_cluster_id, village_code) AS queue_rank, observed, concat_ws(';', CASE WHEN observed <> '' AND observed = d THEN 'diskominfo' END, CASE WHEN observed <> '' AND observed = o THEN 'open_data_jabar' END, CASE WHEN observed <> '' AND observed = k THEN 'kodepos_dev' END) AS matched_sources,
 CASE WHEN observed = '' THEN 'not_observed' WHEN observed IN (d, o, k) THEN 'observed_matches_source' ELSE 'observed_new_value' END AS observation_status FROM e""")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES)
    observed = s.select("village_code", F.when(F.col("c_custkey") % 3 == 0, F.col("o")).when(F.col("c_custkey") % 3 == 1, "81234").otherwise("").alias("observed"))
    return G.spotcheck_queue(G.group_unresolved(_consensus(spark, sf_dir)), observed).select("village_code", "priority", "queue_rank", "observed", "matched_sources", "observation_status")


@query("review_worksheet", f"SELECT village_code, CASE WHEN verification_status = 'corroborated_candidate' THEN 'candidate' ELSE 'unresolved' END AS review_case, 'pending' AS review_status, '' AS corrected_postal_code, '' AS reviewer, '' AS note FROM {_c} c WHERE verification_status <> 'verified_consensus'")
def _(spark, sf_dir):
    c = _consensus(spark, sf_dir)
    return G.review_worksheet(c.where("verification_status = 'corroborated_candidate'"), c.where("verification_status = 'review_required'"))


_ADJ = f"""WITH j AS (SELECT c.village_code, c.verification_status, c.postal_code_candidate AS cand, r.*, c.verification_status = 'corroborated_candidate' AS sug FROM {_c} c JOIN {_r} r ON c.village_code = r.village_code WHERE c.verification_status <> 'verified_consensus'),
 x AS (SELECT *, CASE WHEN observation = 'exact_match' THEN official_code WHEN observation = 'no_exact_match' AND corrected_code <> '' AND (sug OR second_approval) THEN corrected_code WHEN observation = 'multiple_exact_codes' AND NOT sug AND corrected_code <> '' AND second_approval THEN corrected_code ELSE '' END AS code FROM j),
 y AS (SELECT *, CASE WHEN code <> '' AND sug AND code = cand THEN 'accept_suggested' WHEN code <> '' AND sug THEN 'replace_suggested' WHEN code <> '' THEN 'promote' WHEN sug THEN 'error_incomplete' ELSE 'remain_unresolved' END AS decision FROM x)"""


def _adjudicated(spark, sf_dir: str) -> DataFrame:
    return G.adjudicate(_consensus(spark, sf_dir).where("verification_status <> 'verified_consensus'").select("village_code", "postal_code_candidate", "verification_status"), I.spark_table(spark, sf_dir, I.REVIEWS))


@query("adjudicated_rows", _ADJ + " SELECT village_code, verification_status, decision, code AS adjudicated_code, CASE WHEN code <> '' THEN 'verified_adjudicated' WHEN decision = 'remain_unresolved' THEN 'blocked' ELSE 'error' END AS adjudication_status FROM y")
def _(spark, sf_dir):
    return _adjudicated(spark, sf_dir)


@query("staged_sections", _ADJ + f" SELECT village_code, postal_code, 1 AS section FROM {_c} c WHERE verification_status = 'verified_consensus' UNION ALL SELECT village_code, code, CASE WHEN sug THEN 2 ELSE 3 END FROM y WHERE code <> ''")
def _(spark, sf_dir):
    return G.staged_sections(_consensus(spark, sf_dir), _adjudicated(spark, sf_dir))


@query("canonical_parent_names", f"""WITH n AS (SELECT district_code, CASE WHEN c_custkey % 3 = 0 THEN district_name || ' X' WHEN c_custkey % 3 = 1 THEN district_name || ' Y' ELSE district_name END AS name FROM {_s} s), c AS (SELECT district_code, name, count(*) AS n FROM n GROUP BY district_code, name),
 r AS (SELECT *, row_number() OVER (PARTITION BY district_code ORDER BY n DESC, name) AS rn FROM c) SELECT district_code, name AS canonical_name FROM r WHERE rn = 1""")
def _(spark, sf_dir):
    k = F.col("c_custkey") % 3
    s = I.spark_table(spark, sf_dir, I.SOURCES).withColumn("n", F.concat("district_name", F.when(k == 0, " X").when(k == 1, " Y").otherwise("")))
    return G.canonical_names(s, "district_code", "n")


@query("final_reference", f"""SELECT village_code, village_name, district_code, district_name, postal_code, verification_status, CASE verification_status WHEN 'verified_consensus' THEN 'usable_verified' WHEN 'corroborated_candidate' THEN 'candidate_review_only' ELSE 'unresolved_do_not_guess' END AS operational_status,
 CASE WHEN c_custkey % 4 = 0 THEN village_name || ' B' ELSE '' END AS aliases, CASE WHEN c_custkey % 3 <> 0 OR k = '' THEN '' WHEN k = postal_code THEN 'postal_code' WHEN k = postal_code_candidate THEN 'candidate' ELSE 'new_value' END AS pos_match FROM {_c} c""")
def _(spark, sf_dir):
    d, o, k = _sources(spark, sf_dir)
    odj = o.withColumn("village_name", F.when(F.col("c_custkey") % 4 == 0, F.concat("village_name", F.lit(" B"))).otherwise(F.lower("village_name")))
    observed = k.where("c_custkey % 3 = 0").select("village_code", F.col("postal_code").alias("observed"))
    return G.final_reference(_consensus(spark, sf_dir), odj, G.canonical_names(d, "district_code", "district_name"), observed)


@query("primary_fold", """SELECT 'V' || cast(o_custkey AS string) AS village_code, min_by('N' || cast(o_orderkey % 3 AS string), o_orderkey) AS village_name, array_to_string(list_sort(list_distinct(list(cast(10000 + o_orderkey % 4 AS string)))), ';') AS postal_codes, count(DISTINCT o_orderkey % 4) - 1 AS postal_conflicts,
 array_to_string(list_sort(list_filter(list_distinct(list('N' || cast(o_orderkey % 3 AS string))), lambda x: x <> min_by('N' || cast(o_orderkey % 3 AS string), o_orderkey))), ';') AS aliases FROM orders GROUP BY o_custkey""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("ordinal"), F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias("village_code"), F.concat(F.lit("N"), (k % 3).cast("string")).alias("village_name"), (k % 4 + 10000).cast("string").alias("postal_code"))
    return G.primary_fold(rows).withColumn("postal_codes", joined("postal_codes")).withColumn("aliases", joined("aliases"))


# --- evaluation ----------------------------------------------------------------------------------------------------


def _spans_sql(column: str) -> str:
    return f"""SELECT id, substring(l, 3) AS type, CAST(i - 1 AS BIGINT) AS start, CAST(i + (SELECT count(*) FROM range(i + 1, 9) t(j) WHERE len(list_filter({column}[i + 1:j], lambda x: x <> 'I-' || substring(l, 3))) = 0) AS BIGINT) AS "end" FROM (SELECT id, {column}, unnest({column}) AS l, unnest(range(1, 9)) AS i FROM {_l} x) y WHERE l LIKE 'B-%'"""


def _spans(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = I.spark_table(spark, sf_dir, I.LABELS)
    return t, E.spans(t, "id", "gold"), E.spans(t, "id", "predicted")


@query("bio_spans", _spans_sql("predicted"))
def _(spark, sf_dir):
    return _spans(spark, sf_dir)[2]


@query("bio_repair", f"SELECT id, array_to_string(list_transform(predicted, lambda l, i: CASE WHEN l LIKE 'I-%' AND (i = 1 OR substring(predicted[i - 1], 3) <> substring(l, 3) OR predicted[i - 1] = 'O') THEN 'B-' || substring(l, 3) ELSE l END), ' ') AS labels FROM {_l} x")
def _(spark, sf_dir):
    return I.spark_table(spark, sf_dir, I.LABELS).select("id", F.array_join(E.repaired("predicted"), " ").alias("labels"))


@query("bio_violations", f"SELECT id, CAST(i - 1 AS BIGINT) AS position, predicted[i] AS label FROM (SELECT id, predicted, unnest(range(1, 9)) AS i FROM {_l} x) y WHERE predicted[i] LIKE 'I-%' AND (i = 1 OR substring(predicted[i - 1], 3) <> substring(predicted[i], 3))")
def _(spark, sf_dir):
    return E.invalid_transitions(I.spark_table(spark, sf_dir, I.LABELS), "id", "predicted")


_BOTH = f"""WITH g AS ({_spans_sql('gold')}), p AS ({_spans_sql('predicted')}), b AS (SELECT coalesce(g.id, p.id) AS id, coalesce(g.type, p.type) AS type, g.id IS NOT NULL AS ing, p.id IS NOT NULL AS inp FROM g FULL JOIN p ON g.id = p.id AND g.type = p.type AND g.start = p.start AND g."end" = p."end")"""
_SCORE = "tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END END AS f1"


@query("span_metrics", _BOTH + f", c AS (SELECT count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM b) SELECT {_SCORE} FROM c")
def _(spark, sf_dir):
    _, g, p = _spans(spark, sf_dir)
    return E.span_metrics(g, p, "id")


_TYPES = ", ".join(f"('{f}')" for f in S.FIELDS)


@query("span_metrics_by_type", _BOTH + f", c AS (SELECT t.type, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM (VALUES {_TYPES}) t(type) LEFT JOIN b ON b.type = t.type GROUP BY t.type) SELECT type, {_SCORE} FROM c")
def _(spark, sf_dir):
    _, g, p = _spans(spark, sf_dir)
    return E.span_metrics_by_type(g, p, "id")


_CRITICAL = ", ".join(f"'{f}'" for f in S.CRITICAL_FIELDS)


@query("critical_exact_match", _BOTH + f", w AS (SELECT DISTINCT id FROM b WHERE type IN ({_CRITICAL}) AND NOT (ing AND inp)) SELECT count(*) AS examples, count(*) FILTER (w.id IS NULL) AS exact, count(*) FILTER (w.id IS NULL) / count(*) AS rate FROM {_l} x LEFT JOIN w ON x.id = w.id")
def _(spark, sf_dir):
    t, g, p = _spans(spark, sf_dir)
    return E.critical_exact_match(t, g, p, "id")


@query("nearest_rank_latency", """WITH v AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM v)
 SELECT event_type, n, min(v) FILTER (rn = ceil(50 * n / 100)) AS p50, min(v) FILTER (rn = ceil(95 * n / 100)) AS p95, min(v) FILTER (rn = ceil(99 * n / 100)) AS p99, sum(v) / n AS mean FROM r GROUP BY event_type, n""")
def _(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return E.nearest_rank(ev, "v", ["event_type"])


@query("error_matrix", """WITH x AS (SELECT doc_id, quality, toxic, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'typo' END, CASE WHEN doc_id % 3 = 0 THEN 'abbreviation' END, CASE WHEN doc_id % 5 = 0 THEN 'conflict' END, 'landmark'], lambda y: y IS NOT NULL) AS c FROM labels), e AS (SELECT unnest(c) AS category, quality, toxic FROM x),
 g AS (SELECT t.category, count(e.category) AS exposure, count(*) FILTER (quality = 0) AS cases, count(*) FILTER (quality = 0 AND toxic = 1) AS critical_failures FROM (VALUES ('typo'), ('abbreviation'), ('rt_rw'), ('landmark'), ('missing_field'), ('conflict'), ('ambiguous_region'), ('other_surface_form')) t(category) LEFT JOIN e ON e.category = t.category GROUP BY t.category)
 SELECT *, CASE WHEN exposure > 0 THEN cases / exposure END AS rate, CASE WHEN category IN ('conflict', 'ambiguous_region') AND cases > 0 THEN 'P0' WHEN critical_failures >= 5 THEN 'P0' WHEN cases > 0 THEN 'P1' ELSE 'not_observed' END AS severity FROM g""")
def _(spark, sf_dir):
    k = F.col("doc_id")
    cases = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.array_compact(F.array(F.when(k % 2 == 0, F.lit("typo")), F.when(k % 3 == 0, F.lit("abbreviation")), F.when(k % 5 == 0, F.lit("conflict")), F.lit("landmark"))).alias("categories"), (F.col("quality") == 0).alias("failed"), (F.col("toxic") == 1).alias("critical"))
    return E.error_matrix(cases, "doc_id")


@query("stratified_select", """WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(cast(doc_id AS string)), doc_id) AS turn FROM documents) SELECT doc_id, lang, source, turn FROM r WHERE turn <= 70 ORDER BY turn, lang, source LIMIT 70""")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    return E.round_robin(docs, ["lang", "source"], [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")], 70)


@query("stratified_split", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(cast(doc_id AS string)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN rn <= round_even(n * 130 / 200, 0) THEN 'sealed' ELSE 'dev' END AS split FROM r""")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return E.proportional_split(docs, ["lang"], [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")], 130, 200).select("doc_id", "lang", "split")


@query("split_leakage", "SELECT 'base-' || cast(o_custkey AS string) AS base_id, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("base-"), F.col("o_custkey").cast("string"), F.lit("-01")).alias("id"), "o_orderstatus")
    return E.leakage(o, F.regexp_replace("id", "-[^-]*$", ""), "o_orderstatus")


@query("street_dedupe", "SELECT min(p_partkey) AS p_partkey, min_by(p_name, p_partkey) AS p_name, p_type, count(*) AS segment_count FROM part GROUP BY lower(trim(p_name)), p_type")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    return E.dedupe(part, [F.lower(F.trim("p_name")), F.col("p_type")], "p_partkey", "segment_count")


@query("way_representative", """WITH r AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_suppkey AS node_id FROM lineitem), n AS (SELECT s_suppkey AS node_id, s_nationkey * 1.0 AS lat, s_acctbal AS lon FROM supplier WHERE s_nationkey BETWEEN 5 AND 15),
 j AS (SELECT way_id, lat, lon, row_number() OVER (PARTITION BY way_id ORDER BY pos, node_id) AS rn FROM r JOIN n USING (node_id)) SELECT way_id, lat, lon FROM j WHERE rn = 1""")
def _(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ways = lines.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("node_ids"))
    nodes = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(F.col("s_nationkey").between(5, 15)).select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").cast("double").alias("lat"), F.col("s_acctbal").alias("lon"))
    return E.way_points(ways, nodes)


@query("delta_decode", "SELECT event_id, user_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS value_sum FROM events")
def _(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.round(F.col("value") * 100).cast("long"))
    return E.delta_decoded(ev, "user_id", ["ts", "event_id"], "v").select("event_id", "user_id", "value_sum")


RULES = {"email": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "phone": "[+]1 [(][0-9]{3}[)]", "secret": "(token|secret)[^=]{0,12}="}


@query("secret_scan", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS rule FROM l WHERE regexp_matches(t, '{p}')" for k, p in RULES.items()))
def _(spark, sf_dir):
    hits = E.rule_hits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), RULES, key="doc_id")
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), "rule")


@query("geocode_crosscheck", f"""WITH x AS (SELECT *, address_id % 4 <> 0 AS consent, CASE WHEN address_id % 9 = 0 THEN 'timeout' WHEN address_id % 10 = 0 THEN 'not_found' END AS failure, CASE WHEN address_id % 3 = 0 THEN 'street' ELSE 'rooftop' END AS precision, KODEPOS <> '' AND KODEPOS <> postal_code AS off FROM {_a} a)
 SELECT address_id, CASE WHEN NOT consent THEN 'NOT_REQUESTED' WHEN failure IS NOT NULL THEN 'EXTERNAL_FAILURE' WHEN precision <> 'rooftop' OR off THEN 'AMBIGUOUS' ELSE 'SUCCESS' END AS geocode_status,
 CASE WHEN NOT consent THEN '' WHEN failure = 'timeout' THEN 'GEOCODE_TIMEOUT' WHEN failure = 'not_found' THEN 'GEOCODE_NOT_FOUND' ELSE concat_ws(';', CASE WHEN precision <> 'rooftop' THEN 'LOW_PRECISION' END, CASE WHEN off THEN 'ADMIN_MISMATCH' END) END AS geocode_reasons FROM x""")
def _(spark, sf_dir):
    a = I.addresses(spark, sf_dir, I.ADDRESSES)
    k = F.col("address_id")
    results = a.select("address_id", F.when(k % 9 == 0, "timeout").when(k % 10 == 0, "not_found").alias("failure"), F.when(k % 3 == 0, "street").otherwise("rooftop").alias("precision"), F.lit("").alias("geo_KOTA_KABUPATEN"), F.lit("").alias("geo_PROVINSI"), F.col("postal_code").alias("geo_KODEPOS"))
    out = A.geocode(a.withColumn("consent", k % 4 != 0), results)
    return out.select("address_id", "geocode_status", joined("geocode_reasons").alias("geocode_reasons"))


@query("candidate_gates", "SELECT s_suppkey, concat_ws(';', CASE WHEN NOT s_acctbal >= 1000 THEN 'f1' END, CASE WHEN NOT s_nationkey < 20 THEN 'invalid_bio' END) AS failed_gates, s_acctbal >= 1000 AND s_nationkey < 20 AS selected FROM supplier")
def _(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return E.candidate_gates(s, {"f1": F.col("s_acctbal") >= 1000, "invalid_bio": F.col("s_nationkey") < 20}).select("s_suppkey", "failed_gates", "selected")


# --- sources -------------------------------------------------------------------------------------------------------


@query("json_flatten", "SELECT event_id, '$.k' AS path, 'number' AS type, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(spark, sf_dir):
    return D.flatten_json(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props")


@query("html_cells")
def _(spark, sf_dir):
    return D.html_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", ("tr", "ul"), ("td", "th", "li"))


# --- contract ------------------------------------------------------------------------------------------------------


@query("synthetic_labels")
def _(spark, sf_dir):
    from tapal.operators import synthetic

    bases = synthetic.base_addresses(hierarchy(spark, sf_dir), 2000, 20260813)
    return synthetic.with_splits(synthetic.variants(bases, 3, 20260813), 20260813, {"train": 0.75, "val": 0.125, "test": 0.125})


@query("source_coverage", f"SELECT 'd' AS source, count(*) FILTER (d <> '') AS n_given, count(DISTINCT nullif(d, '')) AS n_distinct FROM {_s} x UNION ALL SELECT 'o', count(*) FILTER (o <> ''), count(DISTINCT nullif(o, '')) FROM {_s} x UNION ALL SELECT 'k', count(*) FILTER (k <> ''), count(DISTINCT nullif(k, '')) FROM {_s} x")
def _(spark, sf_dir):
    s = I.spark_table(spark, sf_dir, I.SOURCES).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, "dok")), F.array("d", "o", "k"))).alias("source", "v"))
    return s.groupBy("source").agg(F.count_if(F.col("v") != "").alias("n_given"), F.countDistinct(F.nullif("v", F.lit(""))).alias("n_distinct"))


from tapal.plans import annotator, augmentation, listings, more, places, sealed  # noqa: E402, F401  the other queries
