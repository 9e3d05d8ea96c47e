"""Registered queries of files, documents of the hierarchy, orders, sums of a queue, actions, and spans of components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import address as A
from tapal.operators import annotation as N
from tapal.operators import evaluation as E
from tapal.operators import exceptions as X
from tapal.operators import files as L
from tapal.operators import governance as G
from tapal.operators import sinks as K
from tapal.operators import synthetic as Y
from tapal.plans import inputs as I
from tapal.plans.registry import _ADJ, _VALID, ORACLES, QUERIES, _adjudicated, hierarchy, query
from tapal.sources.documents import shared_folder

_h = I.oracle_table(I.HIERARCHY)

# --- files ---------------------------------------------------------------------------------------------------------------

#: Files with sizes, of which some are at places or of kinds that are passed over; documents are their texts.
_FILES = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'web/node_modules/' WHEN 1 THEN 'data/Private/' WHEN 2 THEN '.git/' WHEN 3 THEN 'src/raw.d/' ELSE 'src/' || lang || '/' END || 'f' || cast(doc_id AS string) || CASE doc_id % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tar.zip' WHEN 2 THEN '' ELSE '.py' END AS path,
 cast(n_chars * CASE WHEN doc_id % 5 = 0 THEN 20000 ELSE 1 END AS bigint) AS size, CASE WHEN doc_id % 11 = 0 THEN 'x = 1; API_KEY = "abcdefgh1"' WHEN doc_id % 13 = 0 THEN 'token="short"' WHEN doc_id % 17 = 0 THEN 'see ghp_' || 'abcdefghijklmnopqrstuv' ELSE 'nothing' END AS text FROM {documents}"""
_f = I.oracle_table(_FILES)


@query("scannable_files", f"SELECT doc_id, path FROM {_f} f WHERE doc_id % 9 NOT IN (0, 2) AND doc_id % 7 NOT IN (0, 1) AND size <= 6291456")
def _(spark, sf_dir):
    return I.spark_table(spark, sf_dir, _FILES).where(L.scannable(F.col("path"), F.col("size"))).select("doc_id", "path")


@query("policy_problems", f"""SELECT path, 'forbidden_location' AS problem FROM {_f} f WHERE doc_id % 9 = 1 UNION ALL SELECT path, 'too_large' FROM {_f} f WHERE size > 10485760
 UNION ALL SELECT path, 'possible_secret' FROM {_f} f WHERE size <= 10485760 AND (doc_id % 11 = 0 OR (doc_id % 17 = 0 AND doc_id % 13 <> 0)) UNION ALL SELECT 'README.md', 'missing' UNION ALL SELECT 'src/raw.d/none', 'missing'""")
def _(spark, sf_dir):
    return L.policy_problems(I.spark_table(spark, sf_dir, _FILES).select("path", "size", "text"), ["README.md", "src", "src/raw.d", "src/raw.d/none"])


# --- the hierarchy -------------------------------------------------------------------------------------------------------


def _rows(spark, sf_dir: str) -> DataFrame:
    return I.spark_table(spark, sf_dir, I.HIERARCHY).select("village_code", "village_name", "postal_code")


@query("hierarchy_document", f"""WITH r AS (SELECT '{{"postal_code":"' || postal_code || '","village_code":"' || village_code || '","village_name":"' || village_name || '"}}' AS j, row_number() OVER (ORDER BY village_code) AS n, count(*) OVER () AS t FROM {_h} h),
 x AS (SELECT '{{"exception_id":"x' || n_nationkey || '"}}' AS j, row_number() OVER (ORDER BY 'x' || n_nationkey) AS n, count(*) OVER () AS t FROM nation)
 SELECT CAST(section AS INT) AS section, number, line FROM (SELECT 0 AS section, 1 AS number, '{{"schema_version":"1.0.0","build":{{"made_by":"a query"}},"rows":[' AS line UNION ALL SELECT 1, n, j || CASE WHEN n < t THEN ',' ELSE '' END FROM r UNION ALL SELECT 2, 1, '],"exceptions":[' UNION ALL SELECT 3, n, j || CASE WHEN n < t THEN ',' ELSE '' END FROM x UNION ALL SELECT 4, 1, ']}}') y""")
def _(spark, sf_dir):
    exceptions = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("x"), "n_nationkey").alias("exception_id"))
    return L.document_lines(_rows(spark, sf_dir), exceptions, {"made_by": "a query"}, ["village_code"], ["exception_id"])


@query("hierarchy_read_back", f"SELECT village_code, village_name, postal_code FROM {_h} h")
def _(spark, sf_dir):
    exceptions = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("x"), "n_nationkey").alias("exception_id"))
    path = f"{shared_folder(spark)}/hierarchy-{uuid.uuid4().hex}"
    L.write_document(L.document_lines(_rows(spark, sf_dir), exceptions, {}, ["village_code"], ["exception_id"]), path)
    return L.read_document(spark, path, "village_code string, village_name string, postal_code string")[0]


@query("villages_by_code", f"SELECT o_orderkey, village_code, village_name FROM {_h} h JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0")
def _(spark, sf_dir):
    table = f"villages_{uuid.uuid4().hex}"
    L.write_by_code(_rows(spark, sf_dir), table, f"{shared_folder(spark)}/{table}")
    wanted = I.spark_table(spark, sf_dir, f"SELECT o_orderkey, village_code FROM ({I.HIERARCHY}) h JOIN {{orders}} ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0")
    return wanted.join(spark.table(table), "village_code").select("o_orderkey", "village_code", "village_name")


# --- orders, sums, actions -----------------------------------------------------------------------------------------------


@query("ordered_conflicts", "SELECT l_orderkey, village_code, field, issue, row_number() OVER (ORDER BY village_code, field, issue) AS place FROM (SELECT DISTINCT l_orderkey, 'v' || l_orderkey % 1000 AS village_code, l_returnflag || l_orderkey AS field, l_linestatus AS issue FROM lineitem) x")
def _(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.concat(F.lit("v"), F.col("l_orderkey") % 1000).alias("village_code"), F.concat("l_returnflag", "l_orderkey").alias("field"), F.col("l_linestatus").alias("issue")).distinct()
    return G.in_order(lines, "conflicts")


@query("queue_sums", """WITH q AS (SELECT CASE WHEN p_size < 5 THEN 'P0_missing_source' WHEN p_size < 20 THEN 'P1_high_impact' ELSE 'P3_targeted' END AS p, CASE p_partkey % 3 WHEN 0 THEN 'not_observed' WHEN 1 THEN 'observed_matches_source' ELSE 'observed_new_value' END AS s, p_size AS n FROM part),
 a AS (SELECT 'all' AS kind, 'all' AS name, n FROM q UNION ALL SELECT 'priority', p, n FROM q UNION ALL SELECT 'status', s, n FROM q UNION ALL SELECT 'progress', CASE WHEN s = 'not_observed' THEN 'pending' ELSE 'observed' END, n FROM q) SELECT kind, name, count(*) AS rows, CAST(sum(n) AS BIGINT) AS represented FROM a GROUP BY kind, name""")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 3
    queue = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(F.col("p_size") < 5, "P0_missing_source").when(F.col("p_size") < 20, "P1_high_impact").otherwise("P3_targeted").alias("priority"), F.when(k == 0, "not_observed").when(k == 1, "observed_matches_source").otherwise("observed_new_value").alias("observation_status"), F.col("p_size").alias("triplet_cluster_size"))
    return G.queue_sums(queue)


_CASES = "SELECT p_partkey AS id, p_partkey % 5 = 0 AS r, p_partkey % 3 = 0 AS g, p_partkey % 7 = 0 AS l, p_partkey % 2 = 0 AS a FROM part"


def _cases(spark, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.when(k % 5 == 0, 2).otherwise(0).alias("n_repairs"), F.when(k % 3 == 0, F.array(F.lit("model"), F.lit("generator"))).otherwise(F.array(F.lit("model"))).alias("components"), F.when(k % 7 == 0, F.array(F.lit("landmark"))).otherwise(none).alias("categories"), F.when(k % 2 == 0, "automated_accepted").alias("provenance"))


@query("action_cases", f"WITH c AS ({_CASES}) SELECT 'A01' AS action_id, id FROM c WHERE r UNION ALL SELECT 'A02', id FROM c WHERE g UNION ALL SELECT 'A03', id FROM c WHERE l UNION ALL SELECT 'A04', id FROM c WHERE a")
def _(spark, sf_dir):
    return E.action_cases(_cases(spark, sf_dir), "id")


@query("action_register", f"WITH c AS ({_CASES}) SELECT 'A01' AS action_id, 'P0' AS priority, 'validator' AS owner, count(*) FILTER (r) AS evidence_cases FROM c UNION ALL SELECT 'A02', 'P0', 'generator', count(*) FILTER (g) FROM c UNION ALL SELECT 'A03', 'P1', 'model', count(*) FILTER (l) FROM c UNION ALL SELECT 'A04', 'P1', 'annotation', count(*) FILTER (a) FROM c")
def _(spark, sf_dir):
    return E.action_register(_cases(spark, sf_dir), "id")


@query("free_component_spans", """SELECT o_orderkey AS id, x.label, CAST(x.s AS INT) AS start, CAST(x.e AS INT) AS "end" FROM orders, (VALUES ('road', 0, 2, 1), ('city', 3, 6, 1), ('again', 6, 8, 2), ('name', 2, 3, 1)) x(label, s, e, m) WHERE x.m = 1 OR o_orderkey % 2 = 0""")
def _(spark, sf_dir):
    # Jl. Mawar Bandung , Kota Bandung - Kota/Bandung: the second city span is free only once the first is taken.
    k = F.col("o_orderkey")
    tokens = F.array(*map(F.lit, ["Jl.", "Mawar", "Bandung", ",", "Kota", "Bandung", "-", "Kota/Bandung"]))
    entry = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("value"))
    every = [entry("road", "jl mawar"), entry("city", "KOTA: BANDUNG"), entry("nowhere", "Bandung Kota"), entry("name", "bandung"), entry("blank", " . ")]
    both = F.when(k % 2 == 0, F.array(*every[:2], entry("again", "- kota bandung"), *every[2:])).otherwise(F.array(*every))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), tokens.alias("t"), both.alias("c"))
    return rows.select("id", F.explode(N.component_spans("t", "c")).alias("s")).select("id", "s.*")


@query("ordered_spans", "SELECT p_partkey AS id, array_to_string(list_transform(list_sort([[p_size % 4, p_size % 4 + p_partkey % 3 + 1, 3], [1, 2, 1], [1, 3, 0], [p_partkey % 4, 4, 2]]), lambda x: ['JALAN', 'KODEPOS', 'NOMOR', 'RT'][x[3] + 1] || ':' || x[1] || '-' || x[2]), ' ') AS spans FROM part WHERE p_partkey % 4 > 1 AND p_size % 4 = 3")
def _(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    span = lambda t, a, b: F.struct(F.lit(t).alias("type"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where((k % 4 > 1) & (s == 3)).select(k.alias("id"), E.sorted_spans(F.array(span("NOMOR", k % 4, F.lit(4)), span("JALAN", F.lit(1), F.lit(3)), span("RT", s, s + k % 3 + 1), span("KODEPOS", F.lit(1), F.lit(2)))).alias("x"))
    return part.select("id", F.array_join(F.transform("x", lambda y: F.concat(y["type"], F.lit(":"), y["start"], F.lit("-"), y["end"])), " ").alias("spans"))


@query("noise_counts", "WITH v AS (" + ORACLES["varied_addresses"] + ") SELECT noise, count(*) AS n FROM (SELECT unnest(string_split(categories, ';')) AS noise FROM v) x WHERE noise <> '' GROUP BY noise")
def _(spark, sf_dir):
    varied = QUERIES["varied_addresses"](spark, sf_dir)
    return Y.noise_distribution(varied.select(F.filter(F.split("categories", ";"), lambda x: x != "").alias("noise")))


# --- tables that are handed out --------------------------------------------------------------------------------------------


def _objects(spark, sf_dir: str) -> DataFrame:
    """API objects whose regions stand at the object, in the district or in its city."""
    t = I.dealt(I.spark_table(spark, sf_dir, I.HIERARCHY), sf_dir, "customer", "c_custkey")
    part = lambda x, code, name: F.concat(F.lit(f'"{x}":{{"code":"'), code, F.lit('","name":"'), name, F.lit('"'))
    k, close = F.col("c_custkey") % 4, F.lit("}")
    city, province = part("city", F.col("city_code"), F.col("city_name")), part("province", F.col("province_code"), F.col("province_name"))
    flat = F.concat(F.lit('"cityCode":"'), "city_code", F.lit('","cityName":"'), "city_name", F.lit('"'))
    district = F.concat(part("district", F.col("district_code"), F.col("district_name")), F.when(k == 0, F.concat(F.lit(","), city, F.lit(","), province, close, close)).when(k == 1, F.concat(F.lit(","), flat)).otherwise(F.lit("")), close)
    rest = F.when(k == 1, F.concat(F.lit(","), province, close)).when(k == 2, F.concat(F.lit(","), city, F.lit(","), province, close, close)).when(k == 3, F.concat(F.lit(","), city, close)).otherwise(F.lit(""))
    head = F.concat(F.lit('{"code":"'), F.regexp_replace("village_code", "[.]", ""), F.lit('","name":" '), F.when(F.col("c_custkey") % 50 == 7, "").otherwise(F.col("village_name")), F.lit('","postalCode":"'), F.when(F.col("c_custkey") % 60 == 9, "4011").otherwise(F.col("postal_code")), F.lit('",'))
    return t.select("village_code", "c_custkey", F.concat(head, district, rest, close).alias("j"))


_CODE = "substr(d, 1, 2) || '.' || substr(d, 3, 2) || '.' || substr(d, 5, 2) || '.' || substr(d, 7, 4)"
#: Village codes of the tables have 13 digits, of which API objects here give ten.
_TEN = f"(SELECT *, {_CODE} AS code FROM (SELECT *, replace(city_code, '.', '') || lpad(cast(c_custkey % 1000000 AS string), 6, '0') AS d FROM {_h} h) x)"


def _ten(df: DataFrame) -> DataFrame:
    return df.withColumn("j", F.concat(F.lit('{"code":"'), F.regexp_replace(F.substring("village_code", 1, 5), "[.]", ""), F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"), F.regexp_replace("j", '^[{]"code":"[0-9]*', "")))


@query("crosscheck_table", f"""SELECT 'api' AS source_id, 's1' AS snapshot, province_code, province_name, city_code, city_name, district_code, district_name, code AS village_code, village_name, postal_code, 'https://api/' || code AS evidence_url, 'checked' AS note
 FROM {_TEN} t WHERE c_custkey % 4 < 3 AND c_custkey % 50 <> 7 AND c_custkey % 60 <> 9""")
def _(spark, sf_dir):
    df = _ten(_objects(spark, sf_dir))
    code = F.get_json_object("j", "$.code")
    url = F.concat(F.lit("https://api/"), F.concat_ws(".", F.substring(code, 1, 2), F.substring(code, 3, 2), F.substring(code, 5, 2), F.substring(code, 7, 4)))
    return X.crosscheck_table(df, "j", "api", " s1 ", "checked", url)[0]


@query("crosscheck_problems", f"""SELECT d AS village_code, 'no_province' AS problem FROM {_TEN} t WHERE c_custkey % 4 = 3 UNION ALL SELECT d, 'no_village_name' FROM {_TEN} t WHERE c_custkey % 50 = 7 UNION ALL SELECT d, 'postal_code' FROM {_TEN} t WHERE c_custkey % 60 = 9""")
def _(spark, sf_dir):
    return X.crosscheck_table(_ten(_objects(spark, sf_dir)), "j", "api", "s1", "", F.lit(""))[1]


@query("app_lookup", f"SELECT village_code, province_code, province_name, city_code, city_name, district_code, district_name, village_name, postal_code FROM {_h} h WHERE c_custkey % 3 = 0")
def _(spark, sf_dir):
    t = I.spark_table(spark, sf_dir, I.HIERARCHY)
    return G.app_lookup(t.where("c_custkey % 3 = 0").select("village_code", F.concat("postal_code", F.lit(".0")).alias("postal_code")), t)


@query("benchmark_counts", """WITH w AS (SELECT p_brand AS a, cast(p_size % 3 AS string) AS l FROM part) SELECT 'all' AS kind, 'all' AS name, count(*) AS n FROM w UNION ALL SELECT 'annotator', a, count(*) FROM w GROUP BY a UNION ALL SELECT 'level', l, count(*) FROM w GROUP BY l""")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("reference_address"), (F.col("p_size") % 3).cast("string").alias("level"), "p_brand")
    blank = N.worksheet_template(part, ["id", "reference_address", "level", "p_brand"])
    filled = blank.withColumn("rewritten_address", F.concat("reference_address", F.lit(" baru"))).withColumn("annotator_id", F.col("p_brand"))
    return N.assembled_benchmark(filled, "id", "reference_address", "level")[1]


@query("case_records", """WITH x AS (SELECT p_partkey AS id, p_partkey % 5 = 0 AS crit, p_partkey % 7 = 0 AS orphan FROM part) SELECT 'RD-' || id AS case_id, CASE WHEN id % 2 = 0 THEN 'agreed' END AS provenance, 'JALAN:0-2:Jl. Mawar RT:2-3:RT KECAMATAN:3-5:Kec. Cibeunying' AS gold_spans,
 'JALAN:0-' || CASE WHEN crit THEN '1:Jl.' ELSE '2:Jl. Mawar' END || ' RT:2-3:RT KECAMATAN:3-5:Kec. Cibeunying' || CASE WHEN orphan THEN ' RW:5-6:x' ELSE '' END AS predicted_spans, CASE WHEN orphan THEN '5:I-RW>B-RW' ELSE '' END AS repairs FROM x WHERE crit OR orphan""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    array = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"), array("Jl.", "Mawar", "RT", "Kec.", "Cibeunying", "x").alias("tokens"), array("B-JALAN", "I-JALAN", "B-RT", "B-KECAMATAN", "I-KECAMATAN", "O").alias("gold"),
        array("B-JALAN", F.when(k % 5 == 0, "O").otherwise("I-JALAN"), "B-RT", "B-KECAMATAN", "I-KECAMATAN", F.when(k % 7 == 0, "I-RW").otherwise("O")).alias("predicted"),
        F.lit("").alias("street"), F.lit("").alias("district"), F.lit("").alias("city"), F.when(k % 2 == 0, "agreed").alias("provenance"),
    )
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["type"], F.lit(":"), s["start"], F.lit("-"), s["end"], F.lit(":"), s["text"])), " ").alias(c)
    return N.case_records(part, "id").select("case_id", "provenance", listed("gold_spans"), listed("predicted_spans"), F.array_join(F.transform("repairs", lambda r: F.concat(r["index"], F.lit(":"), r["before"], F.lit(">"), r["after"])), " ").alias("repairs"))


@query("quality_rows", """WITH s AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE cast(p_partkey // 2 AS string) END AS k, CASE WHEN p_size < 5 THEN '' ELSE p_brand END AS brand, 'parts' AS t FROM part UNION ALL SELECT cast(s_suppkey AS string), 'x', 'suppliers' FROM supplier),
 g AS (SELECT t, trim(k) AS k, count(*) AS n, count(*) FILTER (brand = '') AS b FROM s GROUP BY t, trim(k)), a AS (SELECT t, sum(n) AS rows, count(*) FILTER (k <> '') AS distinct_keys, coalesce(sum(n) FILTER (k = ''), 0) AS blank_keys, count(*) FILTER (k <> '' AND n > 1) AS repeated_keys, sum(b) AS blank_brand FROM g GROUP BY t)
 SELECT t AS "table", metric, CAST(value AS BIGINT) AS value FROM (SELECT t, 'rows' AS metric, rows AS value FROM a UNION ALL SELECT t, 'distinct_keys', distinct_keys FROM a UNION ALL SELECT t, 'blank_keys', blank_keys FROM a UNION ALL SELECT t, 'repeated_keys', repeated_keys FROM a UNION ALL SELECT t, 'blank_brand', blank_brand FROM a WHERE t = 'parts') x""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(k % 10 == 0, " ").otherwise(F.floor(k / 2).cast("string")).alias("k"), F.when(F.col("p_size") < 5, "").otherwise(F.col("p_brand")).alias("brand"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    return K.quality_rows({"parts": parts, "suppliers": suppliers}, "k", ["brand"])


@query("adjudication_sums", _ADJ + """, z AS (SELECT decision, CASE WHEN code <> '' THEN 'verified_adjudicated' WHEN decision = 'remain_unresolved' THEN 'blocked' ELSE 'error' END AS s, verification_status AS b FROM y)
 SELECT 'all' AS kind, 'all' AS name, count(*) AS n FROM z UNION ALL SELECT 'decision', decision, count(*) FROM z GROUP BY decision UNION ALL SELECT 'status', s, count(*) FROM z GROUP BY s UNION ALL SELECT 'before', b, count(*) FROM z GROUP BY b""")
def _(spark, sf_dir):
    return G.adjudication_sums(_adjudicated(spark, sf_dir))


_REASON = "CASE status WHEN 'incomplete' THEN 'MISSING_ADMINISTRATIVE_FIELDS' WHEN 'not_found' THEN 'REFERENCE_COVERAGE_GAP' WHEN 'invalid' THEN 'ADMINISTRATIVE_CONFLICT' WHEN 'ambiguous' THEN 'AMBIGUOUS_ADMINISTRATIVE_CANDIDATES' ELSE 'VALID_ADMINISTRATIVE_CHAIN' END"


@query("stage_counts", _VALID + f""", q AS MATERIALIZED (SELECT status, {_REASON} AS reason, gate_status FROM z), y AS (SELECT 'extracted' AS stage, * FROM q UNION ALL SELECT 'normalized', * FROM q)
 SELECT stage, 'status' AS kind, status AS name, count(*) AS n FROM y GROUP BY ALL UNION ALL SELECT stage, 'reason', reason, count(*) FROM y GROUP BY ALL UNION ALL SELECT 'gate', 'status', gate_status, count(*) FROM q GROUP BY ALL""")
def _(spark, sf_dir):
    # What the normalizer itself changes is told by normalization_changes_by_rule.
    return A.stage_counts(I.addresses(spark, sf_dir, I.ADDRESSES).select("address_id", *S.ADMIN_FIELDS), A.lookup(hierarchy(spark, sf_dir))).where("stage <> 'normalizer'")
