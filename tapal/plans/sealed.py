"""Registered queries of reviews and sealed evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.operators import review as V
from tapal.operators import sealed as D
from tapal.plans import inputs as I
from tapal.plans.registry import _BOTH, _SCORE, _TYPES, query

_l, _a = I.oracle_table(I.LABELS), I.oracle_table(I.ADDRESSES)

# --- reviews -------------------------------------------------------------------------------------------------------------

#: Lines of orders as components (odd numbers) and corrections (even ones) of few fields, so that fields repeat and some corrections have no component.
_ENTRIES = """
SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_linenumber % 2 = 1 AS component,
 CASE l_partkey % 5 WHEN 0 THEN 'KELURAHAN' WHEN 1 THEN 'KECAMATAN' WHEN 2 THEN 'KOTA_KABUPATEN' WHEN 3 THEN 'RT' ELSE 'KODEPOS' END AS field, 'v' || cast(l_partkey AS string) AS value, CASE WHEN l_suppkey % 3 = 0 THEN 'p' || cast(l_suppkey AS string) ELSE '' END AS previous,
 's' || cast(l_suppkey AS string) AS proposed, CASE l_suppkey % 6 WHEN 0 THEN 'user_input' WHEN 1 THEN 'confirmed_by_user' WHEN 2 THEN 'rule_extracted' WHEN 3 THEN 'returned_by_geocoder' WHEN 4 THEN 'extracted_by_model' ELSE 'legacy' END AS source,
 CASE WHEN l_returnflag = 'A' THEN 'deterministic' ELSE 'requires_confirmation' END AS decision, l_linestatus = 'O' AND l_partkey % 4 = 0 AS applied
FROM {lineitem}"""
_e = I.oracle_table(_ENTRIES)
_SOURCE = "CASE source WHEN 'user_input' THEN 'user' WHEN 'confirmed_by_user' THEN 'user' WHEN 'rule_extracted' THEN 'parser' WHEN 'extracted_by_model' THEN 'parser' WHEN 'returned_by_geocoder' THEN 'reference' ELSE 'input' END"


def _documents(spark, sf_dir: str) -> DataFrame:
    e = I.spark_table(spark, sf_dir, _ENTRIES)
    held = lambda flag, value: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("pos", value.alias("x"))))), lambda y: y["x"])
    component = F.struct("field", F.struct("value", "source", (F.col("source") == "confirmed_by_user").alias("confirmed"), F.lit(None).cast("double").alias("model_score"), F.when(F.col("previous") != "", F.struct(F.col("previous").alias("value"))).alias("previous_value")).alias("result"))
    fix = F.struct("field", "decision", "applied", F.struct(F.col("previous").alias("value"), "source").alias("previous_value"), F.struct(F.col("proposed").alias("value")).alias("proposed_value"))
    return e.groupBy("id").agg(held(F.col("component"), component).alias("components"), held(~F.col("component"), fix).alias("corrections"))


@query("review_components", f"""WITH e AS {_e}, c AS (SELECT * FROM e WHERE component), f AS (SELECT * FROM e WHERE NOT component AND decision = 'requires_confirmation' AND NOT applied),
 w AS (SELECT id, field, arg_min(previous, pos) AS fp, arg_min(proposed, pos) AS fs FROM f GROUP BY id, field), o AS (SELECT f.*, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM f WHERE (id, field) NOT IN (SELECT (id, field) FROM c)),
 n AS (SELECT id, count(*) AS n FROM c GROUP BY id)
 SELECT c.id, c.pos AS place, c.field, c.value, coalesce(nullif(c.previous, ''), w.fp) AS previous_value, w.fs AS suggestion, {_SOURCE} AS source, CASE WHEN w.id IS NOT NULL THEN 'suggested' WHEN source = 'confirmed_by_user' THEN 'confirmed' WHEN previous <> '' THEN 'user-edited' ELSE 'original' END AS state FROM c LEFT JOIN w ON c.id = w.id AND c.field = w.field
 UNION ALL SELECT o.id, coalesce(n, 0) + k, field, previous, nullif(previous, ''), proposed, {_SOURCE}, 'suggested' FROM o LEFT JOIN n ON o.id = n.id""")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    each = docs.select("id", F.posexplode(V.components_with_corrections(docs)).alias("place", "c"))
    return each.select("id", (F.col("place") + 1).cast("long").alias("place"), "c.field", "c.value", "c.previous_value", "c.suggestion", "c.source", "c.state")


@query("editable_text", f"""SELECT address_id, concat_ws(', ', CASE WHEN address_id % 2 = 0 THEN 'Jalan Mawar' || CASE WHEN address_id % 3 = 0 THEN ' No. ' || address_id % 90 ELSE '' END WHEN address_id % 3 = 0 THEN 'No. ' || address_id % 90 END,
 CASE WHEN address_id % 4 = 0 THEN 'RT 00' || address_id % 9 END, nullif(trim(KELURAHAN), ''), nullif(trim(KECAMATAN), ''), nullif(trim(KOTA_KABUPATEN), ''), nullif(trim(PROVINSI), ''), nullif(trim(KODEPOS), '')) AS text FROM {_a} a""")
def _(spark, sf_dir):
    k = F.col("address_id")
    values = {"KODEPOS": F.col("KODEPOS"), "KELURAHAN": F.concat(F.lit(" "), "KELURAHAN"), "KECAMATAN": F.col("KECAMATAN"), "KOTA_KABUPATEN": F.col("KOTA_KABUPATEN"), "PROVINSI": F.col("PROVINSI"), "NOMOR": F.when(k % 3 == 0, (k % 90).cast("string")), "JALAN": F.when(k % 2 == 0, "Jalan Mawar "), "RT": F.when(k % 4 == 0, F.concat(F.lit("00"), (k % 9).cast("string")))}
    # A second value of a field is not taken.
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(v, F.lit("")).alias("value")) for f, v in values.items()], F.struct(F.lit("KODEPOS").alias("field"), F.lit("00000").alias("value")))
    return I.spark_table(spark, sf_dir, I.ADDRESSES).select("address_id", V.editable_text(entries).alias("text"))


# --- sealed runs ---------------------------------------------------------------------------------------------------------


@query("sealed_slices", _BOTH + f""", v AS (SELECT *, CASE id % 4 WHEN 0 THEN 'automated' WHEN 1 THEN 'agreed' WHEN 2 THEN 'adjudicated' ELSE '(null)' END AS who FROM b),
 s AS (SELECT 'all' AS slice, 'all' AS name, * FROM v UNION ALL SELECT 'type', type, * FROM v UNION ALL SELECT 'provenance', who, * FROM v),
 c AS (SELECT slice, name, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM s GROUP BY slice, name),
 w AS (SELECT DISTINCT id FROM b WHERE NOT (ing AND inp) AND type NOT IN ('RT', 'RW', 'DETAIL_LOKASI')), x AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'automated' WHEN 1 THEN 'agreed' WHEN 2 THEN 'adjudicated' ELSE '(null)' END AS who, p_partkey NOT IN (SELECT id FROM w) AS same FROM part),
 e AS (SELECT 'all' AS slice, 'all' AS name, count(*) AS examples, count(*) FILTER (same) AS exact FROM x UNION ALL SELECT 'provenance', who, count(*), count(*) FILTER (same) FROM x GROUP BY who UNION ALL SELECT 'type', type, NULL, NULL FROM (VALUES {_TYPES}) t(type)),
 j AS (SELECT e.slice, e.name, examples, exact, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM e LEFT JOIN c ON e.slice = c.slice AND e.name = c.name)
 SELECT slice, name, examples, exact, exact / examples AS exact_rate, {_SCORE} FROM j""")
def _(spark, sf_dir):
    k = F.col("id")
    t = I.spark_table(spark, sf_dir, I.LABELS).withColumn("provenance", F.when(k % 4 == 0, "automated").when(k % 4 == 1, "agreed").when(k % 4 == 2, "adjudicated"))
    return D.slice_metrics(t, "gold", "predicted", "provenance")


_PLACED = "row_number() OVER (ORDER BY p_partkey)"


@query("sealed_items", f"""WITH p AS (SELECT p_partkey AS id, p_name, {_PLACED} AS place FROM part), d AS (SELECT id, place + CASE WHEN id % 40 = 7 THEN 1 ELSE 0 END AS place, CASE WHEN id % 50 = 0 THEN p_name || '!' ELSE p_name END AS n, id % 60 = 1 AS twice, id % 70 = 3 AS gone FROM p)
 SELECT id, 'repeated' AS problem FROM d WHERE twice AND NOT gone UNION ALL SELECT id, 'unlisted' FROM d WHERE gone UNION ALL SELECT id + 10000000, 'missing' FROM d WHERE id % 90 = 5
 UNION ALL SELECT id, 'digest_differs' FROM d WHERE id % 50 = 0 AND NOT twice AND NOT gone UNION ALL SELECT id, 'out_of_order' FROM d WHERE id % 40 = 7 AND NOT twice AND NOT gone""")
def _(spark, sf_dir):
    from tapal.operators.ranking import numbered

    part = numbered(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name"), [F.col("id")], "place")
    digest = lambda c: F.sha2(F.to_json(F.struct("id", c.alias("name"))), 256).alias("sha256")
    k = F.col("id")
    found = part.select("id", "place", digest(F.col("p_name")))
    listed = part.where(k % 70 != 3).select("id", F.when(k % 40 == 7, F.col("place") + 1).otherwise(F.col("place")).alias("place"), digest(F.when(k % 50 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))))
    more = listed.where(k % 60 == 1).unionByName(part.where(k % 90 == 5).select((k + 10000000).alias("id"), "place", digest(F.col("p_name"))))
    return D.item_problems(found, listed.unionByName(more), "id")


@query("sealed_digest", """WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, sha256(cast(o_orderkey AS string) || '|' || o_orderpriority) AS h, count(*) OVER () AS n, 0 AS k FROM orders
 UNION ALL SELECT i // 1000, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 999) // 1000, k + 1 FROM v WHERE n > 1 OR k = 0 GROUP BY i // 1000, k) SELECT h AS sha256 FROM v WHERE n = 1 AND k > 0""")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_orderpriority"), 256).alias("h"))
    return spark.createDataFrame([(D.ordered_digest(orders, [F.col("o_orderkey")], "h"),)], "sha256 string")


@query("confinement", """WITH t AS (SELECT l_suppkey AS base, CASE l_linenumber % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'real_dev' ELSE 'sealed' END AS split FROM lineitem WHERE l_partkey % 23 = 0)
 SELECT a.base, a.split AS one, b.split AS other FROM (SELECT DISTINCT * FROM t) a JOIN (SELECT DISTINCT * FROM t) b ON a.base = b.base AND (a.split, b.split) IN (('train', 'val'), ('real_dev', 'sealed'), ('train', 'sealed'))""")
def _(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey % 23 = 0").select(F.col("l_suppkey").alias("base"), F.when(n == 0, "train").when(n == 1, "val").when(n == 2, "real_dev").otherwise("sealed").alias("split"))
    return D.shared_bases(rows, "base", "split", [("train", "val"), ("real_dev", "sealed"), ("train", "sealed")])


@query("boundary_problems", """WITH t AS (SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE cast(o_orderkey // CASE WHEN o_orderkey % 1000 < 20 THEN 2 ELSE 1 END AS string) END AS base, CASE WHEN o_orderkey % 41 = 0 THEN 'val' WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'real_dev' END AS split FROM orders)
 SELECT base, 'other_split' AS problem FROM t WHERE split IS DISTINCT FROM 'real_dev' UNION ALL SELECT base, 'no_base' FROM t WHERE base IS NULL UNION ALL SELECT base, 'repeated_base' FROM t WHERE base IS NOT NULL GROUP BY base HAVING count(*) > 1 UNION ALL SELECT NULL, 'sealed_path'""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    base = F.when(k % 37 != 0, F.floor(k / F.when(k % 1000 < 20, 2).otherwise(1)).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(base.alias("base"), F.when(k % 41 == 0, "val").when(k % 43 == 0, None).otherwise("real_dev").alias("split"))
    return D.boundary_problems(rows, "data\\Sealed-set.json", "split", "base")


@query("unknown_fields", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'BLOK;KODE_POS' WHEN 1 THEN 'jalan' END AS unknown, CASE WHEN o_orderkey % 5 = 0 THEN 'INVALID_REQUEST' ELSE 'UNKNOWN_FIELD' END AS code, CASE WHEN o_orderkey % 7 = 0 THEN 'The request is not valid.' ELSE 'no such field' END AS message, CASE WHEN o_orderkey % 2 = 0 THEN 'JALAN' END AS field FROM orders""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    maps = F.when(k % 3 == 0, F.create_map(*map(F.lit, ["KODE_POS", "1", "RT", "2", "BLOK", "3"]))).when(k % 3 == 1, F.create_map(*map(F.lit, ["jalan", "1", "JALAN", "2"]))).otherwise(F.create_map(*map(F.lit, ["KODEPOS", "1"])))
    detail = F.struct(F.when(k % 2 == 0, "JALAN").otherwise(" ").alias("field"), F.when(k % 5 == 0, " ").otherwise("UNKNOWN_FIELD").alias("code"), F.when(k % 7 != 0, "no such field").alias("message"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), F.array_join(V.unknown_fields(maps), ";").alias("unknown"), V.safe_detail(detail).alias("d"))
    return rows.select("id", "unknown", "d.code", "d.message", "d.field")
