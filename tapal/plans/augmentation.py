"""Registered queries of examples that are made: the oracle makes the same choices from the same MD5 hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.operators import augmentation as G
from tapal.plans import inputs as I
from tapal.plans.registry import joined, query

_h = I.oracle_table(I.HIERARCHY)
_SEED = 42


def _pick(purpose: str, n: int | str, key: str = "id") -> str:
    return f"(CAST('0x' || substr(md5('{_SEED}|{purpose}|' || {key}), 1, 12) AS BIGINT) % {n})"


def _one(values: list[str], place: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST({place} AS INT) + 1)"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def _misspelled(x: str, purpose: str, key: str = "id") -> str:
    words = f"string_split({x}, ' ')"
    long = f"list_filter(range(1, len({words}) + 1), lambda i: length({words}[i]) >= 5)"
    which = f"list_extract({long}, CAST({_pick(purpose + ' word', 1 << 20, key)} % greatest(len({long}), 1) AS INT) + 1)"
    at = f"CAST({_pick(purpose + ' place', 1 << 20, key)} % greatest(length(w) - 2, 1) + 1 AS INT)"
    new = f"CASE WHEN {_pick(purpose + ' kind', 2, key)} = 0 THEN substr(w, 1, {at}) || substr(w, {at} + 2) ELSE substr(w, 1, {at}) || substr(w, {at} + 2, 1) || substr(w, {at} + 1, 1) || substr(w, {at} + 3) END"
    return f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = {which} THEN {new} ELSE w END), ' ')"


def _words(text: str, field: str) -> str:
    """A list of 'token label' strings."""
    return f"list_transform(list_filter(string_split({text}, ' '), lambda w: w <> ''), lambda w, i: w || ' ' || " + ("'O')" if field == "O" else f"CASE WHEN i = 1 THEN 'B-' ELSE 'I-' END || '{field}')")


def _listed(parts: list[str]) -> str:
    return "flatten([" + ", ".join(parts) + "])"


def _chains(spark, sf_dir: str) -> DataFrame:
    return I.spark_table(spark, sf_dir, I.HIERARCHY)


_COUNT = 3000
_PARTS = {"street": "street", "district": "d", "city": "c", "district~": _misspelled("d", "district"), "city~": _misspelled("c", "city"), "district=": "replace(d, ' ', '')", "city=": "replace(c, ' ', '')", "rt": f"lpad(cast({_pick('rt', 15)} + 1 AS string), 2, '0')", "rw": f"lpad(cast({_pick('rw', 15)} + 1 AS string), 2, '0')", "place": _one(G.PLACES, _pick("place", len(G.PLACES)))}
_RENDERED = "CASE pattern " + " ".join(f"WHEN '{p}' THEN " + _listed([_words(f"'{x}'", "O") if isinstance(x, str) else _words(f"'{x[0]}' || {_PARTS[x[1]]}", x[2]) for x in parts]) for p, (parts, _) in G.PATTERNS.items()) + " END"
_NAMED = "CASE pattern " + " ".join(f"WHEN '{p}' THEN [" + ", ".join(f"'{c}'" for c in ["sparse_address", p, *more]) + "]" for p, (_, more) in G.PATTERNS.items()) + " END"
_TARGETED = f"""WITH h AS {_h}, ch AS (SELECT *, row_number() OVER (ORDER BY village_code) - 1 AS place, count(*) OVER () AS total FROM h),
 i AS (SELECT range AS id FROM range({_COUNT})), t AS (SELECT id, {_one(list(G.PATTERNS), f"(row_number() OVER (ORDER BY {_pick('shuffle', 1 << 40)}, id) - 1) % 8")} AS pattern FROM i),
 b AS (SELECT id, pattern, village_code, {_title('district_name')} AS d, {_title("regexp_replace(city_name, '^(KAB\\.|KABUPATEN|KOTA)\\s+', '')")} AS c, {_one(G.STREETS, _pick('street', len(G.STREETS)))} AS street, {_one(['', 'lower', 'upper'], _pick('case', 3))} AS kase
  FROM t JOIN ch ON ch.place = {_pick('chain', '(SELECT count(*) FROM h)')}),
 r AS (SELECT *, {_RENDERED} AS x, list_sort(list_distinct(list_concat({_NAMED}, CASE WHEN kase <> '' THEN ['case_' || kase] ELSE [] END))) AS names FROM b),
 z AS (SELECT 'TGT-' || lpad(cast(id AS string), 7, '0') AS id, village_code, pattern, names, list_transform(x, lambda y: CASE kase WHEN 'lower' THEN lower(string_split(y, ' ')[1]) WHEN 'upper' THEN upper(string_split(y, ' ')[1]) ELSE string_split(y, ' ')[1] END) AS tokens, list_transform(x, lambda y: string_split(y, ' ')[2]) AS labels FROM r)"""


@query("targeted_examples", _TARGETED + " SELECT id, village_code, pattern, array_to_string(names, ';') AS categories, array_to_string(tokens, ' ') AS tokens, array_to_string(labels, ' ') AS labels FROM z")
def _(spark, sf_dir):
    found = G.targeted(_chains(spark, sf_dir), _COUNT, _SEED)
    return found.select("id", "village_code", "pattern", joined("categories").alias("categories"), F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


_DEFECTS = ", ".join(f"'{d}'" for d in G.SCORED_DEFECTS)


@query("study_tasks", _TARGETED + f""" SELECT id AS task_id, replace(array_to_string(tokens, ' '), ' ,', ',') AS address_text, array_to_string(list_filter(names, lambda y: y IN ({_DEFECTS})), ';') AS expected_defects, CAST(len(list_filter(names, lambda y: y IN ({_DEFECTS}))) AS BIGINT) AS defect_count,
 array_to_string(list_transform(list_filter(range(1, len(labels) + 1), lambda j: labels[j] LIKE '%-KECAMATAN'), lambda j: tokens[j]), ' ') AS district FROM z""")
def _(spark, sf_dir):
    tasks = G.study_tasks(G.targeted(_chains(spark, sf_dir), _COUNT, _SEED))
    return tasks.select("task_id", "address_text", joined("expected_defects").alias("expected_defects"), "defect_count", F.col("components")["KECAMATAN"].alias("district"))


#: One address for each customer; some have no RT and RW, no landmark or no detail.
_BASES = f"""SELECT c_custkey AS base_id, village_code, village_name, district_name, city_name, province_name, postal_code, 'Mawar ' || cast(c_custkey % 7 AS string) AS street, cast(c_custkey % 200 + 1 AS string) AS number,
 CASE WHEN c_custkey % 3 > 0 THEN lpad(cast(c_custkey % 15 + 1 AS string), 2, '0') END AS rt, CASE WHEN c_custkey % 3 > 0 THEN lpad(cast(c_custkey % 9 + 1 AS string), 2, '0') END AS rw, CASE WHEN c_custkey % 4 = 0 THEN 'dekat Masjid An-Nur' END AS place, CASE WHEN c_custkey % 5 = 0 THEN 'Blok C' || cast(c_custkey % 12 AS string) END AS detail FROM ({I.HIERARCHY}) h"""
_k = lambda purpose, n: _pick(purpose, n, "k")
_SLOTS = {
    "JALAN": _words("CASE WHEN short THEN 'Jln. ' ELSE 'Jalan ' END || street", "JALAN"), "NOMOR": _words("'No. ' || number", "NOMOR"), "RT_RW": "CASE WHEN rt IS NULL THEN [] ELSE list_concat(" + _words("'RT ' || rt", "RT") + ", " + _words("'RW ' || rw", "RW") + ") END",
    "LANDMARK": "CASE WHEN place IS NULL THEN [] ELSE " + _words("place", "DETAIL_LOKASI") + " END", "DETAIL": "CASE WHEN detail IS NULL THEN [] ELSE " + _words("detail", "DETAIL_LOKASI") + " END", "KELURAHAN": _words("CASE WHEN short THEN 'Kel. ' ELSE 'Kelurahan ' END || CASE WHEN wrong THEN " + _misspelled("v", "village", "k") + " ELSE v END", "KELURAHAN"),
    "KECAMATAN": _words(f"CASE WHEN short THEN 'Kec. ' ELSE 'Kecamatan ' END || {_title('district_name')}", "KECAMATAN"), "KOTA": _words(f"CASE WHEN city_name LIKE 'KOTA %' THEN 'Kota ' ELSE 'Kabupaten ' END || {_title("regexp_replace(city_name, '^(KABUPATEN|KOTA) ', '')")}", "KOTA_KABUPATEN"),
    "PROVINSI": f"CASE WHEN p THEN {_words(_title('province_name'), 'PROVINSI')} ELSE [] END", "KODEPOS": f"CASE WHEN z THEN {_words('postal_code', 'KODEPOS')} ELSE [] END",
}
_COMMA = lambda s: f"CASE WHEN {_pick('comma', 2, f"k || '|{s}'")} = 0 THEN [', O'] ELSE [] END"
_VARIED = f"""WITH b AS (SELECT *, cast(base_id AS string) || '-' || variant AS k FROM {I.oracle_table(_BASES)} x, (SELECT unnest([1, 2]) AS variant)),
 f AS (SELECT *, {_k('short', 100)} < 40 AS short, {_k('typo', 100)} < 15 AS wrong, {_k('order', 8)} AS o, {_one(['upper', 'lower', 'title', ''], _k('case', 4))} AS kase, {_k('province', 100)} < 50 AS p, {_k('postal', 100)} < 60 AS z, {_k('junk', 100)} < 15 AS junk, {_k('note', 100)} < 10 AS note, {_title('village_name')} AS v FROM b),
 x AS (SELECT *, list_concat(CASE WHEN junk THEN ['Kirim O', 'ke: O'] ELSE [] END, CASE o {" ".join(f"WHEN {i} THEN " + _listed([_listed([_COMMA(s), _SLOTS[s]]) if s in G.COMMA_SLOTS else _SLOTS[s] for s in order]) for i, order in enumerate(G.ORDERS))} END, CASE WHEN note THEN ['hubungi O', 'dulu O', 'sebelum O', 'sampai O'] ELSE [] END) AS x FROM f)
 SELECT base_id, CAST(variant AS INT) AS variant, village_code, CAST(o AS INT) AS order_number, array_to_string(list_transform(x, lambda y: CASE kase WHEN 'upper' THEN upper(string_split(y, ' ')[1]) WHEN 'lower' THEN lower(string_split(y, ' ')[1]) WHEN 'title' THEN upper(y[1:1]) || lower(string_split(y, ' ')[1][2:]) ELSE string_split(y, ' ')[1] END), ' ') AS tokens, array_to_string(list_transform(x, lambda y: string_split(y, ' ')[2]), ' ') AS labels,
 array_to_string(list_sort(list_filter([CASE WHEN short THEN 'abbreviation' END, CASE WHEN wrong THEN 'typo' END, CASE WHEN junk THEN 'prefix_junk' END, CASE WHEN note THEN 'instruksi' END, CASE WHEN NOT p THEN 'missing_provinsi' END, CASE WHEN NOT z THEN 'missing_kodepos' END, CASE WHEN rt IS NULL THEN 'missing_rt_rw' END, CASE WHEN list_contains(x, ', O') THEN 'separator' END, CASE WHEN kase <> '' THEN 'case_' || kase END], lambda y: y IS NOT NULL)), ';') AS categories FROM x"""


@query("varied_addresses", _VARIED)
def _(spark, sf_dir):
    found = G.varied(I.dealt(I.spark_table(spark, sf_dir, _BASES), sf_dir, "customer", "base_id"), 2, _SEED)
    return found.select("base_id", "variant", "village_code", "order_number", F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"), joined("categories").alias("categories"))


_b = lambda purpose, n: _pick(purpose, n, "base_id")
_NAMES = "CASE " + _b("landmark kind", len(G.LANDMARKS)) + " " + " ".join(f"WHEN {i} THEN '{word} ' || {_one(each, _b('landmark name', len(each)))}" if word else f"WHEN {i} THEN {_one(each, _b('landmark name', len(each)))}" for i, (word, each) in enumerate(G.LANDMARKS)) + " END"
_FILLED = _one(G.DETAILS, _b("detail", len(G.DETAILS)))
for _name, _value in (("name", _one(G.ESTATES, _b("detail name", len(G.ESTATES)))), ("letter", _one(list("ABCDEFGH"), _b("detail letter", 8))), ("floor", f"cast({_b('detail floor', 20)} + 1 AS string)"), ("unit", f"lpad(cast({_b('detail unit', 20)} + 1 AS string), 2, '0')")):
    _FILLED = f"replace({_FILLED}, '{{{_name}}}', {_value})"
_two = lambda purpose: f"CASE WHEN {_b('no rt', 100)} >= 30 THEN lpad(cast({_b(purpose, 15)} + 1 AS string), 2, '0') END"
_wrong = lambda at, purpose: f"cast((cast(substr(postal_code, {at}, 1) AS INT) + {_b(purpose, 8)} + 1) % 10 AS string)"


@query("synthetic_bases", f"""WITH h AS {_h}, ch AS (SELECT *, row_number() OVER (ORDER BY village_code) - 1 AS nth FROM h), i AS (SELECT range AS base_id FROM range({_COUNT})), x AS (SELECT * FROM i JOIN ch ON ch.nth = {_b('chain', '(SELECT count(*) FROM h)')})
 SELECT base_id, village_code, {_one(G.STREETS, _b('street', len(G.STREETS)))} AS street, cast({_b('number', 250)} + 1 AS string) || CASE WHEN {_b('letter', 100)} < 20 THEN {_one(['A', 'B', 'C'], _b('letter of number', 3))} ELSE '' END AS number, {_two('rt')} AS rt, {_two('rw')} AS rw,
 CASE WHEN {_b('has landmark', 100)} < 25 THEN {_one(G.DIRECTIONS, _b('landmark direction', len(G.DIRECTIONS)))} || ' ' || {_NAMES} END AS place, CASE WHEN {_b('has detail', 100)} < 20 THEN {_FILLED} END AS detail, {_b('conflict', 100)} < 8 AS admin_conflict,
 CASE WHEN {_b('conflict', 100)} < 8 THEN substr(postal_code, 1, 3) || {_wrong(4, 'fourth digit')} || {_wrong(5, 'fifth digit')} ELSE postal_code END AS postal_code FROM x""")
def _(spark, sf_dir):
    return G.bases(_chains(spark, sf_dir), _COUNT, _SEED).select("base_id", "village_code", "street", "number", "rt", "rw", "place", "detail", "admin_conflict", "postal_code")
