"""The online layer over a DataFrame of addresses: PII, tagging, normalization, validation, quality gate, document."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.functions.text_udfs import compose_fields, tag_fields, tag_tokens
from tapal.operators import pii as P
from tapal.operators.pii import redact  # noqa: F401

# --- tagging -------------------------------------------------------------------------------------------------------


def tag(df: DataFrame, column: str = "address_text") -> DataFrame:
    """df with tokens and their BIO labels."""
    # Called nondeterministic it is a step of its own, which the optimizer does not copy to where its result is used.
    return df.withColumn("tokens", S.tokens(column)).withColumn("labels", tag_tokens.asNondeterministic()("tokens"))


def decode(df: DataFrame) -> DataFrame:
    """df with a column for each field: the first span of its type, null if there is none; stray I- labels are dropped."""
    after = F.filter(F.transform("labels", lambda l, i: F.when(l.startswith("B-"), F.struct(F.substring(l, 3, 99).alias("type"), i.alias("at")))), lambda x: x.isNotNull())
    # A span goes on over the I- labels of its type: up to the first label behind it that is none.
    end = F.expr("transform(_starts, s -> named_struct('type', s.type, 'at', s.at, 'n', coalesce(nullif(array_position(transform(slice(labels, s.at + 2, size(labels)), x -> x <> concat('I-', s.type)), true), 0), size(labels) - s.at)))")
    out = df.withColumn("_starts", after).withColumn("_spans", end)
    first = lambda f: F.get(F.filter("_spans", lambda s: s["type"] == f), F.lit(0))
    out = out.withColumns({f: F.when(first(f).isNotNull(), F.array_join(F.slice("tokens", (first(f)["at"] + 1).cast("int"), first(f)["n"].cast("int")), " ")) for f in S.FIELDS})
    return out.drop("_starts", "_spans")


def extract(df: DataFrame, column: str = "address_text") -> DataFrame:
    """df with the fields of decode(tag(df)) as x_<field>, and _json: their compatibility forms where they go beyond ASCII.

    One call to Python for a text takes the place of arrays of tokens and labels, and of the loops over them.
    """
    out = df.withColumn("_fields", tag_fields.asNondeterministic()(F.make_valid_utf8(F.col(column))))
    return out.select(*df.columns, *[F.col(f"_fields.{f}").alias(f"x_{f}") for f in S.FIELDS], F.col("_fields.composed").alias("_json"))


# --- normalization -------------------------------------------------------------------------------------------------

RULES = [
    ("unicode_whitespace_v1", "rule_extracted"),
    ("designator_dictionary_v1", "normalized_by_dictionary"),
    ("rt_rw_three_digit_v1", "rule_extracted"),
    ("postcode_spacing_v1", "rule_extracted"),
    ("component_capitalization_v1", "normalized_by_dictionary"),
]


def normalize(df: DataFrame, fields: list[str] | None = None, source: str = "rule_extracted", own: str = "{}", composed: str | None = None) -> DataFrame:
    """df with its fields normalized, <field>_source, and changes: one entry for each rule that changed a value.

    An entry's before has the provenance that the value had, its after that of the rule. Null fields stay null. own is the
    form of the columns that have the fields; composed one that has the compatibility forms of all fields in JSON, null
    where they need none.
    """
    names, every = fields or S.FIELDS, []
    out, given = df, {f: own.format(f) for f in names}
    if composed is None:
        # Only rows with characters beyond ASCII need the compatibility form, which no built-in function has; see tag().
        beyond = ~S.is_ascii(F.concat_ws("", *given.values()))
        # The values go to Python as one text: an array takes Arrow much longer, also where a row has none.
        out = out.withColumn("_composed", compose_fields.asNondeterministic()(F.when(beyond, F.to_json(F.array(*given.values())))))
    out = out.withColumn("_nfkc", F.from_json(composed or "_composed", "array<string>"))
    order = S.FIELDS if composed else names
    composed_ = {f: F.when(F.col(x).isNull(), None).when(F.col("_nfkc").isNull(), S.collapse(x)).otherwise(F.get("_nfkc", F.lit(order.index(f)))) for f, x in given.items()}
    # A rule has the fields that it can change, and what it makes of a column of theirs.
    steps = [
        (names, lambda f, x: composed_[f]),
        ([f for f, _, _ in S.DESIGNATORS], lambda f, x: S.designator(f, F.col(x))),
        (["RT", "RW"], lambda f, x: S.rt_rw(f, F.col(x))),
        (["KODEPOS"], lambda f, x: S.postcode(F.col(x))),
        (S.TITLE_FIELDS, lambda f, x: S.smart_title(x)),
    ]
    taken: dict[str, list[tuple[str, str, str, str]]] = {f: [] for f in names}
    levels: list[dict[str, Column]] = []
    for f in names:
        last = given[f]
        for (some, step), (rule, kind) in zip(steps, RULES):
            if f in some:
                level, made = len(taken[f]), f"_{f}{len(taken[f]) + 1}"
                levels += [{}] if level == len(levels) else []
                levels[level][made] = step(f, last)
                taken[f].append((last, made, rule, kind))
                last = made
    # All fields take their first rule at once, then their second, and so on: each step of the plan copies all columns.
    for level in levels:
        out = out.withColumns(level)
    sources = {}
    for f in names:
        held: Column = F.lit(source)
        for x, y, rule, kind in taken[f]:
            before, after = F.col(x), F.col(y)
            entry = F.struct(F.lit(f).alias("field"), before.alias("before"), held.alias("before_source"), after.alias("after"), F.lit(kind).alias("after_source"), F.lit(rule).alias("rule_id"), F.lit("deterministic").alias("decision"), F.lit(True).alias("applied"))
            every.append((before != after, entry))
            held = F.when(before != after, F.lit(kind)).otherwise(held)
        sources[f"{f}_source"] = F.when(F.col(given[f]).isNotNull(), held)
    out = out.withColumns({**sources, "changes": S.chosen(every)})
    return out.withColumns({f: F.col(taken[f][-1][1]) for f in names}).drop("_composed", "_nfkc", *[y for f in names for _, y, _, _ in taken[f]])


def composed() -> Column:
    """The display line: fields that are not blank in canonical order."""
    return F.concat_ws(", ", *[F.nullif(F.trim(F.col(f)), F.lit("")) for f in S.FIELDS])


# --- validation ----------------------------------------------------------------------------------------------------

_LEVEL = {"KELURAHAN": "village", "KECAMATAN": "district", "KOTA_KABUPATEN": "city", "PROVINSI": "province"}


def parts(x: Column | str) -> Column:
    return S.name_parts(x)


def _same_name(field: str):
    own = F.col(f"p_{field}")
    return lambda x: (x["base"] != "") & (x["base"] == own["base"]) & F.coalesce(x["kind"] == own["kind"], F.lit(True))


_CANDIDATE = ["village_code", "village_name", "district_name", "city_name", "province_name"]


class Lookup(NamedTuple):
    """The hierarchy prepared once for validation.

    postals has (v_base, v_postal, villages): the villages with a name of that base form and that postal code. names has
    (n_base, chains, members): chains are the distinct upper levels of all villages with the name, each with its number of
    villages, and members the villages themselves. A list of chains stops growing where the upper levels do.
    """

    names: DataFrame
    postals: DataFrame


def lookup(hierarchy: DataFrame) -> Lookup:
    """hierarchy has, for each level, <level>_code, <level>_name and <level>_aliases, and postal_codes."""
    names = lambda level: F.array_distinct(F.transform(F.concat(F.array(f"{level}_name"), F.coalesce(f"{level}_aliases", F.array().cast("array<string>"))), parts))
    out = hierarchy.select(F.struct(*_CANDIDATE).alias("row"), "postal_codes", *[names(x).alias(f"n_{f}") for f, x in _LEVEL.items() if f != "KELURAHAN"], F.explode(names("village")).alias("_v")).where("_v.base <> ''")
    levels = [F.col("_v.kind").alias("v_kind"), *[f"n_{f}" for f in _LEVEL if f != "KELURAHAN"]]
    # Where postal codes are missing, none can be told to be wrong.
    open_ = F.coalesce(F.exists("postal_codes", lambda x: x.isNull()), F.lit(True)).alias("open")
    each = out.groupBy(F.col("_v.base").alias("n_base"), "row").agg(F.sort_array(F.collect_set(F.struct(*levels, open_))).alias("profile"))
    chains = each.groupBy("n_base", "profile").agg(F.count(F.lit(1)).alias("n"), F.collect_list("row").alias("rows"))
    by_name = chains.groupBy("n_base").agg(F.collect_list(F.struct("profile", "n")).alias("chains"), F.collect_list(F.struct("profile", "rows")).alias("members"))
    coded = out.select("row", *levels, F.col("_v.base").alias("v_base"), F.explode(F.array_distinct("postal_codes")).alias("v_postal")).where("v_postal <> ''")
    return Lookup(by_name, coded.groupBy("v_base", "v_postal").agg(F.collect_list(F.struct("row", "v_kind", *levels[1:])).alias("villages")))


def validate(addresses: DataFrame, prepared: Lookup, key: str = "address_id") -> DataFrame:
    """addresses with status, reason_code, affected_fields, missing_fields, candidates and their number n_candidates.

    Two left joins with the prepared hierarchy, and everything else within the row, so that addresses are neither grouped
    nor read twice: villages of the name and the postal code tell a match; only where they tell none, or no code is given,
    the chains of the name are asked what is at fault. Kinds must not contradict.
    """
    others = S.ADMIN_FIELDS[1:]
    levels = others[:-1]
    # Names are normalized in a step of their own, not in a lambda, which is not compiled.
    own = addresses.withColumns({f"p_{f}": S.surface(f) for f in ("KELURAHAN", *levels)})
    own = own.withColumns({f"p_{f}": F.when(F.col(f"p_{f}") != "", S.normalize_hierarchy(f"p_{f}")) for f in ("KELURAHAN", *levels)})
    own = own.withColumns({f"p_{f}": F.when(F.col(f"p_{f}").isNotNull(), S.parts_of(F.col(f"p_{f}"))) for f in levels})
    name = S.parts_of(F.coalesce("p_KELURAHAN", F.lit("")))
    own = own.withColumns({"_base": name["base"], "_kind": name["kind"], "_postal": S.surface("KODEPOS")}).drop("p_KELURAHAN")
    out = own.join(prepared.postals, (F.col("_base") == F.col("v_base")) & (F.col("_postal") == F.col("v_postal")), "left")
    none = F.array().cast("array<string>")
    rows = F.array().cast("array<struct<village_code:string,village_name:string,district_name:string,city_name:string,province_name:string>>")
    near = lambda v: F.coalesce(F.col("_kind") == v["v_kind"], F.lit(True))
    level = lambda v, f: F.col(f"p_{f}").isNull() | F.exists(v[f"n_{f}"], _same_name(f))
    meets = lambda v: near(v) & level(v, levels[0]) & level(v, levels[1]) & level(v, levels[2])
    out = out.withColumn("_coded", F.coalesce(F.array_distinct(F.transform(F.filter("villages", meets), lambda v: v["row"])), rows)).withColumn("_n_coded", F.size("_coded").cast("long"))
    # Other rows get keys of their own that no name has, so that they do not meet in one task; they need no villages more.
    asked = (F.col("_base") != "") & (F.col("_n_coded") == 0)
    out = out.withColumn("_asked", F.when(asked, F.col("_base")).otherwise(F.concat(F.lit("-"), F.xxhash64(key).cast("string")))).withColumn("villages", F.when(asked, F.col("villages")))
    out = out.join(prepared.names, F.col("_asked") == F.col("n_base"), "left")

    counted = lambda which: F.coalesce(F.aggregate(F.filter("chains", lambda x: F.exists(x["profile"], which)), F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long"))
    listed = lambda which: F.coalesce(F.array_sort(F.flatten(F.transform(F.filter("members", lambda x: F.exists(x["profile"], which)), lambda x: x["rows"]))), rows)
    out = out.withColumn("_b", counted(near)).withColumn("_c", F.when(F.col("_postal") != "", F.col("_n_coded")).otherwise(counted(meets)))
    blank = {f: S.surface(f) == "" for f in S.ADMIN_FIELDS}
    missing = S.chosen([(blank[f], F.lit(f)) for f in S.ADMIN_FIELDS])
    out = out.withColumn("missing_fields", missing)
    case = F.when(blank["KELURAHAN"], "village").when((F.col("_b") == 0) & (F.col("_c") == 0), "gap").when(F.col("_c") == 0, "conflict").when(F.col("_c") > 1, "ambiguous").when(F.size("missing_fields") > 0, "missing").otherwise("valid")
    out = out.withColumn("_case", case)

    flags = lambda postal: lambda v: F.struct(*[level(v, f).alias(f) for f in levels], postal(v).alias("KODEPOS"))
    by_chain = F.transform(F.filter(F.flatten(F.transform("chains", lambda x: x["profile"])), near), flags(lambda v: (F.col("_postal") == "") | F.when(v["open"], F.lit(None).cast("boolean")).otherwise(False)))
    by_code = F.transform(F.filter("villages", near), flags(lambda v: F.lit(True)))
    empty = F.array().cast("array<struct<KECAMATAN:boolean,KOTA_KABUPATEN:boolean,PROVINSI:boolean,KODEPOS:boolean>>")
    # A village with the given code is in both lists; what it meets is told by the second.
    out = out.withColumn("_m", F.when(F.col("_case") == "conflict", F.array_distinct(F.concat(F.coalesce(by_chain, empty), F.coalesce(by_code, empty)))))
    every = lambda fields: lambda m: F.forall(F.array(*[m[f] for f in fields]), lambda x: x)
    at_fault = lambda f: ~F.exists("_m", lambda m: m[f]) | F.exists("_m", every([g for g in others if g != f]))
    hit = F.array_compact(F.array(*[F.when(~blank[f] & at_fault(f), F.lit(f)) for f in others]))
    given = F.array_compact(F.array(*[F.when(~blank[f], F.lit(f)) for f in others]))
    out = out.withColumn("_hit", F.when(F.col("_case") == "conflict", hit).otherwise(none))
    pick = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("_case")]
    status = {"village": "incomplete", "gap": "not_found", "conflict": "invalid", "ambiguous": "ambiguous", "missing": "incomplete", "valid": "valid"}
    reason = {"village": "MISSING_ADMINISTRATIVE_FIELDS", "gap": "REFERENCE_COVERAGE_GAP", "conflict": "ADMINISTRATIVE_CONFLICT", "ambiguous": "AMBIGUOUS_ADMINISTRATIVE_CANDIDATES", "missing": "MISSING_ADMINISTRATIVE_FIELDS", "valid": "VALID_ADMINISTRATIVE_CHAIN"}
    out = out.withColumn("status", pick(status)).withColumn("reason_code", pick(reason))
    out = out.withColumn("affected_fields", F.when(F.col("_case") == "conflict", F.when(F.size("_hit") > 0, F.col("_hit")).otherwise(given)).otherwise(none))
    found = F.col("_case").isin("ambiguous", "missing", "valid")
    out = out.withColumn("n_candidates", F.when(F.col("_case") == "conflict", F.col("_b")).when(found, F.col("_c")).otherwise(0))
    out = out.withColumn("candidates", F.when(F.col("_case") == "conflict", listed(near)).when(found & (F.col("_postal") != ""), F.array_sort("_coded")).when(found, listed(meets)).otherwise(rows))
    return out.drop("_base", "_kind", "_postal", "v_base", "v_postal", "villages", "_coded", "_n_coded", "_asked", "n_base", "chains", "members", "_m", "_b", "_c", "_case", "_hit", *[f"p_{f}" for f in levels])


def exact_lookup(wanted: DataFrame, hierarchy: DataFrame, key: str = "address_id") -> DataFrame:
    """(key, lookup_status, n_rows): exact, ambiguous or not_found by whole normalized names; blank conjuncts are ignored.

    Villages are counted once for each name with its upper levels, given or left out, so that an address meets one row
    however many villages have its name. Only rows that share a key and ask for different names meet the villages.
    """
    upper = ["district", "city", "province"]
    names = F.concat(F.array("village_name"), F.coalesce("village_aliases", F.array().cast("array<string>")))
    index = hierarchy.select("village_code", F.explode(F.array_distinct(F.transform(names, S.normalize_hierarchy))).alias("_n"), *[S.normalize_hierarchy(f"{x}_name").alias(f"_{x}") for x in upper]).where("_n is not null")
    counts = index
    for x in upper:
        counts = counts.withColumn(f"_{x}", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(f"_{x}", F.lit(""))))))
    counts = counts.groupBy("_n", *[f"_{x}" for x in upper]).agg(F.countDistinct("village_code").alias("_rows"))
    own = wanted.select(key, F.struct(*[S.normalize_hierarchy(S.surface(f)).alias(x) for f, x in _LEVEL.items()]).alias("_w")).groupBy(key).agg(F.collect_set("_w").alias("_all"))
    one = own.where(F.size("_all") == 1).select(key, F.col("_all")[0].alias("_w"))
    met = F.col("_w.village") == F.col("_n")
    single, several = met, met
    for x in upper:
        single = single & (F.col(f"_w.{x}") == F.col(f"_{x}"))
        several = several & ((F.col(f"_w.{x}") == "") | (F.col(f"_w.{x}") == F.col(f"_{x}")))
    found = one.join(counts, single, "left").select(key, F.coalesce("_rows", F.lit(0).cast("long")).alias("n_rows"))
    rest = own.where(F.size("_all") > 1).select(key, F.explode("_all").alias("_w")).join(index, several, "left").groupBy(key).agg(F.countDistinct("village_code").alias("n_rows"))
    return found.unionByName(rest).select(key, F.when(F.col("n_rows") == 0, "not_found").when(F.col("n_rows") == 1, "exact").otherwise("ambiguous").alias("lookup_status"), "n_rows")


# --- quality gate --------------------------------------------------------------------------------------------------


def gate(df: DataFrame) -> DataFrame:
    """df with issues and gate_status, from validation and from the changes (if there are any) not yet applied."""
    fields = lambda x: F.array_join(x, ", ")
    conflict = F.col("status") == "invalid"
    other = F.filter("affected_fields", lambda x: x != "KODEPOS")

    def issue(when: Column, code: str, severity: str, message: Column | str, affected: Column, question: Column | str, origin: str) -> tuple[Column, Column]:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return when, F.struct(F.lit(code).alias("reason_code"), F.lit(severity).alias("severity"), text(message).alias("message"), affected.alias("affected_fields"), text(question).alias("clarification_question"), F.lit(origin).alias("source_reason_code"))

    names = lambda *x: F.array(*map(F.lit, x))
    found = [
        issue(conflict & F.array_contains("affected_fields", "KODEPOS"), "KODEPOS_TIDAK_COCOK", "high", "Kode pos bertentangan dengan rantai wilayah pada referensi administratif yang digunakan.", names("KODEPOS"), "Kode pos mana yang benar untuk kelurahan dan kecamatan tujuan?", "ADMINISTRATIVE_CONFLICT"),
        issue(conflict & (F.size(other) > 0), "ADMINISTRATIVE_CONFLICT", "high", F.concat(F.lit("Komponen administratif berikut saling bertentangan: "), fields(other), F.lit(".")), other, F.concat(F.lit("Mohon periksa "), fields(other), F.lit("; nilai mana yang sesuai dengan alamat tujuan?")), "ADMINISTRATIVE_CONFLICT"),
        issue(F.col("status") == "incomplete", "MISSING_ADMINISTRATIVE_FIELDS", "medium", F.concat(F.lit("Komponen administratif wajib belum lengkap: "), fields("missing_fields"), F.lit(".")), F.col("missing_fields"), F.concat(F.lit("Mohon lengkapi "), fields("missing_fields"), F.lit(" agar rantai wilayah dapat diperiksa?")), "MISSING_ADMINISTRATIVE_FIELDS"),
        issue(F.col("status") == "ambiguous", "AMBIGUOUS_ADMINISTRATIVE_CANDIDATES", "medium", "Nama kelurahan cocok dengan lebih dari satu rantai wilayah pada referensi.", names("KELURAHAN", "KECAMATAN", "KOTA_KABUPATEN"), "Kecamatan dan kota/kabupaten mana yang benar untuk kelurahan tujuan?", "AMBIGUOUS_ADMINISTRATIVE_CANDIDATES"),
        issue(F.col("status") == "not_found", "KELURAHAN_TIDAK_DITEMUKAN", "medium", "Kelurahan belum ditemukan pada versi referensi saat ini; hasil ini tidak membuktikan alamat salah.", names("KELURAHAN"), "Apakah ejaan kelurahan serta kecamatan dan kota/kabupatennya sudah benar?", "REFERENCE_COVERAGE_GAP"),
    ]
    if "changes" in df.columns:
        open_ = F.array_distinct(F.transform(F.filter("changes", lambda c: (c["decision"] == "requires_confirmation") & ~c["applied"]), lambda c: c["field"]))
        ordered = F.filter(names(*S.FIELDS), lambda f: F.array_contains(open_, f))
        found.append(issue(F.size(ordered) > 0, "CORRECTION_REQUIRES_CONFIRMATION", "medium", F.concat(F.lit("Koreksi semantik belum diterapkan untuk: "), fields(ordered), F.lit(".")), ordered, F.concat(F.lit("Apakah koreksi yang disarankan untuk "), fields(ordered), F.lit(" boleh diterapkan?")), "CORRECTION_REQUIRES_CONFIRMATION"))
    out = df.withColumn("issues", S.chosen(found))
    high = F.exists("issues", lambda x: x["severity"] == "high")
    return out.withColumn("gate_status", F.when(high, "TIDAK_VALID").when(F.size("issues") > 0, "PERLU_KONFIRMASI").otherwise("SIAP_DIPROSES"))


# --- corrections, geocoding, document ------------------------------------------------------------------------------


def propose(df: DataFrame, field: str, value: Column, rule_id: str, source: str = "inferred_from_hierarchy") -> DataFrame:
    """df with an unapplied correction of a field added to changes where the value is given and differs."""
    entry = F.struct(F.lit(field).alias("field"), F.col(field).alias("before"), F.col(f"{field}_source").alias("before_source"), value.alias("after"), F.lit(source).alias("after_source"), F.lit(rule_id).alias("rule_id"), F.lit("requires_confirmation").alias("decision"), F.lit(False).alias("applied"))
    return df.withColumn("changes", F.concat("changes", F.filter(F.array(F.when(value != F.col(field), entry)), lambda x: x.isNotNull())))


def confirm(df: DataFrame, field: str, accepted: Column) -> DataFrame:
    """df with the open correction of a field applied where accepted; its value is then confirmed by the user."""
    open_ = F.filter("changes", lambda c: (c["field"] == field) & ~c["applied"])
    take = accepted & (F.size(open_) > 0)
    done = F.transform("changes", lambda c: F.when(take & (c["field"] == field), c.withField("applied", F.lit(True)).withField("after_source", F.when(c["applied"], c["after_source"]).otherwise("confirmed_by_user"))).otherwise(c))
    return df.withColumn(f"{field}_source", F.when(take, "confirmed_by_user").otherwise(F.col(f"{field}_source"))).withColumn(field, F.when(take, F.get(open_, F.lit(0))["after"]).otherwise(F.col(field))).withColumn("changes", done)


def geocode(df: DataFrame, results: DataFrame, key: str = "address_id", consent: str = "consent") -> DataFrame:
    """df with geocode_status and geocode_reasons, from a table of one provider result for each key.

    results has key, failure (null, not_found, timeout, rate_limited or unavailable), provider, precision, lat, lon and
    the provider's fields as geo_<field>. Without consent nothing is looked at; a key without a row is not found.
    """
    out = df.join(results, key, "left")
    failed = F.when(F.col("precision").isNull() & F.col("failure").isNull(), "not_found").otherwise(F.col("failure"))
    off = F.array_compact(F.array(*[F.when((S.surface(f) != "") & (S.surface(f"geo_{f}") != "") & (S.normalize_hierarchy(f) != S.normalize_hierarchy(f"geo_{f}")), F.lit(f)) for f in ("KOTA_KABUPATEN", "PROVINSI", "KODEPOS")]))
    findings = F.array_compact(F.array(F.when(F.col("precision") != "rooftop", F.lit("LOW_PRECISION")), F.when(F.size(off) > 0, F.lit("ADMIN_MISMATCH"))))
    code = F.create_map(*[F.lit(x) for p in (("not_found", "GEOCODE_NOT_FOUND"), ("timeout", "GEOCODE_TIMEOUT"), ("rate_limited", "GEOCODE_RATE_LIMITED"), ("unavailable", "GEOCODE_UNAVAILABLE")) for x in p])[failed]
    asked = F.coalesce(F.col(consent), F.lit(False))
    none = F.array().cast("array<string>")
    out = out.withColumn("geocode_reasons", F.when(~asked, none).when(failed.isNotNull(), F.array(F.coalesce(code, F.lit("GEOCODE_UNAVAILABLE")))).otherwise(findings))
    out = out.withColumn("geocode_status", F.when(~asked, "NOT_REQUESTED").when(failed.isNotNull(), "EXTERNAL_FAILURE").when(F.size("geocode_reasons") > 0, "AMBIGUOUS").otherwise("SUCCESS"))
    return out.drop("failure")


#: Versions, and the gate's statuses in order of precedence.
VERSIONS = {"contract": "1.0.0", "model": "regex-baseline-v1", "normalizer": "normalizer-v1", "validator": "jabar-reference-v1", "reference_data": "jabar-reference-v1", "quality_gate": "quality-gate-v1"}
PRECEDENCE = [("TIDAK_VALID", "at least one high-severity issue exists"), ("PERLU_KONFIRMASI", "at least one medium-severity issue exists"), ("SIAP_DIPROSES", "no quality issue exists")]

_AUDIT_VALUE = "struct<field:string,value:string,source:string,confirmed:boolean>"
_BASIC = "struct<value:string,source:string,confirmed:boolean>"
_CORRECTIONS = f"array<struct<correction_id:string,field:string,previous_value:{_BASIC},proposed_value:{_BASIC},rule_id:string,decision:string,applied:boolean,user_confirmation:string>>"


def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


def basic(value: Column, source: Column | str) -> Column:
    """A contract value; it is confirmed exactly if the user is its source."""
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(value.alias("value"), source.alias("source"), (source == "confirmed_by_user").alias("confirmed"))


def result_value(value: Column, source: Column) -> Column:
    return F.struct(value.alias("value"), source.alias("source"), (source == "confirmed_by_user").alias("confirmed"), null_of("double").alias("model_score"), null_of("string").alias("previous_value"))


def components(value: str = "{}", source: str | Column = "{}_source") -> Column:
    """The contract's components: fields that are not blank, in canonical order, from the columns that the forms name."""
    given = lambda f: F.col(value.format(f))
    origin = lambda f: source if isinstance(source, Column) else F.col(source.format(f))
    return S.chosen([(F.trim(given(f)) != "", F.struct(F.lit(f).alias("field"), result_value(given(f), origin(f)).alias("result"))) for f in S.FIELDS])


def geocoding_block() -> Column:
    """The contract's geocoding: what geocode() found, or an empty block where nothing was asked for or geocode() was not called."""
    coordinate = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("value"), F.lit("returned_by_geocoder").alias("source")))
    asked = F.col("geocode_status") != "NOT_REQUESTED"
    good = F.col("geocode_status").isin("SUCCESS", "AMBIGUOUS")
    return F.struct(
        F.col("geocode_status").alias("status"), asked.alias("consent"), F.when(asked, F.col("provider")).alias("provider"), F.when(good, F.col("precision")).alias("precision"),
        F.when(good, coordinate("lat")).alias("latitude"), F.when(good, coordinate("lon")).alias("longitude"),
        F.when(good, components("geo_{}", F.lit("returned_by_geocoder"))).otherwise(F.slice(components("geo_{}", F.lit("returned_by_geocoder")), 1, 0)).alias("components"),
        F.when(F.col("geocode_status") == "EXTERNAL_FAILURE", F.get("geocode_reasons", F.lit(0))).alias("error_code"),
    )


def audit_trail() -> Column:
    """Numbered events: pii, model, one for each change, validator, gate. The personal-data event carries no values."""
    none = F.array().cast(f"array<{_AUDIT_VALUE}>")

    def event(at: Column, stage: str, action: Column, rule: Column, before: Column = none, after: Column = none) -> Column:
        return F.struct(at.alias("sequence"), F.lit(stage).alias("stage"), action.alias("action"), F.lit("system").alias("actor"), rule.alias("rule_id"), before.alias("previous_values"), after.alias("resulting_values"))

    def audit_value(field: Column, value: Column, source: Column) -> Column:
        return F.struct(field.alias("field"), value.alias("value"), source.alias("source"), (source == "confirmed_by_user").alias("confirmed"))

    extracted = S.chosen([(F.col(f"x_{f}").isNotNull(), audit_value(F.lit(f), F.col(f"x_{f}"), F.lit("rule_extracted"))) for f in S.FIELDS])
    changes = F.transform("changes", lambda c, i: event(i + 3, "normalizer", F.concat(c["decision"], F.lit(":"), F.when(c["applied"], "applied").otherwise("proposed")), c["rule_id"], F.array(audit_value(c["field"], c["before"], c["before_source"])), F.array(audit_value(c["field"], c["after"], c["after_source"]))))
    listed = lambda x, other: F.when(F.size(x) > 0, F.array_join(x, ",")).otherwise(F.lit(other))
    codes, n = F.transform("issues", lambda x: x["reason_code"]), F.size("changes")
    # Events are numbered where they are made: a loop over the finished ones would copy them all.
    return F.concat(
        F.array(event(F.lit(1), "pii", listed("pii_codes", "no_pii_detected"), null_of("string")), event(F.lit(2), "model", F.lit("extract_components"), F.lit(VERSIONS["model"]), none, extracted)), changes,
        F.array(event(n + 3, "validator", F.concat_ws(":", "status", "reason_code"), F.lit(VERSIONS["validator"])), event(n + 4, "quality_gate", F.concat_ws(":", "gate_status", listed(codes, "no_issue")), F.lit(VERSIONS["quality_gate"]))),
    )


def corrections() -> Column:
    """Semantic proposals, numbered over all changes; deterministic rewrites are no decisions."""
    each = F.transform("changes", lambda c, i: F.struct(
        F.concat(F.lit("corr_"), F.lower(c["field"]), F.lit("_"), F.lpad((i + 1).cast("string"), 3, "0")).alias("correction_id"), c["field"].alias("field"),
        basic(c["before"], c["before_source"]).alias("previous_value"), basic(c["after"], c["after_source"]).alias("proposed_value"), c["rule_id"].alias("rule_id"), c["decision"].alias("decision"), c["applied"].alias("applied"), null_of("string").alias("user_confirmation"),
    ))
    some = F.exists("changes", lambda c: c["decision"] != "deterministic")
    return F.when(some, F.filter(each, lambda c: c["decision"] != "deterministic")).otherwise(F.array().cast(_CORRECTIONS))


def document_body(df: DataFrame, key: str = "address_id") -> DataFrame:
    """(key, body): the contract's response document of each processed address as a struct."""
    df = df if "geocode_status" in df.columns else df.withColumns({"geocode_status": F.lit("NOT_REQUESTED"), "geocode_reasons": F.array().cast("array<string>"), **{c: null_of("string") for c in ("provider", "precision")}, **{c: null_of("double") for c in ("lat", "lon")}})
    df = df.withColumns({f"geo_{f}": null_of("string") for f in S.FIELDS if f"geo_{f}" not in df.columns})
    body = F.struct(
        F.lit("address_parse_response").alias("document_type"), F.lit(VERSIONS["contract"]).alias("schema_version"), F.concat(F.lit("req_"), F.lpad(F.col(key).cast("string"), 8, "0")).alias("request_id"),
        F.struct(*[F.lit(v).alias(k) for k, v in VERSIONS.items()]).alias("versions"),
        F.struct(basic(F.col("address_text"), "rule_extracted").alias("address_text"), basic(F.col("redacted_text"), "rule_extracted").alias("redacted_text"), F.col("pii_entities").alias("entities"), F.col("pii_codes").alias("reason_codes"), F.col("pii_warnings").alias("warnings")).alias("pii"),
        components().alias("components"), result_value(composed(), F.lit("normalized_by_dictionary")).alias("normalized_address"),
        F.struct(F.col("gate_status").alias("status"), F.col("issues"), F.struct(F.lit(VERSIONS["quality_gate"]).alias("version"), F.array(*[F.struct(F.lit(a).alias("status"), F.lit(b).alias("when")) for a, b in PRECEDENCE]).alias("precedence")).alias("rules")).alias("quality_gate"),
        corrections().alias("corrections"), geocoding_block().alias("geocoding"), audit_trail().alias("audit_trail"),
    )
    return df.select(key, body.alias("body"))


def document(df: DataFrame, key: str = "address_id") -> DataFrame:
    """(key, document): the contract's response document of each processed address as JSON, null keys kept."""
    return document_body(df, key).select(key, F.to_json("body", {"ignoreNullFields": "false"}).alias("document"))


def process(raw: DataFrame, prepared: Lookup, column: str = "text", key: str = "address_id") -> DataFrame:
    """Raw address texts through all steps up to the gate; stateless but for the prepared hierarchy.

    Only what the later steps are made of goes through the two joins: the marked and the cleaned text, the fields as they
    were found, and the normalized names and code that the hierarchy is asked for. Personal data, changes and their
    sources come after them. No change of normalization is left open, so that the gate can come before it.
    """
    found = extract(P.cleaned(P.marked(raw, column)))
    asked = normalize(found, S.ADMIN_FIELDS, own="x_{}", composed="_json").select(*found.columns, *S.ADMIN_FIELDS)
    told = gate(validate(asked, prepared, key)).drop(*S.ADMIN_FIELDS)
    return P.shown(normalize(told, own="x_{}", composed="_json")).drop("_marked", "_named", "_json")


def stage_counts(extracted: DataFrame, prepared: Lookup, key: str = "address_id") -> DataFrame:
    """(stage, kind, name, n): what normalization and the gate add to the validation of extracted fields.

    Stages extracted and normalized have the status and reason of each address, validated before and after normalization;
    normalizer how many addresses it changed and how often each rule did; gate the final statuses. The addresses are
    normalized and gated once, and both sides are summed up in one shuffle of as many rows as there are names.
    """
    fact = lambda stage, kind, name: F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), name.alias("name"))
    told = lambda stage: [fact(stage, "status", F.col("status")), fact(stage, "reason", F.col("reason_code"))]
    before = validate(extracted, prepared, key).select(F.explode(F.array(*told("extracted"))).alias("f"))
    after = gate(validate(normalize(extracted, [f for f in S.FIELDS if f in extracted.columns]), prepared, key))
    changed = F.when(F.size("changes") > 0, F.array(fact("normalizer", "addresses", F.lit("changed")))).otherwise(F.slice(F.array(fact("normalizer", "addresses", F.lit("changed"))), 1, 0))
    rules = F.transform("changes", lambda c: fact("normalizer", "rule", c["rule_id"]))
    facts = F.concat(F.array(*told("normalized"), fact("gate", "status", F.col("gate_status"))), changed, rules)
    return before.unionByName(S.each(after.withColumn("_facts", facts), "_facts", "f")).groupBy("f.stage", "f.kind", "f.name").agg(F.count(F.lit(1)).alias("n"))
