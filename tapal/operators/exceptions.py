"""What a reference build has to document: conflicts within the primary source and with a cross-check, and broken preconditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import governance as G

PRIMARY = "primary"
_VALUES = "array<struct<source:string,value:string>>"
LEVELS = ["province", "city", "district", "village"]


def _entry(when: Column, kind: str, field: str, *values: tuple[Column | str, Column]) -> Column:
    pairs = F.array(*[F.struct((F.lit(s) if isinstance(s, str) else s).alias("source"), v.alias("value")) for s, v in values])
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.sort_array(pairs).alias("values")))


def _with_id(found: DataFrame) -> DataFrame:
    """exception_id: REF- and twelve hex digits of the SHA-256 of [kind, village_code, field, [[source, value], ...]] as compact JSON."""
    quoted = lambda x: F.to_json(F.array(x))
    inner = lambda x: F.substring(quoted(x), F.lit(2), F.length(quoted(x)) - 2)
    pairs = F.array_join(F.transform("values", lambda v: F.concat(F.lit("["), inner(v["source"]), F.lit(","), inner(v["value"]), F.lit("]"))), ",")
    text = F.concat(F.lit("["), inner(F.col("kind")), F.lit(","), inner(F.col("village_code")), F.lit(","), inner(F.col("field")), F.lit(",["), pairs, F.lit("]]"))
    return found.withColumn("exception_id", F.concat(F.lit("REF-"), F.upper(F.substring(F.sha2(text, 256), 1, 12))))


def primary_exceptions(rows: DataFrame) -> DataFrame:
    """(exception_id, village_code, kind, field, values) of a primary source's rows.

    rows: line, village_code, city_code, bps_city_code, postal_code, and <level>_name and bps_<level>_name of province,
    district and village. A postal conflict is a code that differs from all of the village's on earlier lines; it tells
    those and its own line. The first line of each code decides, so that no village is held in one task.
    """
    named = [_entry((S.surface(f"bps_{x}_name") != "") & (S.normalize_hierarchy(f"bps_{x}_name") != S.normalize_hierarchy(f"{x}_name")), "name_difference", f"{x}_name", ("BPS", F.col(f"bps_{x}_name")), ("Kemendagri", F.col(f"{x}_name"))) for x in ("province", "district", "village")]
    own = [_entry(F.col("bps_city_code") != F.col("city_code"), "hierarchy_code_conflict", "city_code", ("BPS", F.col("bps_city_code")), ("Kemendagri", F.col("city_code"))), *named]
    found = rows.select("village_code", F.explode(F.array_compact(F.array(*own))).alias("e")).select("village_code", "e.*")
    firsts = rows.where(S.surface("postal_code") != "").groupBy("village_code", "postal_code").agg(F.min("line").alias("line"))
    known = firsts.groupBy("village_code").agg(F.sort_array(F.collect_list(F.struct("line", "postal_code"))).alias("codes"))  # distinct codes of a village, a few
    later = known.select("village_code", "codes", F.posexplode("codes").alias("i", "c")).where("i > 0")
    before = F.array_join(F.sort_array(F.transform(F.slice("codes", 1, F.col("i")), lambda c: c["postal_code"])), ",")
    postal = later.select("village_code", _entry(F.lit(True), "postal_code_conflict", "postal_code", (PRIMARY, before), (F.concat(F.lit(f"{PRIMARY}:row-"), F.col("c.line").cast("string")), F.col("c.postal_code"))).alias("e")).select("village_code", "e.*")
    return _with_id(found.unionByName(postal))


def inconsistent_villages(rows: DataFrame) -> DataFrame:
    """(village_code, n): villages that the primary source gives more than one chain of codes or names."""
    chain = [c for x in LEVELS for c in (f"{x}_code", f"{x}_name") if c in rows.columns and c != "village_code"]
    return rows.groupBy("village_code").agg(F.countDistinct(*[F.coalesce(c, F.lit("")) for c in chain]).alias("n")).where("n > 1")


def crosscheck_exceptions(entries: DataFrame, crosscheck: DataFrame) -> DataFrame:
    """(exception_id, village_code, kind, field, values) of cross-check rows against the primary entries, a left join.

    entries: village_code, <level>_code, <level>_name, postal_codes. crosscheck: source_id, village_code, the same codes
    and names as x_<level>_code and x_<level>_name, x_postal_code. A row without an entry is missing_primary_row.
    """
    out = crosscheck.join(entries.withColumn("_known", F.lit(True)), "village_code", "left")
    known, source = F.col("_known").isNotNull(), F.col("source_id")
    each = [_entry(~known, "missing_primary_row", "village_code", (source, F.col("village_code")), (PRIMARY, F.lit("missing")))]
    for x in LEVELS:
        if x != "village":
            each.append(_entry(known & (F.col(f"x_{x}_code") != F.col(f"{x}_code")), "hierarchy_code_conflict", f"{x}_code", (PRIMARY, F.col(f"{x}_code")), (source, F.col(f"x_{x}_code"))))
        each.append(_entry(known & (S.surface(f"x_{x}_name") != "") & (S.normalize_hierarchy(f"x_{x}_name") != S.normalize_hierarchy(f"{x}_name")), "name_difference", f"{x}_name", (PRIMARY, F.col(f"{x}_name")), (source, F.col(f"x_{x}_name"))))
    each.append(_entry(known & (S.surface("x_postal_code") != "") & ~F.array_contains("postal_codes", F.col("x_postal_code")), "postal_code_conflict", "postal_code", (PRIMARY, F.array_join(F.sort_array("postal_codes"), ",")), (source, F.col("x_postal_code"))))
    return _with_id(out.select("village_code", F.explode(F.array_compact(F.array(*each))).alias("e")).select("village_code", "e.*"))


def promoted_aliases(entries: DataFrame, crosscheck: DataFrame, used: list[str]) -> DataFrame:
    """(village_code, level, alias): differing names of cross-check sources that may be used; held sources promote none."""
    out = crosscheck.where(F.col("source_id").isin(used)).join(entries, "village_code")
    differs = lambda x: (S.surface(f"x_{x}_name") != "") & (S.normalize_hierarchy(f"x_{x}_name") != S.normalize_hierarchy(f"{x}_name"))
    each = F.array_compact(F.array(*[F.when(differs(x), F.struct(F.lit(x).alias("level"), F.col(f"x_{x}_name").alias("alias"))) for x in LEVELS]))
    return out.select("village_code", F.explode(each).alias("a")).select("village_code", "a.*").distinct()


# --- preconditions ----------------------------------------------------------------------------------------------------


def indexed(rows: DataFrame, province: str = "32", placeholder: str = "00.00.00.0000") -> DataFrame:
    """The rows of a province with a code that can be canonical, with it as village_code; placeholders are no codes."""
    code = S.village_code("village_code")
    return rows.where((F.col("village_code") != placeholder) & (code != "") & code.startswith(province + ".")).withColumn("village_code", code)


def coverage(tables: dict[str, DataFrame], key: str = "village_code") -> DataFrame:
    """(key, table): keys that some of the tables have and this one has not; none if all cover the same."""
    each = [df.select(key, F.lit(name).alias("_t")).distinct() for name, df in tables.items()]
    held = reduce(lambda a, b: a.unionByName(b), each).groupBy(key).agg(F.collect_set("_t").alias("_ts"))  # as many as there are tables
    return held.select(key, F.explode(F.array_except(F.array(*map(F.lit, tables)), F.col("_ts"))).alias("table"))


def section_problems(sections: dict[int, DataFrame]) -> DataFrame:
    """(village_code, section, problem): blank, repeated and overlapping codes, and postal codes that are not of five digits."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select("village_code", "postal_code", F.lit(k).alias("section")) for k, df in sections.items()])
    own = F.array_compact(F.array(F.when(S.surface("village_code") == "", F.lit("blank_code")), F.when(S.clean_postal("postal_code") == "", F.lit("bad_postal_code"))))
    found = rows.select("village_code", "section", F.explode(own).alias("problem"))
    counts = rows.where(S.surface("village_code") != "").groupBy("village_code", "section").agg(F.count(F.lit(1)).alias("n"))
    twice = counts.where("n > 1").select("village_code", "section", F.lit("repeated").alias("problem"))
    both = counts.groupBy("village_code").agg(F.collect_set("section").alias("s")).where(F.size("s") > 1).select("village_code", F.explode("s").alias("section"), F.lit("overlap").alias("problem"))
    return found.unionByName(twice).unionByName(both)


def consensus_outputs(rows: DataFrame) -> DataFrame:
    """(village_code, output): the outputs a consensus row goes to; review holds all that is not accepted, so it overlaps."""
    status = F.col("verification_status")
    outputs = F.when(status == "verified_consensus", F.array(F.lit("accepted"))).when(status == "corroborated_candidate", F.array(F.lit("corroborated"), F.lit("review"))).otherwise(F.array(F.lit("review"), F.lit("unresolved")))
    return rows.select("village_code", F.explode(outputs).alias("output"))


def codes_of(rows: DataFrame, by: list[str], code: str) -> DataFrame:
    """(by, codes): the distinct sorted codes of digits of each group, a trailing .0 dropped."""
    clean = F.regexp_replace(S.surface(code), "\\.0$", "")
    return rows.withColumn("_c", F.when(clean.rlike("^[0-9]+$"), clean)).groupBy(*by).agg(F.sort_array(F.collect_set("_c")).alias("codes"))


def code_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(village_code) of a text list: comments and blank lines dropped, codes canonical and distinct; a line that is no code gives null."""
    text = F.trim(F.regexp_replace(column, "#.*$", ""))
    return lines.select(text.alias("_t")).where("_t <> ''").select(F.nullif(S.village_code("_t"), F.lit("")).alias("village_code")).distinct()


def source_codes(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, source, code) of a column like d:40111;o:40112."""
    pairs = F.map_entries(F.str_to_map(column, F.lit(";"), F.lit(":")))
    return rows.where(S.surface(column) != "").select(key, F.explode(pairs).alias("p")).select(key, F.col("p.key").alias("source"), F.col("p.value").alias("code"))


def observation_problems(rows: DataFrame, source_id: str) -> DataFrame:
    """(village_code, problem): another source, codes that are not canonical, postal codes that are not of five digits, repeated codes."""
    checks = {"source": F.col("source_id") == source_id, "village_code": S.village_code("village_code") != "", "postal_code": (S.surface("postal_code") == "") | (S.clean_postal("postal_code") != "")}
    found = rows.select("village_code", F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))).alias("problem"))
    return found.unionByName(G.violations(rows, "village_code").where("reason = 'repeated'").select(F.col("key").alias("village_code"), F.col("reason").alias("problem")))


# --- postal search and API observations -----------------------------------------------------------------------------------


#: Where a region may be said beside the object itself: inside the regions below it, the nearest first.
_ANCESTORS = {"district": [()], "city": [(), ("district",)], "province": [(), ("city",), ("district", "city"), ("district",)]}
_CASES = {"camel": ("{}Code", "{}Name"), "snake": ("{}_code", "{}_name")}


def _api_schema() -> str:
    """The parts of an API object that are read: regions nested in each other, with their own and the upper regions' codes and names."""
    flat = lambda names: [f"`{form.format(x)}`:string" for x in names for forms in _CASES.values() for form in forms]
    own = ["code:string", "name:string"]
    province = f"struct<{','.join(own)}>"
    city = f"struct<{','.join([*own, *flat(['province']), f'province:{province}'])}>"
    district = f"struct<{','.join([*own, *flat(['city', 'province']), f'city:{city}', f'province:{province}'])}>"
    return f"struct<{','.join([*own, 'postalCode:string', 'postal_code:string', *flat(['village', 'district', 'city', 'province']), f'district:{district}', f'city:{city}', f'province:{province}'])}>"


#: The columns of a cross-check table.
CROSSCHECK_COLUMNS = ["source_id", "snapshot", "province_code", "province_name", "city_code", "city_name", "district_code", "district_name", "village_code", "village_name", "postal_code", "evidence_url", "note"]


def crosscheck_row(column: str) -> Column:
    """The cross-check row of an API object in JSON: village code and name, postal code, and each region's code and name.

    A region is the first of a nested object, camel-case and snake-case keys that has both a code and a name, in the
    object itself or else in the regions below that one.
    """

    def told(o: Column) -> Column:
        given = lambda *values: F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))

        def region(x: str) -> Column:
            found = []
            for path in _ANCESTORS[x]:
                at = o
                for step in path:
                    at = at[step]
                found += [(at[x]["code"], at[x]["name"]), *[(at[c.format(x)], at[n.format(x)]) for c, n in _CASES.values()]]
            pairs = [F.when((F.coalesce(c, F.lit("")) != "") & (F.coalesce(n, F.lit("")) != ""), F.struct(c.alias("code"), n.alias("name"))) for c, n in found]
            return F.coalesce(*pairs, F.struct(F.lit("").alias("code"), F.lit("").alias("name")))

        return F.struct(given(o["code"], o["villageCode"], o["village_code"]).alias("village_code"), given(o["name"], o["villageName"], o["village_name"]).alias("village_name"), given(o["postalCode"], o["postal_code"]).alias("postal_code"), *[region(x).alias(x) for x in ("district", "city", "province")])

    return S.once(F.from_json(column, _api_schema()), told)


def crosscheck_table(objects: DataFrame, column: str, source_id: str, snapshot: str, note: str, evidence_url: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): API objects as rows of CROSSCHECK_COLUMNS, and (village_code, problem) of those that are none.

    village_code (not of ten digits), no_village_name, postal_code (not of five digits), and no_district, no_city or
    no_province where no form of the region is whole. A row with a problem is in no table of rows.
    """
    if not snapshot.strip():
        raise ValueError("a snapshot is required")
    r = S.held(objects.select(F.col(column).alias("_j"), evidence_url.alias("_url")), "r", crosscheck_row("_j")).withColumn("_code", S.village_code("r.village_code"))
    checks = {"village_code": F.col("_code") != "", "no_village_name": S.surface("r.village_name") != "", "postal_code": F.trim("r.postal_code").rlike("^[0-9]{5}$"), **{f"no_{x}": F.col(f"r.{x}.code") != "" for x in ("district", "city", "province")}}
    r = r.withColumn("_p", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])))
    values = {"source_id": F.lit(source_id), "snapshot": F.lit(snapshot.strip()), "village_code": F.col("_code"), "village_name": F.trim("r.village_name"), "postal_code": F.trim("r.postal_code"), "evidence_url": F.col("_url"), "note": F.lit(note)}
    values |= {f"{x}_{c}": F.trim(f"r.{x}.{c}") for x in ("province", "city", "district") for c in ("code", "name")}
    rows = r.where(F.size("_p") == 0).select(*[values[c].alias(c) for c in CROSSCHECK_COLUMNS])
    return rows, S.each(r.withColumn("village_code", F.col("r.village_code")), "_p", "problem", "village_code")


def pos_observations(rows: DataFrame, queries: DataFrame, results: DataFrame) -> DataFrame:
    """(village_code, observation_status, official_postal_code, search_result_count, exact_result_count) of each row.

    queries (query) are the searches that were made, results (query, village_name, district_name, city_name,
    province_name, postal_code) what they gave. A result is exact if all four names agree but for case and white space.
    Exact results without any code of five digits count as multiple_exact_codes, as they do not settle one.
    """
    names = ["village_name", "district_name", "city_name", "province_name"]
    own = rows.select("village_code", *[S.normalize_pos(n).alias(n) for n in names]).withColumn("query", F.col("village_name"))
    asked = queries.select(S.normalize_pos("query").alias("query")).distinct().withColumn("_asked", F.lit(True))
    found = results.select(S.normalize_pos("query").alias("query"), *[S.normalize_pos(n).alias(n) for n in names], F.trim("postal_code").alias("code"))
    sizes = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    exact = found.groupBy("query", *names).agg(F.count(F.lit(1)).alias("exact"), F.sort_array(F.collect_set(F.when(F.col("code").rlike("^[0-9]{5}$"), F.col("code")))).alias("codes"))
    out = own.join(asked, "query", "left").join(sizes, "query", "left").join(exact, ["query", *names], "left")
    status = F.when(F.col("_asked").isNull(), "not_queried").when(F.col("exact").isNull(), "no_exact_match").when(F.size("codes") == 1, "exact_match").otherwise("multiple_exact_codes")
    count = lambda c: F.when(F.col("_asked").isNotNull(), F.coalesce(c, F.lit(0)))
    return out.select("village_code", status.alias("observation_status"), F.when(F.size("codes") == 1, F.col("codes")[0]).otherwise("").alias("official_postal_code"), count("n").alias("search_result_count"), count("exact").alias("exact_result_count"))


def pos_summary(observations: DataFrame, expected: DataFrame) -> DataFrame:
    """(observation_status, n, matching): observations by status, and how many have the expected postal_code of their village."""
    out = observations.join(expected.select("village_code", F.col("postal_code").alias("_e")), "village_code", "left")
    return out.groupBy("observation_status").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("observation_status") == "exact_match") & (F.col("official_postal_code") == F.col("_e"))).alias("matching"))


def benchmark_candidates(rows: DataFrame, ordinal: str, key: str, address: str, parents: list[str], least: int = 8) -> DataFrame:
    """The first fit row of each id: an id and parents that are not blank and an address of some length. An unfit first row does not take the id."""
    fit = (S.surface(key) != "") & (F.length(S.surface(address)) >= least)
    for p in parents:
        fit = fit & (S.surface(p) != "")
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.where(fit).groupBy(F.col(key).alias("_k")).agg(F.min_by(whole, F.col(ordinal)).alias("_r")).select("_r.*")
