"""Reference building: consensus of three sources, clusters, review queues, adjudication and the final hierarchy.

Sources are DataFrames of strings with village_code and the columns each function names. Blank and null are the same.
Keys must be unique; violations() tells where they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators.ranking import numbered


def violations(df: DataFrame, key: str) -> DataFrame:
    """(key, reason): blank and repeated keys."""
    blank = df.where(S.surface(key) == "").select(F.coalesce(F.col(key), F.lit("")).alias("key"), F.lit("blank").alias("reason"))
    twice = df.where(S.surface(key) != "").groupBy(key).count().where("count > 1").select(F.col(key).alias("key"), F.lit("repeated").alias("reason"))
    return blank.unionByName(twice)


def remap(source: DataFrame, resolutions: DataFrame) -> DataFrame:
    """source with former village codes replaced by current ones, where the names agree; remap_conflict tells where they do not.

    resolutions: former_village_code, current_village_code, resolved_name.
    """
    out = source.join(resolutions, source.village_code == resolutions.former_village_code, "left")
    agree = S.normalize_workbook("village_name") == S.normalize_workbook("resolved_name")
    known = F.col("former_village_code").isNotNull()
    return out.withColumn("remap_conflict", known & ~agree).withColumn("village_code", F.when(known & agree, F.col("current_village_code")).otherwise(F.col("village_code"))).drop(*resolutions.columns)


def remap_problems(resolutions: DataFrame) -> DataFrame:
    """(code, problem) of a table of resolutions: codes that are none, a former code or a current one that comes twice, and a code that becomes itself."""
    pair = {"former": "former_village_code", "current": "current_village_code"}
    bad = F.array_compact(F.array(*[F.when(S.village_code(c) != S.surface(c), F.lit(f"{k}_is_no_code")) for k, c in pair.items()], *[F.when(S.surface(c) == "", F.lit(f"{k}_is_blank")) for k, c in pair.items()], F.when(S.surface(pair["former"]) == S.surface(pair["current"]), F.lit("unchanged"))))
    out = resolutions.select(F.col(pair["former"]).alias("code"), F.explode(bad).alias("problem"))
    for k, c in pair.items():
        out = out.unionByName(resolutions.where(S.surface(c) != "").groupBy(c).count().where("count > 1").select(F.col(c).alias("code"), F.lit(f"{k}_repeated").alias("problem")))
    return out


def postal_consensus(d: Column, o: Column, k: Column) -> Column:
    """(accepted, candidate, status, confidence, source_ids, reason) of three cleaned codes; two agreeing local sources are no majority."""

    def result(accepted, candidate, status, confidence, ids, reason):
        return F.struct(accepted.alias("accepted"), candidate.alias("candidate"), F.lit(status).alias("verification_status"), F.lit(confidence).alias("confidence"), F.lit(ids).alias("source_ids"), F.lit(reason).alias("reason"))

    e = F.lit("")
    return (
        F.when((d != "") & (d == o) & (o == k), result(d, e, "verified_consensus", "high", "diskominfo;kodepos_dev;open_data_jabar", "all_sources_agree"))
        .when((k != "") & (k == o) & (k != d), result(e, k, "corroborated_candidate", "medium", "kodepos_dev;open_data_jabar", "api_and_odj_agree"))
        .when((k != "") & (k == d) & (k != o), result(e, k, "corroborated_candidate", "medium", "diskominfo;kodepos_dev", "api_and_diskominfo_agree"))
        .otherwise(result(e, e, "review_required", "unresolved", "", "sources_disagree"))
    )


def consensus(diskominfo: DataFrame, odj: DataFrame, api: DataFrame) -> DataFrame:
    """The three-way inner join on village_code with the postal decision; each source has village_code and postal_code, diskominfo the names too."""
    joined = diskominfo.withColumn("d", S.clean_postal("postal_code")).drop("postal_code")
    joined = joined.join(odj.select("village_code", S.clean_postal("postal_code").alias("o")), "village_code").join(api.select("village_code", S.clean_postal("postal_code").alias("k")), "village_code")
    out = joined.withColumn("_p", postal_consensus(F.col("d"), F.col("o"), F.col("k")))
    return out.select(*joined.columns, F.col("_p.accepted").alias("postal_code"), F.col("_p.candidate").alias("postal_code_candidate"), "_p.verification_status", "_p.confidence", "_p.source_ids", "_p.reason", F.when(F.col("_p.verification_status") == "verified_consensus", "no").otherwise("yes").alias("review_required"))


def key_differences(a: DataFrame, b: DataFrame, key: str = "village_code") -> DataFrame:
    """(key, side): keys that only one side has."""
    return a.select(key).join(b.select(key), key, "left_anti").select(key, F.lit("left").alias("side")).unionByName(b.select(key).join(a.select(key), key, "left_anti").select(key, F.lit("right").alias("side")))


def compare(d: DataFrame, o: DataFrame, k: DataFrame) -> DataFrame:
    """The three-way full outer comparison: (village_code, d, o, k, status, d_relation, o_relation, local_relation)."""
    side = lambda df, c: df.select("village_code", S.clean_postal("postal_code").alias(c), F.lit(True).alias(f"has_{c}"))
    out = side(d, "d").join(side(o, "o"), "village_code", "full_outer").join(side(k, "k"), "village_code", "full_outer")
    for c in "dok":
        out = out.withColumn(c, F.coalesce(c, F.lit(""))).withColumn(f"has_{c}", F.coalesce(f"has_{c}", F.lit(False)))
    same_d, same_o = (F.col("d") != "") & (F.col("d") == F.col("k")), (F.col("o") != "") & (F.col("o") == F.col("k"))
    status = (
        F.when(~F.col("has_k"), "missing_in_api").when(~F.col("has_d") & ~F.col("has_o"), "api_extra").when(same_d & same_o, "all_match").when(same_d, "api_matches_diskominfo").when(same_o, "api_matches_odj")
        .when((F.col("d") == "") & (F.col("o") == ""), "api_only").otherwise("api_differs_available_sources")
    )
    relation = lambda c: F.when(~F.col("has_k"), "missing_in_api").when(F.col(c) == "", "source_postal_missing").when(F.col(c) == F.col("k"), "match").otherwise("different")
    local = F.when((F.col("d") == "") & (F.col("o") == ""), "both_missing").when(F.col("d") == "", "diskominfo_missing").when(F.col("o") == "", "odj_missing").when(F.col("d") == F.col("o"), "match").otherwise("different")
    return out.select("village_code", "d", "o", "k", status.alias("status"), relation("d").alias("d_relation"), relation("o").alias("o_relation"), local.alias("local_relation"))


def postal_decision(d: Column, o: Column, k: Column) -> Column:
    """(candidate, decision, review) of three cleaned codes; blank is missing."""

    def result(candidate, decision, review="yes"):
        return F.struct(candidate.alias("candidate"), F.lit(decision).alias("decision"), F.lit(review).alias("review"))

    e, both, differ = F.lit(""), (d != "") & (o != ""), (d != "") & (o != "") & (d != o)
    alone = F.size(F.array_distinct(F.filter(F.array(d, o, k), lambda x: x != ""))) == 1
    return (
        F.when((d == "") & (o == "") & (k == ""), result(e, "unresolved"))
        .when(alone & both, result(d, "agree", "no")).when(alone & (d == "") & (o == ""), result(k, "kodepos_only")).when(alone & (d != ""), result(d, "diskominfo_only")).when(alone, result(o, "odj_only"))
        .when(differ & (k == d), result(d, "conflict_api_supports_diskominfo")).when(differ & (k == o), result(o, "conflict_api_supports_odj"))
        .when(differ & (k != ""), result(e, "conflict_api_third_value")).when(differ, result(e, "conflict"))
        .when((d != "") & (k != d), result(e, "conflict_api_vs_diskominfo")).otherwise(result(e, "conflict_api_vs_odj"))
    )


def merge(primary: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """Two left joins driven by the first source: (village_code, d, o, k, candidates, candidate, decision, review)."""
    out = primary.select("village_code", S.clean_postal("postal_code").alias("d"))
    for c, df in (("o", second), ("k", third)):
        out = out.join(df.select("village_code", S.clean_postal("postal_code").alias(c)), "village_code", "left").withColumn(c, F.coalesce(c, F.lit("")))
    return out.select("village_code", "d", "o", "k", S.joined_values(F.array("d", "o", "k")).alias("candidates"), postal_decision(F.col("d"), F.col("o"), F.col("k")).alias("_p")).select("village_code", "d", "o", "k", "candidates", "_p.*")


def unresolved_pattern(d: Column, o: Column, k: Column) -> Column:
    """The class of an unresolved triplet, null for one that fits none."""
    return (
        F.when((d != "") & (d == o) & (k != d), "government_sources_agree_api_differs")
        .when((d != "") & (o != "") & (k != "") & (d != o) & (d != k) & (o != k), "all_three_different")
        .when((d == "") & (o != "") & (k != o), "diskominfo_missing_api_odj_different")
        .when((o == "") & (d != "") & (k != d), "open_data_jabar_missing_api_diskominfo_different")
        .when((k == "") & (d != "") & (o != d), "api_missing_local_sources_different")
    )


def unclassified(rows: DataFrame) -> DataFrame:
    """(village_code, d, o, k) of rows to review whose triplet fits no class; group_unresolved leaves them out, so there should be none."""
    return rows.where((F.col("verification_status") == "review_required") & unresolved_pattern(F.col("d"), F.col("o"), F.col("k")).isNull()).select("village_code", "d", "o", "k")


TRIPLET = ["city_code", "district_code", "unresolved_pattern", "d", "o", "k"]


def group_unresolved(rows: DataFrame) -> DataFrame:
    """The rows of review_required with pattern, cluster ids and sizes and review priority; rows of no pattern are left out."""
    out = rows.where(F.col("verification_status") == "review_required").withColumn("unresolved_pattern", unresolved_pattern(F.col("d"), F.col("o"), F.col("k"))).where("unresolved_pattern is not null")
    district = ["city_code", "district_code", "unresolved_pattern"]
    out = out.withColumn("district_cluster_id", S.stable_id("DIST-", *district)).withColumn("triplet_cluster_id", S.stable_id("TRIP-", *TRIPLET))
    sizes = out.groupBy("district_cluster_id").agg(F.count(F.lit(1)).alias("district_cluster_size"))
    triplets = out.groupBy("triplet_cluster_id").agg(F.count(F.lit(1)).alias("triplet_cluster_size"))
    out = out.join(sizes, "district_cluster_id").join(triplets, "triplet_cluster_id")
    return out.withColumn("review_priority", F.when(F.col("unresolved_pattern").contains("missing"), "highest").otherwise("high"))


def clusters(detail: DataFrame) -> DataFrame:
    """A row for each district cluster: size, distinct triplets, value lists, five first villages, and rank.

    The lists of first villages hold five entries for any size: each task keeps the five least of its rows.
    """
    key = ["district_cluster_id", "city_code", "district_code", "unresolved_pattern"]
    values = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ";")
    sums = detail.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("triplet_cluster_id").alias("triplet_count"), values("d").alias("d_values"), values("o").alias("o_values"), values("k").alias("k_values"))
    first = detail.withColumn("_r", F.row_number().over(Window.partitionBy("district_cluster_id").orderBy("village_code"))).where("_r <= 5")
    first = first.groupBy("district_cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("village_code", "village_name"))), lambda x: x["village_code"]), ";").alias("sample_codes"))
    return numbered(sums.join(first, "district_cluster_id"), [F.desc("row_count"), F.col("city_code"), F.col("district_code"), F.col("unresolved_pattern")], "cluster_rank")


def spotcheck_queue(detail: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """One representative for each triplet, ranked; with observations (village_code, observed) their status and matches."""
    rep = detail.groupBy("triplet_cluster_id").agg(F.min_by(F.struct(*[F.col(c) for c in detail.columns]), "village_code").alias("_r")).select("_r.*")
    impact = F.col("triplet_cluster_size")
    rep = rep.withColumn("priority", F.when(F.col("unresolved_pattern").contains("missing"), "P0_missing_source").when(impact >= 10, "P1_high_impact").when(impact >= 5, "P2_medium_impact").otherwise("P3_targeted"))
    rep = numbered(rep, [F.col("priority"), F.desc("triplet_cluster_size"), F.desc("district_cluster_size"), F.col("city_code"), F.col("district_code"), F.col("triplet_cluster_id"), F.col("village_code")], "queue_rank")
    if observations is None:
        return rep
    out = rep.join(observations.select("village_code", S.clean_postal("observed").alias("observed")), "village_code", "left").withColumn("observed", F.coalesce("observed", F.lit("")))
    matched = F.array_compact(F.array(*[F.when((F.col("observed") != "") & (F.col("observed") == F.col(c)), F.lit(name)) for c, name in (("d", "diskominfo"), ("o", "open_data_jabar"), ("k", "kodepos_dev"))]))
    return out.withColumn("matched_sources", F.array_join(matched, ";")).withColumn("observation_status", F.when(F.col("observed") == "", "not_observed").when(F.size(matched) > 0, "observed_matches_source").otherwise("observed_new_value"))


def review_worksheet(candidates: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Rows that are in exactly one of the two groups, with review columns to fill in; both have village_code."""
    both = candidates.select("village_code", F.lit(True).alias("c")).join(unresolved.select("village_code", F.lit(True).alias("u")), "village_code", "full_outer")
    one = both.where(F.col("c").isNull() != F.col("u").isNull())
    case = F.when(F.col("c").isNotNull(), "candidate").otherwise("unresolved")
    return one.select("village_code", case.alias("review_case"), F.lit("pending").alias("review_status"), F.lit("").alias("corrected_postal_code"), F.lit("").alias("reviewer"), F.lit("").alias("note"))


def adjudicate(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """(village_code, decision, adjudicated_code, operational): the outcome of each reviewed row.

    rows: village_code, postal_code_candidate, verification_status. reviews: village_code, observation (exact_match,
    no_exact_match, multiple_exact_codes or not_queried), official_code, corrected_code, second_approval. Both cover
    the same codes; key_differences tells where not.
    """
    out = rows.join(reviews, "village_code")
    fixed = S.clean_postal("corrected_code") != ""
    suggested = F.col("verification_status") == "corroborated_candidate"
    code = F.when(F.col("observation") == "exact_match", S.clean_postal("official_code")).when((F.col("observation") == "no_exact_match") & fixed & (suggested | F.col("second_approval")), S.clean_postal("corrected_code"))
    code = code.when((F.col("observation") == "multiple_exact_codes") & ~suggested & fixed & F.col("second_approval"), S.clean_postal("corrected_code")).otherwise("")
    decision = (
        F.when((code != "") & suggested & (code == F.col("postal_code_candidate")), "accept_suggested").when((code != "") & suggested, "replace_suggested").when(code != "", "promote")
        .when(suggested, "error_incomplete").when(F.col("observation").isin("no_exact_match", "multiple_exact_codes"), "remain_unresolved").otherwise("error_unknown_observation")
    )
    return out.select("village_code", "verification_status", decision.alias("decision"), code.alias("adjudicated_code"), F.when(code != "", "verified_adjudicated").when(decision == "remain_unresolved", "blocked").otherwise("error").alias("adjudication_status"))


def operational_status(status: Column, with_adjudicated: bool = False) -> Column:
    """What a verified row may be used for; null for a status outside the table. Adjudicated rows count only if asked for."""
    out = F.when(status == "verified_consensus", "usable_verified").when(status == "corroborated_candidate", "candidate_review_only").when(status == "review_required", "unresolved_do_not_guess")
    return out.when(status == "verified_adjudicated", "usable_verified") if with_adjudicated else out


def staged_sections(consensus_rows: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """The union of three sections with its section number: consensus, adjudicated candidates, adjudicated unresolved."""
    cols = ["village_code", "postal_code"]
    one = consensus_rows.where("verification_status = 'verified_consensus'").select(*cols, F.lit(1).alias("section"))
    done = adjudicated.where("adjudication_status = 'verified_adjudicated'").select("village_code", F.col("adjudicated_code").alias("postal_code"), "verification_status")
    two = done.where("verification_status = 'corroborated_candidate'").select(*cols, F.lit(2).alias("section"))
    three = done.where("verification_status = 'review_required'").select(*cols, F.lit(3).alias("section"))
    return one.unionByName(two).unionByName(three)


def canonical_names(rows: DataFrame, code: str, name: str, authoritative: DataFrame | None = None) -> DataFrame:
    """(code, canonical_name): the authoritative name, else the most frequent, of equals the first in order."""
    counts = rows.where(S.surface(name) != "").groupBy(code, name).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(code).agg(F.min_by(name, F.struct(-F.col("_n"), F.col(name))).alias("canonical_name"))
    if authoritative is None:
        return best
    return best.join(authoritative.select(code, F.col("name").alias("_a")), code, "full_outer").select(code, F.coalesce("_a", "canonical_name").alias("canonical_name"))


def final_reference(consensus_rows: DataFrame, odj: DataFrame, parents: DataFrame, observations: DataFrame) -> DataFrame:
    """The governed lookup: consensus ⋈ odj ⋈ canonical parent names ⟕ observations, with aliases and operational status."""
    out = consensus_rows.join(odj.select("village_code", F.col("village_name").alias("odj_name")), "village_code").join(parents, "district_code").join(observations.select("village_code", S.clean_postal("observed").alias("observed")), "village_code", "left")
    alias = F.filter(S.clean_values(F.array(F.coalesce("odj_name", F.lit("")))), lambda v: S.normalize_workbook(v) != S.normalize_workbook("village_name"))
    match = F.when(F.coalesce("observed", F.lit("")) == "", "").when(F.col("observed") == F.col("postal_code"), "postal_code").when(F.col("observed") == F.col("postal_code_candidate"), "candidate").otherwise("new_value")
    return out.select("village_code", "village_name", "district_code", F.col("canonical_name").alias("district_name"), "postal_code", "verification_status", operational_status(F.col("verification_status")).alias("operational_status"), F.array_join(alias, ";").alias("aliases"), match.alias("pos_match"))


def _source_key(source: Column) -> Column:
    return F.struct(source["source_id"].alias("source_id"), source["snapshot"].alias("snapshot"))


def hierarchy_violations(h: DataFrame) -> DataFrame:
    """(code, reason): broken row invariants and names or parents that a code has more than one of.

    Names, aliases and sources (source_id, snapshot) are looked at where there are such columns: names are not blank,
    aliases and sources are distinct and sorted, and a row with sources has at least one.
    """
    checks = {
        "village_code": F.col("village_code").rlike("^[0-9.]+$"),
        "district_parent": F.col("village_code").startswith(F.concat(F.col("district_code"), F.lit("."))),
        "city_parent": F.col("district_code").startswith(F.concat(F.col("city_code"), F.lit("."))),
        "province_parent": F.col("city_code").startswith(F.concat(F.col("province_code"), F.lit("."))),
        **{f"{x}_name": S.surface(f"{x}_name") != "" for x in ("village", "district", "city", "province") if f"{x}_name" in h.columns},
        **{f"{x}_aliases": F.array_sort(F.array_distinct(F.transform(f"{x}_aliases", F.trim))) == F.col(f"{x}_aliases") for x in ("village", "district", "city", "province") if f"{x}_aliases" in h.columns},
        **{f"{x}_alias_blank": ~F.exists(f"{x}_aliases", lambda a: F.trim(a) == "") for x in ("village", "district", "city", "province") if f"{x}_aliases" in h.columns},
        **({"no_source": F.size("sources") > 0, "sources": F.array_sort(F.array_distinct(F.transform("sources", _source_key))) == F.transform("sources", _source_key), "source_id": F.forall("sources", lambda x: (F.trim(x["source_id"]) != "") & (F.trim(x["snapshot"]) != ""))} if "sources" in h.columns else {}),
        "postal_codes": (F.size("postal_codes") > 0) & F.forall("postal_codes", lambda p: p.rlike("^[0-9]{5}$")) & (F.array_sort(F.array_distinct("postal_codes")) == F.col("postal_codes")),
    }
    out = h.select(F.col("village_code").alias("code"), F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))).alias("reason"))
    for level, parent in (("village", "district"), ("district", "city"), ("city", "province")):
        several = h.groupBy(F.col(f"{level}_code").alias("code")).agg(F.countDistinct(f"{parent}_code", f"{level}_name").alias("n")).where("n > 1")
        out = out.unionByName(several.select("code", F.lit(f"{level}_not_functional").alias("reason")))
    return out


def primary_fold(rows: DataFrame) -> DataFrame:
    """One row for each village of a primary source (ordinal, village_code, village_name, postal_code): postal codes, aliases, and conflicts.

    A postal conflict is a code that differs from all codes of the village on earlier lines.
    """
    own = rows.withColumn("p", S.clean_postal("postal_code"))
    firsts = own.where("p <> ''").groupBy("village_code", "p").agg(F.min("ordinal").alias("first"))
    conflicts = firsts.groupBy("village_code").agg((F.count(F.lit(1)) - 1).alias("postal_conflicts"))
    names = own.groupBy("village_code").agg(F.min_by("village_name", "ordinal").alias("village_name"), F.array_sort(F.collect_set(F.nullif("p", F.lit("")))).alias("postal_codes"), S.clean_values(F.collect_set("village_name")).alias("_names"))
    alias = F.filter("_names", lambda v: S.normalize_hierarchy(v) != S.normalize_hierarchy("village_name"))
    return names.join(conflicts, "village_code", "left").select("village_code", "village_name", "postal_codes", alias.alias("aliases"), F.coalesce("postal_conflicts", F.lit(0)).alias("postal_conflicts"))


#: The orders in which tables are handed out.
ORDERS = {"hierarchy": ["village_code"], "candidate_review": ["village_code"], "unresolved_review": ["review_case", "district_cluster_id", "triplet_cluster_id", "village_code"], "conflicts": ["village_code", "field", "issue"]}


def in_order(df: DataFrame, kind: str, name: str = "place") -> DataFrame:
    """df with its rows' places in the order of that kind of table; the places are those of the whole table and come from ranges."""
    return numbered(df, [F.col(c) for c in ORDERS[kind]], name)


def queue_sums(queue: DataFrame, status: str = "observation_status", pending: str = "not_observed") -> DataFrame:
    """(kind, name, rows, represented): rows of a review queue and the rows that they stand for, over all, by priority, by status,
    and for those that are still pending or done; one pass over the queue by grouping sets."""
    done = F.when(F.col(status) == pending, "pending").otherwise("observed")
    own = queue.select(F.col("priority").alias("_p"), F.col(status).alias("_s"), done.alias("_d"), F.col("triplet_cluster_size").cast("long").alias("_n"))
    cols = {"priority": F.col("_p"), "status": F.col("_s"), "progress": F.col("_d")}
    kind = F.lit("all")
    for k, c in zip(cols, ("_p", "_s", "_d")):
        kind = F.when(F.grouping(c) == 0, k).otherwise(kind)
    out = own.groupingSets([[], *[[c] for c in cols.values()]], *cols.values()).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("represented"), kind.alias("kind"))
    return out.select("kind", F.coalesce("_p", "_s", "_d", F.lit("all")).alias("name"), "rows", "represented")


#: The columns of the lookup table of an application.
LOOKUP_COLUMNS = ["village_code", "province_code", "province_name", "city_code", "city_name", "district_code", "district_name", "village_name", "postal_code"]


def app_lookup(staged: DataFrame, names: DataFrame) -> DataFrame:
    """The staged sections as LOOKUP_COLUMNS: postal codes of staged (village_code, postal_code), the rest of names; in order of village_code when written by in_order."""
    own = staged.select("village_code", S.clean_postal("postal_code").alias("postal_code"))
    return own.join(names.select(*[c for c in LOOKUP_COLUMNS if c != "postal_code"]), "village_code").select(*LOOKUP_COLUMNS)


def adjudication_sums(adjudicated: DataFrame) -> DataFrame:
    """(kind, name, n): adjudicated rows by decision, by status, by what they were before, and all, in one pass."""
    cols = {"decision": F.col("decision"), "status": F.col("adjudication_status"), "before": F.col("verification_status")}
    kind = F.lit("all")
    for k, c in zip(cols, ("decision", "adjudication_status", "verification_status")):
        kind = F.when(F.grouping(c) == 0, k).otherwise(kind)
    out = adjudicated.groupingSets([[], *[[c] for c in cols.values()]], *cols.values()).agg(F.count(F.lit(1)).alias("n"), kind.alias("kind"))
    return out.select("kind", F.coalesce(*cols.values(), F.lit("all")).alias("name"), "n")
