"""Validation where many villages share a name: what an address meets does not grow with them, and results are those of a plain search."""

import itertools

from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import address as A
from tapal.plans import registry

SF = "/root/testdata/sf0.001"
OTHERS = S.ADMIN_FIELDS[1:]


def parts(x):
    words = (x or "").strip().lower().replace(".", " ").split()
    kind = S.KINDS.get(words[0]) if words else None
    return " ".join(words[1:] if kind else words), kind


def same(own, other):
    (a, k), (b, m) = parts(own), parts(other)
    return b != "" and a == b and (k is None or m is None or k == m)


def plain(address, villages):
    own = dict(zip(S.ADMIN_FIELDS, ((x or "").strip() for x in address)))
    met = []
    for code, names, district, city, postals in villages:
        if any(same(own["KELURAHAN"], n) for n in names) and parts(own["KELURAHAN"])[0]:
            m = {f: own[f] == "" or same(own[f], x) for f, x in zip(OTHERS, (district, city, "JAWA"))}
            met.append((code, m | {"KODEPOS": own["KODEPOS"] == "" or own["KODEPOS"] in postals}))
    good = {c for c, m in met if all(m.values())}
    missing = [f for f in S.ADMIN_FIELDS if own[f] == ""]
    if own["KELURAHAN"] == "" or not met:
        return ("incomplete" if own["KELURAHAN"] == "" else "not_found"), [], []
    if not good:
        hit = [f for f in OTHERS if own[f] and (not any(m[f] for _, m in met) or any(all(m[g] for g in OTHERS if g != f) for _, m in met))]
        return "invalid", hit or [f for f in OTHERS if own[f]], sorted({c for c, _ in met})
    return ("ambiguous" if len(good) > 1 else "incomplete" if missing else "valid"), [], sorted(good)


def prepared(spark, villages):
    df = spark.createDataFrame([(c, n[0], n[1:], d, k, p) for c, n, d, k, p in villages], "village_code string, village_name string, village_aliases array<string>, district_name string, city_name string, postal_codes array<string>").withColumn("province_name", F.lit("JAWA"))
    return A.lookup(df.withColumns({f"{x}_aliases": F.array().cast("array<string>") for x in ("district", "city", "province")}))


def test_as_a_plain_search(spark):
    villages = [(f"{i:04d}", [["DESA MAJU", "MAJU", "KEL JAYA"][i % 3], *(["MAJU"] if i % 4 == 0 else [])], f"D{i % 2}", ["KOTA B", "KABUPATEN B"][i // 2 % 2], [f"4010{i % 5}", f"4020{i % 3}"]) for i in range(24)]
    addresses = list(itertools.product(["Desa Maju", "Kel. Maju", "maju", "Kota Maju", "Jaya", "Kel.", None], ["Kec. D0", "D1", "D9", None], ["Kota B", "B", "C", ""], ["Prov. Jawa", "Bali", None], ["40101", "40202", "99999", " "]))
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(addresses)], "address_id int, " + ", ".join(f"{f} string" for f in S.ADMIN_FIELDS))
    for r in A.validate(df, prepared(spark, villages)).collect():
        codes = [c.village_code for c in r.candidates]
        assert (r.status, r.affected_fields, codes, r.n_candidates) == (*plain(addresses[r.address_id], villages), len(codes)), addresses[r.address_id]


def test_lists_do_not_grow_with_a_name(spark):
    for n in (50, 400):
        found = prepared(spark, [(f"{i:04d}", ["DESA MAJU"], f"D{i % 3}", "KOTA B", [f"{40000 + i}"]) for i in range(n)])
        assert [(r.k, r.n) for r in found.names.select(F.size("chains").alias("k"), F.aggregate("chains", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")).collect()] == [(3, n)]
        assert found.postals.agg(F.max(F.size("villages")).alias("n")).first().n == 1


def test_no_filter_on_issues_is_moved_below_what_makes_them(spark):
    for name in ("gate_issues", "stage_counts", "normalization_changes_by_rule", "pii_entities"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "(size(" in line], name


def test_exact_lookup_meets_one_row(spark):
    """As the plain join, rows that share a key among them, and counts are joined instead of villages."""
    villages = [(f"{i:04d}", ["Maju", "Jaya"][i % 2], ["Maju Lama"] if i % 3 == 0 else None, ["D 0", "", None][i % 3], f"C{i % 4}", "Jawa") for i in range(40)]
    h = spark.createDataFrame(villages, "village_code string, village_name string, village_aliases array<string>, district_name string, city_name string, province_name string")
    asked = [(i, v, d, c, "") for i, (v, d, c) in enumerate(itertools.product(["maju", "MAJU lama", "nowhere", None], ["d 0", "", "d 9"], ["C1", None, "x"]))]
    asked += [(100, "maju", "", "C0", ""), (100, "maju lama", "", "", ""), (None, "jaya", "d 0", "c1", "JAWA")]
    got = A.exact_lookup(spark.createDataFrame(asked, "address_id int, KELURAHAN string, KECAMATAN string, KOTA_KABUPATEN string, PROVINSI string"), h)
    low = lambda x: (x or "").lower()
    want = {}
    for k, v, *upper in asked:
        hits = {c for c, n, al, *own in villages if low(v) in {low(n), *map(low, al or [])} and all(not a or low(a) == low(b) for a, b in zip(upper, own))}
        want[k] = want.get(k, set()) | hits
    assert {r.address_id: r.n_rows for r in got.collect()} == {k: len(v) for k, v in want.items()}
    assert {r.lookup_status for r in got.collect() if r.n_rows > 1} == {"ambiguous"}
    assert "_rows" in got._jdf.queryExecution().optimizedPlan().toString()
