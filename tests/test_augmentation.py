"""Examples that are made: balance, labels, determinism and what is left out."""

import collections

import pytest
from pyspark.sql import functions as F

from tapal.operators import augmentation as G
from tapal.operators import evaluation as E


@pytest.fixture(scope="module")
def chains(spark):
    rows = [(f"32.01.{i:02d}.2001", f"DESA {i}", f"KECAMATAN LAMA {i}", ["KAB. BANDUNG BARAT", "KOTA BOGOR", "CIMAHI"][i % 3], "JAWA BARAT", f"40{i:03d}") for i in range(9)]
    return spark.createDataFrame(rows, "village_code string, village_name string, district_name string, city_name string, province_name string, postal_code string")


def test_targeted(spark, chains):
    got = G.targeted(chains, 83, 5).withColumn("bio", E.is_bio(F.col("labels"))).collect()
    assert sorted(collections.Counter(r.pattern for r in got).values()) == [10] * 5 + [11] * 3
    again = G.targeted(chains.repartition(3), 83, 5).collect()
    assert {r.id: r.tokens for r in again} == {r.id: r.tokens for r in got}
    assert {r.id: r.tokens for r in G.targeted(chains, 83, 6).collect()} != {r.id: r.tokens for r in got}
    for r in got:
        assert r.bio and len(r.tokens) == len(r.labels) and r.id.startswith("TGT-") and {"sparse_address", r.pattern} <= set(r.categories) and r.categories == sorted(r.categories)
        fields = {x[2:] for x in r.labels if x != "O"}
        assert not fields & {"KELURAHAN", "KODEPOS", "PROVINSI"} and ("KOTA_KABUPATEN" in fields) == (r.pattern != "district_only")
    assert {"case_lower", "case_upper"} <= {c for r in got for c in r.categories}


def test_no_chains(spark, chains):
    with pytest.raises(ValueError, match="chains"):
        G.targeted(chains.limit(0), 8, 1)


def test_misspelled(spark):
    df = spark.createDataFrame([(i, x) for i in range(60) for x in ("Kec Cibeunying Kidul", "abc de", "Bandung")], "id long, x string")
    for r in df.select("x", G.misspelled(F.col("x"), 1, "t", "id").alias("y")).collect():
        a, b = r.x.split(), r.y.split()
        changed = [(p, q) for p, q in zip(a, b) if p != q]
        assert len(a) == len(b) and len(changed) <= 1 and (r.x != "abc de" or not changed)
        for p, q in changed:
            assert len(p) >= 5 and q[0] == p[0] and (len(q) == len(p) - 1 or sorted(p) == sorted(q))


def test_varied(spark, chains):
    bases = chains.selectExpr("monotonically_increasing_id() as base_id", "*", "'Mawar' as street", "'5' as number", "'01' as rt", "'02' as rw", "'dekat Pasar' as place", "cast(null as string) as detail")
    got = G.varied(bases, 40, 3).withColumn("bio", E.is_bio(F.col("labels"))).collect()
    assert len(got) == 360 and all(r.bio and len(r.tokens) == len(r.labels) for r in got) and {r.order_number for r in got} == set(range(8))
    for r in got:
        first = [x[2:] for x in r.labels if x.startswith("B-")]
        expected = [f for s in G.ORDERS[r.order_number] for f in {"RT_RW": ["RT", "RW"], "LANDMARK": ["DETAIL_LOKASI"], "DETAIL": [], "KOTA": ["KOTA_KABUPATEN"], "PROVINSI": [] if "missing_provinsi" in r.categories else ["PROVINSI"], "KODEPOS": [] if "missing_kodepos" in r.categories else ["KODEPOS"]}.get(s, [s])]
        has = [f for f in expected if f in first or f not in ("PROVINSI", "KODEPOS")]
        assert first == [f for f in has if f in first] and ("separator" in r.categories) == ("," in r.tokens)


def test_joined_and_tasks(spark, chains):
    a = G.targeted(chains, 8, 1)
    with pytest.raises(ValueError, match="both"):
        G.joined(a, a)
    b = G.joined(a, G.targeted(chains, 8, 1, first=100).withColumn("more", F.lit(1)))
    assert b.groupBy("origin").count().count() == 2 and b.count() == 16 and b.where("origin = 'training' and more is not null").count() == 0
    tasks = {r.task_id: r for r in G.study_tasks(a).collect()}
    for r in a.collect():
        t = tasks[r.id]
        assert set(t.expected_defects) == set(r.categories) & set(G.SCORED_DEFECTS) and t.defect_count == len(t.expected_defects)
        assert t.components["JALAN"] == " ".join(x for x, l in zip(r.tokens, r.labels) if l.endswith("-JALAN")) and " ," not in t.address_text


def test_bases_feed_variants(spark, chains):
    """Addresses made from chains go through the variants; every kind of part occurs, and a wrong postal code differs in two digits at most."""
    found = G.bases(chains, 600, 4).collect()
    assert len({r.base_id for r in found}) == 600 and {r.village_code for r in found} == {r.village_code for r in chains.collect()}
    assert any(r.rt is None for r in found) and all((r.rt is None) == (r.rw is None) for r in found) and any(r.place and "Masjid" in r.place for r in found) and any(r.detail and "Tower" in r.detail for r in found)
    assert not any("{" in (r.detail or "") for r in found)
    codes = {r.village_code: r.postal_code for r in chains.collect()}
    for r in found:
        assert r.admin_conflict == (r.postal_code != codes[r.village_code]) and r.postal_code[:3] == codes[r.village_code][:3] and len(r.postal_code) == 5
    out = G.varied(G.bases(chains, 50, 4), 3, 4).withColumn("bio", E.is_bio(F.col("labels")))
    assert out.count() == 150 and out.where("not bio").count() == 0
