import pytest
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.functions.text_udfs import fold, tag
from tapal.operators import address as A


def one(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_normalizer_vectors(spark):
    cases = [
        ("JALAN", "  jl. asia   afrika ", "Jalan Asia Afrika"), ("NOMOR", "nomor 7A", "No. 7A"), ("RT", "rt. 1", "RT 001"), ("RW", "RW 02", "RW 002"),
        ("KELURAHAN", "kel. braga", "Kelurahan Braga"), ("KECAMATAN", "kec sumur bandung", "Kecamatan Sumur Bandung"), ("KOTA_KABUPATEN", "kota bandung", "Kota Bandung"),
        ("PROVINSI", "prov. jawa barat", "Provinsi Jawa Barat"), ("JALAN", "gg melati", "Gang Melati"), ("KELURAHAN", "ds sukajadi", "Desa Sukajadi"), ("KODEPOS", " 40 111 ", "40111"),
        ("DETAIL_LOKASI", "jalan veteran ii dan sekitarnya", "Jalan Veteran II dan Sekitarnya"), ("RT", "RT A", "RT A"), ("RW", "RW 1/2", "RW 1/2"), ("KODEPOS", "4011A", "4011A"), ("NOMOR", "7-9", "7-9"), ("JALAN", "   ", ""),
    ]
    rows = [tuple(i if f == "i" else (v if f == field else None) for f in ["i", *S.FIELDS]) for i, (field, v, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{f} string" for f in S.FIELDS))
    once = A.normalize(df)
    got = {r.i: r for r in once.collect()}
    for i, (field, _, expected) in enumerate(cases):
        assert got[i][field] == expected
    assert len(got[10].changes) == 2
    assert [len(got[i].changes) for i in (12, 13, 14, 15)] == [0, 0, 0, 0]
    again = {r.i: r for r in A.normalize(once.drop("changes", *[f"{f}_source" for f in S.FIELDS])).collect()}
    assert all(again[i][f] == got[i][f] for i in got for f in S.FIELDS)


@pytest.fixture(scope="module")
def hierarchy(spark):
    rows = [
        ("32.73.05.1002", "BRAGA", ["BRAGA KULON"], "SUMUR BANDUNG", "KOTA BANDUNG", ["40111"]),
        ("32.73.05.1003", "SUKAMAJU", [], "SUMUR BANDUNG", "KOTA BANDUNG", ["40111"]),
        ("32.73.09.1001", "SUKAMAJU", ["SUKA MAJU"], "CIBEUNYING KIDUL", "KOTA BANDUNG", ["40122"]),
    ]
    df = spark.createDataFrame(rows, "village_code string, village_name string, village_aliases array<string>, district_name string, city_name string, postal_codes array<string>")
    df = df.withColumn("province_name", F.lit("JAWA BARAT"))
    for level in ("district", "city", "province"):
        df = df.withColumn(f"{level}_aliases", F.array().cast("array<string>"))
    return A.lookup(df)


def test_validator_vectors(spark, hierarchy):
    full = ("Kel. Braga", "Kec. Sumur Bandung", "Kota Bandung", "Prov. Jawa Barat", "40111")
    cases = [
        (full, "valid", [], 1), (("Kel. Braga Kulon", full[1], "Bandung", full[3], full[4]), "valid", [], 1), ((full[0], full[1], "Kabupaten Bandung", full[3], full[4]), "invalid", ["KOTA_KABUPATEN"], 1),
        ((*full[:4], "40112"), "invalid", ["KODEPOS"], 1), (("Kel. Nowhere", *full[1:]), "not_found", [], 0), (("Braga", None, None, None, None), "incomplete", [], 1),
        ((None, full[1], None, None, None), "incomplete", [], 0), ((*full[:4], "   "), "incomplete", [], 1), (("Sukamaju", None, None, None, None), "ambiguous", [], 2),
        (("Sukamaju", "Sumur Bandung", None, None, None), "incomplete", [], 1), (("Sukamaju", "Sumur Bandung", "Kota Bandung", "Jawa Barat", "40122"), "invalid", ["KECAMATAN", "KODEPOS"], 2), (("Kel.", *full[1:]), "not_found", [], 0),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "address_id int, " + ", ".join(f"{f} string" for f in S.ADMIN_FIELDS))
    got = {r.address_id: r for r in A.gate(A.validate(df, hierarchy)).collect()}
    for i, (_, status, affected, n) in enumerate(cases):
        assert (got[i].status, got[i].affected_fields, len(got[i].candidates)) == (status, affected, n), i
    assert got[0].gate_status == "SIAP_DIPROSES" and got[3].issues[0].reason_code == "KODEPOS_TIDAK_COCOK" and got[3].gate_status == "TIDAK_VALID"
    assert all(x.clarification_question.endswith("?") for r in got.values() for x in r.issues)


def test_end_to_end(spark, hierarchy):
    ready = "Jl. Asia Afrika No. 1, Kel. Braga, Kec. Sumur Bandung, Kota Bandung, Jawa Barat 40111"
    texts = [ready, ready.replace("40111", "99999"), "Jl. Merdeka No. 10, Kel. Braga", ready.replace("Braga", "Nowhere"), f"Penerima: Budi Santoso 081234567890, {ready}", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "address_id int, text string")
    out = A.process(df, hierarchy)
    got = {r.address_id: r for r in out.collect()}
    assert [got[i].gate_status for i in range(5)] == ["SIAP_DIPROSES", "TIDAK_VALID", "PERLU_KONFIRMASI", "PERLU_KONFIRMASI", "SIAP_DIPROSES"]
    assert got[4].pii_codes == ["PII_DETECTED"] and "[PHONE_REDACTED]" in got[4].redacted_text and "Budi" not in got[4].redacted_text
    assert got[5].gate_status == got[6].gate_status == "PERLU_KONFIRMASI"
    documents = A.document(out).collect()
    assert len(documents) == 7 and all('"audit_trail":[{"sequence":1,"stage":"pii"' in r.document for r in documents)


def test_pii_vectors(spark):
    cases = [
        ("Penerima: Ibu Siti Aminah, Jl. Mawar No. 7", "Jl. Mawar No. 7"), ("Nama Penerima: Budi Santoso Jalan Merdeka 5", "Jalan Merdeka 5"), ("Penerima: 12345, Jalan Mawar 7", "Penerima: 12345, Jalan Mawar 7"),
        ("Budi Santoso, Jl. Mawar", "Budi Santoso, Jl. Mawar"), ("0812000", "0812000"), ("08120000000000", "08120000000000"), ("NPSN: 081234567890", "NPSN: 081234567890"), ("Jl. Melati No. 12, Bandung 40111", "Jl. Melati No. 12, Bandung 40111"),
        ("Koordinat -6.9175, 107.6191", "Koordinat -6.9175, 107.6191"), ("Jl. A HP: 0812-3456-7890", "Jl. A"), ("Telp (022) 4231234 Jl. B", "Jl. B"), ("kode pesanan hp 081234567890 x", "kode pesanan x"),
    ]
    rows = {r.i: r.address_text for r in A.redact(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")).collect()}
    for i, (_, expected) in enumerate(cases):
        assert rows[i] == expected, i


def test_tokenizer(spark):
    texts = ["RT 03/RW 07", "Sukamulya, Kec Cikembar", "Bandung,,", "Jl. Asia Afrika No. 12", "", "   "]
    assert one(spark, texts, S.tokens) == [["RT", "03", "/", "RW", "07"], ["Sukamulya", ",", "Kec", "Cikembar"], ["Bandung", ",", ","], ["Jl.", "Asia", "Afrika", "No.", "12"], [], []]


def test_tagger():
    assert tag("Jl. Mawar RT04 RW09".split()) == ["B-JALAN", "I-JALAN", "B-RT", "B-RW"]
    assert tag(["RT", ".02"]) == ["B-RT", "I-RT"]
    assert tag(["RT", "03", "/", "RW", "07", "Kec.", "X"]) == ["B-RT", "I-RT", "B-JALAN", "B-RW", "I-RW", "B-KECAMATAN", "I-KECAMATAN"]
    assert tag(["Kelapa"]) == ["B-KELURAHAN"]


def test_names(spark):
    assert one(spark, ["É-a", "Kab. BOGOR"], S.normalize_hierarchy) == ["e a", "kab bogor"]
    assert one(spark, ["É-a"], S.normalize_workbook) == ["a"]
    assert one(spark, ["  A-b  C "], S.normalize_pos) == ["a-b c"]
    assert one(spark, ["40111.0", "00000", "4011", None], S.clean_postal) == ["40111", "", "", ""]
    assert one(spark, ["3273051002", "32.73", None], S.village_code) == ["32.73.05.1002", "", ""]
    assert one(spark, ["o'brien rt.1 ii di"], S.smart_title) == ["O'Brien Rt.1 II DI"]
    assert fold("ß É") == "ss e" or fold("ß É") == "e"


def test_stage_counts(spark, hierarchy):
    """Each address is counted once before, once after normalization and once by the gate; changes are counted by rule."""
    rows = [(1, "kel. braga", "kec. sumur bandung", "kota bandung", "jawa barat", "40 111"), (2, "Kelurahan Braga", "Kecamatan Sumur Bandung", "Kota Bandung", "Jawa Barat", "40111"), (3, "Entah", None, None, None, None)]
    df = spark.createDataFrame(rows, "address_id long, KELURAHAN string, KECAMATAN string, KOTA_KABUPATEN string, PROVINSI string, KODEPOS string")
    got = {(r.stage, r.kind, r.name): r.n for r in A.stage_counts(df, hierarchy).collect()}
    assert got["extracted", "status", "valid"] == 1 and got["normalized", "status", "valid"] == 2 and got["normalizer", "addresses", "changed"] == 1
    assert got["normalizer", "rule", "postcode_spacing_v1"] == 1 and got["normalizer", "rule", "designator_dictionary_v1"] >= 2
    for stage in ("extracted", "normalized"):
        assert sum(n for (s, k, _), n in got.items() if s == stage and k == "status") == 3
    assert sum(n for (s, _, _), n in got.items() if s == "gate") == 3
