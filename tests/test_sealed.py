"""Reviews and sealed runs: merges of components and corrections, and what a run must pass."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import address as A
from tapal.operators import review as V
from tapal.operators import sealed as D
from tests.test_address import hierarchy  # noqa: F401


def value(v, source="user_input", confirmed=False, previous=None, score=None):
    return (v, source, confirmed, score, None if previous is None else (previous,))


RESULT = "struct<value:string,source:string,confirmed:boolean,model_score:double,previous_value:struct<value:string>>"
SCHEMA = f"id long, components array<struct<field:string,result:{RESULT}>>, corrections array<struct<field:string,previous_value:struct<value:string,source:string>,proposed_value:struct<value:string>,decision:string,applied:boolean>>"


def fix(field, before, after, decision="requires_confirmation", applied=False):
    return (field, (before, "rule_extracted"), (after,), decision, applied)


def test_components_with_corrections(spark):
    rows = [
        (1, [("KELURAHAN", value("A")), ("KELURAHAN", value("B", confirmed=True)), ("RT", value("1", "confirmed_by_user")), ("RW", value("2", previous="3", score=0.5)), ("X", value("y", "odd", previous=""))],
         [fix("KELURAHAN", "a", "K1"), fix("KELURAHAN", "a", "K2"), fix("KOTA_KABUPATEN", "", "Kota Q"), fix("KOTA_KABUPATEN", "q", "Kota R"), fix("RT", "1", "9", applied=True), fix("RW", "2", "8", "deterministic"), fix("PROVINSI", "p", "P", applied=True)]),
        (2, None, [fix("KODEPOS", "1", "2")]), (3, [], None), (4, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: [tuple(c) for c in r.c] for r in df.select("id", V.components_with_corrections(df).alias("c")).collect()}
    assert got[1] == [
        ("KELURAHAN", "Kelurahan", "A", "a", "K1", "user", "suggested", None), ("KELURAHAN", "Kelurahan", "B", "a", "K1", "user", "suggested", None),
        ("RT", "RT", "1", None, None, "user", "confirmed", None), ("RW", "RW", "2", "3", None, "user", "user-edited", 0.5), ("X", "X", "y", "", None, "input", "original", None),
        ("KOTA_KABUPATEN", "Kota/Kabupaten", "", None, "Kota Q", "parser", "suggested", None), ("KOTA_KABUPATEN", "Kota/Kabupaten", "q", "q", "Kota R", "parser", "suggested", None),
    ]
    assert got[2] == [("KODEPOS", "Kode pos", "1", "1", "2", "parser", "suggested", None)] and got[3] == got[4] == []


def test_review_of_documents(spark, hierarchy):  # noqa: F811
    raw = spark.createDataFrame([(1, "Penerima: Budi, Jl. Mawar No. 5, Kel. Entah, HP 081234567890")], "address_id long, text string")
    out = V.review(A.document_body(A.process(raw, hierarchy))).head()
    assert out.status in ("TIDAK_VALID", "PERLU_KONFIRMASI") and not out.is_final and "081234567890" not in out.redacted_input
    assert out.issues[0].id.endswith("-0") and out.issues[0].title and {c.field for c in out.components} >= {"JALAN", "NOMOR", "KELURAHAN"}


def test_editable_text(spark):
    df = spark.createDataFrame([([("NOMOR", " 5 "), ("KODEPOS", "40111"), ("RT", "001"), ("RW", " "), ("NOMOR", "6")],), ([("JALAN", "Jl. A"), ("NOMOR", "7"), ("DETAIL_LOKASI", "x"), ("RW", "2")],), ([],)], "c array<struct<field:string,value:string>>")
    assert [r[0] for r in df.select(V.editable_text(F.col("c"))).collect()] == ["No. 5, RT 001, 40111", "Jl. A No. 7, RW 2, x", ""]


@pytest.fixture
def examples(spark):
    rows = [(f"e{i}", i + 1, ["Jl", "Mawar"], ["B-JALAN", "I-JALAN"]) for i in range(25)]
    df = spark.createDataFrame(rows, "base string, place long, tokens array<string>, labels array<string>")
    return df, df.select("base", "place", S.canonical_hash("base", "labels", "tokens").alias("sha256"))


def test_opened_only_if_all_agrees(spark, examples, monkeypatch):
    df, items = examples
    assert items.head().sha256 == hashlib.sha256(b'{"base":"e0","labels":["B-JALAN","I-JALAN"],"tokens":["Jl","Mawar"]}').hexdigest()
    whole = D.ordered_digest(items, [F.col("place")], "sha256")
    assert whole == hashlib.sha256("".join(r.sha256 for r in items.orderBy("place").collect()).encode()).hexdigest()
    good = {"full": whole, "boundary": whole}
    assert D.opened(df, items, items, "base", good, 1).count() == 25
    swapped = items.withColumn("place", F.when(F.col("base") == "e3", 5).when(F.col("base") == "e4", 4).otherwise(F.col("place")))
    other = items.withColumn("sha256", F.when(F.col("base") == "e9", F.lit("0")).otherwise(F.col("sha256")))
    for declared, digests, openings, why in ((items, good, 0, "opening"), (swapped, good, 1, "out_of_order"), (other, good, 1, "digest_differs"), (items.where("base <> 'e5'"), good, 1, "unlisted"), (items.union(items.limit(1)), good, 1, "repeated"), (items.union(spark.createDataFrame([("zz", 26, "0")])), good, 1, "missing"), (items, {"full": whole, "boundary": "0"}, 1, "boundary")):
        with pytest.raises(D.NotAllowed, match=why):
            D.opened(df, items, declared, "base", digests, openings)
    monkeypatch.setattr(D, "RANGE", 4)
    deep = D.ordered_digest(items, [F.col("place")], "sha256")
    level = [r.sha256 for r in items.orderBy("place").collect()]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    assert deep == level[0] and D.ordered_digest(items.limit(0), [F.col("place")], "sha256") == hashlib.sha256(b"").hexdigest()


def test_release_manifest(spark, tmp_path):
    for name, content in (("a.txt", b"one"), ("sub/b.bin", b"\x00\xff"), ("c.txt", b"three")):
        (tmp_path / "release" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "release" / name).write_bytes(content)
    files, declared = D.release_manifest(spark, str(tmp_path / "release"), {"model": "m-1", "gate": "g-2"})
    assert {(r.path, r.bytes, r.sha256) for r in files.collect()} == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in (("a.txt", b"one"), ("sub/b.bin", b"\x00\xff"), ("c.txt", b"three"))}
    frozen = spark.createDataFrame(files.collect())
    D.required(files=D.file_problems(files, frozen), versions=D.version_problems({"model": "m-1", "gate": "g-2"}, declared))
    (tmp_path / "release" / "a.txt").write_bytes(b"two")
    (tmp_path / "release" / "sub/b.bin").unlink()
    (tmp_path / "release" / "new").write_bytes(b"")
    now, _ = D.release_manifest(spark, str(tmp_path / "release"), {})
    assert {tuple(r) for r in D.file_problems(now, frozen).collect()} == {("a.txt", "sha256_differs"), ("sub/b.bin", "missing"), ("new", "unlisted")}
    assert {tuple(r) for r in D.version_problems({"model": "m-9", "extra": "1"}, declared).collect()} == {("model", "differs"), ("gate", "not_in_use"), ("extra", "undeclared")}
    with pytest.raises(D.NotAllowed, match="files"):
        D.required(files=D.file_problems(now, frozen))


def test_second_report_is_refused(spark, tmp_path):
    report = spark.createDataFrame([(1,)], "n int")
    D.published(report, f"{tmp_path}/report")
    with pytest.raises(D.NotAllowed, match="already"):
        D.published(report, f"{tmp_path}/report")


def test_slices_add_up(spark):
    rows = [(1, ["B-RT", "I-RT", "O"], ["B-RT", "O", "O"], "a"), (2, ["B-JALAN", "O"], ["B-JALAN", "B-RW"], "b"), (3, ["O"], ["I-RT"], None), (4, [], [], "b")]
    df = spark.createDataFrame(rows, "id long, gold array<string>, predicted array<string>, who string")
    out = D.slice_metrics(df, "gold", "predicted", "who")
    got = {(r.slice, r.name): r for r in out.collect()}
    assert len(got) == 1 + 3 + 10 and got["all", "all"].examples == 4 and got["all", "all"].exact == 4
    assert (got["all", "all"].tp, got["all", "all"].fp, got["all", "all"].fn) == (1, 2, 1) and got["who", "(null)"].tp == 0 and got["type", "RT"].f1 == 0.0
    for c in ("tp", "fp", "fn"):
        assert sum(r[c] for (s, _), r in got.items() if s == "type") == sum(r[c] for (s, _), r in got.items() if s == "who") == got["all", "all"][c]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Expand") == 2 and "CartesianProduct" not in plan


def test_boundary(spark):
    none = spark.createDataFrame([], "split string, base string")
    assert {tuple(r) for r in D.boundary_problems(none, "/x/real.json", "split", "base").collect()} == {(None, "no_examples")}
    good = spark.createDataFrame([("real_dev", "a"), ("real_dev", "b")], "split string, base string")
    assert D.boundary_problems(good, "/x/real.json", "split", "base").collect() == []
