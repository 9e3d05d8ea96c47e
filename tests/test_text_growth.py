"""What is computed for each text: no search through thousands of characters, and no word looked at twice."""

import unicodedata

from tapal.functions import scalar as S
from tapal.functions import text_udfs as T
from tapal.operators import address as A


def test_characters_are_looked_up(spark):
    """Names with marks are told by a table, not by a pattern of all characters, and fold as before."""
    some = sorted(S._MANY)[::40]
    df = spark.createDataFrame([(i, f"{c} É a") for i, c in enumerate(some)], "i int, v string").select("i", S.normalize_hierarchy("v").alias("x"))
    plain = lambda c: " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in unicodedata.normalize("NFKD", f"{c} É a") if not unicodedata.combining(x)).lower().split())
    assert {r.i: r.x for r in df.collect()} == {i: plain(c) for i, c in enumerate(some)}
    assert "RLIKE([" not in df._jdf.queryExecution().optimizedPlan().toString().replace("\\", "").upper().replace("RLIKE(^[", "")


def test_tokens_are_looked_at_once():
    T.looks.cache_clear()
    assert [T.tag("Jl. Mawar No. 5 , RT 03 40111".split()) for _ in range(3)][2] == ["B-JALAN", "I-JALAN", "B-NOMOR", "I-NOMOR", "O", "B-RT", "I-RT", "B-KODEPOS"]
    assert T.looks.cache_info().misses == 8 and T.looks.cache_info().hits == 16


def test_no_arrays_go_to_python_for_composition(spark):
    """An array takes Arrow several times as long as a text, also where it is null."""
    raw = [(1, "Jl. Mawar No. 5, RT 03, Kel. Ｍａｊｕ é, 40111"), (2, None), (3, ""), (4, "Kel. Satu, Kel. Dua Tiga, Kec."), (5, 'Jl. "A\\B" №7')]
    found = A.normalize(A.decode(A.tag(spark.createDataFrame(raw, "i int, t string"), "t")))
    plan = found._jdf.queryExecution().optimizedPlan()
    calls, nodes = [], [plan]
    while nodes:
        at = nodes.pop()
        nodes += [at.children().apply(k) for k in range(at.children().size())]
        if at.nodeName() == "ArrowEvalPython":
            calls += [at.udfs().apply(k) for k in range(at.udfs().size())]
    assert [u.name() for u in calls].count("compose_fields") == 1
    for u in (u for u in calls if u.name() == "compose_fields"):
        assert {u.dataType().simpleString(), *[u.children().apply(k).dataType().simpleString() for k in range(u.children().size())]} == {"string"}
    rows = {r.i: r for r in found.collect()}
    assert rows[1].KELURAHAN == "Kelurahan Maju É" and rows[1].KODEPOS == "40111" and rows[1].labels[:2] == ["B-JALAN", "I-JALAN"]
    assert rows[2].labels == rows[3].labels == [] and rows[2].KELURAHAN is None
    assert rows[4].KELURAHAN == "Kelurahan Satu" and rows[4].KECAMATAN == "Kecamatan" and rows[5].JALAN.startswith('Jalan "A\\B"') and "No" in rows[5].JALAN
