"""What a document costs on its way: narrow rows between tasks, one call to Python, and nothing dear inside a lambda."""

import random
import re

from tapal.functions import scalar as S
from tapal.operators import address as A
from tapal.operators import pii as P
from tapal.plans import registry

SF = "/root/testdata/sf0.001"


def nodes(plan):
    out = [plan]
    for k in range(plan.children().size()):
        out += nodes(plan.children().apply(k))
    return out


def test_only_narrow_rows_travel(spark):
    """Sentences, entities, changes and their sources are made after the joins."""
    plan = registry.QUERIES["address_documents"](spark, SF)._jdf.queryExecution().optimizedPlan()
    for at in nodes(plan):
        if at.nodeName() == "Join":
            names = {re.sub(r"#.*", "", at.output().apply(k).toString()) for k in range(at.output().size())}
            assert not names & {"text", "tokens", "labels", "changes", "redacted_text", "pii_entities", "JALAN_source"}
    assert [x.nodeName() for x in nodes(plan)].count("ArrowEvalPython") == 1


def test_fields_in_one_call(spark):
    """As by tokens and labels."""
    rng = random.Random(3)
    bits = ["Jl. Mawar", "No. 5", "RT 03", "rt.3/rw.4", "Kel. W1", "Kel. é", "Kec.", "Kota B", "Prov. Jawa Barat", "jabar", "40111", ",", ";", "/", ":", "\t", "\x1c", "\x85", "　", "​", "-", "😀", "x"]
    texts = ["", " ", None] + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, address_text string")
    want = {r.i: [r[f] for f in S.FIELDS] for r in A.decode(A.tag(df)).collect()}
    got = A.extract(df).collect()
    assert {r.i: [r[f"x_{f}"] for f in S.FIELDS] for r in got} == want
    assert all((r["_json"] is None) == all(x is None or x.isascii() for x in want[r.i]) for r in got)


def test_what_is_shown_comes_from_marks_alone(spark):
    df = spark.createDataFrame([("Penerima: Budi, hp 0812-3456-7890, Jl. A",), (None,), ("Jl. B",)], "text string")
    apart = P.shown(P.cleaned(P.marked(df)).drop("text")).drop("_marked", "_named")
    assert apart.collect() == P.redact(df).select(*apart.columns).collect()


def test_documents_are_not_made_inside_a_lambda(spark):
    plan = registry.QUERIES["document_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json(" in plan and "transform(array(from_json(" not in plan
