"""Documents that are plainly right are told without the long check, and what is found does not depend on it."""

import json

from pyspark.sql import functions as F

from tapal.operators import contract as C
from tapal.plans import registry

SF = "/root/testdata/sf0.001"


def test_sound_documents_are_told_fast(spark, monkeypatch):
    good = [r.document for r in registry.QUERIES["address_documents"](spark, SF).limit(4).collect()]
    bad = []
    for text in good[:2]:
        compact = lambda d: json.dumps(d, separators=(",", ":"), ensure_ascii=False)
        for path, value in (("request_id", "x"), ("schema_version", None), ("versions.model", ""), ("versions", None), ("components.0.result.model_score", 0.5), ("components.0.result.source", "nobody"), ("components.0.result.value", 5), ("audit_trail.0.sequence", 0), ("audit_trail.0.sequence", 1.5), ("pii.entities", [{"type": "PHONE", "start": -1, "end": 2, "redacted_value": "x"}]), ("quality_gate.rules.precedence", []), ("components", [None]), ("geocoding.consent", "true"), ("geocoding.latitude", {"value": 1.5, "source": "user_input"}), ("pii.warnings", [None]), ("more", 1)):
            d = json.loads(text)
            at, *rest = path.split(".")
            node = d
            for step in rest:
                node, at = node[int(at) if at.isdigit() else at], step
            node[int(at) if at.isdigit() else at] = value
            bad.append(compact(d))
        d = json.loads(text)
        bad += [compact({k: v for k, v in d.items() if k != "pii"}), json.dumps(d), text.replace('"corrections":', '"corrections":[],"corrections":'), compact({**d, "document_type": "api_error"}), text[:-1]]
    df = spark.createDataFrame(list(enumerate([*good, *bad, None, "", '{"document_type":"address_parse_request","schema_version":"1.0.0","request_id":"req_00000001","input":{"address_text":"a","geocoding_consent":false}}'])), "address_id int, document string")
    told = {r.address_id for r in df.select("address_id", C.sound(C.SCHEMA, F.col("document")).alias("s")).collect() if r.s}
    assert told == {*range(len(good)), len(good) + len(bad) + 2}
    fast = sorted(C.violations(df).collect())
    monkeypatch.setattr(C, "sound", lambda schema, raw: F.lit(False))
    assert fast == sorted(C.violations(df).collect())
    assert len({r.address_id for r in fast}) >= len(bad) - 4
