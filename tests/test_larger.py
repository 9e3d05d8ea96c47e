"""Steps whose work or whose number of tasks grew worse than their input, and that their results stay the same."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapal.plans import inputs as I
from tapal.plans import more, registry
from tapal.sources import osm_pbf as O

SF = "/root/testdata/sf0.001"


def test_document_is_parsed_once_for_its_summary(spark):
    docs = ['{"quality_gate":{"status":"S","issues":[{"reason_code":"R","x":1},{"reason_code":"Q"}]},"normalized_address":{"value":"é \\"n\\""},"components":[{"field":"RT"},{"field":"RW"}],"audit_trail":[{"action":"a"},{"action":"b"},{"action":"c"}]}', '{"quality_gate":{"status":"S","issues":[]},"components":[],"audit_trail":[]}', "{}", None]
    df = spark.createDataFrame(list(enumerate(docs)), "address_id int, document string")
    out = more.summary(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan
    size = lambda p: F.json_array_length(F.get_json_object("document", p)).cast("long")
    get = lambda p: F.get_json_object("document", p)
    paths = df.select("address_id", get("$.quality_gate.status"), get("$.quality_gate.issues[0].reason_code"), get("$.normalized_address.value"), get("$.audit_trail[0].action"), size("$.components"), size("$.audit_trail"))
    assert sorted(map(tuple, out.drop("document").collect())) == sorted(map(tuple, paths.collect()))


@pytest.mark.parametrize("name", ["search_results", "varied_addresses", "noise_counts", "crosscheck_table", "crosscheck_problems", "pii_views", "annotated_addresses"])
def test_rows_are_dealt_out(spark, name):
    """One small file is no one task's work."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "RoundRobin" not in plan


def test_objects_are_parsed_once(spark):
    for name in ("crosscheck_table", "crosscheck_problems"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, name


def test_more_tasks_for_larger_tables(spark, tmp_path):
    ids = spark.range(100000).select(F.col("id").alias("k"))
    ids.repartition(6).write.parquet(f"{tmp_path}/orders.parquet")
    cores = spark.sparkContext.defaultParallelism
    many = I.dealt(spark.read.parquet(f"{tmp_path}/orders.parquet"), str(tmp_path), "orders", "k")
    assert many.rdd.getNumPartitions() >= min(4, spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions()) * cores
    assert sorted(r.k for r in many.collect()) == list(range(100000))


def test_ways_are_coded_in_blocks(monkeypatch):
    """The same bytes and the same rows as one way at a time, odd ones too, and no unpacking for each way."""
    rng = random.Random(3)
    rows = [{"id": rng.randrange(1 << rng.randrange(1, 62)), "node_ids": [rng.randrange(-(1 << 40), 1 << 62) for _ in range(rng.choice([0, 1, 3, 300]))], "tags": rng.choice([None, [], [("highway", "é" * rng.randrange(200)), ("name", None)], [(f"k{k}", f"v{rng.randrange(400)}") for k in range(40)]])} for _ in range(300)]
    schema = pa.schema([("id", pa.int64()), ("node_ids", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    assert O.encode_ways(batch) == O.encode_block(batch.to_pylist(), "ways") and O.encode_ways(batch.slice(7, 90)) == O.encode_block(batch.slice(7, 90).to_pylist(), "ways")
    calls, real = [], O.packed
    monkeypatch.setattr(O, "packed", lambda data: calls.append(1) or real(data))
    found = O.decode_block(O.encode_ways(batch))[1]
    assert len(calls) < 20
    assert found == [(r["id"], r["node_ids"], [(k, v or "") for k, v in r["tags"] or []]) for r in rows]
    way = lambda *parts: O.field_of(3, b"".join(parts))
    strings = O.field_of(1, b"".join(O.field_of(1, x) for x in (b"", b"a", b"b", b"a")))
    odd = way(O.field_of(1, 7), O.field_of(2, b"\1\2\3"), O.field_of(3, b"\2\1\2"), O.field_of(4, b"info")) + way(O.field_of(2, b"\1\2"), O.field_of(1, 8), O.field_of(3, b"\2"), O.field_of(8, b"\4"))
    assert O.decode_block(strings + O.field_of(2, odd))[1] == [(7, [], [("a", "b"), ("b", "a")]), (8, [2], [("a", "b")])]
    for broken in (way(O.field_of(1, 1), O.field_of(8, b"\x80")) + way(O.field_of(1, 2), O.field_of(8, b"\2")), way(O.field_of(8, b"\2")), way(O.field_of(1, 1), b"\x42\5\1")):
        with pytest.raises(ValueError):
            O.decode_block(O.field_of(2, broken))


def test_annotator_makes_the_fields_once(spark):
    """The step that gives each segment its field is not put into the loop over the tokens."""
    plan = registry.QUERIES["annotated_addresses"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    final = next(line for line in plan.splitlines() if " AS labels#" in line)
    assert "DETAIL_LOKASI" in plan and "DETAIL_LOKASI" not in final
