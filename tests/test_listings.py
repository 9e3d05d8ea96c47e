"""Files, documents, tables by code, spans of components, and functions that no query calls."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import annotation as N
from tapal.operators import contract as C
from tapal.operators import evaluation as E
from tapal.operators import exceptions as X
from tapal.operators import files as L
from tapal.operators import governance as G
from tapal.operators import ranking as R
from tapal.operators import sinks, synthetic
from tapal.sources import documents as D
from tapal.streaming import gate
from tests.test_address import hierarchy  # noqa: F401


def test_only_scannable_files_are_opened(spark, tmp_path):
    root = tmp_path / "tree"
    content = {"src/a.py": b"x = 1", "src/node_modules/b.py": b"y", "img/c.PNG": b"\x89", "src/.hidden": b"h", "big.txt": b"z" * 300, "raw/secret.txt": b"api_key = 'abcdefgh'", "bad.txt": b"\xff\xfe token='abcdefgh'"}
    for name, data in content.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    df = L.read_scannable(spark, str(root), 200)
    got = {r.path: r.text for r in df.where(F.expr("is_valid_utf8(text)")).collect()}
    assert got == {"src/a.py": "x = 1", "raw/secret.txt": "api_key = 'abcdefgh'"} and df.count() == 3  # Spark's listing leaves out names that begin with a full stop
    assert _scan_metric(df, "numFiles") == 3
    problems = {tuple(r) for r in L.policy_problems(df, ["src", "docs"]).collect()}
    assert problems == {("raw/secret.txt", "forbidden_location"), ("raw/secret.txt", "possible_secret"), ("docs", "missing")}


def _scan_metric(df, name):
    """A number of the only scan of a query, after it ran."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    leaves = query.executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().get(name).get().value()


def test_document(spark, tmp_path):
    rows = [(f"32.01.{i // 50:02d}.{i:04d}", f'Desa "{i}" ü', None if i % 3 else "40111") for i in range(230)]
    df = spark.createDataFrame(rows, "village_code string, village_name string, postal_code string").repartition(5)
    none = spark.createDataFrame([], "exception_id string, note string")
    for k, exceptions in enumerate((none, spark.createDataFrame([("e2", "x"), ("e1", None)], "exception_id string, note string"))):
        lines = L.document_lines(df, exceptions, {"by": "us", "at": 'a "day"'}, ["village_code"], ["exception_id"])
        path = f"{tmp_path}/doc{k}"
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        L.write_document(lines, path)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts = sorted(p for p in (tmp_path / f"doc{k}").iterdir() if p.name.startswith("part-"))
        document = json.loads("".join(p.read_text() for p in parts))
        assert len(parts) > 1 and document["schema_version"] == L.DOCUMENT_VERSION and document["build"] == {"by": "us", "at": 'a "day"'}
        assert [(r["village_code"], r["village_name"], r["postal_code"]) for r in document["rows"]] == sorted(rows)
        assert [r["exception_id"] for r in document["exceptions"]] == (["e1", "e2"] if k else [])
        back, found = L.read_document(spark, path, "village_code string, village_name string, postal_code string", "exception_id string, note string")
        assert {tuple(r) for r in back.collect()} == set(rows) and found.count() == 2 * k
    with pytest.raises(ValueError, match="empty"):
        L.document_lines(df.limit(0), none, {}, ["village_code"], ["exception_id"])
    spark.createDataFrame([('{"schema_version":"9","build":{},"rows":[',), ("]}",)], "v string").coalesce(1).write.text(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="version 9"):
        L.read_document(spark, f"{tmp_path}/other", "village_code string")


def test_lookup_reads_one_bucket(spark, tmp_path):
    df = spark.createDataFrame([(f"32.01.01.{i:04d}", f"Desa {i}") for i in range(200)], "village_code string, village_name string")
    L.write_by_code(df, "villages_test", f"{tmp_path}/by_code")
    try:
        table = spark.table("villages_test")
        found = L.by_code(table, "3201010042")
        assert [r.village_name for r in found.collect()] == ["Desa 42"] and _scan_metric(found, "numOutputRows") < 50 < _scan_metric(table, "numOutputRows")
        assert L.by_code(table, "32.01.01.9999").count() == L.by_code(table, "32-01").count() == 0
    finally:
        spark.sql("DROP TABLE villages_test")


def slow_spans(tokens, components):
    form = lambda x: " ".join(__import__("re").sub("[.,;:/]+", " ", x.lower()).split())
    taken, out = [False] * len(tokens), []
    for label, value in components:
        hit = next(((a, b) for a in range(len(tokens)) for b in range(a + 1, len(tokens) + 1) if form(value) and not any(taken[a:b]) and form(" ".join(tokens[a:b])) == form(value)), None)
        if hit:
            taken[hit[0] : hit[1]] = [True] * (hit[1] - hit[0])
            out.append((label, *hit))
    return out


def test_component_spans(spark):
    rng = random.Random(4)
    words = ["Kota", "kota", "Kotabaru", "Jl.", "a/b", "B", ".", ",", "-", "x+(y", "[z]", "\\d", "ü"]
    rows = [([rng.choice(words) for _ in range(rng.randrange(8))], [(f"l{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(5)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "t array<string>, c array<struct<label:string,value:string>>")
    for (tokens, components), r in zip(rows, df.select(N.component_spans("t", "c").alias("s"), N.component_span("t", F.col("c")[0]["value"]).alias("one")).collect()):
        assert [tuple(x) for x in r.s] == slow_spans(tokens, components), (tokens, components)
        assert (r.one and tuple(r.one)) == next((x[1:] for x in slow_spans(tokens, components[:1])), None)


def test_ranks_by_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.choice([rng.random() * 100, 5.0])) for _ in range(2000)] + [("d", 1.5), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for by in (["g"], []):
        got = {tuple(r[c] for c in by): (r.n, r.p50, r.p95, r.p99) for r in E.nearest_rank(df, "v", by).collect()}
        groups = {}
        for g, v in rows:
            if v is not None:
                groups.setdefault((g,) if by else (), []).append(v)
        assert got == {k: (len(v), *[sorted(v)[-(-p * len(v) // 100) - 1] for p in (50, 95, 99)]) for k, v in groups.items()}
    sums = R.cumulated(spark.range(100).withColumn("w", F.col("id") % 7), [F.desc("id")], "w").collect()
    assert {r.id: r.upto for r in sums} == {i: sum(j % 7 for j in range(i, 100)) for i in range(100)}


def test_csv_separators(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("code;name, of it\n1;A, b\n2;C, d, e\n")
    (folder / "b.csv").write_text('code,"name, of it"\n3,"x;y;z"\n')
    got = D.read_csv(spark, str(folder), ["code"])
    assert {(r["code"], r["name, of it"]) for r in got.collect()} == {("1", "A, b"), ("2", "C, d, e"), ("3", "x;y;z")}
    assert D.separator_of(["a;b,c,d", "1;2", "3;4"]) == ";" and D.separator_of([]) == "," and D.separator_of(["a\tb"]) == "\t"
    (tmp_path / "none.csv").write_text("code,name\n")
    with pytest.raises(ValueError, match="no rows"):
        D.read_csv(spark, str(tmp_path / "none.csv"), ["code"])
    (tmp_path / "blank.csv").write_text("code,name\n1,\n")
    with pytest.raises(ValueError, match="name has blank"):
        D.read_csv(spark, str(tmp_path / "blank.csv"), ["code"], filled=["code", "name"])


def test_json_documents(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"schema_version": "1.0.0", "rows": [{"a": "x"}, {"a": "y"}]}))
    (tmp_path / "bare.json").write_text(json.dumps([{"a": "x"}, {"a": "y"}]))
    assert D.read_document(spark, str(tmp_path / "doc.json"), "rows", "a string", "1.0.0").count() == D.read_document(spark, str(tmp_path / "bare.json"), None, "a string").count() == 2
    with pytest.raises(ValueError, match="version 1.0.0"):
        D.read_document(spark, str(tmp_path / "doc.json"), "rows", "a string", "2.0.0")
    (tmp_path / "labels.json").write_text(json.dumps({"labels": S.LABELS}))
    (tmp_path / "turned.json").write_text(json.dumps({"labels": S.LABELS[::-1]}))
    assert D.read_labels(spark, str(tmp_path / "labels.json")) == S.LABELS
    with pytest.raises(ValueError, match="order"):
        D.read_labels(spark, str(tmp_path / "turned.json"))


def test_splits(spark, tmp_path):
    examples = spark.createDataFrame([("e1", "train"), ("e2", "train"), ("e3", "val")], "id string, split string")
    sinks.write_splits(examples, f"{tmp_path}/splits")
    paths = {n: f"{tmp_path}/splits/split={n}" for n in ("train", "val")}
    assert {tuple(r) for r in D.read_splits(spark, paths, "id string").collect()} == {("e1", "train"), ("e2", "train"), ("e3", "val")}
    sinks.write_json(examples.limit(0), f"{tmp_path}/empty")
    with pytest.raises(ValueError, match="test"):
        D.read_splits(spark, {**paths, "test": f"{tmp_path}/empty"}, "id string")
    sinks.write_json(spark.createDataFrame([(None, 1)], "b string, a int"), f"{tmp_path}/one")
    assert spark.read.text(f"{tmp_path}/one").head()[0] == '{"a":1,"b":null}'


def test_remap_problems(spark):
    rows = [("32.01.01.0001", "32.01.01.0002"), ("32.01.01.0001", "32.01.01.0003"), ("32.01.01.0004", "32.01.01.0003"), ("32.01.01.0005", "32.01.01.0005"), ("", "x")]
    got = {tuple(r) for r in G.remap_problems(spark.createDataFrame(rows, "former_village_code string, current_village_code string")).collect()}
    assert got == {("32.01.01.0001", "former_repeated"), ("32.01.01.0003", "current_repeated"), ("32.01.01.0005", "unchanged"), ("", "former_is_blank"), ("", "current_is_no_code")}


def test_uncalled(spark):
    html = spark.createDataFrame([(1, "<table><tr><td>a<td>b<td>c<td>d<td>e<td>f</tr><tr><td>x</tr></table>"), (2, "")], "id long, html string")
    assert [tuple(r) for r in D.related_rows(html, "id", "html", F.lit("same")).collect()] == [(1, "same", "a", "b", "c", "d", "e")]
    assert C.schema_problems({"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": "x", "a": {"$ref": "#/none"}}) == ["reference #/none"] and set(C.schema_problems({})) == {"draft", "id"}
    rows = spark.createDataFrame([("32.01.01.0001", "pos", "40111"), ("32.01.01.0001", "pos", "4"), ("q", "other", "")], "village_code string, source_id string, postal_code string")
    assert {tuple(r) for r in X.observation_problems(rows, "pos").collect()} == {("32.01.01.0001", "postal_code"), ("32.01.01.0001", "repeated"), ("q", "source"), ("q", "village_code")}
    chains = spark.createDataFrame([("v1", "d1", "D"), ("v1", "d1", "D"), ("v2", "d1", "D"), ("v2", "d2", "D")], "village_code string, district_code string, district_name string")
    assert [tuple(r) for r in X.inconsistent_villages(chains).collect()] == [("v2", 2)]
    paths = spark.createDataFrame([("web", ["a", "b"]), ("api", ["c"])], "path string, modules array<string>")
    covered = spark.createDataFrame([("a",), ("c",), ("c",)], "module string")
    assert {(r.path, r.modules, tuple(r.uncovered)) for r in E.coverage_report(paths, covered).collect()} == {("web", 2, ("b",)), ("api", 1, ())}
    summary = sinks.quality_summary({"one": chains, "two": spark.createDataFrame([(" ",), (None,)], "village_code string")}).collect()
    assert [tuple(r) for r in summary] == [("one", 4, 2, 0), ("two", 2, 1, 2)]
    texts = synthetic.text_of(spark.createDataFrame([(["Jl.", "A", ",", "B"],)], "tokens array<string>"))
    assert texts.head().text == "Jl. A, B"


def test_windowed_status_counts(spark):
    rows = [("2024-01-01 00:01:00", "VALID"), ("2024-01-01 00:09:00", "VALID"), ("2024-01-01 00:11:00", "VALID"), ("2024-01-01 00:02:00", "OTHER")]
    df = spark.createDataFrame(rows, "t string, gate_status string").withColumn("t", F.to_timestamp("t"))
    got = {(str(r.window.start), r.gate_status): r["count"] for r in gate.status_counts(df, "t").collect()}
    assert got == {("2024-01-01 00:00:00", "VALID"): 2, ("2024-01-01 00:10:00", "VALID"): 1, ("2024-01-01 00:00:00", "OTHER"): 1}


def test_worksheet_and_benchmark(spark):
    rows = [("b", "Jl. A", "SD", ""), ("a", " Jl. B ", "SMP", "")]
    blank = N.worksheet_template(spark.createDataFrame(rows, "id string, reference_address string, level string, x string"), ["id", "reference_address", "level"])
    assert blank.columns == ["id", "reference_address", "level", *N.EDITABLE] and {r.reference_address for r in blank.collect()} == {"Jl. A", "Jl. B"}
    with pytest.raises(ValueError, match="candidates"):
        N.worksheet_template(blank.limit(0), ["id"])
    done = blank.withColumn("rewritten_address", F.concat(F.lit("jalan "), "id")).withColumn("annotator_id", F.lit("p1"))
    examples, counts = N.assembled_benchmark(done, "id", "reference_address", "level")
    assert {(r.id, r.text) for r in examples.collect()} == {("a", "jalan a"), ("b", "jalan b")}
    assert {tuple(r) for r in counts.select("kind", "name", "n").collect()} == {("all", "all", 2), ("annotator", "p1", 2), ("level", "SD", 1), ("level", "SMP", 1)}
    for wrong, why in ((done.withColumn("annotator_id", F.lit(" ")), "a: no_annotator"), (done.withColumn("rewritten_address", F.upper("reference_address")), "a: identical"), (done.union(done), "a: repeated"), (done.withColumn("rewritten_address", F.lit("0812345678")), "a: long_digit_run")):
        with pytest.raises(ValueError, match=why):
            N.assembled_benchmark(wrong, "id", "reference_address", "level")


def test_crosscheck_ancestors(spark):
    whole = {"code": "3201010001", "name": "Desa", "postalCode": "40111", "district": {"code": "d", "name": "D", "city": {"code": "c", "name": "C", "province": {"code": "p", "name": "P"}}}}
    snake = {"code": "32.01.01.0002", "name": "Desa", "postalCode": "40112", "district": {"code": "d", "name": "D", "city_code": "c", "city_name": "C", "provinceCode": "p", "provinceName": "P"}}
    half = {"code": "3201010003", "name": "Desa", "postalCode": "4011", "district": {"code": "d", "name": "D", "city": {"code": "c"}}}
    df = spark.createDataFrame([(json.dumps(x),) for x in (whole, snake, half, {"code": "1"})] + [("broken",)], "j string")
    rows, problems = X.crosscheck_table(df, "j", "api", "s", "n", F.lit("u"))
    assert rows.columns == X.CROSSCHECK_COLUMNS and {(r.village_code, r.province_name, r.city_code) for r in rows.collect()} == {("32.01.01.0001", "P", "c"), ("32.01.01.0002", "P", "c")}
    found = {}
    for r in problems.collect():
        found.setdefault(r.village_code, set()).add(r.problem)
    every = {"village_code", "no_village_name", "postal_code", "no_district", "no_city", "no_province"}
    assert found == {"3201010003": {"postal_code", "no_city", "no_province"}, "1": every, "": every}
    with pytest.raises(ValueError, match="snapshot"):
        X.crosscheck_table(df, "j", "api", " ", "n", F.lit("u"))


def test_row_invariants_of_aliases_and_sources(spark):
    good = ("32", "JABAR", "32.01", "KAB", "32.01.01", "KEC", "32.01.01.0001", "DESA", ["40111"], ["A", "B"], [("s1", "t")])
    rows = [good, (*good[:6], "32.01.01.0002", " ", ["40111"], ["B", "A", ""], []), (*good[:6], "32.01.01.0003", "DESA", ["40111"], [], [("s2", "t"), ("s1", "t"), ("s1", " ")])]
    df = spark.createDataFrame(rows, "province_code string, province_name string, city_code string, city_name string, district_code string, district_name string, village_code string, village_name string, postal_codes array<string>, village_aliases array<string>, sources array<struct<source_id:string,snapshot:string>>")
    assert {tuple(r) for r in G.hierarchy_violations(df).collect()} == {("32.01.01.0002", "village_name"), ("32.01.01.0002", "village_aliases"), ("32.01.01.0002", "village_alias_blank"), ("32.01.01.0002", "no_source"), ("32.01.01.0003", "sources"), ("32.01.01.0003", "source_id")}


def test_gate_of_stream_and_table(spark, hierarchy, tmp_path):  # noqa: F811
    """A stream in several batches, stopped and started again, gives the rows of the table, each once."""
    rows = [(i, f"Jl. Mawar No. {i}, {'Kel. Braga' if i % 2 else 'Kel. Sukamaju'}, Kec. Sumur Bandung, Kota Bandung, Jawa Barat 40111") for i in range(12)]
    df = spark.createDataFrame(rows, "address_id long, text string")
    expected = sorted((r.address_id, r.gate_status, r.reason_code) for r in gate.gated(df, hierarchy).collect())
    assert len({x[1] for x in expected}) >= 1 and len(expected) == 12
    for part in (df.where("address_id < 5"), df.where("address_id between 5 and 8"), df.where("address_id > 8")):
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("address_id long, text string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        query = gate.gate_batches(stream, hierarchy, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.address_id, r.gate_status, r.reason_code) for r in got.collect()) == expected
