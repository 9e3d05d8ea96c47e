"""The Merkle manifest against a plain version of its contract."""

import collections
import hashlib
import zlib

import duckdb
import pytest

from tapal.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root of nodes, and for each the runs (before, after) on its way."""
    steps, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            steps[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            own[k] = at // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, tops = {}, []
    for lang in langs:
        own = sorted(((r, h(*map(framed, r))) for r in rows if r[2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, steps = climb([d for _, d in own])
        tops.append(top)
        found[lang] = list(zip(own, steps))
    root, above = climb(tops)
    out = collections.Counter()
    for k, lang in enumerate(langs):
        for (r, leaf), steps in found[lang]:
            steps = steps + above[k]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc = h(*map(framed, (*r[:4], text)))
            for before, after in steps:
                acc = h(before, acc, after)
            out[r[0], leaf, tops[k], root, h(*[x for s in steps for x in s]), acc, acc == root] += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
CASES = {
    "several": [(i, None if i % 7 == 0 else f"s{i % 3}", ["en", "de", None, "ü", ""][i * i % 5], i * 3, f"Text {i} É") for i in range(300)],
    "groups": [(i, "s", f"x{i % 70:02d}", 1, "A") for i in range(90)],
    "one": [(1, "s", "en", 1, "ONE")],
    "ties": [(5, "s", "en", 1, "T")] * 20 + [(5, "s", "en", 1, None), (None, None, None, None, None), (None, None, None, None, None), (-9, "", "", 0, ""), (12, "s", "en", 2, "L" * 50_000)],
    "edges": [(i, "s", f"l{n}", 1, "Q") for n in (7, 8, 9, 64, 65) for i in range(n)],
    "empty": [],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_manifest(spark, tmp_path, name):
    rows = CASES[name]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as tree", "1 as i", "2 as n", "'y' as digest", "'z' as path").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle(spark, str(tmp_path))
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == (plain(rows) if rows else collections.Counter())


def test_sql_says_the_same(spark, tmp_path):
    rows = CASES["several"] + CASES["ties"]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = connection.execute(merkle.OP12_SQL)
    at = [[d[0] for d in found.description].index(c) for c in COLUMNS]
    assert collections.Counter(tuple(r[i] for i in at) for r in found.fetchall()) == plain(rows)


def test_proof_finds_any_change(spark):
    """A changed byte, length or null leads to another root; the untouched row leads to the root."""
    from pyspark.sql import functions as F

    rows = [(i, "s", "en", 1, f"t{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for changed in ({"text": F.concat("text", F.lit(" "))}, {"n_chars": F.lit(2)}, {"source": F.lit(None)}):
        got = merkle.manifest(docs, changed=changed).withColumn("to", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("from_other", merkle.folded(F.col("altered"), F.col("path"))).collect()
        assert len(got) == 30 and all(r.to == r.root != r.from_other for r in got)
