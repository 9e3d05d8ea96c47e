"""Ranked search against a plain version of its contract."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from tapal.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = collections.Counter()
    for item, words in asked.items():
        scored = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        for rank, x in enumerate(sorted(scored)[:k], 1):
            out[item, rank, x[3], -x[0]] += 1
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200]))) for _ in range(n)]
    for _ in range(n // 5):
        texts[rng.randrange(n)] = texts[rng.randrange(n)]
    return [(rng.choice([i, i, i, i // 2]), t) for i, t in enumerate(texts)], [(j, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 30])))) for j in range(25)]


@pytest.mark.parametrize("seed,n,shards", [(1, 400, 1), (2, 400, 7), (3, 3, 3), (4, 1, 1), (5, 700, 2)])
def test_shards_and_bounds(seed, n, shards):
    """Any number of shards gives the plain result, and bounds never fall below a document's score."""
    docs, items = corpus(seed, n)
    full = [x for x in docs if terms(x[1])]
    n_terms = sum(len(terms(t)) for _, t in full)
    built = []
    for s in range(shards):
        shard = lexical.Building(len(full), n_terms)
        for i, t in full[s::shards]:
            shard.add(i, t.encode())
        if shard.docs:
            built.append(shard.row())
    df = collections.Counter(t for _, x in full for t in set(terms(x)))
    got, opened, nodes = collections.Counter(), 0, 0
    for item, text in items:
        best = lexical.Best(10)
        for row in built:
            place = {t: k for k, t in enumerate(row["terms"])}
            there = sorted(t for t in {x.encode() for x in terms(text)} if t in place)
            weights = np.array([lexical.weight(len(full), df[t.decode()]) for t in there], dtype=np.int64)
            shard = lexical.Shard(np.array(row["doc_ids"]), np.array(row["starts"]), row["zeros"], row["bits"], row["impacts"])
            if there:
                opened += lexical.search_shard(shard, np.array([place[t] for t in there]), weights, best)
            nodes += len(row["doc_ids"])
        for rank, (s, i) in enumerate(zip(best.scores.tolist(), best.docs.tolist()), 1):
            got[item, rank, i, s] += 1
    assert got == plain(docs, items)
    assert n < 400 or opened < nodes


def test_step_size_changes_nothing(monkeypatch):
    docs, items = corpus(9, 300)
    built = lexical.Building(len(docs), sum(len(terms(t)) for _, t in docs))
    for i, t in docs:
        built.add(i, t.encode())
    row = built.row()
    shard = lexical.Shard(np.array(row["doc_ids"]), np.array(row["starts"]), row["zeros"], row["bits"], row["impacts"])
    lists = np.arange(min(40, len(row["terms"])))
    found = []
    for step in (1, 100, 1 << 20):
        monkeypatch.setattr(lexical, "STEP_PAIRS", step)
        best = lexical.Best(10)
        lexical.search_shard(shard, lists, np.full(len(lists), 3, dtype=np.int64), best)
        found.append((best.scores.tolist(), best.docs.tolist()))
    assert found[0] == found[1] == found[2]


DOCS = [*corpus(11, 200)[0], (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, None), (8, ""), (9, "!!! ---"), (10, "Ünï 日本 w1 W1"), (11, "x" * 200_000), (12, "w1 " * 50_000), (-5, "w1"), (-5, "w1"), (13, "a\x00b_c w299")]
ITEMS = [*corpus(11, 200)[1], (100, None), (101, ""), (102, "??"), (103, "nowhere"), (104, "Ünï 日本"), (105, "w1"), (105, "w2 w1"), (None, "w3"), (None, "w4"), (106, "x" * 200_000), (107, "A b C")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lexical"))
    spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' as terms", "1 as rank", "2 as score").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_op11(spark, tables):
    got = collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.op11_wavelet(spark, tables).collect())
    assert got == plain(DOCS, ITEMS)


def test_sql_says_the_same(tables):
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    found = connection.execute(lexical.OP11_SQL)
    at = [[d[0] for d in found.description].index(c) for c in ("item_id", "rank", "doc_id", "score")]
    assert collections.Counter(tuple(r[i] for i in at) for r in found.fetchall()) == plain(DOCS, ITEMS)


def test_empty_tables(spark, tmp_path):
    for docs, items in (([], ITEMS[:2]), ([(1, None), (2, "")], ITEMS[:2]), (DOCS[:3], [])):
        folder = f"{tmp_path}/{len(docs)}"
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert lexical.op11_wavelet(spark, folder).collect() == []
