"""Nearest-neighbour voting: exact cosines, what it may learn from, odd rows, and accuracy on rows kept from it."""

import collections
import os
import random
import zlib

import numpy as np
import pytest

from tapal.llm import voting
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def junk(k):
    return " ".join(f"{w.upper()}!!" for w in prose(k % 5, 20).split()) * 8


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark, odd_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("voting"))
    good = [(1000 + k, prose(k, 80 + k)) for k in range(60)] + [(2000 + k, junk(k)) for k in range(30)]
    extra = spark.createDataFrame(good, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars", *[f"0 as {c}" for c in ("_id",)])
    odd_docs.unionByName(extra, allowMissingColumns=True).selectExpr("*", "0.25D as score", "'q' as counts").write.parquet(f"{folder}/documents.parquet")
    labels = [(1000 + k, 1, 0) for k in range(60)] + [(2000 + k, 0, 0) for k in range(30)] + [(1000, 1, 0), (2000, 1, 0), (None, 1, 0), (11, None, 1), (77777, 0, 0), (11, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_op13_rows(spark, tables, odd_docs):
    got = voting.op13_voting(spark, tables).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    judged = [r for r in got if r.doc_id and r.doc_id >= 1000]
    assert all(r.predicted == (r.doc_id < 2000) for r in judged)


def test_held_out_labels_teach_nothing(spark, tables, tmp_path):
    """Other labels for the rows that are kept out, and other values in lang, source and doc_id, leave all scores."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    flipped = spark.read.parquet(f"{tables}/labels.parquet").selectExpr("doc_id", "case when coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false) then 1 - quality else quality end as quality", "toxic")
    flipped.write.parquet(f"{tmp_path}/labels.parquet")
    docs.selectExpr("*").drop("lang", "source").selectExpr("*", "'zz' as lang", "'other' as source").write.parquet(f"{tmp_path}/documents.parquet")
    scores = lambda folder: sorted((str(r.doc_id), r.score) for r in voting.op13_voting(spark, folder).collect())
    assert [x[0] for x in scores(tables)] == [x[0] for x in scores(str(tmp_path))]
    for (_, a), (_, b) in zip(scores(tables), scores(str(tmp_path))):
        assert a == pytest.approx(b, abs=1e-4)


def test_votes_are_exact():
    rng = np.random.default_rng(3)
    known, labels = voting.unit(rng.standard_normal((200, 8))), rng.integers(0, 2, 200).astype(float)
    asked = voting.unit(rng.standard_normal((50, 8)))
    for k in (1, 7, 200, 500):
        for x, s in zip(asked, voting.votes(asked, known, labels, k)):
            near = sorted(((float(x @ v), y) for v, y in zip(known, labels)), reverse=True)[:k]
            w = [max(c, 0) ** voting.SHARPNESS for c, _ in near]
            assert s == pytest.approx(sum(a * y for a, (_, y) in zip(w, near)) / sum(w), abs=1e-9)
    assert voting.votes(np.zeros((1, 8)), known, labels)[0] == pytest.approx(labels.mean())


def test_latent_is_the_truncated_decomposition():
    rows = np.random.default_rng(4).standard_normal((60, 5)) @ np.random.default_rng(5).standard_normal((5, 40))
    basis = voting.latent(rows.astype(np.float32), 5)
    assert np.allclose(rows @ basis @ basis.T, rows, atol=1e-3) and np.allclose(basis.T @ basis, np.eye(5), atol=1e-4)


def test_frequencies_and_counts(spark, odd_docs):
    """Bucket weights count every row of every partition."""
    hashes = voting.Hashes()
    found = np.array([voting.counts((r.text or "").encode(), hashes) for r in odd_docs.collect()])
    expected = np.log((len(found) + 1) / ((found > 0).sum(axis=0) + 1)) + 1
    assert np.allclose(voting.inverse_frequencies(odd_docs.selectExpr("text").repartition(3)), expected)


def test_no_labels_and_no_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in voting.scored(odd_docs, voting.fitted(odd_docs, none)).collect()} == {0.5}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert voting.scored(empty, voting.fitted(empty, none)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_accuracy_on_held_out_rows(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r.predicted, truth[r.doc_id]) for r in voting.op13_voting(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert len(got) > 50 and sum(a == b for a, b in got) >= 0.97 * len(got)
    assert sum(a for a, b in got if b) >= 0.97 * sum(b for _, b in got)
