"""The near-duplicate stage links by the trie join of fingerprints, and by similarity what fingerprints do not tell."""

import random

import numpy as np

from tapal.llm import pipeline, simhash


def test_near_fingerprints_link(spark):
    """Texts with one repeated passage and ends of their own have near fingerprints, though fewer than a half of their shingles are shared."""
    rng = random.Random(5)
    words = lambda n: rng.choices([f"w{i}" for i in range(3000)], k=n)
    passage = words(31) * 60
    texts = [" ".join(passage + words(40)) for _ in range(6)] + [" ".join(words(150)) for _ in range(20)]
    fps = [simhash.fingerprint(t.encode(), pipeline.SHINGLE) for t in texts]
    label = simhash.spanning(len(fps), *map(np.array, zip(*[(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])))
    sets = [set(simhash.shingle_hashes(t.encode(), pipeline.SHINGLE).tolist()) for t in texts]
    assert set(label[:6].tolist()) == {0} and all(2 * len(sets[0] & sets[i]) < len(sets[0] | sets[i]) for i in range(1, 6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()} == set(label.tolist())
