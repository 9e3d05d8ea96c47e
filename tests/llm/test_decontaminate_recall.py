"""Recall of edited items for every layout of the edits that are allowed, and runs of words in large vocabularies."""

import random

import numpy as np
import pytest

from tapal.llm import decontaminate as D


def edited(rng, item, layout, kind):
    n = len(item)
    d = D.edits_allowed(n)
    first = {"start": 0, "end": n - d, "middle": (n - d) // 2, "clustered": rng.randrange(n - d + 1)}.get(layout)
    at = set(range(first, first + d)) if first is not None else set(rng.sample(range(n), d)) if layout == "scattered" else {*range(d // 2), *range(n - (d - d // 2), n)}
    out = []
    for i, w in enumerate(item):
        op = (rng.choice(["delete", "change", "insert"]) if kind == "mixed" else kind) if i in at else ""
        out += [] if op == "delete" else [f"new{rng.randrange(10**6)}"] if op == "change" else [f"new{rng.randrange(10**6)}", w] if op == "insert" else [w]
    return out


@pytest.mark.parametrize("lengths", ["one", "mixed"])
@pytest.mark.parametrize("n", [5, 12, 25, 45, 100, 200])
def test_recall(n, lengths):
    """0.9 or more of the items at the allowed distance are found in each layout, and every pair that is found is right."""
    rng = random.Random(n)
    size = lambda: n if lengths == "one" else max(5, int(n * rng.uniform(0.8, 1.25)))
    some = lambda k: [f"v{rng.randrange(3000)}" for _ in range(k)]
    items = [some(size()) for _ in range(30)]
    index = D.Index([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    for layout in ("start", "end", "middle", "clustered", "scattered", "both"):
        for kind in ("delete", "change", "insert", "mixed"):
            texts = [some(40) + edited(rng, x, layout, kind) + some(40) for x in items]
            found = index.search([" ".join(t).encode() for t in texts])
            assert sum((i, i) in {(r, k) for r, k, *_ in found} for i in range(30)) >= 0.9 * 30, (layout, kind)
            for r, k, d, _ in found:
                words = {w: i for i, w in enumerate(dict.fromkeys(items[k] + texts[r]))}
                exact, _ = D.fitting_distance(np.array([words[w] for w in items[k]]), np.array([words[w] for w in texts[r]]))
                assert exact <= d <= D.edits_allowed(len(items[k]))


def test_runs_of_any_vocabulary():
    """Numbers of runs are dense, so that no vocabulary makes them overflow, and equal exactly for equal runs."""
    rng = random.Random(2)
    items = [[f"w{rng.randrange(9)}" for _ in range(rng.choice([3, 20, 60]))] for _ in range(40)]
    index = D.Index([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    index_of = {}
    for q in index.runs:
        for x, words in zip(index.items, items):
            if len(words) < q:
                continue
            for at, code in enumerate(index.codes(x, q).tolist()):
                assert code >= 0 and index_of.setdefault((q, code), words[at : at + q]) == words[at : at + q]
        assert max(code for k, code in index_of if k == q) < sum(map(len, items))
        assert (index.codes(np.array([-1, 0, -1, -1, 0]), q) == -1).all() or q == 1
