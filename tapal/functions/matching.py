"""How alike two strings are by their matching blocks, for whole batches of pairs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Cells of the table of one step; longer strings are compared in smaller batches.
CELLS = 1 << 20


def coded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each string begins, with the end) of strings one after the other."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.r_[0, np.cumsum([len(s) for s in strings])].astype(np.int64)


def letter_bound(a: list[str], b: list[str]) -> np.ndarray:
    """The most that each pair's ratio can be: all letters that both have, in any order."""
    letters: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for strings in (a, b):
        points, at = coded(strings)
        letters.append(points.astype(np.int64))
        owners.append(np.repeat(np.arange(len(strings)), np.diff(at)))
    _, code = np.unique(np.concatenate(letters), return_inverse=True)
    n = int(code.max(initial=0)) + 1
    found = [np.unique(owner * n + c, return_counts=True) for owner, c in zip(owners, (code[: len(letters[0])], code[len(letters[0]) :]))]
    both, x, y = np.intersect1d(found[0][0], found[1][0], assume_unique=True, return_indices=True)
    shared = np.bincount(both // n, weights=np.minimum(found[0][1][x], found[1][1][y]), minlength=len(a))
    total = np.array([len(s) + len(t) for s, t in zip(a, b)])
    return np.where(total > 0, 2 * shared / np.maximum(total, 1), 0.0)


def longest(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest common block of each row of part: first in a, then in b, among equals.

    part has a's and b's bounds (a0, a1, b0, b1). One step takes the next character of all the rows' a and goes over all
    of b; a cell holds how long the run that ends there is.
    """
    a0, a1, b0, b1 = part.T
    width = int((b1 - b0).max())
    other = b[np.minimum(b0[:, None] + np.arange(width), len(b) - 1)].astype(np.int64)
    other[np.arange(width) >= (b1 - b0)[:, None]] = -1
    run = np.zeros((len(part), width + 1), dtype=np.int32)
    best, at_a, at_b = np.zeros(len(part), dtype=np.int64), a0.copy(), b0.copy()
    rows = np.arange(len(part))
    for step in range(int((a1 - a0).max())):
        here = np.where(a0 + step < a1, a[np.minimum(a0 + step, len(a) - 1)].astype(np.int64), -2)
        new = np.zeros_like(run)
        np.add(run[:, :-1], 1, out=new[:, 1:], where=other == here[:, None])
        run = new
        top = run.argmax(axis=1)
        size = run[rows, top]
        more = size > best
        best[more], at_a[more], at_b[more] = size[more], (a0 + step + 1 - size)[more], (b0 + top - size)[more]
    return at_a, at_b, best


def ratios(first: list[str], second: list[str], least: float = 0.0) -> np.ndarray:
    """Twice the characters in matching blocks over all characters, for each pair; 0 if either is empty.

    The longest common block is taken, then those before it and behind it, all pairs' parts of one depth together. A
    pair whose letters cannot reach `least` is not compared and has 0.
    """
    out = np.zeros(len(first))
    live = np.flatnonzero([bool(x) and bool(y) for x, y in zip(first, second)])
    if len(live) and least > 0:
        live = live[letter_bound([first[i] for i in live], [second[i] for i in live]) >= least]
    if not len(live):
        return out
    a, at_a = coded([first[i] for i in live])
    b, at_b = coded([second[i] for i in live])
    matched = np.zeros(len(live), dtype=np.int64)
    todo = np.column_stack([np.arange(len(live)), at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]])
    while len(todo):
        todo = todo[np.argsort(todo[:, 4] - todo[:, 3], kind="stable")]
        most = int((todo[-1, 4] - todo[-1, 3]) + 1)
        size = max(1, CELLS // most)
        rest = []
        for k in range(0, len(todo), size):
            part = todo[k : k + size]
            i, j, n = longest(a, b, part[:, 1:])
            np.add.at(matched, part[:, 0], n)
            some = n > 0
            before = np.column_stack([part[:, 0], part[:, 1], i, part[:, 3], j])[some]
            behind = np.column_stack([part[:, 0], i + n, part[:, 2], j + n, part[:, 4]])[some]
            rest += [before, behind]
        todo = np.concatenate(rest)
        todo = todo[(todo[:, 2] > todo[:, 1]) & (todo[:, 4] > todo[:, 3])]
    total = np.diff(at_a) + np.diff(at_b)
    out[live] = 2 * matched / total
    return out


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two columns; null if either is, 1 for two empty strings."""
    known = (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    found = ratios(x, y)
    found[[not s and not t for s, t in zip(x, y)]] = 1.0
    out = np.full(len(a), np.nan)
    out[known] = found
    return pd.Series(out).where(known, None)


def matching_ratios(least: float):
    """A function of two array columns: the ratios of their elements pair by pair, 0 for those that cannot reach least."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        x = [s or "" for row in a for s in (() if row is None else row)]
        y = [s or "" for row in b for s in (() if row is None else row)]
        sizes = [0 if row is None else len(row) for row in a]
        return pd.Series(np.split(ratios(x, y, least), np.cumsum(sizes)[:-1]) if sizes else [], dtype=object)

    return each
