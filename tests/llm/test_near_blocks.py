"""Near duplicates where a candidate component is larger than a block, and the solver against brute force."""

import random

import numpy as np
import pytest

from datalathe.llm import near
from tests.llm import brute


def key(i):
    return str(i)


def copies(seed, n, words=60, edits=6):
    """Edited copies of a base and of each other: dense and sparse links, chains, and rows that only collide in bands."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    rows, texts = [], [base]
    for i in range(n):
        t = list(r.choice(texts) if r.random() < 0.3 else base)
        for _ in range(r.randrange(edits)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        if r.random() < 0.2:
            t = t[:len(t) - r.randrange(12)]
        texts.append(t)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("block", [16, 60, 2048])
def test_blocks_lose_no_link(spark, block):
    rows = copies(block, 150) + [(1000 + i, t) for i, t in copies(2, 40, words=25, edits=3)] + [(None, "one two three four"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near.near_groups(df, 3, 85, block=block).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == brute.near(rows, 3, 85)


def test_forest_joins_what_is_linked_and_no_more():
    r = np.random.default_rng(0)
    n_bands = near.bands_for(0.8)
    factors = r.integers(1, 2**63, 5 * n_bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    solver = near.Solver(80, near.MISS, n_bands, factors, r.integers(0, 2**63, 5 * n_bands, dtype=np.uint64))
    base = r.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate((r.choice(base, 100 - int(k), replace=False), r.integers(0, 2**63, int(k), dtype=np.uint64)))) for k in r.integers(0, 25, 250)]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    want = {frozenset(j for j in range(len(sets)) if root(j) == root(i)) for i in range(len(sets))}
    for few in (near.FEW_PAIRS, 0):
        near_few, near.FEW_PAIRS = near.FEW_PAIRS, few
        found = solver.forest(sets, np.arange(len(sets)), None)
        near.FEW_PAIRS = near_few
        assert len(found) == len(sets) - len(want)  # a forest: no link more than is needed
        groups = {i: {i} for i in range(len(sets))}
        for i, j in found:
            merged = groups[i] | groups[j]
            for x in merged:
                groups[x] = merged
        assert {frozenset(g) for g in groups.values()} == want


def test_shared_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, int(n)).astype(np.uint64)) for n in r.integers(0, 60, 30)]
    a, b = (x.astype(int) for x in np.triu_indices(30, 1))
    assert near.shared_counts(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
