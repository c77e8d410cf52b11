"""SimHash: fingerprints and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from blockquorum.llm import simhash
from blockquorum.llm.common import components


def slow_fingerprint(text, k=3):
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(items, most=3):
    """items: (id, fp); the smallest id reachable for each item."""
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= most:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    least = {}
    for i, f in items:
        if i is not None:
            r = find(f)
            least[r] = min(least.get(r, i), i)
    return [(i, f, least.get(find(f))) for i, f in items]


def found(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=str)


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["a", "Bé", "cc", "d d"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_documents(spark, documents):
    df, rows = documents
    items = [(i, slow_fingerprint(t)) for i, t in rows]
    assert found(simhash.near_duplicates(df)) == sorted(slow_components(items), key=str)


def test_hard_rows(hard, hard_rows):
    items = [(r[0], slow_fingerprint(r[1])) for r in hard_rows]
    assert found(simhash.near_duplicates(hard)) == sorted(slow_components(items), key=str)


def test_keep_one(hard):
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 3, 8, 11, 12]  # 2 and 9 have no words either, 7 repeats 3
    assert ids.count(None) == 2


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("max_bits", [1, 3, 5])
def test_links_connect_as_brute_force(spark, max_bits):
    """Clusters of near fingerprints, more of them in one bucket than a block holds."""
    rng = np.random.default_rng(max_bits)
    fps = set(rng.integers(0, 1 << 63, 300, dtype=np.int64).tolist())
    centre = int(rng.integers(0, 1 << 62))
    for _ in range(400):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(62, size=rng.integers(1, 5), replace=False)))
    items = [(f, f) for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(df, max_bits, block=16)
    roots = {r.node: r.root for r in components(links).collect()}
    want = {f: c for f, _, c in slow_components(items, max_bits)}
    assert {f: roots.get(f, f) for f in fps} == want


def test_every_pair_within_reach_shares_a_mask(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(x),) for x in rng.integers(0, 1 << 62, 500)], "fp long")
    masks = simhash.plan_masks(df, 3)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, size=3, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_allocate_takes_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 1.0, 1: 2.0}]
    assert simhash.allocate(costs, 0) == (2.0, [-1, 1])
    assert simhash.allocate(costs, 1)[1] == [0, 1]
