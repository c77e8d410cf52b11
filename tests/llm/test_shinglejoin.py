"""The exact join of shingle sets against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from blockquorum.llm import shinglejoin as join


def brute(rows, size=4, percent=85):
    """(id, set size, component) of every row, by comparing all pairs of sets of words."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in join.near_duplicates(df, **kw).collect()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for at in rng.integers(0, len(words), size=n):
        words[at] = f"x{rng.integers(1 << 30)}"
    return " ".join(words)


def copies(seed, bases=6, each=8, least=6, most=120):
    """Groups of copies with so many edits that some pairs lie just above and some just below the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(bases):
        n = int(rng.integers(least, most))
        base = [f"w{rng.integers(400)}" for _ in range(n)]
        for _ in range(each):
            rows.append((len(rows) * 3 % 1000 - 20, edited(rng, base, int(rng.integers(0, 2 + n // 40)))))
    return rows


def test_documents_as_brute_force(documents):
    df, rows = documents
    want = brute(rows)
    assert found(df) == want
    assert any(c != d for d, _, c in want)


def test_groups_around_the_threshold_in_tiles_of_blocks(spark):
    rows = copies(0) + copies(5, bases=2, each=40, least=60, most=90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, tile_bytes=4_000) == brute(rows)


def test_other_sizes_and_thresholds(spark):
    rows = copies(7, bases=4, each=6, least=2, most=40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, size=2, percent=70) == brute(rows, 2, 70)
    assert join.Bands(100).tiles(10**6) == []
    with pytest.raises(ValueError):
        join.Bands(50)


def test_hard_rows(hard, hard_rows, empty, spark):
    nulls = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    more = spark.createDataFrame(nulls, "doc_id long, text string")
    assert found(hard.select("doc_id", "text").unionByName(more)) == brute([(r[0], r[1]) for r in hard_rows] + nulls)
    assert found(empty) == []


def test_one_large_group_and_a_shared_passage(spark):
    """Many near copies, and many documents that hold one passage and are not alike."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(100)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, edited(rng, base, 1)) for i in range(300)]
    rows += [(1000 + i, passage + " " + " ".join(f"o{rng.integers(10000)}" for _ in range(60))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = found(df)
    assert {c for d, _, c in got if d < 1000} == {0}
    assert all(c == d for d, _, c in got if d >= 1000)


hashes = st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60).map(lambda s: np.array(sorted(s), dtype=np.uint64))


@given(hashes, hashes)
@settings(max_examples=100, deadline=None)
def test_bitmaps_bound_the_overlap_from_above(a, b):
    a = np.unique(np.concatenate([a, b[::2]]))
    bits = [join.bitmap(x) for x in (a, b)]
    size = min(len(x) for x in bits)
    apart = int(np.bitwise_count(join.folded(bits[0], size) ^ join.folded(bits[1], size)).sum())
    exact = len(set(a.tolist()) & set(b.tolist()))
    assert exact == join.overlap(a, b) <= (len(a) + len(b) - apart) // 2


@given(hashes.filter(lambda h: len(h) > 6), st.data())
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_key(a, data):
    gone = data.draw(st.integers(0, len(a) // 6))
    new = data.draw(st.sets(st.integers(0, (1 << 64) - 1), max_size=len(a) // 6))
    b = np.unique(np.concatenate([a[gone:], np.array(sorted(new), dtype=np.uint64)]))
    same = np.array_equal(a, b)
    if not same and join.linked(a, join.bitmap(a), b, join.bitmap(b), 85):
        bands = join.Bands(85)
        assert set(join.keys_of(a, bands).tolist()) & set(join.keys_of(b, bands).tolist())
