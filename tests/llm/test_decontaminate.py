"""Greedy string tiling against a plain quadratic version."""

import random

import numpy as np
import pytest

from blockquorum.llm import decontaminate as own


def slow_tiles(doc, item, least):
    width = min(least, len(item))
    doc_free, item_free, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (width - 1, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and doc_free[d + n] and item_free[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < width:
            return tiles
        n, d, i = best
        tiles.append((d, i, n))
        doc_free[d : d + n] = [False] * n
        item_free[i : i + n] = [False] * n


@pytest.mark.parametrize("seed", range(30))
def test_tiles(seed):
    rng = random.Random(seed)
    item = " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 25)))
    doc = " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 40)))
    items = own.Items([(1, item)], least=3)
    ids = items.numbers(own.words_of(doc))
    seeds = items.shared_seeds(ids).get(0, [])
    got = own.tile(ids, items.ids[0][1], seeds, 3)
    assert got == slow_tiles(doc.split(), item.split(), 3)


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def test_reordered_and_partial_passages(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    halves = " ".join(words[20:]) + " and then " + " ".join(words[:20])
    docs = [
        (1, "before " + item.upper() + " after"),
        (2, halves),
        (3, " ".join(words[:15]) + " rest"),
        (4, " ".join(words[::-1])),
        (5, " ".join(words[:12]) + " x " + " ".join(words[30:])),
        (6, None),
        (None, item),
        (1, item),
    ]
    bench = frame(spark, [(7, item, 1), (8, None, 1), (None, item, 1), (9, "", 1), (10, "one two", 1), (7, item, 1)], "item_id long, text string, fp int")
    got = own.contaminated(frame(spark, docs), bench).collect()
    assert sorted((str(r.doc_id), r.item_id, round(r.coverage, 3), r.tiles) for r in got) == sorted(
        [(d, 7, c, t) for d, c, t in (("1", 1.0, 1), ("1", 1.0, 1), ("2", 1.0, 2), ("5", 0.55, 2), ("None", 1.0, 1)) for _ in range(2)]
    )
    kept = own.keep_clean(frame(spark, [*docs, (None, "clean"), (None, None)]), bench)
    assert sorted(str(r.doc_id) + str(r.text)[:5] for r in kept.collect()) == sorted(["3w0 w1", "4w39 w", "6None", "Noneclean", "NoneNone"])


def test_short_item_matches_as_a_whole(spark):
    got = own.contaminated(frame(spark, [(1, "a one, two b"), (2, "one b two")]), frame(spark, [(3, "One two")], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 3)]


def test_blocks_give_the_same(spark, sf_dir, documents, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    df, rows = documents
    want = sorted(map(tuple, own.contaminated(df, bench).collect()))
    monkeypatch.setattr(own, "BLOCK_BYTES", 4000)
    assert len(own._blocks(bench)) > 2
    assert sorted(map(tuple, own.contaminated(df, bench).collect())) == want
    items = [(r.item_id, own.words_of(r.text)) for r in bench.collect()]
    slow = []
    for doc_id, text in rows:
        doc = own.words_of(text or "")
        grams = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        for item_id, item in items:
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)) and len(doc) < 400:
                tiles = slow_tiles(doc, item, 5)
                if sum(t[2] for t in tiles) / len(item) >= own.THRESHOLD:
                    slow.append((doc_id, item_id))
    assert [r[:2] for r in want if len(own.words_of(dict(rows)[r[0]])) < 400] == sorted(slow)


def test_hard_rows(spark, hard, empty):
    bench = frame(spark, [(1, "the same words of the text"), (2, "x" * 3000)], "item_id long, text string")
    got = own.contaminated(hard, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("3", 1), ("7", 1), ("7", 1), ("8", 2), ("None", 1)]
    kept = own.keep_clean(hard, bench)
    assert kept.columns == hard.columns and kept.count() == hard.count() - 5
    none = frame(spark, [], "item_id long, text string")
    assert own.contaminated(hard, none).count() == 0 and own.contaminated(empty, bench).count() == 0
    assert own.keep_clean(hard, none).count() == hard.count()


def test_running_hash_tells_windows_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 4])
    h = own.running_hash(ids, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(own.running_hash(ids, 8)) == 0
