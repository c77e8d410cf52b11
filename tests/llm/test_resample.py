"""Crc32 of features by position tables, weights and the draw."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from blockquorum.llm import resample

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return [zlib.crc32(w) for w in words] + [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def check(items):
    hashes, n = resample.feature_hashes(pa.array(items, pa.string()))
    ends = np.append(0, np.cumsum(n))
    assert len(hashes) == ends[-1]
    for i, text in enumerate(items):
        assert sorted(hashes[ends[i] : ends[i + 1]].tolist()) == sorted(features(text))


@given(st.lists(st.one_of(st.none(), st.text(max_size=90), st.text("ab1 Z-é", max_size=300)), min_size=1, max_size=8))
@settings(max_examples=120, deadline=None)
def test_crc_of_any_texts(items):
    check(items)


@pytest.mark.parametrize("size", [1, 63, 64, 65, 127, 128, 129, 192, 5000])
def test_long_spans_fold(size):
    assert resample.fold(np.frombuffer(b"q" * size, dtype=np.uint8)) ^ int(resample._lengths.upto(size)[size]) == zlib.crc32(b"q" * size)
    check(["z" * size, "a " + "b" * size + " c " + "d" * size, "e" * size + " f"])


def test_slices_of_a_column_and_cuts_between_texts():
    column = pa.array(["drop", "one two", None, "three", "", "end"])[1:]
    hashes, n = resample.feature_hashes(column)
    assert n.tolist() == [3, 0, 1, 0, 1]
    assert hashes[-1] == zlib.crc32(b"end")


def test_many_slices(monkeypatch):
    monkeypatch.setattr(resample, "TOGETHER", 64)
    check([f"some words {i} and more of them" for i in range(40)] + ["x" * 500, "", None])


def brute(rows, target, percent=25, least_words=20, buckets=10_000, seed=7):
    raw, goal = Counter(), Counter()
    for counts, texts in ((raw, [t for _, t in rows]), (goal, target)):
        for t in texts:
            counts.update(h % buckets for h in features(t))
    s, t = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    out = []
    for doc_id, text in rows:
        own = [gain(h % buckets) for h in features(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, (len(own) + 1) // 2, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[3]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def found(df, target, **kw):
    return sorted((tuple(r) for r in resample.resample(df, target, **kw).collect()), key=repr)


def test_documents_as_brute_force(spark, sf_dir, documents):
    df, rows = documents
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute(rows, [r.text for r in bench.collect()])
    assert found(df, bench) == want
    assert sum(r[5] is not None for r in want) == 25 * sum(r[1] >= 20 for r in want) // 100


def test_hard_rows(spark, hard, hard_rows, empty):
    target = spark.createDataFrame([("the same words",), (None,), ("",)], "text string")
    want = brute([(r[0], r[1]) for r in hard_rows], ["the same words"], percent=50, least_words=1)
    assert found(hard, target, percent=50, least_words=1) == want
    assert found(empty, target) == []
    assert found(hard, empty, least_words=10**6) == brute([(r[0], r[1]) for r in hard_rows], [], least_words=10**6)


def test_ties_go_to_the_smaller_id(spark):
    """Rows of one id have one score; with all others they are drawn in order."""
    rows = [(i % 40, "words of a text that is long enough " * 4) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df, df, percent=60)
    assert got == brute(rows, [t for _, t in rows], percent=60)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 121))
