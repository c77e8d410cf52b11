"""Stupid backoff against counts in plain Python."""

from collections import Counter
from math import log

import numpy as np
import pytest

from blockquorum.llm import lmscore as own


def slow_scores(texts, order=3):
    toks = [own.words_of(t or "") for t in texts]
    counts = [Counter() for _ in range(order)]
    mine = [[Counter(zip(*[w[j:] for j in range(k)])) for k in range(1, order + 1)] for w in toks]
    for m in mine:
        for k in range(order):
            counts[k].update(m[k])
    n = sum(map(len, toks))
    out = []
    for w, m in zip(toks, mine):
        left = lambda g: counts[len(g) - 1][g] - m[len(g) - 1][g]  # noqa: B023, E731
        score, longest = 0.0, 0
        for p in range(len(w)):
            most = min(order - 1, p)
            for q in range(most, -1, -1):
                c = left(tuple(w[p - q : p + 1]))
                if q and c > 0:
                    score += (most - q) * log(own.ALPHA) + log(c / left(tuple(w[p - q : p])))
                    longest += q == order - 1
                    break
                if not q:
                    score += most * log(own.ALPHA) + log((c or own.ALPHA) / max(1, n - len(w)))
        out.append((len(w), round(score, 6), longest))
    return out


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, round(r.log_score, 6), r.n_longest) for r in df.collect())


@pytest.mark.parametrize("chunk,bucket,order", [(10**6, 10**6, 3), (3000, 2000, 3), (3000, 500, 2), (5000, 9000, 1)])
def test_documents(documents, monkeypatch, chunk, bucket, order):
    monkeypatch.setattr(own, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(own, "BUCKET_WORDS", bucket)
    df, rows = documents
    rows = rows[:120]
    want = sorted((str(i), *s) for (i, _), s in zip(rows, slow_scores([t for _, t in rows], order)))
    got = rows_of(own.score(df.filter(df.doc_id <= rows[-1][0]), order))
    assert [g[:2] + g[3:] for g in got] == [(w[0], w[1], w[3] if order > 1 else 0) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)


def test_hard_rows(hard, hard_rows, empty):
    want = sorted((str(r[0]), *s) for r, s in zip(hard_rows, slow_scores([r[1] for r in hard_rows])))
    got = rows_of(own.score(hard))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)
    assert own.score(empty).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (own.unpack_hashes(own.pack_hashes(h)) == h).all()
    for n in (np.array([0, 255]), np.array([256, 1]), np.array([70000]), np.empty(0, dtype=np.int64)):
        assert own._unpack(own._pack(own._narrow(n)))[0].tolist() == n.tolist()
