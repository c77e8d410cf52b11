"""Token shards and BPE: against the tokenizers and tiktoken libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from blockquorum.llm import bpe, tokenids

P = pytest.importorskip("public_tokenizers")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")

ODD = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\n\n\nb", "\n\n", "don't we'll x's", "x\x1c y\x85 z​ q", "\0 a", "a\tb\t\tc",
    "<|endoftext|> is text", "日本語のテキスト　と", "aaaa" * 60, "=" * 500 + " " * 70, "1234567890" * 20, "\U0001f600\U0001f601 é́",
]


def some_texts(n=300, seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("ab'sté1 .\n") for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_pieces_encode_as_whole_texts(tokenizer):
    enc, items = tokenids.PieceEncoder(JSON), some_texts()
    got = [np.frombuffer(x, dtype=enc.kind).tolist() for x in enc.encode_many(items)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in items]


MARKS = ["a,b.c", "x,. y", "..,", ", start", "a ,b", "a_.b", "².,é,ü.", "don't,.it's", "3.14,15", "a.", "b,", "a..b", "a,\nb.\nc", "w.'s,'t", "日,本.", "a,&&& b.$$ c,"]


def test_marks_after_words(tokenizer, tik):
    enc, codec = tokenids.PieceEncoder(JSON), bpe.codec(RANKS, P.PATTERN)
    rng = random.Random(6)
    items = MARKS + ["".join(rng.choice("ab1é,. '\n_-") for _ in range(rng.randrange(40))) for _ in range(3000)]
    got = [np.frombuffer(x, dtype=enc.kind).tolist() for x in enc.encode_many(items)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in items]
    packed = codec.encode(items)
    assert [np.frombuffer(x, dtype=codec.kind).tolist() for x in packed] == [tik.encode_ordinary(t) for t in items]
    assert codec.decode(packed) == [t.encode() for t in items]


def test_streams_decode_in_slices(monkeypatch):
    codec, items = bpe.codec(RANKS, P.PATTERN), ["", *some_texts(40, seed=9), ""]
    packed = codec.encode(items)
    monkeypatch.setattr(bpe, "DECODE_ROWS", 37)
    assert codec.decode(packed) == [t.encode() for t in items]


def test_memo_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenids, "MOST_KNOWN", 50)
    enc, items = tokenids.PieceEncoder(JSON), some_texts(100, seed=3)
    for t in items:
        assert np.frombuffer(enc.encode_many([t])[0], dtype=enc.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 7, 500, 5000])
def test_index_is_minimal_and_perfect(n):
    keys = np.arange(n, dtype=np.int64) * 11 - 40
    _, _, slots = tokenids.build_index(keys, np.zeros(n, dtype=np.uint32))
    assert sorted(slots.tolist()) == list(range(n))


def test_shard_finds_every_key_and_no_other():
    keys = [None, None, -3, 5, 5, 5, 9]
    payloads = [np.arange(i, dtype="<u2").tobytes() for i in range(7)]
    shard = tokenids.Shard(tokenids.shard_bytes(keys, payloads, np.dtype("<u2"), 2))
    repeats = [0, 1, 0, 0, 1, 2, 0]
    for k, r, p in zip(keys, repeats, payloads):
        assert shard.get(k, r).tobytes() == p
    assert all(shard.get(k) is None for k in range(100, 1100))
    assert shard.get(9, 1) is None and shard.get(0) is None


def expected(tokenizer, rows):
    out, start = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()], key=lambda r: r[1])


def test_documents_in_shards(documents, tokenizer, monkeypatch):
    df, rows = documents
    monkeypatch.setattr(tokenids, "TASK_BYTES", 100_000)  # several tasks, several files each
    folder = None
    shards = tokenids.write_shards(df, folder := tokenids.fresh_path(df.sparkSession, "t"), JSON, shard_bytes_most=20_000)
    assert shards.count() > 8
    found = tokenids.read_shards(df.sparkSession, folder).join(shards.select("name", "start"), "name")
    assert rows_of(found.selectExpr("doc_id", "start + offset AS start", "n_tokens", "ids_crc32")) == expected(tokenizer, rows)


def test_hard_rows(hard, hard_rows, tokenizer):
    got = rows_of(tokenids.write_and_read(hard, JSON))
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    by_size = lambda rows: sorted((str(i), n, c) for i, _, n, c in rows)
    assert by_size(got) == by_size(expected(tokenizer, [(r[0], r[1]) for r in hard_rows]))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()


def test_empty_tables(empty):
    assert tokenids.write_and_read(empty, JSON).count() == 0
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_round_trips_as_tiktoken(tik):
    codec, items = bpe.codec(RANKS, P.PATTERN), some_texts()
    for text, (ids, decoded) in zip(items, zip(codec.encode(items), codec.decode(codec.encode(items)))):
        assert np.frombuffer(ids, dtype=codec.kind).tolist() == tik.encode_ordinary(text)
        assert decoded == text.encode()


def test_long_words_as_tiktoken(tik):
    rng = random.Random(4)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("etaoin", 900), ("ab", 400), ("日本é", 300), ("xyzXYZ", 65))]
    codec = bpe.codec(RANKS, P.PATTERN)
    got = codec.merge([w.encode() for w in words])
    assert [np.frombuffer(x, dtype=codec.kind).tolist() for x in got] == [tik.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("letters, n", [("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("stern", 100_000), ("éüßabeж語", 50_000), ("ab", 3_000)])
def test_very_long_words_as_tiktoken(tik, letters, n):
    rng = random.Random(8)
    word = "".join(rng.choice(letters) for _ in range(n))
    codec = bpe.codec(RANKS, P.PATTERN)
    assert np.frombuffer(codec.encode([word])[0], dtype=codec.kind).tolist() == tik.encode_ordinary(word)


def test_one_syllable_many_times_as_tiktoken(tik):
    codec = bpe.codec(RANKS, P.PATTERN)
    for word in ("ab" * 100_000, "a" * 100_001, "cab" * 20_000, "ana" * 20_000):
        assert np.frombuffer(codec.encode([word])[0], dtype=codec.kind).tolist() == tik.encode_ordinary(word)


def test_cuts_are_where_no_token_reaches_over(tik):
    codec = bpe.codec(RANKS, P.PATTERN)
    word = "".join(random.Random(9).choice("sternxq") for _ in range(400)).encode()
    ends = np.cumsum([len(p) for p in codec.cut(word)])[:-1].tolist()
    over = {k for i in range(400) for j in range(i + 2, 401) if codec.starts.get(word[i:j]) for k in range(i + 1, j)}
    assert b"".join(codec.cut(word)) == word and ends == [k for k in range(1, 400) if k not in over]


def test_rounds_go_on(tik, monkeypatch):
    monkeypatch.setattr(bpe, "ROUNDS_ROWS", 1000)
    word = "".join(random.Random(2).choice("stern") for _ in range(300))
    codec = bpe.codec(RANKS, P.PATTERN)
    assert np.frombuffer(codec.merge([word.encode()])[0], dtype=codec.kind).tolist() == tik.encode_ordinary(word)


def test_documents_encode(documents, tik):
    df, rows = documents
    texts = dict(rows)
    for r in bpe.encode(df, RANKS, P.PATTERN).collect():
        ids = np.array(tik.encode_ordinary(texts[r.doc_id]), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_hard_rows_decode(hard, hard_rows):
    made = bpe.encode(hard, RANKS, P.PATTERN, keep=hard.columns)
    assert made.columns[: len(hard.columns)] == hard.columns
    back = bpe.decode(made, RANKS, P.PATTERN)
    key = lambda rows: sorted(rows, key=str)
    assert key((r.doc_id, bytes(r.bytes)) for r in back.collect()) == key((r[0], (r[1] or "").encode()) for r in hard_rows)
