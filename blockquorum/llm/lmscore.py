"""Stupid-backoff language-model scores of documents against the rest of the corpus.

A word with its context scores c(context, word) / c(context) in the longest context, of up to ``ORDER`` - 1
words, in which other documents have seen it, times ``ALPHA`` for every context that was left off; in the empty
context c(word) / N. Counts are of the whole corpus without the document that is scored. A word no other
document has counts as ALPHA of one occurrence.

The tables are joined as relations of packed rows, because single n-grams as rows would take several times
their size in shuffles:

  chunks   documents of about ``CHUNK_WORDS`` words as word numbers with the hashes of the chunk's words;
           by chunk
  counts   (order, bucket of the n-gram's hash, chunk): the distinct n-grams of a chunk, their hashes sorted and
           packed, and how often the chunk has them; by bucket
  sums     the same rows with the corpus counts in place of the chunk's, after each bucket has added up
           its n-grams; back by chunk
  scores   chunks joined with sums: every n-gram gets its corpus count less the document's own, and the logarithms
           are summed per document

Buckets are ranges of the 64-bit hash, as many as the corpus needs for a bucket of bounded size; an n-gram takes one
place per chunk in its bucket, however frequent it is, so frequent n-grams make no bucket larger. N-grams are
known by 64-bit hashes (two of 10^9 share one with odds of 3 in 100).

Words are runs of letters, digits and non-ASCII characters, in lower case. Edge cases: null, empty and word-less
texts have no words, score 0.0 and a null mean; null and repeated ids stay rows of their own (each row is a
document); in a corpus of one document all words are unseen; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from blockquorum.llm.common import in_arrow, map_batches, texts, worker_store

ORDER = 3
ALPHA = 0.4
CHUNK_WORDS = 1_000_000
BUCKET_WORDS = 3_000_000  # of the corpus per bucket and order
MOST_KNOWN = 400_000  # words whose hash a worker remembers

_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split()


def word_hashes(words: list[bytes]) -> list[int]:
    known = worker_store("word hashes")
    if len(known) > MOST_KNOWN:
        known.clear()
    try:
        return [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return [known[w] for w in words]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, compressed by byte planes."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + planes)
    return zstandard.compress(b"".join(parts), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        dtype = np.dtype("<" + kind.decode())
        at += struct.calcsize("<2sQ")
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * dtype.itemsize, offset=at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted distinct hashes as their first and the differences, which need fewer bytes."""
    return _pack(np.diff(h, prepend=np.uint64(0)).astype("<u8"))


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data)[0], dtype=np.uint64)


def _narrow(n: np.ndarray) -> np.ndarray:
    top = int(n.max(initial=0))
    return n.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4" if top < 1 << 32 else "<u8")


def gram_hashes(words: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which an n-gram of ``order`` words of one document ends, its hash at each)."""
    n = len(words) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = np.full(n, np.uint64(order))
    for j in range(order):
        x = (h ^ words[j : j + n]) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = x ^ (x >> np.uint64(32))
    whole = np.flatnonzero(doc[:n] == doc[order - 1 :])
    return whole + order - 1, h[whole]


def pack_chunks(docs: DataFrame, id_kind: str) -> DataFrame:
    """(chunk, ids array, sizes array, payload): documents in chunks, each made by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        hashes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, sizes, hashes, held, number
            vocab, at = np.unique(np.concatenate(hashes), return_inverse=True)
            payload = _pack(vocab.astype("<u8"), at.astype("<u4"))
            row = [pa.array([task << 32 | number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            ids, sizes, hashes, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(row, names=["chunk", "ids", "sizes", "payload"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part)):
                    own = word_hashes(words_of(text))
                    ids.append(doc_id)
                    sizes.append(len(own))
                    hashes.append(np.array(own, dtype=np.uint64))
                    held += len(own)
                    if held >= CHUNK_WORDS:
                        yield flush()
        if ids:
            yield flush()

    return in_arrow(docs.select("doc_id", "text"), run, f"chunk long, ids array<{id_kind}>, sizes array<long>, payload binary")


def _words(payload: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    vocab, at = _unpack(payload)
    return vocab[at].astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def chunk_counts(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(part, chunk, hashes, counts): part is the order and the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, payload in zip(*[batch.column(c).to_pylist() for c in ("chunk", "sizes", "payload")]):
                words, doc = _words(payload, sizes)
                for k in range(1, order + 1):
                    h, n = np.unique(gram_hashes(words, doc, k)[1], return_counts=True)
                    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    rows: dict[str, list] = {"part": [], "chunk": [], "hashes": [], "counts": []}
                    for lo, hi in zip(cuts, np.append(cuts[1:], len(h))):
                        rows["part"].append(k << 40 | int(bucket[lo]))
                        rows["chunk"].append(chunk)
                        rows["hashes"].append(pack_hashes(h[lo:hi]))
                        rows["counts"].append(_pack(_narrow(n[lo:hi])))
                    if rows["part"]:
                        yield pa.RecordBatch.from_pydict(rows)

    # all columns are taken, so that the same shuffle of chunks serves here and where they are scored
    return in_arrow(chunks, run, "part long, chunk long, hashes binary, counts binary")


def _add_up(table: pa.Table) -> pa.Table:
    """One part of the table: every chunk's n-grams with the counts of the whole corpus."""
    hashes = [unpack_hashes(x) for x in table.column("hashes").to_pylist()]
    counts = [_unpack(x)[0] for x in table.column("counts").to_pylist()]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at]
    ends = np.cumsum([len(h) for h in hashes])
    sums = [_pack(_narrow(total[lo:hi])) for lo, hi in zip([0, *ends], ends)]
    return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "sums": pa.array(sums, pa.binary())})


def score_chunk(words: np.ndarray, doc: np.ndarray, docs: int, sums: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log scores, words scored in their longest context) per document; ``sums[k - 1]`` are the corpus counts of the
    chunk's distinct n-grams of order k, by hash."""
    sizes = np.bincount(doc, minlength=docs)
    left = []  # for each order and position: corpus count of the n-gram that ends there, less the document's own
    for k, total in enumerate(sums, 1):
        at, h = gram_hashes(words, doc, k)
        _, gram = np.unique(h, return_inverse=True)
        _, same, own = np.unique(gram * docs + doc[at], return_inverse=True, return_counts=True)
        rest = np.zeros(len(words))
        rest[at] = total[gram] - own[same]
        left.append(rest)
    others = np.maximum(n_words - sizes[doc], 1).astype(np.float64)
    score = np.log(np.where(left[0] > 0, left[0], ALPHA) / others)
    score += (len(sums) - 1) * log(ALPHA)
    place = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[doc]
    # words at the start of a document have shorter contexts: they do not pay for those they cannot have
    score -= np.maximum(len(sums) - 1 - place, 0) * log(ALPHA)
    longest = np.zeros(len(words), dtype=bool)
    for k in range(2, len(sums) + 1):
        hit = left[k - 1] > 0
        context = np.concatenate([[0.0], left[k - 2][:-1]])
        paid = np.minimum(len(sums) - 1, place) - (k - 1)
        score[hit] = np.log(left[k - 1][hit] / context[hit]) + paid[hit] * log(ALPHA)
        longest = hit
    sums_of = lambda x: np.bincount(doc, weights=x, minlength=docs).astype(np.float64)
    return sums_of(score), sums_of(longest)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_longest) of every document."""
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": [sum(len(words_of(t)) for t in texts(batch))]})

    n_words = map_batches(docs.select("text"), count, "n long").agg(F.sum("n")).first()[0] or 0
    bits = max(0, (max(1, n_words // BUCKET_WORDS) - 1).bit_length())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = pack_chunks(docs, id_kind).repartition(n, "chunk")
    counts = chunk_counts(chunks, order, bits)
    sums = counts.groupBy("part").applyInArrow(_add_up, "part long, chunk long, sums binary")

    def scored(key: tuple, own: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "log_score", "n_longest"]
        kind = own.schema.field("ids").type.value_type
        ids, sizes = own.column("ids").to_pylist()[0], own.column("sizes").to_pylist()[0]
        words, doc = _words(own.column("payload").to_pylist()[0], sizes)
        parts = sorted(zip(rows.column("part").to_pylist(), rows.column("sums").to_pylist())) if rows.num_rows else []
        by_order = [[_unpack(x)[0] for p, x in parts if p >> 40 == k] for k in range(1, order + 1)]
        total = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in by_order]
        log_score, longest = score_chunk(words, doc, len(ids), total, n_words)
        return pa.Table.from_arrays([pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(log_score), pa.array(longest.astype(np.int64))], names=names)

    schema = f"doc_id {id_kind}, n_words long, log_score double, n_longest long"
    found = chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(scored, schema)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return found.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"), "n_longest")
