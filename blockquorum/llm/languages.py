"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``ORDER`` bytes. In a context the next byte costs
-log2 of its share of the counts there; a byte the context has not seen costs an escape (as likely as the
number of different bytes seen, method C) and then its cost in the context one byte shorter, with the bytes
already ruled out taken from the sum. Statistics are frozen after learning, so the sum over a text is an exact
code length in bits; the language with the shortest code wins.

Learning counts, in one pass over a sample of whole texts, the runs of up to ORDER + 1 bytes per language;
the sample is bounded by ``TRAIN_BYTES`` of text per language (in expectation, by a hash of the id), and so is
the model. Texts of any length are scored whole, in pieces.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and so is everything when nothing
was learned. Rows with null lang or id are not learned from, repeated rows count as often as they occur; ties
go to the language name that sorts first. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockquorum.llm.common import crc_mod, in_arrow, map_batches, texts

ORDER = 3
TRAIN_BYTES = 3_000_000
LEAST_CONTEXT = 6  # times a longest context must have been seen, in some language, to be kept
PIECE = 1 << 20  # values in one piece of a scoring pass
UND = "und"

_LETTER = re.compile(r"[^\W\d_]")
_HEAD = b"\n" * ORDER  # what every text is taken to follow


def gram_counts(data: bytes) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, runs as big-endian numbers, counts) of all runs of 1 to ORDER + 1 bytes."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = []
    for size in range(1, ORDER + 2):
        code = np.zeros(max(0, len(x) - ORDER), dtype=np.uint32)
        for j in range(size):  # runs that end at each byte after the head
            at = ORDER - size + 1 + j
            code = code << np.uint32(8) | x[at : at + len(code)]
        values, n = np.unique(code, return_counts=True)
        out.append((size, values, n))
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, size, gram, n) over the texts of ``rows`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                by_lang.setdefault(lang, []).append(text.encode("utf-8"))
            for lang, items in by_lang.items():
                sums: dict[int, list] = {}
                for item in items:
                    for size, values, n in gram_counts(_HEAD + item):
                        sums.setdefault(size, []).append((values, n))
                for size, parts in sums.items():
                    values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(values))
                    row = {"lang": [lang] * len(values), "size": np.full(len(values), size, np.int32), "gram": values.astype(np.int64), "n": n.astype(np.int64)}
                    yield pa.RecordBatch.from_pydict(row)

    counted = in_arrow(rows.select("lang", "text"), run, "lang string, size int, gram long, n long")
    return counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # byte -> symbol; the last symbol stands for bytes that were never seen
    node: np.ndarray  # of the ORDER symbols before a byte: the longest known context
    bits: np.ndarray  # (node * symbols + symbol) x language

    @property
    def symbols(self) -> int:
        return int(self.code.max()) + 1 if len(self.langs) else 0


def build(langs: list[str], counts: list[dict[int, dict[int, int]]]) -> Model:
    """Cost tables from the counts of each language: ``counts[l][size][gram]``."""
    seen = sorted({*_HEAD, *(g for c in counts for g in c.get(1, {}))})
    a = len(seen) + 1
    code = np.full(256, a - 1, dtype=np.int64)
    code[seen] = np.arange(a - 1)

    def split(gram: int, size: int) -> tuple[int, ...]:
        return tuple(int(code[(gram >> 8 * (size - 1 - j)) & 255]) for j in range(size))

    # the contexts that are kept: a node for each, the empty one first, shorter ones before longer ones
    contexts: list[tuple[int, ...]] = [()]
    weight: dict[tuple[int, ...], int] = {}
    for c in counts:
        own: dict[tuple[int, ...], int] = {}
        for size in range(2, ORDER + 2):
            for gram, n in c.get(size, {}).items():
                ctx = split(gram >> 8, size - 1)
                own[ctx] = own.get(ctx, 0) + n
        for ctx, n in own.items():
            weight[ctx] = max(weight.get(ctx, 0), n)
    for k in range(1, ORDER + 1):
        contexts += sorted(ctx for ctx, n in weight.items() if len(ctx) == k and n >= LEAST_CONTEXT)
    number = {ctx: i for i, ctx in enumerate(contexts)}
    parent = np.array([0] + [number[next(ctx[j:] for j in range(1, len(ctx) + 1) if ctx[j:] in number)] for ctx in contexts[1:]])
    bits = np.empty((len(contexts) * a, len(langs)), dtype=np.float32)
    for at, c in enumerate(counts):
        table = np.zeros((len(contexts), a))
        for size in range(1, ORDER + 2):
            for gram, n in c.get(size, {}).items():
                sym = split(gram, size)
                if sym[:-1] in number:
                    table[number[sym[:-1]], sym[-1]] += n
        prob = np.empty_like(table)
        uniform = np.full(a, 1 / 256)
        uniform[-1] = max(1, 256 - len(seen)) / 256  # all unseen bytes together
        lengths = np.array([len(ctx) for ctx in contexts])
        for k in range(ORDER + 1):
            rows = np.flatnonzero(lengths == k)
            lower = np.broadcast_to(uniform, (len(rows), a)) if k == 0 else prob[parent[rows]]
            own = table[rows]
            total, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
            left = np.where(own > 0, 0, lower)
            rest = left.sum(axis=1, keepdims=True)
            full = np.maximum(total + kinds, 1)
            escape = np.where(total > 0, kinds / full, 1.0)
            prob[rows] = np.where(own > 0, own / full, escape * left / np.maximum(rest, 1e-300))
            done = (rest[:, 0] <= 1e-12) & (total[:, 0] > 0)  # every symbol was seen: no escape is needed
            prob[rows[done]] = (own / np.maximum(total, 1))[done]
        prob[:, -1] /= max(1, 256 - len(seen))  # of one byte among those never seen
        bits[:, at] = -np.log2(np.maximum(prob, 1e-30)).ravel()
    node = np.zeros((a,) * ORDER, dtype=np.int32)
    for ctx, i in zip(contexts, range(len(contexts))):  # longer ones overwrite shorter ones
        node[(slice(None),) * (ORDER - len(ctx)) + ctx] = i
    return Model(langs, code.astype(np.uint8 if a <= 256 else np.int64), node.ravel(), bits)


def learn(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """The model of all languages in ``docs`` (doc_id, lang, text)."""
    rows = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null and doc_id is not null")
    scale = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    size = F.octet_length("text")
    told = rows.groupBy("lang").agg(F.sum(size).alias("n"), F.min(F.when(size > 0, place)).alias("least")).collect()
    # at least one document of every language
    shares = {r.lang: max(r["least"] + 1, min(scale, int(scale * train_bytes / r.n))) for r in told if r.n}
    if not shares:
        return Model([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    share = F.create_map(*[F.lit(x) for item in sorted(shares.items()) for x in item])
    sample = rows.filter(place < share[F.col("lang")])
    found = count_grams(sample).toPandas()
    langs = sorted(found["lang"].unique())
    counts: list[dict[int, dict[int, int]]] = []
    for lang in langs:
        own = found[found["lang"] == lang]
        counts.append({int(s): dict(zip(p["gram"].tolist(), p["n"].tolist())) for s, p in own.groupby("size")})
    return build(langs, counts) if langs else Model([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))


def code_lengths(model: Model, items: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(items), len(model.langs)))
    a, most = model.symbols, max(1, PIECE // max(1, len(model.langs)))

    def add(rows: list[int], parts: list[bytes]) -> None:
        """Parts that each begin with the ORDER bytes before them."""
        x = model.code[np.frombuffer(b"".join(parts), dtype=np.uint8)].astype(np.int32)
        ctx = np.zeros(len(x) - ORDER, dtype=np.int32)
        for j in range(ORDER):
            ctx = ctx * a + x[j : len(x) - ORDER + j]
        cost = model.bits[model.node[ctx].astype(np.int64) * a + x[ORDER:]]
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        bounds = np.stack([starts, starts + sizes - ORDER], axis=1).ravel()  # what lies between two texts is left out
        if bounds[-1] >= len(cost):
            cost = np.vstack([cost, np.zeros((1, cost.shape[1]), cost.dtype)])
        out[rows] += np.add.reduceat(cost, bounds, axis=0, dtype=np.float64)[::2]

    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, data in enumerate(items):
        if not data:
            continue
        data = _HEAD + data
        if len(data) > most + ORDER:
            for lo in range(ORDER, len(data), most):
                add([i], [data[lo - ORDER : lo + most]])
            continue
        rows.append(i)
        parts.append(data)
        size += len(data)
        if size >= most:
            add(rows, parts)
            rows, parts, size = [], [], 0
    if rows:
        add(rows, parts)
    return out


def predict_texts(model: Model, items: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the winner's share of 2^-bits, all languages alike."""
    said = np.array([bool(_LETTER.search(t)) for t in items], dtype=bool)
    if not model.langs or not len(items):
        return [UND] * len(items), np.zeros(len(items))
    bits = code_lengths(model, [t.encode("utf-8") for t in items])
    best = bits.argmin(axis=1)
    gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
    score = np.where(said, 1 / np.exp2(-gap).sum(axis=1), 0.0)
    return [model.langs[k] if ok else UND for k, ok in zip(best, said)], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = predict_texts(shared.value, texts(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), step, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows whose hash allows it."""
    held_out = crc_mod("doc_id", 3) == 1
    found = predict(docs, learn(docs.filter(~held_out), train_bytes))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
