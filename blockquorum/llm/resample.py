"""Importance resampling towards a target: hashed n-gram features, a weight per document, a seeded draw.

A text is lower-cased (A-Z) and cut into words: runs of digits, small letters and characters beyond ASCII.
Features are its words and pairs of neighbouring words (joined by one space), repeats counted; a feature's
bucket is the crc32 of its bytes modulo the number of buckets. Counts over all documents and over all target
texts give each bucket a gain, the floored log ratio of the smoothed shares; a document's weight is the
floored mean gain of its features. A Gumbel number from the hash of the id is added, and the highest
scores are drawn: sampling without replacement in proportion to the exponential of the weight.

The crc32 of all features of an Arrow batch is found at once. It is linear over XOR: a byte at a distance
from the end of its span adds a fixed 32-bit value, which a table holds by distance and byte, and the
length adds a constant. So the values of all bytes are looked up and XORed with
``bitwise_xor.reduceat`` over the spans. A pair of words is the first word with its space, at the distances
that the second adds, XORed with the second word's own value. Spans longer than the table are cut into
blocks from their end, and each block's value is carried over the following ones.

Only bucket counts and score counts reach the driver; they are bounded by the number of buckets and by the
range of the rounded logarithms, not by the input.

Edge cases: a null text has no words; no features: weight 0; a null id is hashed as the text of no digits and
is ordered last; rows with equal ids keep rows of their own, with ranks in turn; an empty table or target
gives smoothed gains of zero counts; texts of any length count whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from blockquorum.llm.common import in_arrow, map_batches
from blockquorum.runtime import materialize

BUCKETS = 10_000
SPAN = 64  # bytes that the table holds; longer spans fold in blocks of it
TOGETHER = 1 << 20  # bytes of texts that are hashed at once; a longer text goes alone
POLYNOMIAL = 0xEDB88320  # of the crc32 of zlib, lowest bit first


def _byte_table() -> np.ndarray:
    """What one byte turns the register into, from zero."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


BYTES = _byte_table()


def _after_zero(register: np.ndarray) -> np.ndarray:
    """Registers after one more byte of zero."""
    return (register >> 8) ^ BYTES[register & 0xFF]


def _position_table() -> np.ndarray:
    """By distance from the end of a span and byte: what the byte adds to the register."""
    rows = [BYTES]
    for _ in range(SPAN - 1):
        rows.append(_after_zero(rows[-1]))
    return np.stack(rows)


def _block_shift() -> np.ndarray:
    """By byte of a register (4) and its value: that byte's share after SPAN bytes of zero."""
    values = np.arange(256, dtype=np.uint32)
    out = [values << np.uint32(8 * k) for k in range(4)]
    for _ in range(SPAN):
        out = [_after_zero(x) for x in out]
    return np.stack(out)


POSITIONS, SHIFT = _position_table(), _block_shift()


class _Lengths:
    """By length: what the start value and the final complement add to the crc32."""

    def __init__(self) -> None:
        self.table = np.zeros(0, dtype=np.uint32)

    def upto(self, n: int) -> np.ndarray:
        if n >= len(self.table):
            size = max(n + 1, 2 * len(self.table), 256)
            register, rows, table = 0xFFFFFFFF, [], BYTES.tolist()
            for _ in range(size):
                rows.append(register ^ 0xFFFFFFFF)
                register = (register >> 8) ^ table[register & 0xFF]
            self.table = np.array(rows, dtype=np.uint32)
        return self.table


_lengths = _Lengths()


def fold(data: np.ndarray) -> int:
    """The register that the bytes of a span of any length add up to: blocks of SPAN, each carried over the next."""
    table, shift = POSITIONS, SHIFT
    head = len(data) % SPAN
    register = np.uint32(0)
    if head:
        register = np.bitwise_xor.reduce(table[np.arange(head - 1, -1, -1), data[:head]])
    blocks = data[head:].reshape(-1, SPAN)
    if len(blocks):
        sums = np.bitwise_xor.reduce(table[np.arange(SPAN - 1, -1, -1)[None, :], blocks], axis=1)
        for own in sums:
            r = int(register)
            register = shift[0, r & 255] ^ shift[1, r >> 8 & 255] ^ shift[2, r >> 16 & 255] ^ shift[3, r >> 24] ^ own
    return int(register)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """(each byte in lower case, whether it belongs to a word)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    of_word = np.zeros(256, dtype=bool)
    of_word[ord("0") : ord("9") + 1] = of_word[ord("a") : ord("z") + 1] = of_word[128:] = True
    return lower, of_word[lower]


LOWER, OF_WORD = _byte_classes()


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, the place where each starts and the last ends); nulls are empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case of all words, each with one byte of space after it; where each word starts, and the
    end; how many words each text has)."""
    data, offsets = _text_bytes(column)
    inside = OF_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]  # a word does not reach over the end of its text
    starts = np.flatnonzero(begins)
    ends = np.append(np.cumsum(inside), 0)  # word bytes up to each place
    before = ends[starts] - 1 if len(starts) else np.zeros(0, dtype=np.int64)  # word bytes before each word
    number = np.arange(len(starts))
    total = int(inside.sum())
    places = np.append(before + number, total + len(starts))
    joined = np.full(places[-1], ord(" "), dtype=np.uint8)
    which = np.cumsum(begins)[inside] - 1
    joined[np.arange(total) + which] = LOWER[data[inside]]
    counts = np.diff(np.searchsorted(starts, offsets))
    return joined, places, counts


def feature_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(crc32 of every feature: for each word itself and, after it, the pair that it starts; number of features
    of each text), the features of a text lying together."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    found = [_hashes(column.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    joined, places, counts = words_of(column)
    n = len(places) - 1
    if not n:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(column), dtype=np.int64)
    table = POSITIONS
    starts, sizes = places[:-1], np.diff(places) - 1
    following = np.append(sizes[1:], 0)
    ends = np.repeat(places[1:] - 1, sizes + 1)  # of the word that a byte belongs to; its space lies at that place
    away = ends - np.arange(len(joined)) - 1
    own = table[np.clip(away, 0, SPAN - 1), joined]
    own[away < 0] = 0  # the space
    word = np.bitwise_xor.reduceat(own, starts)
    away += np.repeat(following, sizes + 1) + 1
    first = np.bitwise_xor.reduceat(table[np.minimum(away, SPAN - 1), joined], starts)
    pair = first ^ np.append(word[1:], np.uint32(0))
    long_word = np.flatnonzero(sizes > SPAN)
    for i in long_word:
        word[i] = fold(joined[starts[i] : starts[i] + sizes[i]])
    spans = sizes + 1 + following
    last = np.cumsum(counts)[counts > 0] - 1  # starts no pair
    paired = np.ones(n, dtype=bool)
    paired[last] = False
    for i in np.flatnonzero((spans > SPAN) & paired):
        pair[i] = fold(joined[starts[i] : starts[i] + spans[i]])
    lengths = _lengths.upto(int(spans.max()))
    both = np.empty(2 * n, dtype=np.uint32)
    both[0::2] = word ^ lengths[sizes]
    both[1::2] = pair ^ lengths[spans]
    keep = np.ones(2 * n, dtype=bool)
    keep[1::2] = paired
    return both[keep], np.where(counts > 0, 2 * counts - 1, 0)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket. Each task adds up its own and gives one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            hashes, _ = feature_hashes(batch.column(0))
            sums += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(sums)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(sums[met])], names=["bucket", "n"])

    rows = in_arrow(docs.select(text_col), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=int)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log of its share in the target against that in the raw texts, one feature added
    to each bucket, floored."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    found = [
        math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n))))
        for a, b in zip(raw.tolist(), target.tolist())
    ]
    return np.array(found, dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row; ``weight`` is the floored mean gain."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, n = feature_hashes(batch.column(text_col))
        ends = np.append(0, np.cumsum(gain[hashes % np.uint32(len(gain))]))
        at = np.cumsum(n)
        weight = (ends[at] - ends[at - n]) // np.maximum(n, 1)
        made = [pa.array((n + 1) // 2), pa.array(n), pa.array(weight)]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *made], names=[id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), step, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: the place among the rows drawn, null for all others. Of the rows
    with ``least_words`` or more, ``percent`` in a hundred are drawn, those of the highest scores, on ties of
    the smaller id.

    Rows are counted per score first; only rows of one score are ordered among themselves, and the number
    of rows above comes from the counts. Scores are whole numbers within some 100,000 of zero, whatever the input.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel), "scored")
    counts = scored.filter(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    drawn = percent * int(counts["n"].sum()) // 100
    counts["above"] = counts["n"].cumsum() - counts["n"]
    counts = counts[counts["above"] < drawn]
    lowest = int(counts["score"].iloc[-1]) if len(counts) else None
    spark = weighed.sparkSession
    placed = spark.createDataFrame(pa.table({"score": counts["score"].to_numpy("int64"), "above": counts["above"].to_numpy("int64")}))
    able = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last(id_col), "n_features", "weight")
    ranked = scored.filter(able).withColumn("place", F.row_number().over(within)).join(placed, "score")
    rank = F.col("above") + F.col("place")
    ranked = ranked.withColumn("rank", F.when(rank <= drawn, rank).cast("bigint"))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [*weighed.columns, "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards ``target`` (text)."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(weigh(docs, gain), percent, least_words, seed)
