"""SimHash fingerprints and their exact near-duplicate join by the generalised pigeonhole principle.

The 64 bits are dealt into parts of correlated bits. With part thresholds that sum to
``max_bits - parts + 1`` (a part may have -1: it is not probed), two fingerprints within
``max_bits`` agree in at least one part up to that part's threshold. A part is probed by grouping
on its bits with every choice of ``threshold`` bits blanked out. Number of parts and thresholds
come from a dynamic program over the expected rows and candidate pairs, which a mergeable sketch
over all fingerprints estimates. Candidates are verified on all 64 bits.

Edge cases: a null text counts as empty; a text without words has fingerprint zero; rows with a null
id get a fingerprint and a component like others, but a null never is the smallest id (a group of only
null ids has a null component). Repeated ids are kept as rows. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from blockquorum.llm.common import components, Forest, in_arrow, map_batches, texts
from blockquorum.runtime import materialize

BITS = 64
SEED = 42
SKETCH = 1024  # counters of a candidate sketch: about 4% relative error
BLOCK = 4096  # members of a bucket that are compared in one piece
PAIR_COST = 0.02  # of comparing a pair, against shuffling a row
_FULL = (1 << BITS) - 1


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of a text: a bit is set if over half of the shingles' hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [0], 0
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    counts, n = np.zeros(BITS, dtype=np.int64), len(words) - shingle + 1
    for lo in range(0, n, 1 << 16):  # memory stays bounded for the longest text
        hi = min(n, lo + (1 << 16))
        h = [digest(joined[a : b - 1], SEED) for a, b in zip(ends[lo:hi], ends[lo + shingle : hi + shingle])]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row; fp holds the 64 bits as a signed number."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts(batch, text_col)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), step, f"{id_col} {kind}, fp bigint")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            x = np.asarray(batch.column(0)).astype(np.int64).view(np.uint8).reshape(-1, 8)
            m = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            both += (m.T @ m).astype(np.int64)
            n += len(m)
        if n:
            at = np.arange(BITS * BITS + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n))], names=["at", "n"])

    sums = in_arrow(fps.select("fp"), run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(BITS * BITS + 1, dtype=np.int64)
    flat[sums["at"].to_numpy(dtype=int)] = sums["n"].to_numpy()
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def bit_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into parts of near equal width, each grown by the bit most correlated with it."""
    p = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs(cov / np.outer(dev, dev))
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        rest = sorted(left)
        first = max(rest, key=lambda b: (link[b, rest].sum(), -b))
        part = [first]
        left.discard(first)
        while len(part) < width:
            best = max(sorted(left), key=lambda b: (link[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def _masks(part: list[int], blank: int) -> list[int]:
    whole = sum(1 << b for b in part)
    return [whole & ~sum(1 << b for b in drop) & _FULL for drop in combinations(part, blank)]


def _pairs(fps: DataFrame, choices: dict[tuple, list[int]]) -> dict[tuple, float]:
    """Estimated pairs of fingerprints with equal keys for each list of masks: signed counters over
    all rows, whose squares estimate the sum of squared group sizes."""
    order = sorted(choices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(order), SKETCH), dtype=np.float64)
        for batch in batches:
            x = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for c, key in enumerate(order):
                for k, mask in enumerate(choices[key]):
                    h = _mix((x & np.uint64(mask)) + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & _FULL))
                    sign = (h >> np.uint64(63)).astype(np.float64) * 2 - 1
                    sums[c] += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), weights=sign, minlength=SKETCH)
        at = np.arange(sums.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], names=["at", "x"])

    got = in_arrow(fps.select("fp"), run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(len(order) * SKETCH)
    flat[got["at"].to_numpy(dtype=int)] = got["x"].to_numpy()
    squares = (flat.reshape(len(order), SKETCH) ** 2).sum(axis=1)
    return dict(zip(order, squares))


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per part, that sum to ``total`` at the least cost: dynamic program over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in options.items():
                if spent + t not in grown or cost + c < grown[spent + t][0]:
                    grown[spent + t] = (cost + c, [*chosen, t])
        best = grown
    return best.get(total, (float("inf"), []))


def plan_masks(fps: DataFrame, max_bits: int) -> list[int]:
    """The masks to group distinct fingerprints by: every pair within ``max_bits`` agrees under one."""
    n, both = _bit_counts(fps)
    layouts = {m: bit_parts(n, both, m) for m in range(max(1, (max_bits + 1) // 2), max_bits + 2)}
    most = 600  # keys of one fingerprint in one part that are worth thinking about
    choices = {
        (m, k, t): _masks(part, t)
        for m, parts in layouts.items()
        for k, part in enumerate(parts)
        for t in range(max_bits + 1)
        if t <= max_bits - m + 1 and comb(len(part), t) <= most
    }
    squares = _pairs(fps, choices)
    plans = []
    for m, parts in layouts.items():
        costs = []
        for k in range(m):
            options = {-1: 0.0}
            for t in range(max_bits + 1):
                if (m, k, t) in choices:
                    rows = n * len(choices[m, k, t])
                    options[t] = rows + PAIR_COST * max(0.0, squares[m, k, t] - rows) / 2
            costs.append(options)
        cost, thresholds = allocate(costs, max_bits - m + 1)
        if thresholds:
            plans.append((cost, m, thresholds))
    _, m, thresholds = min(plans)
    return [mask for k, t in enumerate(thresholds) if t >= 0 for mask in choices[m, k, t]]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of equal keys: (fp, fp of its root) of every linked row that is no root."""
    forest, n = Forest(len(keys)), len(keys)
    for shift in range(1, n):
        i = np.flatnonzero(keys[:-shift] == keys[shift:])
        if not len(i):
            break
        near = np.bitwise_count(fps[i] ^ fps[i + shift]) <= max_bits
        forest.join(i[near], i[near] + shift)
    moved = np.flatnonzero(forest.root != np.arange(n))
    return fps[moved], fps[forest.root[moved]]


def _verify(max_bits: int, block: int):
    """Arrow step over rows (k, fp) sorted by k: links within each key. A key with more than ``block``
    members gives its rows back, numbered in blocks, to be compared block against block."""
    names = ["a", "b", "k", "block"]

    def linked(k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        a, b = _links(k, x, max_bits)
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], names=names)

    def heavy(key: int, x: np.ndarray, first: int) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        at = (np.arange(first, first + len(x)) // block).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), none, pa.array(np.full(len(x), key, dtype=np.int64)), pa.array(at)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, given = None, 0  # the key whose members are being given back, and how many were
        k0, x0 = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = np.concatenate([k0, np.asarray(batch.column(0)).astype(np.int64)])
            x = np.concatenate([x0, np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)])
            if not len(k):
                continue
            cuts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            last = cuts[-1]
            sizes = np.diff(np.append(cuts, len(k)))
            light = np.ones(len(k), dtype=bool)
            light[last:] = False
            for c in np.flatnonzero((sizes > block) | (k[cuts] == (hot if hot is not None else k[0] - 1))):
                lo, hi = cuts[c], cuts[c] + sizes[c]
                given = given if hot is not None and k[lo] == hot else 0
                hot = int(k[lo])
                yield heavy(hot, x[lo:hi], given)
                given += hi - lo
                light[lo:hi] = False
                if c == len(cuts) - 1:
                    last = len(k)
            if light.any():
                yield linked(k[light], x[light])
            k0, x0 = k[last:], x[last:]
        if len(k0):
            yield linked(k0, x0)

    return run


def near_links(fps: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fps`` (fp long) within ``max_bits``:
    one row per member and key at most, not one per pair."""
    masks = plan_masks(fps, max_bits)
    key = lambda i, m: F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m))))
    rows = fps.select(F.explode(F.array(*[key(i, m) for i, m in enumerate(masks)])).alias("k"), "fp")
    schema = "a bigint, b bigint, k bigint, block bigint"
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = materialize(in_arrow(rows.repartition(n, "k").sortWithinPartitions("k", "fp"), _verify(max_bits, block), schema), "links")
    light = first.filter("k is null").select("a", "b")
    hot = first.filter("k is not null").select("k", "block", F.col("a").alias("fp"))
    counts = hot.groupBy("k").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))
    pairs = hot.join(counts, "k").select("k", "block", "fp", other.alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    pairs = pairs.select(F.xxhash64("k", lo, hi).alias("k"), "fp").repartition(n, "k").sortWithinPartitions("k", "fp")
    more = in_arrow(pairs, _verify(max_bits, 4 * block), schema).filter("k is null").select("a", "b")
    return light.unionByName(more)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that can be reached over links of ``max_bits`` or
    fewer differing bits. One row per row of ``docs``."""
    own = materialize(fingerprints(docs, shingle), "fingerprints")
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(near_links(least.select("fp"), max_bits, block))
    rooted = least.join(groups, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; repeated rows of it count as one.
    Rows with a null id cannot be told apart and stay."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle, max_bits)
    kept = materialize(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies")), "kept")
    repeated = kept.filter("copies > 1").limit(1).count() > 0
    # the ids kept grow with the documents, so this is a sorted join at every size
    stay = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if repeated:
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter("doc_id is null")).select(docs.columns)
