"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are word sequences (lower case, ASCII punctuation dropped). Windows of ``least``
words that a document shares with an item seed the comparison: a running polynomial hash (Karp-Rabin) over
the document's words meets the hashes of the items' windows. For each (document, item) with a seed, tiles
are marked greedily: the longest common run of unmarked words first, on both sides, down to ``least`` words.
As tiles may lie in any order, reordered passages are found as well. A document is contaminated if tiles
cover at least ``threshold`` of an item's words.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents
for each block, so its size is not bounded by a task's memory; an item longer than a block is a block alone.

Items shorter than ``least`` words match as a whole. Edge cases: null and empty texts match nothing; items
without words or with null id or text are passed over; repeated items and documents give a row each; a null
doc_id is kept in the hits. An empty benchmark or an empty table gives no hits. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockquorum.llm.common import map_batches, texts
from blockquorum.runtime import materialize

LEAST = 5
THRESHOLD = 0.5
BLOCK_BYTES = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split()


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def running_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of ``width`` word numbers."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    x, h = _mixed(ids), np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h = h * BASE + x[j : j + n]
    return h


class Items:
    """A block of the benchmark: word numbers, and where the windows of each item start."""

    def __init__(self, rows: list[tuple[int, str]], least: int = LEAST):
        self.least = least
        self.vocab: dict[bytes, int] = {}
        self.ids: list[tuple[int, np.ndarray]] = []
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            words = words_of(text or "")
            if item_id is None or not words:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64)
            width = min(least, len(ids))
            for at, h in enumerate(running_hash(ids, width).tolist()):
                self.seeds[width][h].append((len(self.ids), at))
            self.ids.append((int(item_id), ids))
        self.seeds = {w: dict(t) for w, t in self.seeds.items()}
        self.hashes = {w: np.array(sorted(t), dtype=np.uint64) for w, t in self.seeds.items()}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def shared_seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item number -> (place in the document, place in the item) of every shared window."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for width, table in self.hashes.items():
            full = np.flatnonzero(known[width:] - known[:-width] == width) if len(ids) >= width else []
            if not len(full):
                continue
            h = running_hash(ids, width)[full]
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for place, code in zip(full[table[at] == h].tolist(), h[table[at] == h].tolist()):
                for k, start in self.seeds[width][code]:
                    found[k].append((place, start))
        return found


def tile(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from shared windows: (place in doc, place in item, length) of every tile.

    Seeds on one diagonal that follow each other are one maximal run, so runs are found once; when a
    longer tile marks part of a run, the unmarked rests go on. Longest first; ties go to the run that
    starts first in the document, then in the item.
    """
    width = min(least, len(item))
    runs, by_diagonal = [], defaultdict(list)
    for d, i in set(seeds):
        if (doc[d : d + width] == item[i : i + width]).all():  # a hash may collide
            by_diagonal[d - i].append(d)
    for diagonal, places in by_diagonal.items():
        places.sort()
        first = last = places[0]
        for d in places[1:]:
            if d != last + 1:
                runs.append((first, first - diagonal, last - first + width))
                first = d
            last = d
        runs.append((first, first - diagonal, last - first + width))
    by_size: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for d, i, n in runs:
        by_size[n].add((d, i))
    doc_free, item_free, tiles = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool), []
    size = max(by_size, default=0)
    while size >= width:
        for d, i in sorted(by_size.pop(size, ())):
            free = doc_free[d : d + size] & item_free[i : i + size]
            if free.all():
                tiles.append((d, i, size))
                doc_free[d : d + size] = False
                item_free[i : i + size] = False
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if hi - lo >= width:
                    by_size[hi - lo].add((d + lo, i + lo))
        size -= 1
    return tiles


def hits_of(items: Items, text: str, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item_id, coverage, tiles, longest) of every item that a text covers enough of."""
    ids, out = items.numbers(words_of(text)), []
    for k, seeds in sorted(items.shared_seeds(ids).items()):
        item_id, item = items.ids[k]
        tiles = tile(ids, item, seeds, items.least)
        covered = sum(n for *_, n in tiles) / len(item)
        if tiles and covered >= threshold:
            out.append((item_id, covered, len(tiles), max(n for *_, n in tiles)))
    return out


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(100)
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = -(-total * 2 // BLOCK_BYTES)  # twice as many as needed: a hash does not deal evenly
    if n <= 1:
        return [benchmark] if total else []
    return [benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest): documents that cover ``threshold`` of an item."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, coverage double, tiles int, longest int"

    def one(block: DataFrame) -> DataFrame:
        rows = [(r.item_id, r.text) for r in block.select("item_id", "text").collect()]  # bounded by BLOCK_BYTES
        shared = spark.sparkContext.broadcast(Items(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), least))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = [(i, *hit) for i, t in enumerate(texts(batch)) for hit in hits_of(shared.value, t, threshold)]
            if not found:
                return None
            at, item, covered, tiles, longest = zip(*found)
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array(item, pa.int64()), pa.array(covered), pa.array(tiles, pa.int32()), pa.array(longest, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "coverage", "tiles", "longest"])

        return map_batches(docs.select("doc_id", "text"), step, schema)

    parts = [one(b) for b in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item. Rows with a null id are judged by their text."""
    hits = materialize(contaminated(docs, benchmark, least, threshold).select("doc_id").distinct(), "leaks")
    clean = docs.join(hits.filter("doc_id is not null"), "doc_id", "left_anti").select(docs.columns)
    if not hits.filter("doc_id is null").limit(1).count():
        return clean
    nameless = docs.filter("doc_id is null").withColumn("doc_id", F.xxhash64("text"))
    bad = contaminated(nameless, benchmark, least, threshold).select("doc_id").distinct()
    null = F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    good = nameless.join(bad, "doc_id", "left_anti").select(*[null if c == "doc_id" else F.col(c) for c in docs.columns])
    return clean.filter("doc_id is not null").unionByName(good)
