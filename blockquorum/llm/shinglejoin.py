"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share, exactly.

Sets of one size band meet in tiles. Band k holds the sizes from which no partner can lie beyond band k + 1;
tile k compares sets of band k with each other and with those of band k + 1. Two linked sets of a tile differ
in at most D hashes, so of D + 1 + z parts of the hash range they agree in z + 1 or more. A set gives the keys
of all parts but its z smallest, in an order common to all sets; of the agreed parts the foremost is given by both.
So linked sets share a key, and sets that merely share a passage seldom do.

Within a key the sets lie in order of size. First each is compared with the next one, which joins groups of
near copies whatever their size; the pairs come from a sort by ranges, so one key may span many tasks. Keys that
still hold sets of several components become tiles, in which bitmaps meet: first every set is paired with the
one of another component that is nearest by bitmaps, and in keys that are mixed even then, with all. Tiles are cut
into blocks bounded in bytes, where the blocks of the largest component meet only those of other ones. So work is
quadratic only in sets of one key that stay apart.

A comparison looks at sizes, then at hashed bitmaps: a bit holds the parity of the hashes that fall on it, so
every bit in which two bitmaps differ is at least one hash in one set only, and half of what is left of both
sizes bounds the overlap from above. Pairs that pass go to the sorted hashes, whose intersection decides.

Sets are made from whole texts; 64-bit hashes stand for the shingles. Equal sets are one class with one member in
the join. Hashes are kept for sets that share a key with another only; they are made again from the texts of
those. Nothing is written but to the shared folder, so lost executors cost their tasks alone.

Edge cases: a null text or one without words has the empty set and is linked with nothing, its component is its
own id. Fewer words than a shingle: the whole sequence is one shingle. Rows with a null id are linked like
others, but a null never is the smallest id (a group of only null ids has a null component). Rows that repeat are
kept as rows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockquorum.llm.common import components, in_arrow, map_batches, texts
from blockquorum.runtime import materialize

PERCENT = 85
TILE_BYTES = 8_000_000  # of bitmaps in one block of a tile
BITS_A_HASH = 4  # in a bitmap, rounded up to a power of two
KEYS_TOGETHER = 1_000_000  # keys that one task sorts
PIECE = 1 << 16  # shingles hashed together
KEEP_ALWAYS = 3  # members of a key from which comparing neighbours may not be all


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined)], dtype=np.uint64)
    ends, at = [0], 0
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = len(words) - size + 1
    parts = [
        np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip(ends[lo : min(n, lo + PIECE)], ends[lo + size :])], dtype=np.uint64))
        for lo in range(0, n, PIECE)
    ]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Bands:
    """Size bands for a link from ``percent`` per cent on, as far as sizes of 2^40."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50 and up to 100")
        self.percent = percent
        firsts = [1] if percent < 100 else [1, 1 << 40]  # only equal sets are linked: one band
        while firsts[-1] < 1 << 40:
            firsts.append(firsts[-1] * 100 // percent + 1)
        self.firsts = np.array(firsts)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.firsts, size, side="right")) - 1

    def differ(self, tile: int) -> int:
        """How many hashes two linked sets of a tile may have in one of them only."""
        top = int(self.firsts[tile + 1]) - 1
        return (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def tiles(self, size: int) -> list[int]:
        """The tiles in which a set of this size can meet a different one that it is linked with."""
        own = self.of(size)
        found = [own]
        if own and size <= (int(self.firsts[own]) - 1) * 100 // self.percent:
            found.append(own - 1)
        return [t for t in found if self.differ(t)]


def keys_of(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys that a set gives: all its parts but the smallest ones, for each of its tiles."""
    out = [np.zeros(0, dtype=np.uint64)]
    sums = np.append(np.uint64(0), np.cumsum(_mix(hashes)))  # modulo 2^64, so differences are sums of parts
    high = hashes >> np.uint64(32)
    for tile in bands.tiles(len(hashes)):
        differ = bands.differ(tile)
        parts = differ + 1 + differ // 8 + 1
        of = (high * np.uint64(parts)) >> np.uint64(32)  # rises with the hash
        ends = np.searchsorted(of, np.arange(1, parts + 1, dtype=np.uint64))
        sizes = np.diff(ends, prepend=0)
        place = np.arange(parts, dtype=np.uint64) + np.uint64(tile << 40)
        keys = _mix((sums[ends] - sums[ends - sizes]) ^ _mix(place * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)))
        out.append(keys[np.lexsort((keys, -sizes))[: differ + 1]])
    return np.concatenate(out)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap, a power of two of bits (64 at least): parities of the hashes that fall on each."""
    width = max(64, 1 << (BITS_A_HASH * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set that has ``size`` bytes."""
    return bits if len(bits) == size else np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def enough(overlap: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Is an overlap of sets, of ``both`` hashes in sum, a link?"""
    return 100 * overlap >= percent * (both - overlap)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, bits_a: np.ndarray, b: np.ndarray, bits_b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    size = min(len(bits_a), len(bits_b))
    apart = int(np.bitwise_count(folded(bits_a, size) ^ folded(bits_b, size)).sum())
    return bool(enough((both - apart) // 2, both, percent)) and bool(enough(overlap(a, b), both, percent))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def describe(docs: DataFrame, size: int = 4, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n, f1, f2, keys) of every row: hash of the text, size of its set, 128-bit hash of the set, keys."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bands, n, first, second, keys, ends = Bands(percent), [], [], [], [], [0]
        for text in texts(batch, text_col):
            own = shingles(text, size)
            f = xxhash.xxh3_128_digest(own.tobytes())
            n.append(len(own))
            first.append(int.from_bytes(f[:8], "little", signed=True))
            second.append(int.from_bytes(f[8:], "little", signed=True))
            keys.append(keys_of(own, bands) if len(own) else np.zeros(0, dtype=np.uint64))
            ends.append(ends[-1] + len(keys[-1]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
        made = [batch.column("th"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *made], names=["doc_id", "th", "n", "f1", "f2", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, _text_hash(text_col).alias("th"))
    return map_batches(rows, step, f"doc_id {kind}, th bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (k, n, node) in order: kind 0 (k, a, b), sets next to each other in a key; kind 1 (k, a, size), the
    members of keys with ``KEEP_ALWAYS`` or more; kind 2 (k, a, place), first and last row of the task."""
    names, task = ["kind", "k", "a", "b"], TaskContext.get().partitionId()

    def rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(columns[0]), kind, dtype=np.int8))
        return pa.RecordBatch.from_arrays([kinds, *[pa.array(np.asarray(c, dtype=np.int64)) for c in columns]], names=names)

    held = np.zeros((3, 0), dtype=np.int64)  # the open key's rows so far, or its last row if it has given its members
    wide, begun = None, False  # the open key, if it has given its members
    for batch in batches:
        new = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
        if not new.shape[1]:
            continue
        if not begun:
            yield rows(2, new[0, :1], new[2, :1], [2 * task])
            wide, begun = int(new[0, 0]), True  # the key may have begun in an earlier task
        k, n, node = rows_now = np.hstack([held, new])
        same = np.flatnonzero(k[1:] == k[:-1])
        if len(same):
            yield rows(0, k[same], node[same], node[same + 1])
        cuts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        lengths = np.diff(np.append(cuts, len(k)))
        give = np.repeat((lengths >= KEEP_ALWAYS) | (k[cuts] == wide), lengths)
        if wide is not None and held.shape[1] and held[0, -1] == wide:
            give[: held.shape[1]] = False  # given before
        if give.any():
            yield rows(1, k[give], node[give], n[give])
        open_wide = lengths[-1] >= KEEP_ALWAYS or k[-1] == wide
        wide = int(k[-1]) if open_wide else None
        held = rows_now[:, -1:] if open_wide else rows_now[:, cuts[-1] :]
    if begun:
        if wide is None:  # the key may go on in the next task
            yield rows(1, held[0], held[2], held[1])
        yield rows(2, held[0, -1:], held[2, -1:], [2 * task + 1])


def neighbours(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of sets next to each other in a key, a < b; members (k, node, n) of the keys of three or more)."""
    total = classes.agg(F.sum(F.size("keys").cast("bigint"))).first()[0] or 0
    rows = classes.select(F.explode("keys").alias("k"), "n", "node")
    dealt = rows.repartitionByRange(max(1, -(-total // KEYS_TOGETHER)), "k", "n", "node").sortWithinPartitions("k", "n", "node")
    found = materialize(in_arrow(dealt, _neighbours, "kind tinyint, k bigint, a bigint, b bigint"), "neighbours")
    # two rows a task: where a key goes on in the next one
    before = Window.partitionBy("k").orderBy("b")
    across = found.filter("kind = 2").select(F.lag("a").over(before).alias("a"), F.col("a").alias("b")).filter("a <> b")
    pairs = found.filter("kind = 0").select("a", "b").unionByName(across)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(pairs, "pairs"), found.filter("kind = 1").select("k", F.col("a").alias("node"), F.col("b").alias("n"))


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, hashes, bits) of the classes ``wanted`` (node, least, th), made from the text of one of their rows."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t, size) for t in texts(batch)]
        columns = [pa.array([x.tobytes() for x in own], pa.binary()), pa.array([bitmap(x).tobytes() for x in own], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=["node", "hashes", "bits"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("th"))
    one = rows.alias("r").join(wanted.alias("w"), F.expr("r.th = w.th AND r.doc_id <=> w.least")).groupBy("w.node").agg(F.first("r.text").alias("text"))
    return map_batches(one, step, "node bigint, hashes binary, bits binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are links."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, bits_a, bits_b = ([np.frombuffer(x.as_buffer(), dtype=kind) for x in batch.column(c)] for c, kind in (("ha", "u8"), ("hb", "u8"), ("ba", "u1"), ("bb", "u1")))
        keep = pa.array([linked(*x, percent) for x in zip(a, bits_a, b, bits_b)], pa.bool_())
        return batch.select(["a", "b"]).filter(keep)

    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("bits").alias("ba"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("bits").alias("bb"))
    return map_batches(pairs.join(first, "a").join(second, "b").select("a", "b", "ha", "hb", "ba", "bb"), step, "a bigint, b bigint")


def tile_pairs(tile: pa.Table, percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different components in one tile that their sizes and bitmaps let be links; with
    ``nearest`` of each set only the one with the most similar set. Sets of one block are compared only if the
    tile is that block alone."""
    tile = tile.sort_by([("n", "ascending"), ("node", "ascending")]).combine_chunks()
    n, root, node, side = (tile[c].to_numpy() for c in ("n", "root", "node", "block"))
    alone = tile["i"][0].as_py() == tile["j"][0].as_py()
    raw = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in tile["bits"].combine_chunks()]
    least = min(len(x) for x in raw)
    bits = np.stack([folded(x, least) for x in raw]).view(np.uint64)
    one, two = [], []
    for at in range(len(n)):
        first = int(np.searchsorted(n, -(-n[at] * percent // 100))) if nearest else at + 1
        others = np.arange(first, int(np.searchsorted(n, n[at] * 100 // percent, side="right")))
        others = others[(root[others] != root[at]) & (alone | (side[others] != side[at]))]
        apart = np.bitwise_count(bits[others] ^ bits[at]).sum(axis=1, dtype=np.int64)
        both = n[others] + n[at]
        passed = np.flatnonzero(enough((both - apart) // 2, both, percent))
        if nearest and len(passed):
            passed = passed[[apart[passed].argmin()]]
        one.append(np.full(len(passed), node[at]))
        two.append(node[others[passed]])
    return np.concatenate(one), np.concatenate(two)


def mixed_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame, nearest: bool, percent: int = PERCENT, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Pairs (a, b) of sets that share a key, belong to different components (``roots``: node, root; others are their
    own) and may be links."""
    rooted = members.join(roots, "node", "left").select("k", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    parts = rooted.groupBy("k", "root").agg(F.sum("n").alias("n"))
    keys = parts.groupBy("k").agg(F.count("*").alias("c"), F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("large"), F.sum("n").alias("n_all"))
    whole = F.col("n_all") * BITS_A_HASH / 8 <= tile_bytes
    blocks = lambda n: F.ceil(n * BITS_A_HASH / F.lit(8 * tile_bytes))
    keys = keys.filter("c > 1").select(
        "k", "major", F.when(whole, 0).otherwise(blocks(F.col("large"))).alias("m"), F.when(whole, 1).otherwise(blocks(F.col("n_all") - F.col("large"))).alias("o")
    )
    rows = rooted.join(keys, "k")
    is_major = (F.col("root") == F.col("major")) & (F.col("m") > 0)
    draw = F.xxhash64("node")
    block = F.when(is_major, F.pmod(draw, F.greatest("m", F.lit(1)))).otherwise(F.col("m") + F.pmod(draw, F.col("o")))
    others = F.sequence(F.when(is_major, F.col("m")).otherwise(F.lit(0)).cast("bigint"), (F.col("m") + F.col("o") - 1).cast("bigint"))
    placed = rows.withColumn("block", block.cast("bigint")).withColumn("with", F.explode(others))
    placed = placed.select("k", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "root", "n")

    def compare(tile: pa.Table) -> pa.Table:
        a, b = tile_pairs(tile, percent, nearest)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    found = placed.join(sets.select("node", "bits"), "node").groupBy("k", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return materialize(found.distinct(), "pairs")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = PERCENT, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text): the smallest id that can be reached
    over links of sets whose intersection has ``percent`` or more per cent of their union."""
    own = materialize(describe(docs, size, percent), "described")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = own.filter("n > 0").groupBy("f1", "f2").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", F.col("rep.doc_id").alias("least"), F.col("rep.th").alias("th"), "n", "keys")
    classes = materialize(classes, "classes")
    pairs, members = neighbours(classes)
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialize(sets_of(docs, classes.select("node", "least", "th").join(met, "node"), size), "sets")
    links = materialize(verified(pairs, sets, percent), "verified")
    roots = components(links)
    for nearest in (True, False):
        pairs = mixed_pairs(members, roots, sets, nearest, percent, tile_bytes)
        if pairs.isEmpty():  # then there are none to compare with all either
            break
        more = materialize(verified(pairs, sets, percent), "verified")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    rooted = classes.join(roots, "node", "left").select("f1", "f2", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "classes")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(smallest, "root").select("f1", "f2", "component_id")
    filled = own.filter("n > 0").select("doc_id", "n", "f1", "f2").join(labels, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
