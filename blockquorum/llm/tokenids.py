"""Token ids as binary shards, with a minimal perfect hash index from document keys to shard offsets.

Documents are dealt into ranges of their id, encoded there, and written in id order as shard files of
about ``SHARD_BYTES``. Each shard holds its own index, so no task holds more than one shard. The index
is a minimal perfect hash (hash, displace): a key's bucket gives a displacement, which with the key's hash
gives its slot; the slot holds the key's fingerprint and the place of its document. Finding a document
takes the same few steps in a shard of any size, and an unknown key is told by its fingerprint (a false hit
has odds of 2^-64).

Shard file (``part-<task>-<number>.tok``), little-endian:
  8 bytes ``TOKSHRD1``; u64 item size (2 or 4: the least that holds the vocabulary), end id, documents n,
  ids m, hash seed, buckets b; then i64 key[n] and u32 repeat[n] (bit 31: the key is null) in document order;
  i32 displacement[b]; u64 fingerprint[n] and u32 document[n] by slot; u64 offset[n + 1]; ids[m].

Files are written to a temporary name and moved, under a name that only depends on the task, so a
task that is run again after a lost executor replaces its file by the same bytes. The folder must be one
that all tasks reach by ``pyarrow.fs`` (spark.checkpoint.dir by default); files are read back by Spark.

Edge cases: a null text counts as empty, so its document is the end id alone; null ids sort first; rows with
the same id stay as documents of their own, ordered by text, with the key (id, number of the repeat within
the shard); an empty table gives no shards and no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from blockquorum.llm.common import Memo, in_arrow, pieces, texts, worker_store
from blockquorum.runtime import fresh_path, materialize

MAGIC = b"TOKSHRD1"
HEAD = "<8s6Q"
SHARD_BYTES = 16_000_000
TASK_BYTES = 24_000_000  # of text that one task encodes
MOST_KNOWN = 800_000  # encoded pieces a worker remembers
SLICE = 256  # documents that are encoded together
TOGETHER = 64  # new pieces in one call's text
NULL_KEY = 1 << 31

class PieceEncoder:
    """A tokenizer of the tokenizers library that remembers the ids of pieces (see ``common.pieces``).

    New pieces are encoded together; as a token never crosses their borders, the lengths of the tokens tell
    which belong to which piece. Texts that cannot be cut are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        n = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        # a byte-level token has one character for each byte
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], dtype=np.int64)
        self.memo = Memo(MOST_KNOWN)

    def _whole(self, items: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        joined = ["".join(new[lo : lo + TOGETHER]) for lo in range(0, len(new), TOGETHER)]
        ids = np.concatenate([np.empty(0, self.kind), *self._whole(joined)])
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in new])
        cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * self.kind.itemsize
        data, cuts = ids.tobytes(), cuts.tolist()
        self.memo.young.update(zip(new, [data[a:b] for a, b in zip([0, *cuts], cuts)]))

    def encode_many(self, items: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        split = [pieces(t) for t in items]
        new = self.memo.missing(set().union(*[s[1:] for s in split if s]))
        alone = [p for p in new if p == "\n" or p[0] in ".,"]  # next to others these could make one token with them
        self.memo.young.update(zip(alone, [ids.tobytes() for ids in self._whole(alone)]))
        self._learn([p for p in new if p != "\n" and p[0] not in ".,"])
        known = self.memo.young
        heads = self._whole([t if s is None else s[0] for t, s in zip(items, split)])
        return [h.tobytes() + b"".join([known[p] for p in s[1:]]) if s else h.tobytes() for h, s in zip(heads, split)]


def encoder(path: str) -> PieceEncoder:
    kept = worker_store("encoders")
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def key_hashes(keys: np.ndarray, repeats: np.ndarray, seed: int) -> np.ndarray:
    digest, pack = xxhash.xxh64_intdigest, struct.Struct("<qI").pack
    return np.array([digest(pack(k, r), seed) for k, r in zip(keys.tolist(), repeats.tolist())], dtype=np.uint64)


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slot of hash ``h`` under displacement ``d`` of its bucket."""
    x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def _displace(own: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The first displacement that sends the hashes of a bucket to different free slots, and the slots."""
    for lo in range(1, 1 << 24, 64):
        tries = np.arange(lo, lo + 64)
        at = _slot(own[None, :], tries[:, None], len(free))
        for t in np.flatnonzero(free[at].all(axis=1)):
            if len(set(at[t].tolist())) == len(own):
                return int(tries[t]), at[t]
    return None


def build_index(keys: np.ndarray, repeats: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacement of each bucket, slot of each key): a bijection of n distinct keys to n slots."""
    n = len(keys)
    buckets = max(1, n // 4)
    for seed in range(1, 100):
        h = key_hashes(keys, repeats, seed)
        if len(np.unique(h)) < n:
            continue
        of = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=buckets)
        ends = np.cumsum(sizes)
        free, slots, moves = np.ones(n, dtype=bool), np.empty(n, dtype=np.int64), np.zeros(buckets, dtype=np.int32)
        failed = False
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[ends[b] - sizes[b] : ends[b]]
            if len(members) < 2:
                break
            found = _displace(h[members], free)
            if found is None:
                failed = True
                break
            moves[b], slots[members] = found
            free[found[1]] = False
        if failed:
            continue
        # buckets of one key take the slots that are left, by their number
        rest, single = np.flatnonzero(free), np.flatnonzero(sizes == 1)
        slots[order[ends[single] - 1]] = rest
        moves[single] = -rest.astype(np.int32) - 1
        return seed, moves, slots
    raise RuntimeError("no perfect hash was found")


class Shard:
    """A shard file in memory."""

    def __init__(self, content: bytes):
        magic, item, self.end, n, m, self.seed, b = struct.unpack_from(HEAD, content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.keys, self.repeats = take("<i8", n), take("<u4", n)
        self.moves, self.prints, self.documents = take("<i4", b), take("<u8", n), take("<u4", n)
        self.offsets, self.ids = take("<u8", n + 1), take("<u2" if item == 2 else "<u4", m)

    def place(self, key: int | None, repeat: int = 0) -> int | None:
        """Number of the document with this key, or None."""
        packed = struct.pack("<qI", key or 0, repeat | (NULL_KEY if key is None else 0))
        h = xxhash.xxh64_intdigest(packed, self.seed)
        if not len(self.keys):
            return None
        d = int(self.moves[h % len(self.moves)])
        slot = -d - 1 if d < 0 else int(_slot(np.array([h], dtype=np.uint64), np.array([d]), len(self.keys))[0])
        return int(self.documents[slot]) if int(self.prints[slot]) == xxhash.xxh64_intdigest(packed, self.seed + 1000) else None

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        """Ids of the document with this key, its end id included, or None."""
        at = self.place(key, repeat)
        return None if at is None else self.ids[int(self.offsets[at]) : int(self.offsets[at + 1])]


def shard_bytes(keys: list[int | None], payloads: list[bytes], kind: np.dtype, end: int) -> bytes:
    seen: dict[int | None, int] = {}
    repeats = []
    for k in keys:
        repeats.append(seen.get(k, 0) | (NULL_KEY if k is None else 0))
        seen[k] = seen.get(k, 0) + 1
    key = np.array([k or 0 for k in keys], dtype="<i8")
    repeat = np.array(repeats, dtype="<u4")
    seed, moves, slots = build_index(key, repeat)
    prints, documents = np.empty(len(key), dtype="<u8"), np.empty(len(key), dtype="<u4")
    prints[slots] = key_hashes(key, repeat, seed + 1000)
    documents[slots] = np.arange(len(key))
    offsets = np.cumsum([0, *[len(p) // kind.itemsize for p in payloads]]).astype("<u8")
    head = struct.pack(HEAD, MAGIC, kind.itemsize, end, len(key), int(offsets[-1]), seed, len(moves))
    return b"".join([head, *[a.tobytes() for a in (key, repeat, moves.astype("<i4"), prints, documents, offsets)], *payloads])


def write_file(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    temporary = f"{base}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(content)
    system.move(temporary, f"{base}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, shard_bytes_most: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files below ``folder``; one row per file: name, task,
    number, documents and ids in it, and the ids of all shards before it. Nothing is encoded twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        last = np.array([end], dtype=enc.kind).tobytes()
        keys: list[int | None] = []
        payloads: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, payloads, size, number
            name = f"part-{task:06d}-{number:06d}.tok"
            write_file(folder, name, shard_bytes(keys, payloads, enc.kind, end))
            row = {"name": [name], "task": [task], "number": [number], "documents": [len(keys)], "ids": [size // enc.kind.itemsize]}
            keys, payloads, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                for key, packed in zip(part.column("doc_id").to_pylist(), enc.encode_many(texts(part))):
                    keys.append(key)
                    payloads.append(packed + last)
                    size += len(payloads[-1])
                    if size >= shard_bytes_most:
                        yield flush()
        if keys:
            yield flush()

    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    print_ = F.xxhash64("text")  # rows of one id are put in order without comparing whole texts across tasks
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("h", print_)
    dealt = dealt.repartitionByRange(max(1, -(-total // TASK_BYTES)), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    made = in_arrow(dealt.drop("h"), run, "name string, task long, number long, documents long, ids long")
    made = materialize(made, "shards")
    # one row for each file of SHARD_BYTES: a table that one task can sum up
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(name, doc_id, offset, n_tokens, ids_crc32) of every document, read from the files through their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard = Shard(content.as_buffer())
                keys = [None if r & NULL_KEY else k for k, r in zip(shard.keys.tolist(), shard.repeats.tolist())]
                places = [shard.place(k, r & (NULL_KEY - 1)) for k, r in zip(keys, shard.repeats.tolist())]
                lo, hi = shard.offsets[:-1][places], shard.offsets[1:][places]
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(lo.tolist(), hi.tolist())]
                row = {
                    "name": [path.rpartition("/")[2]] * len(keys),
                    "doc_id": pa.array(keys, pa.int64()),
                    "offset": lo.astype(np.int64),
                    "n_tokens": (hi - lo).astype(np.int64),
                    "ids_crc32": np.array(crc, dtype=np.int64),
                }
                yield pa.RecordBatch.from_pydict(row)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    return in_arrow(files, run, "name string, doc_id long, offset long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, end: int = 2, folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, offset): what the files hold of every document."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    shards = write_shards(docs, folder, tokenizer, end)
    if not shards.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, offset long")
    found = read_shards(spark, folder).join(shards.select("name", "start"), "name")
    return found.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard"), "offset")
