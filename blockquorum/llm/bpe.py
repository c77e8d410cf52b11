"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A text is split by a pattern into words; each word's bytes become rows (word, position, token). A
recursive query joins neighbouring tokens with the merge table and contracts the leftmost pair of the
least rank of every word, until no word has a pair left. Decoding joins the ids of whole texts with the
vocabulary and concatenates their bytes in order, as an ordered aggregation.

Only words a worker has not met yet go to DuckDB, many at a time; it remembers a bounded number of words
and of pieces between spaces. In words of over ``LONG`` bytes a round contracts all non-overlapping pairs of
the least rank at once, where no token of the word has a pair of a lesser or equal rank with the new token (the
leftmost ones would follow one by one); other ranks go one pair a round. Both ways give what repeated leftmost
merging gives.
Words of over ``LONG`` bytes are first cut wherever no token that stands in them reaches over, as no merge can cross
there, so the rounds of a word are those of its longest part. Only in parts that tokens chain together over
thousands of bytes (two letters at random) may n bytes take up to n rounds over their rows.

Edge cases: a null text counts as empty; an empty text has no ids; equal rows give equal rows; empty tables
give no rows; other columns are not read. Bytes without a rank cannot be encoded and raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockquorum.llm.common import Memo, map_batches, pieces, texts, worker_store

LONG = 64
ROUNDS_ROWS = 2_000_000  # rows that one recursive query may pile up for long words
CHUNK_BYTES = 500_000  # of words that go to DuckDB together
MOST_KNOWN = 600_000  # words and pieces that a worker remembers
DECODE_ROWS = 1_000_000  # ids that are decoded together
TEXT_CHARS = 6_000_000  # that are encoded together

#: One contraction a round: the leftmost pair of the least rank.
LEFTMOST = """
WITH RECURSIVE t AS (
  SELECT w, pos, tok, 0 AS round FROM word_tokens
  UNION ALL
  SELECT b.w, b.pos, CASE WHEN b.pos = c.best & 4294967295 THEN (c.best >> 32)::INT ELSE b.tok END, b.round + 1
  FROM (
    SELECT a.w, min(m.rank::BIGINT << 32 | a.pos) AS best, arg_min(a.next_pos, m.rank::BIGINT << 32 | a.pos) AS gone
    FROM (
      SELECT w, pos, tok, lead(tok) OVER v AS next_tok, lead(pos) OVER v AS next_pos
      FROM t WINDOW v AS (PARTITION BY w ORDER BY pos)
    ) a JOIN merges m ON m.l = a.tok AND m.r = a.next_tok
    GROUP BY a.w
  ) c JOIN t b ON b.w = c.w
  WHERE b.pos <> c.gone
), ends AS (SELECT w, max(round) AS round FROM t GROUP BY w)
SELECT w, tok FROM t JOIN ends USING (w, round) ORDER BY w, pos
"""

#: Every other pair of each run of pairs of the least rank, where no token of the word has a pair of a lesser or equal
#: rank with the new one (nor the new one with itself); at most $rounds rounds.
RUNS = """
WITH RECURSIVE t AS (
  SELECT w, pos, tok, 0 AS round FROM word_tokens
  UNION ALL
  SELECT w, pos, CASE WHEN chosen THEN (best >> 32)::INT ELSE tok END, round + 1
  FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY w ORDER BY pos), false) AS gone
    FROM (
      SELECT *, hit AND (idx - run_start) % 2 = 1 AND (safe AND apart OR idx = best & 4294967295) AS chosen
      FROM (
        SELECT *, coalesce(max(CASE WHEN NOT hit THEN idx END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS run_start
        FROM (
          SELECT c.*, coalesce(rank = best >> 32, false) AS hit, bool_and(u.made IS NULL) OVER (PARTITION BY w) AS apart
          FROM (
            SELECT a.*, m.rank, m.safe, min(m.rank::BIGINT << 32 | a.idx) OVER (PARTITION BY a.w) AS best
            FROM (
              SELECT w, pos, tok, round, lead(tok) OVER v AS next_tok, row_number() OVER v AS idx
              FROM t WHERE round < $rounds WINDOW v AS (PARTITION BY w ORDER BY pos)
            ) a LEFT JOIN merges m ON m.l = a.tok AND m.r = a.next_tok
          ) c LEFT JOIN earlier u ON u.made = best >> 32 AND u.other = c.tok
          WHERE best IS NOT NULL
        )
      )
    )
  ) WHERE NOT gone
), ends AS (SELECT w, max(round) AS round FROM t GROUP BY w)
SELECT w, any_value(round) AS round, list(tok ORDER BY pos) AS ids FROM t JOIN ends USING (w, round) GROUP BY w ORDER BY w
"""

#: Bytes of ids in their order; on its one thread the database adds rows up as they were sorted.
DECODE = """
SELECT w, string_agg(bytes, '') AS text
FROM (SELECT w, bytes FROM token_rows JOIN vocab USING (tok) ORDER BY pos) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _rows(flat: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """(w, pos, tok) of lists of tokens that lie one after another."""
    w = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    pos = np.arange(len(flat), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pa.table({"w": w, "pos": pos.astype(np.int32), "tok": flat.astype(np.int32, copy=False)})


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(flat: np.ndarray, sizes: np.ndarray, kind: np.dtype) -> list[bytes]:
    data, ends = flat.astype(kind).tobytes(), (np.cumsum(sizes) * kind.itemsize).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """A vocabulary of ranks in DuckDB, with what this worker has encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, dtype=np.int32) for x in zip(*pairs)) if pairs else (np.empty(0, np.int32),) * 3
        merges = pa.table({"l": left, "r": right, "rank": rank})  # noqa: F841  read by name
        vocab = pa.table({"tok": np.array(list(ranks.values()), dtype=np.int32), "bytes": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE earlier AS SELECT l AS made, r AS other FROM merges WHERE rank <= l UNION SELECT r, l FROM merges WHERE rank <= r")
        self.db.execute("CREATE TABLE merges AS SELECT *, rank NOT IN (SELECT made FROM earlier WHERE made = other) AS safe FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.starts = {t[:i]: False for t in ranks for i in range(1, len(t))} | dict.fromkeys(ranks, True)  # is it a token?
        self.kind = np.dtype("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4")
        self.memo = Memo(MOST_KNOWN)  # word or piece -> packed ids

    def _query(self, sql: str, name: str, rows: pa.Table, **values) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql, params=values or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def cut(self, word: bytes) -> list[bytes]:
        """The word cut wherever no token of the vocabulary that stands in it reaches over: no merge can cross there."""
        parts, first, far, n = [], 0, 0, len(word)
        for at in range(n):
            if at and far <= at:
                parts.append(word[first:at])
                first = at
            end = at + 1
            while end <= n and (start := word[at:end]) in self.starts:
                if self.starts[start] and end > far:
                    far = end
                end += 1
        return [*parts, word[first:]]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word (of one byte or more)."""
        cut = [[w] if len(w) <= LONG else self.cut(w) for w in words]
        distinct = list(dict.fromkeys(p for parts in cut for p in parts))
        ids = dict(zip(distinct, self._merge(distinct)))
        return [b"".join([ids[p] for p in parts]) for parts in cut]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        for part in self._chunks([i for i, w in enumerate(words) if len(w) <= LONG], words):
            found = self._query(LEFTMOST, "word_tokens", self._start([words[i] for i in part]))
            sizes = np.bincount(found.column("w").to_numpy(), minlength=len(part))
            for i, ids in zip(part, _packed(found.column("tok").to_numpy(), sizes, self.kind)):
                out[i] = ids
        for left in self._chunks([i for i, w in enumerate(words) if len(w) > LONG], words):
            rows = self._start([words[i] for i in left])
            while left:
                rounds = int(np.clip(ROUNDS_ROWS // len(rows), 1, 500))
                found = self._query(RUNS, "word_tokens", rows, rounds=rounds)
                flat, sizes = _flat(found.column("ids"))
                going = found.column("round").to_numpy() >= rounds
                for i, ids in zip(left, _packed(flat, sizes, self.kind)):
                    out[i] = ids
                left = [i for i, g in zip(left, going) if g]
                rows = _rows(flat[np.repeat(going, sizes)], sizes[going])
        return out

    def _start(self, words: list[bytes]) -> pa.Table:
        flat = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        if len(flat) and flat.min() < 0:
            raise ValueError("a byte has no rank")
        return _rows(flat, np.array([len(w) for w in words], dtype=np.int64))

    @staticmethod
    def _chunks(at: list[int], words: list[bytes]) -> Iterator[list[int]]:
        part, size = [], 0
        for i in at:
            part.append(i)
            size += len(words[i])
            if size >= CHUNK_BYTES:
                yield part
                part, size = [], 0
        if part:
            yield part

    def decode(self, packed: list[bytes], kind: np.dtype | None = None) -> list[bytes]:
        """Bytes of each list of packed ids."""
        kind = kind or self.kind
        flat = np.frombuffer(b"".join(packed), dtype=kind)
        of = np.repeat(np.arange(len(packed), dtype=np.int32), [len(x) // kind.itemsize for x in packed])
        parts: list[list[bytes]] = [[] for _ in packed]
        for lo in range(0, len(flat), DECODE_ROWS):
            tok = flat[lo : lo + DECODE_ROWS].astype(np.int32)
            rows = pa.table({"w": of[lo : lo + DECODE_ROWS], "pos": np.arange(len(tok), dtype=np.int32), "tok": tok})
            found = self._query(DECODE, "token_rows", rows)
            for w, text in zip(found.column("w").to_pylist(), found.column("text").to_pylist()):
                parts[w].append(text.encode("latin-1"))
        return [b"".join(p) for p in parts]

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not known."""
        for lo in range(0, len(words), 100_000):
            part = words[lo : lo + 100_000]
            self.memo.young.update(zip(part, self.merge([w.encode("utf-8") for w in part])))

    def _learn_pieces(self, new: list[str]) -> None:
        """The same for pieces but heads; they are split together, as no word crosses their borders but those of
        marks, which are split each alone."""
        marks = [p for p in new if p[0] in ".,"]
        new = [p for p in new if p[0] not in ".,"]
        words, sizes = self.pattern.findall("".join(new)), [len(p) for p in [*new, *marks]]
        words += [w for p in marks for w in self.pattern.findall(p)]
        known = self.memo.young
        self._learn([w for w in dict.fromkeys(words) if w not in known])
        at = 0
        for piece, size in zip([*new, *marks], sizes):
            first, rest = at, size - len(words[at])
            at += 1
            if rest:
                while rest > 0:
                    rest -= len(words[at])
                    at += 1
                known[piece] = b"".join([known[w] for w in words[first:at]])

    def encode(self, items: list[str]) -> list[bytes]:
        """Packed ids of every text, put together from its pieces (see ``common.pieces``)."""
        split = [pieces(t) for t in items]
        heads = [self.pattern.findall(p[0] if p else t) for t, p in zip(items, split)]
        new = self.memo.missing({"\n"}.union(*heads, *[p[1:] for p in split if p]))
        known, own = self.memo.young, {w for ws in heads for w in ws}
        self._learn([w for w in new if w == "\n" or w in own])
        self._learn_pieces([p for p in new if p not in known])
        return [b"".join([known[w] for w in words] + [known[p] for p in cut[1:]] if cut else [known[w] for w in words]) for words, cut in zip(heads, split)]


def codec(path: str, pattern: str) -> Codec:
    kept = worker_store("codecs")
    if (path, pattern) not in kept:
        kept[path, pattern] = Codec(read_ranks(path), pattern)
    return kept[path, pattern]


def _portions(items: list[str]) -> Iterable[list[str]]:
    part, size = [], 0
    for t in items:
        part.append(t)
        size += len(t)
        if size >= TEXT_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None, checked: bool = True) -> DataFrame:
    """(``keep`` columns, n_tokens, ids binary, ids_sha256, decoded_sha256): ids as little-endian unsigned
    32-bit integers; the last is of the bytes the ids decode to."""
    keep = keep if keep is not None else ["doc_id"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, n, ids_, one, two = codec(ranks_path, pattern), [], [], [], []
        for part in _portions(texts(batch)):
            packed = own.encode(part)
            for ids, decoded in zip(packed, own.decode(packed)):
                wide = np.frombuffer(ids, dtype=own.kind).astype("<u4").tobytes()
                n.append(len(wide) // 4)
                ids_.append(wide)
                one.append(hashlib.sha256(wide).hexdigest())
                two.append(hashlib.sha256(decoded).hexdigest())
        made = [pa.array(n, pa.int64()), pa.array(ids_, pa.binary()), pa.array(one), pa.array(two)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    columns = list(dict.fromkeys([*keep, "text"]))
    return map_batches(docs.select(columns), step, f"{kinds}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes): the bytes of ``ids`` (binary, little-endian unsigned 32-bit); null ids count as none."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks_path, pattern)
        out: list[bytes] = []
        part, size, wide = [], 0, np.dtype("<u4")
        for x in batch.column("ids").to_pylist():
            part.append(x or b"")
            size += len(part[-1])
            if size > 4_000_000:
                out += own.decode(part, wide)
                part, size = [], 0
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out + own.decode(part, wide), pa.binary())], names=[id_col, "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_batches(tokens.select(id_col, "ids"), step, f"{id_col} {kind}, bytes binary")
