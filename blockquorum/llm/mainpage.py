"""Main text of web pages: a suffix array over a host's pages tells unique runs from repeated boilerplate, and the
unique runs tell which element of a page is its article.

The pages of a host are concatenated as token streams, in groups of bounded size. A suffix array of the stream
brings equal token runs together; runs of ``LEAST_RUN`` or more tokens that occur on two or more different pages
are boilerplate, the rest are unique runs. Copies of a page (equal streams) count as one page, so a copied article
is not its own boilerplate.

A page is read into blocks (texts between block elements). Blocks in elements that never belong to an article
(menus, headers, footers, sidebars, forms, adverts, notices, reader comments; by element, role or class) are out.
Of the elements that a page marks as an article (``article``, ``main``, or a role or class that says so) the one with
the most unique tokens is the article: all its blocks that are not out are kept, repeated passages too. On a page
without such a mark the article is the innermost element that holds ``SHARE`` of the unique tokens, and blocks that
boilerplate covers by ``COVERED`` are removed from it.

Repeats are looked for over the whole host, for every page: the unique runs come first, the marks are checked after them.
Pages are read once, into chunks of up to ``GROUP_BYTES`` of html that hold words by number; the chunks are stored by
bucket, so that joins by chunk do not move them again. The suffix array groups the equal runs of ``LEAST_RUN`` tokens of
a chunk, each has a 64-bit hash (the host is part of it), and two rounds over ranges of the hashes tell which runs stand
in different streams. In the first, a chunk hands on the leading bits of its hashes, in order and packed; runs whose
bits no other stream has are unique. In the second, whole hashes of the others are compared, so that the first only
spares work. Of copies in several chunks, one chunk hands in the stream, the others only ask. Neither the chunks nor
the number of tasks changes a text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by newlines; a
line break element counts as white space. Edge cases: null or empty html and pages without text give an empty text; a page
that is cut off ends its open elements there; null urls and urls without a host share a group of their own;
repeated rows stay rows; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from blockquorum.llm.common import in_arrow
from blockquorum.runtime import fresh_path

LEAST_RUN = 6
COVERED = 0.8
SHARE = 0.7
GROUP_BYTES = 16_000_000
DEPTH = 64  # tokens up to which suffixes are put in order

#: Elements whose content is no text; elements that are never the article; elements that do
#: not end a block; elements without content; words of a class or id, and roles, that tell.
RAW = set("script style textarea title noscript iframe xmp".split())
OUTSIDE = set("head nav header footer aside form menu dialog template svg object select button canvas audio video math fieldset".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist cookie "
    "cookies consent disqus discussion footer gdpr header masthead menu nav navbar navigation newsletter notice notices pagination pager "
    "popup promo promotion related replies respond responses share sharing sidebar sitefooter siteheader social sponsor sponsored "
    "subscribe subscription toolbar topbar widget".split()
)
LAYOUT_WORDS = set("has with no page layout wrapper container site article post main content".split())
ARTICLE_WORDS = {"article", "article-body", "article-content", "main-content", "entry-content", "post-content", "post-body", "story-body", "articlebody"}
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))", re.I)


@dataclass
class Page:
    """The blocks of a page, for each the innermost element it stands in, and for each element the one around it.

    Elements are numbered as they open, so an element's number is above that of the one around it; 0 is the page.
    """

    blocks: list[str] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    out: list[bool] = field(default_factory=list)
    around: list[int] = field(default_factory=lambda: [0])
    marked: set[int] = field(default_factory=set)  # elements that say they are the article
    lengths: list[int] = field(default_factory=list)  # tokens of the blocks, where those are stored elsewhere

    def sums(self, values: list[int]) -> list[int]:
        """Per element the sum of a value of its blocks, those of inner elements too, without blocks that are out."""
        total = [0] * len(self.around)
        for element, value, out in zip(self.inside, values, self.out):
            if not out:
                total[element] += value
        for element in range(len(total) - 1, 0, -1):
            total[self.around[element]] += total[element]
        return total

    def held_by(self, element: int) -> list[int]:
        """The blocks in an element that are not out."""
        within = [False] * len(self.around)
        within[element] = True
        for e in range(element + 1, len(within)):
            within[e] = within[self.around[e]]
        return [b for b, (e, out) in enumerate(zip(self.inside, self.out)) if within[e] and not out]


def _told(tag: str, attributes: str) -> tuple[bool, bool]:
    """(never the article, marked as the article) of an element."""
    out, marked = tag in OUTSIDE, tag in ("article", "main")
    for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            out |= value in OUTSIDE_ROLES
            marked |= value in ("main", "article")
        elif name.lower() in ("class", "id") and tag not in ("html", "body"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                marked |= "-".join(parts) in ARTICLE_WORDS
                if not LAYOUT_WORDS.intersection(parts[:-1]) or parts[-1].startswith("comment"):
                    out |= parts[0] in OUTSIDE_WORDS or parts[-1] in OUTSIDE_WORDS
    return out, marked and not out


def read_page(html: str) -> Page:
    page, text, at = Page(), [], 0
    stack: list[tuple[str, int, bool, bool]] = []  # open elements: tag, number, never the article, so by one around it
    opened: Counter[str] = Counter()

    def flush() -> None:
        block = " ".join(unescape("".join(text)).split())
        text.clear()
        if block:
            page.blocks.append(block)
            page.inside.append(stack[-1][1] if stack else 0)
            page.out.append(bool(stack) and stack[-1][3])

    def push(tag: str, out: bool) -> int:
        page.around.append(stack[-1][1] if stack else 0)
        number = len(page.around) - 1
        stack.append((tag, number, out, out or bool(stack) and stack[-1][3]))
        opened[tag] += 1
        return number

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while found := _TAG.search(html, at):
        text.append(html[at : found.start()])
        at = found.end()
        if found[2] is None:  # a comment or declaration
            continue
        tag = found[2].lower()
        if found[1]:
            if tag not in INLINE or any(t == tag for t, *_ in stack[-8:]):
                flush()
                if opened[tag]:
                    while pop() != tag:
                        pass
            continue
        if tag in RAW and not found[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(html, at)
            at = end.end()
            continue
        if tag == "br":
            text.append(" ")
            continue
        out, marked = _told(tag, found[3])
        if tag in INLINE and not out:
            continue
        flush()
        if tag in VOID or found[3].endswith("/") and tag not in ("p", "div"):
            continue
        if tag == "body":  # closes all but the document; one that stood inside something else goes on without it
            first = next((i for i, (t, *_) in enumerate(stack) if t != "html"), len(stack))
            again = [(t, out_) for t, _, out_, _ in stack[first:] if t == "html"]
            while len(stack) > first:
                pop()
            for t, out_ in again:
                push(t, out_)
        elif tag not in INLINE and stack and stack[-1][0] == "p":
            pop()  # a paragraph ends where a block begins
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        number = push(tag, out)
        if marked:
            page.marked.add(number)
    text.append(html[at:])
    flush()
    return page


def suffix_array(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions in the order of what follows them, up to ``depth`` tokens, by prefix doubling."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            break
        k *= 2
    return order


def equal_runs(tokens: np.ndarray, page: np.ndarray, least: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places of all runs of ``least`` tokens within a page, equal runs together, and where each set of equals starts."""
    n = len(tokens)
    none = np.empty(0, dtype=np.int64)
    if n < least:
        return none, none
    order = suffix_array(tokens, least)
    within = np.zeros(n, dtype=bool)  # the run does not leave its page
    within[: n - least + 1] = page[: n - least + 1] == page[least - 1 :]
    order = order[within[order]]
    if not len(order):
        return none, none
    same = np.ones(len(order) - 1, dtype=bool)
    for j in range(least):
        same &= tokens[order[1:] + j] == tokens[order[:-1] + j]
    return order, np.flatnonzero(np.concatenate([[True], ~same]))


def covered_by(hits: np.ndarray, n: int, least: int = LEAST_RUN) -> np.ndarray:
    """Which of ``n`` tokens lie in a run of ``least`` that starts at one of the ``hits``."""
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + least, -1)
    return np.cumsum(covered)[:n] > 0


def repeated(tokens: np.ndarray, page: np.ndarray, least: int = LEAST_RUN) -> np.ndarray:
    """Which tokens lie in a run of ``least`` or more that occurs on different pages."""
    order, starts = equal_runs(tokens, page, least)
    if not len(order):
        return np.zeros(len(tokens), dtype=bool)
    lo, hi = np.minimum.reduceat(page[order], starts), np.maximum.reduceat(page[order], starts)
    sizes = np.diff(np.append(starts, len(order)))
    return covered_by(order[np.repeat(lo != hi, sizes)], len(tokens), least)


def marked_with_text(page: Page) -> set[int]:
    """The elements marked as an article that hold a block which is not out."""
    held = page.sums([1] * len(page.blocks)) if page.marked else []
    return {e for e in page.marked if held[e]}


def is_decided(page: Page) -> bool:
    """Does the article not depend on what is unique: one element is marked, or there is no text?"""
    return len(marked_with_text(page)) == 1 or all(page.out)


def article(page: Page, unique: list[int], total: list[int]) -> str:
    """The article's text, from the unique and all tokens of each block."""
    marked = marked_with_text(page)
    own = page.sums(unique)
    if marked:
        whole = page.sums(total)
        kept = page.held_by(max(marked, key=lambda e: (own[e], whole[e], -e)))
    else:
        kept = [b for b, out in enumerate(page.out) if not out]
        # the innermost element that still holds most of what is unique
        if own[0]:
            kept = page.held_by(max(e for e, n in enumerate(own) if n >= SHARE * own[0]))
        kept = [b for b in kept if unique[b] > (1 - COVERED) * total[b]] or kept
    return "\n".join(page.blocks[b] for b in kept)


def articles(htmls: list[str]) -> list[str]:
    """Article texts of pages of one host that are compared with each other."""
    parsed: dict[str, int] = {}
    of = [parsed.setdefault(h, len(parsed)) for h in htmls]
    pages = [read_page(h) for h in parsed]
    streams = [[b.split(" ") for b in p.blocks] for p in pages]
    vocab: dict[str, int] = {}
    first_with: dict[tuple, int] = {}
    tokens, owner = [], []
    for i, blocks in enumerate(streams):
        ids = [vocab.setdefault(w, len(vocab)) for b in blocks for w in b]
        page = first_with.setdefault(tuple(ids), i)  # pages of one stream count as one
        tokens += ids
        owner += [page] * len(ids)
    covered = repeated(np.array(tokens, dtype=np.int64), np.array(owner, dtype=np.int64)) if len(first_with) > 1 else np.zeros(len(tokens), dtype=bool)
    sums = np.concatenate([[0], np.cumsum(~covered)])
    out, at = [], 0
    for page, blocks in zip(pages, streams):
        total = [len(b) for b in blocks]
        ends = at + np.cumsum(total, dtype=np.int64) if total else np.empty(0, dtype=np.int64)
        unique = (sums[ends] - sums[ends - np.array(total, dtype=np.int64)]).tolist() if total else []
        out.append(article(page, unique, total))
        at += sum(total)
    return [out[i] for i in of]


def _hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def gaps(places: np.ndarray) -> bytes:
    """Ascending numbers as bytes: the gaps, 255 standing for a gap that goes on in the next byte."""
    more, rest = np.divmod(np.diff(places, prepend=0), 255)
    out = np.full(int(more.sum()) + len(places), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def from_gaps(data: bytes | None) -> np.ndarray:
    steps = np.frombuffer(data or b"", dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _low_bits(n: int, bits: int) -> int:
    """How many bits of ``n`` values of ``bits`` bits are stored as they are; the bits above them are counted."""
    return min(32, max(0, bits - max(1, n).bit_length() + 1))


def pack(values: np.ndarray, bits: int) -> bytes:
    """Ascending values of ``bits`` bits: the low bits as they are, the high ones as ones at the place of high bits + number."""
    n, low = len(values), _low_bits(len(values), bits)
    high = np.zeros((1 << bits - low) + n, dtype=np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    rest = (values & (1 << low) - 1).astype(">u4").view(np.uint8).reshape(n, 4)
    return np.packbits(high).tobytes() + np.packbits(np.unpackbits(rest, axis=1)[:, 32 - low :]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    low = _low_bits(n, bits)
    all_bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    size = (1 << bits - low) + n
    high = np.flatnonzero(all_bits[:size]) - np.arange(n)
    rest = np.zeros((n, 32), dtype=np.uint8)
    rest[:, 32 - low :] = all_bits[-(-size // 8) * 8 :][: n * low].reshape(n, low)
    return high << low | np.packbits(rest, axis=1).view(">u4").ravel()


def run_hashes(tokens: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    """A hash of the LEAST_RUN tokens from each place on, and of the host."""
    h = hosts[: max(0, len(tokens) - LEAST_RUN + 1)]
    for j in range(LEAST_RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + len(h)]
    return h ^ (h >> np.uint64(32))


#: What the rounds read of a chunk: its words, their numbers in the text; per page the tokens, and stream and host as hashes.
READ = ["chunk", "sizes", "streams", "hosts", "words", "ids"]
CHUNK = "chunk bigint, sizes array<int>, streams array<bigint>, hosts array<bigint>, words binary, ids binary, pages binary"
PLACES = "chunk bigint, base bigint, places binary"


class _Filling:
    """A chunk while pages are read into it."""

    def __init__(self):
        self.pages: list[Page] = []
        self.streams: list[str] = []
        self.of: list[pa.RecordBatch] = []
        self.size = 0

    def read(self, html: str) -> None:
        page = read_page(html)
        self.streams.append(" ".join(page.blocks))
        page.lengths = [b.count(" ") + 1 for b in page.blocks]
        page.blocks = []
        self.size += len(html)
        self.pages.append(page)

    def row(self, number: int) -> pa.RecordBatch:
        split = pc.split_pattern(pa.array([s or None for s in self.streams], pa.string()), " ")
        tokens = split.flatten().dictionary_encode()
        ids, words = tokens.indices.to_numpy(), tokens.dictionary
        # frequent words first, others by letter: numbers and words then pack well
        order = pc.array_sort_indices(words).to_numpy()
        order = order[np.argsort(-np.bincount(ids, minlength=len(words))[order], kind="stable")]
        rank = np.empty(len(words), dtype=np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        ids, words = rank[ids], " ".join(words.take(pa.array(order)).to_pylist())
        planes = {f"b{k}": pa.array((ids >> 8 * k & 255).astype(np.uint8)) for k in range(4)}
        pages = {c: pa.chunked_array([b.column(c) for b in self.of]).combine_chunks() for c in ("page_id", "url", "host")}
        known = {h: _hash64(h) for h in set(pages["host"].to_pylist())}
        hosts = np.array([known[h] for h in pages["host"].to_pylist()], dtype=np.uint64).view(np.int64)
        numbers = pa.list_(pa.int32())
        pages["blocks"] = pa.array([p.lengths for p in self.pages], numbers)
        pages["inside"] = pa.array([p.inside for p in self.pages], numbers)
        pages["around"] = pa.array([p.around for p in self.pages], numbers)
        pages["marked"] = pa.array([sorted(p.marked) for p in self.pages], numbers)
        pages["out"] = pa.array([p.out for p in self.pages], pa.list_(pa.bool_()))
        columns = [
            pa.array([number], pa.int64()),
            pa.array([[sum(p.lengths) for p in self.pages]], numbers),
            pa.array([np.array([_hash64(s) for s in self.streams], dtype=np.uint64).view(np.int64)], pa.list_(pa.int64())),
            pa.array([hosts], pa.list_(pa.int64())),
            pa.array([_stored({"words": pa.array([words])})], pa.binary()),
            pa.array([_stored(planes)], pa.binary()),
            pa.array([_stored(pages)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*READ, "pages"])


def _stored(columns: dict[str, pa.Array]) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _restored(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


class _Chunk:
    """The tokens of a chunk, and the hashes of the runs in it."""

    def __init__(self, row: dict):
        joined = _restored(row["words"]).column(0)[0].as_py()
        self.words = joined.split(" ") if joined else []
        planes = _restored(row["ids"])
        self.ids = sum(planes.column(k).to_numpy().astype(np.int64) << 8 * k for k in range(4))
        sizes = np.array(row["sizes"], dtype=np.int64)
        self.page = np.repeat(np.arange(len(sizes)), sizes)
        self.hosts = np.array(row["hosts"], dtype=np.int64).view(np.uint64)
        self.streams = np.array(row.get("streams") or [], dtype=np.int64)
        self.asks = np.array(row.get("asks") or [], dtype=np.int64)
        n = max(0, len(self.ids) - LEAST_RUN + 1)
        self.hashes = run_hashes(pd.util.hash_array(np.array(self.words, dtype=object), categorize=False)[self.ids], self.hosts[self.page])
        self.places = np.flatnonzero(self.page[:n] == self.page[LEAST_RUN - 1 :][:n])

    def handed_in(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each set of places (they start at ``starts``) the streams that this chunk hands in: 0, 1, or 2 for more."""
        stream = np.unique(self.streams, return_inverse=True)[1]
        stream = np.where(np.isin(self.streams, self.asks), -1, stream)[self.page[places]]
        hi = np.maximum.reduceat(stream, starts)
        lo = np.minimum.reduceat(np.where(stream < 0, len(self.streams), stream), starts)
        return (hi >= 0).astype(np.int64) + (hi > lo)


def _runs_of(group_bytes: int):
    """Pages as chunks of the tokens whose runs are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Filling()
        for batch in batches:
            start = 0
            for i, html in enumerate(batch.column("html").to_pylist()):
                chunk.read(html)
                if chunk.size >= group_bytes:
                    chunk.of.append(batch.slice(start, i + 1 - start))
                    yield chunk.row(number)
                    number, chunk, start = number + 1, _Filling(), i + 1
            if start < batch.num_rows:
                chunk.of.append(batch.slice(start))
        if chunk.pages:
            yield chunk.row(number)

    return run


def _ranges(runs: np.ndarray, range_bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of ascending hashes, by their leading bits."""
    lead = runs >> np.uint64(64 - range_bits)
    starts = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])) if len(runs) else np.empty(0, dtype=np.int64)
    yield from zip(lead[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(runs)])


def _short_runs(bits: int, range_bits: int):
    """Every run of a chunk once, as ``bits`` leading bits of its hash; ``none`` and ``more`` are those not handed in, or by several streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            chunk = _Chunk(row)
            host = np.unique(chunk.hosts, return_inverse=True)[1][chunk.page]
            order, starts = equal_runs(chunk.ids + host * len(chunk.words), chunk.page)
            if not len(order):
                continue
            by_hash = np.argsort(chunk.hashes[order[starts]], kind="stable")
            sizes = np.diff(np.append(starts, len(order)))
            first = np.cumsum(sizes[by_hash]) - sizes[by_hash]
            order = order[np.repeat(starts[by_hash] - first, sizes[by_hash]) + np.arange(len(order))]
            runs = chunk.hashes[order[first]]
            new = np.concatenate([[True], runs[1:] != runs[:-1]])
            runs, handed = runs[new], chunk.handed_in(order, first[new])
            short = (runs >> np.uint64(64 - bits) & np.uint64((1 << bits - range_bits) - 1)).astype(np.int64)
            rows = []
            for number, a, b in _ranges(runs, range_bits):
                none, more = (gaps(np.flatnonzero(handed[a:b] == k)) for k in (0, 2))
                rows.append((number, row["chunk"], a, b - a, pack(short[a:b], bits - range_bits), none, more))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["range", "chunk", "base", "n", "runs", "none", "more"])

    return run


def _whole_runs(range_bits: int):
    """The hashes of a chunk's ``runs`` that are left; in place of the first byte, which the range tells, what is handed in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            chunk = _Chunk(row)
            runs, of = np.unique(chunk.hashes[chunk.places], return_inverse=True)
            left = np.zeros(len(runs), dtype=bool)
            left[from_gaps(row["runs"])] = True
            at = np.flatnonzero(left[of])
            at = at[np.argsort(of[at], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], of[at][1:] != of[at][:-1]]))
            handed = chunk.handed_in(chunk.places[at], starts)
            numbers = np.flatnonzero(left)
            marked = runs[numbers] & np.uint64((1 << 56) - 1) | handed.astype(np.uint64) << np.uint64(56)
            rows = []
            for number, a, b in _ranges(runs[numbers], range_bits):
                rows.append((number, row["chunk"], numbers[a], gaps(numbers[a:b] - numbers[a]), marked[a:b].astype("<u8").tobytes()))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["range", "chunk", "base", "places", "runs"])

    return run


def _in_two(rows: pa.Table, places: list[np.ndarray], values: list[np.ndarray], handed: list[np.ndarray]) -> pa.Table:
    """Of each row the places whose value is handed in by two streams or more."""
    value = np.concatenate(values)
    order = np.argsort(value, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
    many = np.add.reduceat(np.concatenate(handed)[order], starts) >= 2
    hit = np.empty(len(value), dtype=bool)
    hit[order] = np.repeat(many, np.diff(np.append(starts, len(order))))
    found = [gaps(p[h]) for p, h in zip(places, np.split(hit, np.cumsum([len(v) for v in values])[:-1]))]
    out = pa.table([rows.column("chunk"), rows.column("base"), pa.array(found, pa.binary())], names=["chunk", "base", "places"])
    return out.filter(pa.array([bool(f) for f in found]))


def _short_in_two(bits: int):
    def run(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        handed = [np.ones(n, dtype=np.int64) for n in sizes]
        for h, none, more in zip(handed, rows.column("none").to_pylist(), rows.column("more").to_pylist()):
            h[from_gaps(none)], h[from_gaps(more)] = 0, 2
        return _in_two(rows, [np.arange(n) for n in sizes], [unpack(d, n, bits) for d, n in zip(rows.column("runs").to_pylist(), sizes)], handed)

    return run


def _whole_in_two(rows: pa.Table) -> pa.Table:
    marked = [np.frombuffer(r, dtype="<u8") for r in rows.column("runs").to_pylist()]
    places = [from_gaps(p) for p in rows.column("places").to_pylist()]
    return _in_two(rows, places, [m & np.uint64((1 << 56) - 1) for m in marked], [(m >> np.uint64(56)).astype(np.int64) for m in marked])


def _one_row(rows: pa.Table) -> pa.Table:
    """The places of a chunk as one row."""
    rows = rows.sort_by("base")
    runs = np.concatenate([b + from_gaps(p) for b, p in zip(rows.column("base").to_pylist(), rows.column("places").to_pylist())])
    return pa.table([rows.column("chunk").slice(0, 1), pa.array([gaps(runs)], pa.binary())], names=["chunk", "runs"])


def _marked_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a chunk's pages; ``runs`` are those of its runs, by number, that are repeated."""
    for row in (r for batch in batches for r in batch.to_pylist()):
        chunk, rows = _Chunk(row), _restored(row["pages"])
        runs, of = np.unique(chunk.hashes[chunk.places], return_inverse=True)
        again = np.zeros(len(runs), dtype=bool)
        again[from_gaps(row["runs"])] = True
        unique = np.concatenate([[0], np.cumsum(~covered_by(chunk.places[again[of]], len(chunk.ids)))])
        lengths = rows.column("blocks").flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.array(chunk.words, pa.string()).take(pa.array(chunk.ids))
        written = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), words), " ").to_pylist()
        unique, texts, end = np.diff(unique[starts]).tolist(), [], 0
        for blocks, inside, around, marked, out in zip(*(rows.column(c).to_pylist() for c in ("blocks", "inside", "around", "marked", "out"))):
            start, end = end, end + len(blocks)
            page = Page(written[start:end], inside, out, around, set(marked))
            texts.append(article(page, unique[start:end], blocks))
        columns = [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())]
        columns += [pa.array([len(t) for t in texts], pa.int64()), rows.column("host")]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "host"])


def _by_bucket(chunks: DataFrame, buckets: int) -> DataFrame:
    """The chunks, stored so that joins by chunk read them where they are."""
    spark, path = chunks.sparkSession, fresh_path(chunks.sparkSession, "chunks")
    name = f"chunks_{uuid.uuid4().hex}"
    chunks.write.format("parquet").bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name alone, the files stay
    return stored


def extract(pages: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, host) of every page (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.length("html"))).first()[0] or 0
    bits = min(42, max(24, (4 * size).bit_length()))  # a run has some eight characters: one in 32 values is taken, or less
    range_bits = min(11, max(8, bits - 20))
    chunks = _by_bucket(in_arrow(rows, _runs_of(group_bytes), CHUNK), min(1000, 8 + 2 * size // GROUP_BYTES))

    def beside(columns: list[str], *small: DataFrame) -> DataFrame:
        out = chunks.select(*columns)
        for df in small:
            out = out.join(df.hint("shuffle_hash"), "chunk", "left")
        return out

    def by_chunk(places: DataFrame) -> DataFrame:
        return places.groupBy("chunk").applyInArrow(_one_row, "chunk bigint, runs binary")

    streams = chunks.select("chunk", F.explode(F.array_distinct("streams")).alias("stream"))
    copies = streams.groupBy("stream").agg(F.min("chunk").alias("owner"), F.max("chunk").alias("last")).filter("owner != last")
    asks = streams.join(copies, "stream").filter("chunk != owner").groupBy("chunk").agg(F.collect_list("stream").alias("asks"))
    short = in_arrow(beside(READ, asks), _short_runs(bits, range_bits), "range int, chunk bigint, base bigint, n int, runs binary, none binary, more binary")
    left = by_chunk(short.groupBy("range").applyInArrow(_short_in_two(bits - range_bits), PLACES))
    whole = in_arrow(beside(READ, asks, left).filter("runs is not null"), _whole_runs(range_bits), "range int, chunk bigint, base bigint, places binary, runs binary")
    repeats = by_chunk(whole.groupBy("range").applyInArrow(_whole_in_two, PLACES))
    marks = beside(["chunk", "sizes", "hosts", "words", "ids", "pages"], repeats)
    return in_arrow(marks, _marked_off, f"page_id {kind}, url string, text string, n_chars bigint, host string")
