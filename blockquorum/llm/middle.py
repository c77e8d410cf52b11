"""Fill-in-middle transformation: texts cut at two drawn ranks into prefix, middle and suffix.

A text is a row of units: its code points, or the matches of a pattern from left to right (a code point
that no match covers is a unit of its own). The units lie in an indexable skip list. Every link, in the
lowest lane and in the express lanes above it, carries two widths: the units and the code points it passes.
A cut rank is reached from the head of the top lane by going along while the summed unit widths stay
within the rank, else one lane down; the code-point widths summed on the way are the place of the cut.

The ranks and the form of a row come from the sha256 of a seed and its id, so they do not depend on the
layout of the table. With ranks a <= b the prefix ends after a units and the middle after b. Forms:
``psm`` is P prefix S suffix M middle, ``spm`` is S suffix P prefix M middle, with the three marks given;
``plain`` is the text as it is, drawn for a share of the rows and kept for empty texts and for texts that
hold a mark, so that ``restore`` always gives the text back.

Edge cases: a null text counts as empty and is plain; a null id is hashed as the text of no digits; rows that
repeat give equal rows; an empty table gives no rows. Texts of any length are cut whole. Other columns are
kept out, so their names may clash with those made here.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from blockquorum.llm.common import map_batches, texts

MARKS = ("<P>", "<S>", "<M>")
STRIDE = 8  # one unit in so many rises to the next lane
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Towers:
    """Which units rise to which lane: a draw of the unit's number alone, so lists of all lengths share it."""

    def __init__(self) -> None:
        self.known = 0
        self.lanes: list[np.ndarray] = []

    def rising(self, n: int) -> list[np.ndarray]:
        """Numbers below ``n`` of the units in each express lane, lowest lane first; the head, 0, is in all."""
        if n > self.known:
            self.known = max(n, 2 * self.known, 1 << 12)
            at = np.arange(self.known, dtype=np.uint64)
            draw = _mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            self.lanes, step = [], STRIDE
            while step <= self.known:
                self.lanes.append(np.flatnonzero((draw % np.uint64(step) == 0) | (at == 0)))
                step *= STRIDE
        out = []
        for lane in self.lanes:
            size = int(np.searchsorted(lane, n))
            if size < 2:
                break
            out.append(lane[:size])
        return out


_towers = Towers()


class SkipList:
    """Units in order, indexable by rank. Per lane three arrays over its nodes: the unit width and the
    code-point width of the link to the next node, and the node's place in the lane below."""

    def __init__(self, widths: np.ndarray):
        """``widths``: code points of each unit."""
        n = len(widths)
        self.units = n
        starts = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(widths, out=starts[1:])
        self.chars = int(starts[-1])
        below = np.arange(n)
        self.lanes = [(np.ones(n, dtype=np.int64), np.asarray(widths, dtype=np.int64), below)]
        for lane in _towers.rising(n):
            ends = np.append(lane[1:], n)
            self.lanes.append((ends - lane, starts[ends] - starts[lane], np.searchsorted(below, lane)))
            below = lane

    def place(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        node = units = chars = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            unit_width, char_width, down = self.lanes[level]
            last = len(unit_width)
            while node < last and units + unit_width[node] <= rank:
                units += int(unit_width[node])
                chars += int(char_width[node])
                node += 1
            if units == rank:
                return chars
            node = int(down[node])
        raise AssertionError("the lowest lane passes every rank")


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of each unit of ``text``; no pattern: code points are the units."""
    if unit is None:
        return np.ones(len(text), dtype=np.int64)
    return np.fromiter((m.end() - m.start() for m in unit.finditer(text)), dtype=np.int64)


def unit_pattern(unit: str | None) -> re.Pattern | None:
    if unit is None:
        return None
    if re.compile(unit).fullmatch(""):
        raise ValueError("a unit may not be empty")
    return re.compile(f"(?:{unit})|(?s:.)")


def arrange(prefix: str, middle: str, suffix: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    p, s, m = marks
    if form == "psm":
        return f"{p}{prefix}{s}{suffix}{m}{middle}"
    return f"{s}{suffix}{p}{prefix}{m}{middle}"


def _draw(seed: int, id_col: str, group: int) -> Column:
    """The group-th 8 hexadecimal digits of the row's hash as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def transform(
    docs: DataFrame,
    seed: int = 1,
    unit: str | None = None,
    plain_percent: int = 10,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row: ``n`` units, the lengths in code points
    (null if plain) and the rearranged text. The last ``plain_percent`` of a hundred draws stay plain, the
    first ``spm_percent`` of another are spm."""
    pattern = unit_pattern(unit)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, forms, prefixes, middles, outputs = [], [], [], [], []
        draws = zip(*[batch.column(f"draw{i}").to_pylist() for i in (1, 2, 3, 4)])
        for text, (one, two, three, four) in zip(texts(batch, text_col), draws):
            units = SkipList(unit_widths(text, pattern))
            n.append(units.units)
            if not text or three % 100 >= 100 - plain_percent or any(m in text for m in marks):
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
                outputs.append(text)
                continue
            low, high = sorted((one % (units.units + 1), two % (units.units + 1)))
            a, b = units.place(low), units.place(high)
            forms.append("spm" if four % 100 < spm_percent else "psm")
            prefixes.append(a)
            middles.append(b - a)
            outputs.append(arrange(text[:a], text[a:b], text[b:], forms[-1], marks))
        made = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *made], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    drawn = docs.select(id_col, text_col, *[_draw(seed, id_col, i).alias(f"draw{i}") for i in (1, 2, 3, 4)])
    return map_batches(drawn, step, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of. As the text holds no mark and marks do not overlap, the three in
    ``output`` are those that were put there."""
    cut = F.split(output, "|".join("\\Q" + m + "\\E" for m in marks), -1)
    psm = F.concat(cut[1], cut[3], cut[2])
    spm = F.concat(cut[2], cut[3], cut[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
