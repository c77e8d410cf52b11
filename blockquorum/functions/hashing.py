"""Seeded hashing in place of random numbers, so every run repeats exactly.

One md5 digest per row serves all choices: hex digits 1-8 pick the block, digits 9-23
form the 60-bit order value ``u`` used for hold-outs, samples and sub-blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

U_RANGE = 1 << 60
H_RANGE = 1 << 32


def row_key(*cols: str | Column) -> Column:
    return F.concat_ws("-", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def digest(seed: int | str, *parts: str | Column) -> Column:
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def hex_slice(hex_col: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(hex_col, start, length), 16, 10).cast("bigint")


def h32(seed: int | str, *parts: str | Column) -> Column:
    return hex_slice(digest(seed, *parts), 1, 8)


def below(col: Column, share: float, span: int = U_RANGE) -> Column:
    """True for a fixed share of uniform hash values."""
    return col < F.lit(int(share * span))
