"""Canonical text forms of itemsets and baskets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def itemset_key(items: Column) -> Column:
    """``{2,10}``: items in numeric order."""
    joined = F.array_join(F.sort_array(items).cast("array<string>"), ",")
    return F.concat(F.lit("{"), joined, F.lit("}"))


def parse_basket(line: Column) -> Column:
    """Space-separated integers, repeats removed, in numeric order; a blank line is an empty basket."""
    pieces = F.filter(F.split(line, " "), lambda piece: piece != "")
    return F.array_sort(F.array_distinct(pieces.cast("array<int>")))


def basket_line(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), " ")
