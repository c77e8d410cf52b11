"""Frequent itemsets over blocks: by vote, by exact recount, or on the whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..operators.baselines import full_itemsets
from ..operators.blocks import select_blocks
from ..operators.itemsets import candidate_itemsets, local_itemsets, recount_itemsets, vote_itemsets
from ..runtime import cached, spread
from ..sources.store import write_itemsets
from .classify import random_ids


def _chosen(baskets: DataFrame, ids: DataFrame, size: int, n: int) -> DataFrame:
    return select_blocks(baskets, random_ids(ids, size)[:n])


def run_vote(
    baskets: DataFrame,
    ids: DataFrame,
    minsup: float,
    vote: float,
    size: int | None = None,
    path: str | None = None,
) -> DataFrame:
    """Itemsets that enough blocks find: (itemset, votes, support).

    ``size`` takes ``ceil(size * 0.05)`` random blocks; without it every block takes part.
    """
    n = ids.count() if size is None else math.ceil(size * 0.05)
    part = baskets if size is None else _chosen(baskets, ids, size, n)
    voted = vote_itemsets(local_itemsets(part, minsup, n), n, vote)
    if path:
        write_itemsets(voted, path)
    return voted


def run_recount(
    baskets: DataFrame, ids: DataFrame, minsup: float, size: int | None = None, path: str | None = None
) -> DataFrame:
    """Local itemsets as candidates, counted exactly: (items, itemset, support, share).

    ``size`` takes ``ceil(size div 5 * 10 * 0.05)`` random blocks; without it every block.
    """
    n = ids.count() if size is None else math.ceil((size // 5) * 10 * 0.05)
    part = baskets if size is None else _chosen(baskets, ids, size, n)
    with cached(spread(part.select("block_id", "items"))) as part:
        local = local_itemsets(part, minsup, n, min_size=2, ready=True)
        counted = recount_itemsets(part, candidate_itemsets(local), minsup, ready=True)
    if path:
        write_itemsets(counted, path, "share")
    return counted


def run_full(
    baskets: DataFrame, ids: DataFrame, minsup: float = 0.15, size: int | None = None, path: str | None = None
) -> DataFrame:
    """Itemsets of ``size`` random blocks (or all) taken as one table."""
    part = baskets if size is None else _chosen(baskets, ids, size, size)
    found = full_itemsets(part, minsup)
    if path:
        write_itemsets(found, path)
    return found
