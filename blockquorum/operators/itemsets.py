"""Frequent itemsets inside every block, and their combination over blocks.

Baskets are first cut to the items frequent in their block, and equal baskets collapse into one
weighted pattern. Longer itemsets grow level by level: a row is (node, that is the itemset so far,
pattern, items of the pattern that may still follow). A level counts (node, next item) pairs straight
from the rows, which combine before they are shuffled; only rows that hold a surviving pair are carried
on, cut to the items that survived. So nothing is stored for itemsets that turn out rare, no table of
items is held in one array, and keys are a few numbers, however long the itemsets are.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.itemkeys import itemset_key
from ..runtime import cached, materialize, spread

GROUP = "block_id"
PLAIN_PAIRS = 4_000_000  # pairs in all baskets that are counted without a filter
COMBINED = 8  # occurrences per pair from which on counts combine well
MAP_WORDS = 4  # words of 64 bits in a bitmap


def support_threshold(n_baskets: int, minsup: float, n_blocks: int) -> int:
    """Absolute support inside one block."""
    return max(1, int(n_baskets * minsup / n_blocks))


def _patterns(baskets: DataFrame, singles: DataFrame, by: list[str]) -> DataFrame:
    """Baskets cut to the items of ``singles``, equal ones as one: (by, pattern, weight, tail)."""
    whole = baskets.groupBy(*by, "items").agg(F.count("*").alias("weight"))
    return _cut(materialize(whole.withColumn("pattern", F.monotonically_increasing_id()), "baskets"), singles, by)


def _cut(numbered: DataFrame, singles: DataFrame, by: list[str]) -> DataFrame:
    """The same from (by, pattern, weight, items), equal baskets not yet as one."""
    long = numbered.select(*by, "pattern", "weight", F.explode("items").alias("item"))
    cut = long.join(singles, [*by, "item"], "left_semi").groupBy(*by, "pattern", "weight")
    tails = cut.agg(F.array_sort(F.collect_list("item")).alias("tail")).filter(F.size("tail") > 1)
    merged = tails.groupBy(*by, "tail").agg(F.sum("weight").alias("weight"))
    return materialize(merged.withColumn("pattern", F.monotonically_increasing_id()), "patterns")


def _pairs_are_rare(patterns: DataFrame, singles: DataFrame, by: list[str]) -> bool:
    """Would the counts of pairs hardly combine? Not asked of baskets that repeat an item, which the filter does not know."""
    n = F.col("n").cast("double")
    copies = F.max(F.size("tail") - F.size(F.array_distinct("tail")))
    held, most = patterns.withColumn("n", F.size("tail")).agg(F.sum(n * (n - 1) / 2), copies).first()
    if (held or 0) <= PLAIN_PAIRS or most:
        return False
    of_items = singles.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    return of_items * COMBINED > held


def likely_pairs(patterns: DataFrame, least: int, by: list[str]) -> DataFrame:
    """Pairs of items that may be in baskets of weight ``least`` together, none missing: (by, node, item).

    The baskets of every item lie in one order, smaller ones first. Let a pair's first common basket be ``s``: all others
    follow, so in both lists the weight from ``s`` on is ``least`` or more. Only such places are kept, and items meet at
    equal baskets. A bitmap holds a bit per basket from the place on, switched by every basket that has it, so two bitmaps
    differ in no more bits than the lists have baskets that are not common.
    """
    long = patterns.select(*by, "pattern", "weight", F.size("tail").alias("n"), F.explode("tail").alias("item"))
    spot = F.pmod(F.xxhash64("pattern"), F.lit(64 * MAP_WORDS))
    on = Window.partitionBy(*by, "item").orderBy(F.desc("n"), F.desc("pattern")).rowsBetween(Window.unboundedPreceding, 0)
    bit = F.expr("shiftleft(1L, int(spot % 64))")
    words = [F.bit_xor(F.when(F.expr(f"spot div 64 = {k}"), bit).otherwise(F.lit(0).cast("bigint"))).over(on).alias(f"w{k}") for k in range(MAP_WORDS)]
    placed = long.withColumn("spot", spot).select(
        *by,
        "pattern",
        "item",
        F.sum("weight").over(on).alias("rest"),
        F.count("*").over(on).cast("int").alias("size"),
        F.max("weight").over(on).alias("heaviest"),
        *words,
    )
    early = placed.filter(F.col("rest") >= least).drop("rest")
    other = early.select(*by, "pattern", *[F.col(c).alias(f"{c}_") for c in ("item", "size", "heaviest", *[f"w{k}" for k in range(MAP_WORDS)])])
    apart = " + ".join(f"bit_count(w{k} ^ w{k}_)" for k in range(MAP_WORDS))
    may = F.expr(f"(size + size_ - ({apart})) div 2 * least(heaviest, heaviest_) >= {least}")
    met = early.join(other, [*by, "pattern"]).filter((F.col("item") < F.col("item_")) & may)
    return met.select(*by, F.col("item").cast("bigint").alias("node"), F.col("item_").alias("item")).distinct()


def _after(column: str) -> Column:
    """What follows place ``pos`` of an array."""
    return F.slice(column, F.col("pos") + 2, F.size(column))


def _grow(
    patterns: DataFrame, singles: DataFrame, by: list[str], survivors, likely: DataFrame | None = None
) -> list[DataFrame]:
    """Surviving itemsets of two and more items, per length: (by, prefix, support).

    ``survivors(pairs, names)`` gives (by, node, item, support) of the pairs to keep from rows of (by,
    node, item, weight), where ``names`` tells the itemset of each node. Every item of ``singles`` counts
    as a survivor. Nodes and patterns carry numbers from written tables, so they are fixed. Pairs of items that are not
    ``likely`` are left out.
    """
    if likely is not None:
        first = F.col("node").cast(likely.schema["item"].dataType).alias("item")
        items = likely.select(*by, "item").union(likely.select(*by, first)).distinct()
        patterns = _cut(patterns.withColumnRenamed("tail", "items"), items, by)
    names = singles.select(*by, F.col("item").cast("bigint").alias("node"), F.array("item").alias("prefix"))
    grown = patterns.select(*by, "pattern", "weight", "tail", F.posexplode("tail").alias("pos", "item"))
    rows = grown.select(*by, F.col("item").cast("bigint").alias("node"), "pattern", "weight", _after("tail").alias("tail"))
    found = []
    while True:
        pairs = rows.select(*by, "node", "pattern", "weight", F.explode("tail").alias("item"))
        if likely is not None and not found:
            pairs = pairs.join(likely, [*by, "node", "item"], "left_semi")
        counted = survivors(pairs, names).join(names, [*by, "node"])
        numbered = counted.select(
            *by,
            "node",
            "item",
            F.concat("prefix", F.array("item")).alias("prefix"),
            "support",
            F.monotonically_increasing_id().alias("child"),
        )
        kept = materialize(numbered, "frequent")
        found.append(kept.select(*by, "prefix", "support"))
        if kept.isEmpty():
            return found
        alive = pairs.join(kept.select(*by, "node", "item", "child"), [*by, "node", "item"])
        cut = alive.groupBy(*by, "node", "pattern", "weight").agg(
            F.array_sort(F.collect_list(F.struct("item", "child"))).alias("held")
        )
        opened = cut.filter(F.size("held") > 1).select(*by, "pattern", "weight", "held", F.posexplode("held").alias("pos", "e"))
        following = opened.filter(F.col("pos") + 1 < F.size("held")).select(
            *by, F.col("e.child").alias("node"), "pattern", "weight", _after("held.item").alias("tail")
        )
        rows = materialize(following, "grown")
        names = kept.select(*by, F.col("child").alias("node"), "prefix")


@contextmanager
def _kept(baskets: DataFrame, ready: bool):
    if ready:
        yield baskets
    else:
        with cached(spread(baskets)) as kept:
            yield kept


def local_itemsets(
    baskets: DataFrame,
    minsup: float,
    n_blocks: int,
    min_size: int = 1,
    ready: bool = False,
    least: int | None = None,
) -> DataFrame:
    """Itemsets frequent inside each block: (block_id, items, itemset, support).

    ``n_blocks`` is the number of chosen blocks; the threshold is the same in all of them. ``least``
    gives it as a number of baskets instead. ``ready`` says that the caller has cached the baskets.
    """
    by = [GROUP]
    with _kept(baskets.select(GROUP, "items"), ready) as rows:
        min_count = support_threshold(rows.count(), minsup, n_blocks) if least is None else max(1, least)
        singles = rows.select(GROUP, F.explode("items").alias("item")).groupBy(GROUP, "item")
        counted = singles.agg(F.count("*").alias("support")).filter(F.col("support") >= min_count)
        frequent = materialize(counted, "singles")
        patterns = _patterns(rows, frequent, by)

    def survivors(pairs: DataFrame, names: DataFrame) -> DataFrame:
        counts = pairs.groupBy(GROUP, "node", "item").agg(F.sum("weight").alias("support"))
        return counts.filter(F.col("support") >= min_count)

    rare = _pairs_are_rare(patterns, frequent, by)
    found = _grow(patterns, frequent, by, survivors, materialize(likely_pairs(patterns, min_count, by), "likely") if rare else None)
    if min_size < 2:
        found.append(frequent.select(GROUP, F.array("item").alias("prefix"), "support"))
    return (
        reduce(DataFrame.unionByName, found)
        .filter(F.size("prefix") >= min_size)
        .select(GROUP, F.col("prefix").alias("items"), itemset_key(F.col("prefix")).alias("itemset"), "support")
    )


def candidate_itemsets(local: DataFrame) -> DataFrame:
    """Distinct itemsets of more than one item over all blocks."""
    return local.filter(F.size("items") > 1).select("items", "itemset").distinct()


def vote_itemsets(local: DataFrame, n_blocks: int, vote: float) -> DataFrame:
    """Itemsets found by at least ``vote`` of the blocks, with the mean support of the finders."""
    return (
        local.filter(F.size("items") > 1)
        .groupBy("itemset")
        .agg(F.count("*").alias("votes"), F.expr("sum(support) div count(*)").alias("support"))
        .filter(F.col("votes") >= F.lit(float(n_blocks * vote)))
    )


def recount_itemsets(
    baskets: DataFrame, candidates: DataFrame, minsup: float, ready: bool = False
) -> DataFrame:
    """Exact share of all baskets that hold each candidate, kept from ``minsup`` on.

    Candidates must hold every sub-itemset of two or more items, as local results do.
    """
    cand = materialize(candidates.select("items"), "candidates")
    singles = cand.select(F.explode("items").alias("item")).distinct()
    with _kept(baskets.select("items"), ready) as rows:
        n = rows.count()
        patterns = _patterns(rows, singles, [])
    steps = cand.select(
        F.expr("slice(items, 1, size(items) - 1)").alias("prefix"), F.element_at("items", -1).alias("item")
    )

    def survivors(pairs: DataFrame, names: DataFrame) -> DataFrame:
        known = pairs.join(names.join(steps, "prefix").select("node", "item"), ["node", "item"], "left_semi")
        return known.groupBy("node", "item").agg(F.sum("weight").alias("support"))

    found = _grow(patterns, singles, [], survivors)
    counted = reduce(DataFrame.unionByName, found).select(
        F.col("prefix").alias("items"),
        itemset_key(F.col("prefix")).alias("itemset"),
        "support",
        (F.col("support") / F.lit(n)).alias("share"),
    )
    return counted.filter(F.col("share") >= F.lit(float(minsup)))
