"""Decision trees and forests inside every block, grown level by level for all blocks at once.

Features are cut to at most ``bins`` bins of equal size per block, at values that mergeable quantile
sketches find in one pass, so neither skew nor far-off values cost bins. A level is one aggregation:
label counts per (block, tree, node, feature, bin). The best Gini split per node follows from running
sums over the bins, and the small table of splits is joined back to move rows to the child nodes. These
joins are cheap, so rows are cached only every few levels and walk from there. A forest keeps each row
once, whatever the number of trees. Rows of a block with equal label and bins take the same path in every
tree, so they are added up to one cell before the levels, and cells unfold by tree only on the way into the counts.
"""

from __future__ import annotations

import math
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import digest
from ..runtime import cached, settle, working

BINS = 32
ACCURACY = 200_000  # of the quantile sketches: a cut is off by at most one row in so many; exact in blocks of half as many
MAX_CLASSES = 64
CACHE_EVERY = 4
HALVED_DIM = 8  # most features whose bins are found by halving, as code of more would grow too long to be compiled
NODE = ["block_id", "tree", "node"]
NO_FEATURE = -1

# Cumulative Poisson(1) probabilities: how often a row is drawn into a bootstrap sample.
POISSON_STEPS = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1)) for n in range(6)]


def labels_and_dim(rows: DataFrame) -> tuple[list[int], int]:
    found = rows.groupBy("label").agg(F.max(F.size("x")).alias("dim")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} class labels")
    return sorted(r.label for r in found), max((r.dim for r in found), default=0)


def _array(parts: list[str]) -> Column:
    return F.expr(f"array({', '.join(parts)})")


def feature_cuts(rows: DataFrame, dim: int, bins: int = BINS) -> DataFrame:
    """(block_id, cuts): ``cuts[feature]`` holds the values at ranks ceil(k * n / bins), k = 1 .. bins - 1."""
    shares = ", ".join(repr(k / bins) for k in range(1, bins))
    cuts = [f"percentile_approx(x[{j}], array({shares}), {ACCURACY})" for j in range(dim)]
    return rows.groupBy("block_id").agg(_array(cuts).alias("cuts"))


def bin_rows(rows: DataFrame, dim: int, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Rows with ``bins`` instead of ``x``, and (block_id, feature, bin, threshold).

    A value's bin is the number of cuts below it, so a bin and those before it hold the values
    up to the cut of the same number.
    """
    cuts = settle(feature_cuts(rows, dim, bins), dim * bins + 1, "cuts")
    thresholds = cuts.select("block_id", F.posexplode("cuts").alias("feature", "c")).select(
        "block_id", "feature", F.posexplode("c").alias("bin", "threshold")
    )
    if dim > HALVED_DIM:
        binned = _array([f"size(filter(cuts[{j}], c -> c < x[{j}]))" for j in range(dim)])
        return rows.join(cuts, "block_id").select("block_id", "u", "label", binned.alias("bins")), thresholds
    return _bins_by_halves(rows, cuts, dim, bins), thresholds


def _bins_by_halves(rows: DataFrame, cuts: DataFrame, dim: int, bins: int) -> DataFrame:
    """The number of cuts below each value, found by halving the sorted cuts: some five comparisons a value, all in
    generated code, where a lambda over the cuts would be interpreted."""
    features, steps = range(dim), [1 << i for i in reversed(range((bins - 1).bit_length()))]
    sorted_cuts = cuts.selectExpr("block_id", *[f"array_sort(cuts[{j}]) AS c{j}" for j in features])
    keep = ["block_id", "u", "label", *[f"c{j}" for j in features], *[f"x{j}" for j in features]]
    data = rows.select("block_id", "u", "label", *[F.col("x")[j].alias(f"x{j}") for j in features]).join(sorted_cuts, "block_id")
    data = data.selectExpr(*keep, *[f"0 AS p{j}" for j in features])
    for step in steps:
        further = [f"p{j} + if(get(c{j}, p{j} + {step - 1}) < x{j}, {step}, 0) AS p{j}" for j in features]
        data = data.selectExpr(*keep, *further)
    binned = _array([f"if(c{j} IS NULL, size(c{j}), p{j})" for j in features])
    return data.select("block_id", "u", "label", binned.alias("bins"))


def bootstrap(binned: DataFrame, n_trees: int, seed: int) -> DataFrame:
    """Rows with ``draws``: how often each tree draws the row. A row stays one row, however many trees draw it.

    A digest of the row serves eight trees, four hex digits each; these compare as text.
    """
    digits = F.concat(*[digest(f"draw{seed}", F.lit(g), "u") for g in range(-(-n_trees // 8))])
    limits = [f"{int(p * (1 << 16)):04x}" for p in POISSON_STEPS]

    def drawn(tree: int) -> str:  # written out per tree: a lambda over the trees would not be compiled
        digit = f"substr(digits, {tree * 4 + 1}, 4)"
        return f"CASE {' '.join(f"WHEN {digit} < '{p}' THEN {k}Y" for k, p in enumerate(limits))} ELSE {len(limits)}Y END"

    return binned.withColumn("digits", digits).withColumn("draws", _array([drawn(t) for t in range(n_trees)])).drop("digits")


def cells(drawn: DataFrame, n_trees: int) -> DataFrame:
    """Rows of a block with equal label and bins as one, with ``draws``: how often each tree draws any of them.

    A block has no more cells than rows, and no more than ``classes * bins ** dim``, however many rows it has.
    """
    sums = [f"sum(draws[{t}])" for t in range(n_trees)]
    summed = drawn.groupBy("block_id", "label", "bins").agg(_array(sums).alias("draws"))
    # Neighbouring blocks together again, so that label counts combine before their shuffle.
    n = max(drawn.sparkSession.sparkContext.defaultParallelism, int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return summed.repartitionByRange(n, "block_id", F.xxhash64("label", "bins"))


def _feature_subset(node: Column, dim: int, m: int, seed: int) -> Column:
    """``m`` features of a node, those lowest in hash order."""
    ranked = F.array(*[
        F.struct(digest(f"pick{seed}", "block_id", "tree", node, F.lit(j)).alias("h"), F.lit(j).alias("f"))
        for j in range(dim)
    ])
    return F.transform(F.slice(F.array_sort(ranked), 1, m), lambda s: s["f"])


def _label_counts(classes: list[int]) -> list[Column]:
    return [F.expr(f"sum(if(label = {c}, weight, 0)) AS n{i}") for i, c in enumerate(classes)]


def _top_label(counts: list[str], classes: list[int]) -> str:
    """The most frequent label, the smallest one on ties."""
    labels = ", ".join(map(str, classes))
    listed = ", ".join(counts)
    return f"array({labels})[int(array_position(array({listed}), array_max(array({listed})))) - 1]"


def _gini_share(counts: list[str]) -> str:
    squares = " + ".join(f"double({c}) * {c}" for c in counts)
    return f"({squares}) / ({' + '.join(counts)})"


def best_splits(long: DataFrame, classes: list[int], min_leaf: int, node: list[str] = NODE) -> DataFrame:
    """Best Gini split of every node, ties to the lower feature and bin; ``long`` has a row per row and feature
    tried: (the columns of ``node``, label, weight, feature, bin)."""
    hist = long.groupBy(*node, "feature", "bin").agg(*_label_counts(classes))
    ids = range(len(classes))
    whole = f"PARTITION BY {', '.join(node)}, feature"
    # One exchange by node serves the running sums and the choice per node.
    sides = hist.repartition(*node).selectExpr(
        *node,
        "feature",
        "bin",
        *[f"sum(n{i}) OVER ({whole} ORDER BY bin) AS l{i}" for i in ids],
        *[f"sum(n{i}) OVER ({whole}) AS t{i}" for i in ids],
    )
    left, both = [f"l{i}" for i in ids], [f"t{i}" for i in ids]
    right = [f"(t{i} - l{i})" for i in ids]
    left_n, right_n = " + ".join(left), " + ".join(right)
    scored = sides.where(f"{left_n} >= {min_leaf} AND {right_n} >= {min_leaf}").selectExpr(
        "*", f"round({_gini_share(left)} + {_gini_share(right)} - {_gini_share(both)}, 6) AS gain"
    )
    described = (
        f"struct(gain, -feature AS f, -bin AS b, {_top_label(left, classes)} AS left_label, "
        f"{_top_label(right, classes)} AS right_label)"
    )
    best = scored.where("gain > 0").groupBy(*node).agg(F.expr(f"max({described}) AS s"))
    return best.selectExpr(*node, "-s.f AS feature", "-s.b AS bin", "s.left_label", "s.right_label")


def _grow_trees(binned: DataFrame, classes: list[int], depth: int, min_leaf: int) -> tuple[DataFrame, list[DataFrame], int]:
    """One tree per block: root labels, splits by level, and how many roots there are."""
    data = binned.selectExpr("block_id", "0 AS tree", "label", "1 AS weight", "bins", "1 AS node")
    splits: list[DataFrame] = []
    with ExitStack() as held:
        data = held.enter_context(cached(data))
        roots, n = _roots(data, classes)
        for level in range(depth):
            if level and level % CACHE_EVERY == 0:
                data = held.enter_context(cached(data))
            long = data.selectExpr(*NODE, "label", "weight", "posexplode(bins) AS (feature, bin)")
            found = settle(best_splits(long, classes, min_leaf), 7, "splits", most=n << level)
            splits.append(found)
            if level + 1 == depth or found.isEmpty():
                break
            moves = found.selectExpr(*NODE, "feature", "bin AS cut")
            data = data.join(moves, NODE).selectExpr(
                "block_id", "tree", "label", "weight", "bins", "node * 2 + if(bins[feature] <= cut, 0, 1) AS node"
            )
    return roots, splits, n


def _by_slot(live: DataFrame, *columns: str) -> DataFrame:
    """One row per block: arrays of ``columns`` whose places are the slots of its live nodes."""
    ordered = live.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("slot", *columns))).alias("s"))
    return ordered.selectExpr("block_id", *[f"s.{c} AS {c}" for c in columns])


def _grow_forest(
    binned: DataFrame, classes: list[int], dim: int, depth: int, min_leaf: int, n_trees: int, seed: int
) -> tuple[DataFrame, list[DataFrame], int]:
    """The same for a forest per block.

    A cell of equal rows is kept once, with how often each tree draws its rows (``draws``) and where they stand in
    each tree (``slots``). The live nodes of a block, of all its trees, are numbered 0, 1, 2 ...: a cell's slot in a
    tree is the number of its node, -1 below a leaf. Cells unfold by tree and tried feature only on the way into the
    label counts. Joined to them is one row per block with a few numbers for each slot.
    """
    m = max(1, int(math.sqrt(dim)))
    slot = ["block_id", "slot"]
    splits: list[DataFrame] = []
    moved = (
        "transform(slots, s -> if(s < 0, -1, coalesce("
        "base[s] + if(bins[feature[s]] <= cut[s], 0, 1), -1))) AS slots"
    )
    in_tree = (
        "transform(slots, (s, t) -> named_struct('slot', s, 'weight', draws[t], "
        f"'tried', if(s < 0, null, slice(picks, s * {m} + 1, {m}))))"
    )
    with ExitStack() as held:
        start = f"sequence(0, {n_trees - 1}) AS slots"
        data = cells(bootstrap(binned, n_trees, seed), n_trees).selectExpr("block_id", "label", "bins", "draws", start)
        data = held.enter_context(cached(data))
        drawn = data.selectExpr("block_id", "label", "posexplode(draws) AS (tree, weight)").filter("weight > 0")
        roots, n = _roots(drawn.withColumn("node", F.lit(1)), classes)
        blocks = roots.select("block_id").distinct()
        live = blocks.selectExpr("block_id", f"explode(sequence(0, {n_trees - 1})) AS slot").selectExpr(
            *slot, "slot AS tree", "1 AS node"
        )
        for level in range(depth):
            if level and level % CACHE_EVERY == 0:
                data = held.enter_context(cached(data))
            tried = live.withColumn("picks", _feature_subset(F.col("node"), dim, m, seed))
            picks = settle(
                _by_slot(tried, "picks").withColumn("picks", F.flatten("picks")), (m * n_trees << level) + 1, "picks", most=n
            )
            # The features tried go out of the picks before the rows unfold, so no copy carries all of them.
            by_tree = data.join(picks, "block_id").selectExpr("block_id", "label", "bins", f"inline({in_tree})")
            long = by_tree.filter("slot >= 0 AND weight > 0").selectExpr(
                *slot, "label", "bins", "weight", "explode(tried) AS feature"
            ).selectExpr(*slot, "label", "weight", "feature", "bins[feature] AS bin")
            best = best_splits(long, classes, min_leaf, slot).join(live, slot)
            base = 2 * (F.row_number().over(Window.partitionBy("block_id").orderBy("slot")) - 1)
            found = settle(best.withColumn("base", base), 9, "splits", most=n << level)
            splits.append(found)
            if level + 1 == depth or found.isEmpty():
                break
            told = live.join(found.selectExpr(*slot, "feature", "bin AS cut", "base"), slot, "left")
            moves = _by_slot(told, "feature", "cut", "base").join(found.select("block_id").distinct(), "block_id", "left_semi")
            moves = settle(moves, (3 * n_trees << level) + 1, "moves", most=n)
            data = data.join(moves, "block_id").selectExpr("block_id", "label", "bins", "draws", moved)
            live = found.selectExpr("block_id", "base", "tree", "node", "explode(array(0, 1)) AS side").selectExpr(
                "block_id", "base + side AS slot", "tree", "node * 2 + side AS node"
            )
    return roots, splits, n


def _roots(data: DataFrame, classes: list[int]) -> tuple[DataFrame, int]:
    counts = data.groupBy(*NODE).agg(*_label_counts(classes))
    label = _top_label([f"n{i}" for i in range(len(classes))], classes)
    roots = settle(counts.selectExpr(*NODE, f"{label} AS label"), 4, "roots")
    return roots, roots.count()


def _assemble(roots: DataFrame, splits: list[DataFrame], thresholds: DataFrame) -> DataFrame:
    parts = [s.select(*NODE, "feature", "bin", "left_label", "right_label") for s in splits]
    every = reduce(DataFrame.unionByName, parts)
    children = every.select(
        "block_id",
        "tree",
        F.explode(
            F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("left_label").alias("label")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right_label").alias("label")),
            )
        ).alias("c"),
    ).select("block_id", "tree", "c.node", "c.label")
    tests = every.join(thresholds, ["block_id", "feature", "bin"]).select(*NODE, "feature", "threshold")
    nodes = (
        roots.select(*NODE, "label")
        .unionByName(children)
        .join(tests, NODE, "left")
        .withColumn("feature", F.coalesce("feature", F.lit(NO_FEATURE)))
        .withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    )
    return nodes.groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("tree", "node", "feature", "threshold", "label"))).alias("nodes")
    )


def fit_trees(
    rows: DataFrame,
    depth: int = 10,
    min_leaf: int = 10,
    n_trees: int = 0,
    seed: int = 7,
    ready: bool = False,
    bins: int = BINS,
) -> DataFrame:
    """One tree (``n_trees=0``) or one forest per block: (block_id, nodes). Splits are tried at ``bins`` - 1
    values of each feature, of equal row counts in the block.

    A node sends values up to its threshold to child ``2*node``, others to ``2*node+1``.
    """
    with working(rows.select("block_id", "u", "label", "x"), ready) as source:
        classes, dim = labels_and_dim(source)
        if not classes:
            return rows.sparkSession.createDataFrame(
                [], "block_id int, nodes array<struct<tree:int,node:int,feature:int,threshold:double,label:int>>"
            )
        binned, thresholds = bin_rows(source, dim, bins)
        if n_trees:
            roots, splits, n = _grow_forest(binned, classes, dim, depth, min_leaf, n_trees, seed)
        else:
            roots, splits, n = _grow_trees(binned, classes, depth, min_leaf)
        return settle(_assemble(roots, splits, thresholds), 10 * max(1, n_trees) << depth, "trees", most=n)
