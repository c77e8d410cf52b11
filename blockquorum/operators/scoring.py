"""Applying block models to rows.

All models of an ensemble are tried on a row at once inside one scan: they travel as packed
numpy arrays of bounded size, and a row gives its vote counts per class. Neither rows nor
(row, model) pairs are shuffled. An ensemble above the bound is applied part by part, the
counts so far kept in a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize

MAX_VALUES = 16_000_000


@dataclass
class Packed:
    """Models of some blocks as flat arrays. Trees hold node positions, roots per model and tree."""

    blocks: np.ndarray
    classes: np.ndarray
    weights: np.ndarray | None  # one row per model: a set of weights, or a set for each of several labels
    scores: np.ndarray
    answers: np.ndarray | None = None  # class positions of a linear model's labels
    roots: np.ndarray | None = None
    feature: np.ndarray | None = None
    threshold: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    label: np.ndarray | None = None

    def _leaf_labels(self, start: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Class position of the leaf reached from node ``start[i]`` by row ``x[i]``."""
        at = start.copy()
        active = np.flatnonzero(self.feature[at] >= 0)
        while len(active):
            node = at[active]
            goes_left = x[active, self.feature[node]] <= self.threshold[node]
            at[active] = np.where(goes_left, self.left[node], self.right[node])
            active = active[self.feature[at[active]] >= 0]
        return self.label[at]

    def predict(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Class position given by model ``model[i]`` to row ``x[i]``; ties to the smaller label."""
        if self.weights is not None:
            sets = self.weights[model].reshape(len(x), -1, x.shape[1] + 1)
            found = np.einsum("ij,ikj->ik", x, sets[:, :, :-1]) + sets[:, :, -1]
            best = (found[:, 0] > 0).astype(int) if found.shape[1] == 1 else found.argmax(axis=1)
            return self.answers[model, best]
        if self.roots.shape[1] == 1:
            return self._leaf_labels(self.roots[model, 0], x)
        counts = np.zeros((len(x), len(self.classes)), dtype=np.int32)
        each = np.arange(len(x))
        for tree in range(self.roots.shape[1]):
            start = self.roots[model, tree]
            known = start >= 0
            reached = self._leaf_labels(start[known], x[known])
            np.add.at(counts, (each[known], reached), 1)
        return counts.argmax(axis=1)

    def tally(self, x: np.ndarray, weighted: bool) -> np.ndarray:
        votes = np.zeros((len(x), len(self.classes)))
        each = np.arange(len(x))
        for m in range(len(self.blocks)):
            predicted = self.predict(np.full(len(x), m), x)
            votes[each, predicted] += self.scores[m] if weighted else 1.0
        return votes


def _matrix(x: pa.Array) -> np.ndarray:
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1)


def survey(models: DataFrame, max_values: int = MAX_VALUES) -> tuple[list[int], list[list[int]]]:
    """The labels the models can give, and their blocks in groups of bounded packed size."""
    size = F.greatest(F.size("weights"), F.lit(0)) + 5 * F.greatest(F.size("nodes"), F.lit(0))
    given = F.coalesce(F.array_distinct("nodes.label"), F.col("labels") if "labels" in models.columns else F.lit(None).cast("array<int>"))
    labels, parts, room = set(), [], 0
    for block_id, n, found in sorted(
        models.select("block_id", size.alias("n"), given.alias("labels")).collect(),
        key=lambda r: r.block_id,
    ):
        labels.update(found or (0, 1))
        if not parts or room < n:
            parts.append([])
            room = max_values
        parts[-1].append(block_id)
        room -= n
    return sorted(labels or (0, 1)), parts


def pack(models: DataFrame, classes: list[int]) -> Packed:
    scored = "accuracy" if "accuracy" in models.columns else "CAST(NULL AS double) AS accuracy"
    answered = "labels" if "labels" in models.columns else "CAST(NULL AS array<int>) AS labels"
    held = models.selectExpr("block_id", "weights", "nodes", answered, scored).toArrow().sort_by("block_id").combine_chunks()
    blocks = held["block_id"].to_numpy()
    labels = np.array(classes)
    scores = np.nan_to_num(held["accuracy"].to_numpy().astype(float))
    if held["weights"].null_count == 0:
        weights = held["weights"].combine_chunks().flatten().to_numpy().reshape(len(blocks), -1)
        answers = np.searchsorted(labels, [found or (0, 1) for found in held["labels"].to_pylist()])
        return Packed(blocks, labels, weights, scores, answers)
    lists = held["nodes"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    nodes = lists.flatten()
    tree, node, feature, threshold, label = (
        nodes.field(i).to_numpy(zero_copy_only=False).astype(kind)
        for i, kind in enumerate((np.int64, np.int64, np.int64, float, np.int64))
    )
    model = np.repeat(np.arange(len(blocks)), lists.value_lengths().to_numpy())
    n_trees, span = int(tree.max()) + 1, 2 * int(node.max()) + 2
    first = (model * n_trees + tree) * span
    places = first + node
    order = np.argsort(places)

    def at(wanted: np.ndarray) -> np.ndarray:
        near = order[np.minimum(np.searchsorted(places, wanted, sorter=order), len(order) - 1)]
        return np.where(places[near] == wanted, near, -1)

    roots = at(np.arange(len(blocks) * n_trees) * span + 1).reshape(len(blocks), n_trees)
    return Packed(
        blocks,
        labels,
        None,
        scores,
        roots=roots,
        feature=feature,
        threshold=threshold,
        left=at(first + 2 * node),
        right=at(first + 2 * node + 1),
        label=np.searchsorted(labels, label),
    )


def _ship(models: DataFrame, part: list[int], classes: list[int]):
    packed = pack(models.filter(F.col("block_id").isin(part)), classes)
    return models.sparkSession.sparkContext.broadcast(vars(packed))


def _own_udf(shipped):
    def predict(block: pa.Array, x: pa.Array) -> pa.Array:
        packed = Packed(**shipped.value)
        model = np.searchsorted(packed.blocks, block.to_numpy(zero_copy_only=False))
        found = packed.predict(model, _matrix(x)) if len(x) else np.zeros(0, dtype=int)
        return pa.array(packed.classes[found].astype(np.int32))

    return F.arrow_udf(predict, "int")


def _tally_udf(shipped, n_classes: int, weighted: bool):
    def tally(x: pa.Array) -> pa.Array:
        votes = Packed(**shipped.value).tally(_matrix(x), weighted) if len(x) else np.zeros((0, n_classes))
        offsets = np.arange(len(x) + 1, dtype=np.int32) * n_classes
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(votes.ravel()))

    return F.arrow_udf(tally, "array<double>")


def predict_own(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``prediction`` by the model of the row's own block; rows of other blocks are left out."""
    classes, parts = survey(models)
    done = []
    for part in parts:
        udf = _own_udf(_ship(models, part, classes))
        mine = rows.filter(F.col("block_id").isin(part))
        done.append(mine.withColumn("prediction", udf(F.col("block_id"), F.col("x"))))
    if not done:
        return rows.filter(F.lit(False)).withColumn("prediction", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, done)


def vote_tallies(
    rows: DataFrame, models: DataFrame, weighted: bool = False, max_values: int = MAX_VALUES
) -> tuple[DataFrame, list[int]]:
    """Rows with ``votes``: per class the number of models (or their summed accuracy) voting for it.

    Returns the rows and the class labels in the order of ``votes``.
    """
    classes, parts = survey(models, max_values)
    out = rows.withColumn("votes", F.array(*[F.lit(0.0)] * len(classes)))
    for i, part in enumerate(parts):
        votes = _tally_udf(_ship(models, part, classes), len(classes), weighted)(F.col("x"))
        if i:
            votes = F.zip_with(F.col("votes"), votes, lambda a, b: a + b)
        out = out.withColumn("votes", votes)
        if i + 1 < len(parts):
            out = materialize(out, "votes")
    return out, classes


def accuracy_matrix(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Every model on every block of ``rows``: (model_block, block_id, n_test, accuracy).

    Each batch of rows gives one count per model and block, so no pair of row and model leaves
    its task.
    """
    classes, parts = survey(models)
    schema = "model_block int, block_id int, n bigint, n_right bigint"

    def counter(shipped):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed = Packed(**shipped.value)
            for batch in batches:
                x = _matrix(batch.column("x"))
                label = batch.column("label").to_numpy(zero_copy_only=False)
                blocks, at = np.unique(batch.column("block_id").to_numpy(zero_copy_only=False), return_inverse=True)
                n = np.bincount(at, minlength=len(blocks))
                for m, model_block in enumerate(packed.blocks):
                    given = packed.classes[packed.predict(np.full(len(x), m), x)]
                    right = np.bincount(at, weights=given == label, minlength=len(blocks))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "model_block": pa.array(np.full(len(blocks), model_block, dtype=np.int32)),
                            "block_id": pa.array(blocks.astype(np.int32)),
                            "n": pa.array(n.astype(np.int64)),
                            "n_right": pa.array(right.astype(np.int64)),
                        }
                    )

        return count

    source = rows.select("block_id", "label", "x")
    counts = [source.mapInArrow(counter(_ship(models, part, classes)), schema) for part in parts]
    return (
        reduce(DataFrame.unionByName, counts)
        .groupBy("model_block", "block_id")
        .agg(F.sum("n").alias("n_test"), (F.sum("n_right") / F.sum("n")).alias("accuracy"))
    )


def voted_label(votes: Column, classes: list[int]) -> Column:
    """Class with most votes, the smallest label on ties."""
    labels = F.array(*[F.lit(int(c)) for c in classes])
    return labels[(F.array_position(votes, F.array_max(votes)) - 1).cast("int")]


def weighted_label(votes: Column, classes: list[int]) -> Column:
    """Mean label weighted by the votes, rounded half up."""
    total = reduce(lambda a, b: a + b, [votes[i] for i in range(len(classes))])
    mass = reduce(lambda a, b: a + b, [votes[i] * F.lit(float(c)) for i, c in enumerate(classes)])
    return F.floor(mass / total + F.lit(0.5)).cast("int")
