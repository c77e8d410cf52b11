"""One model per block behind one name: the model table used by scoring and votes.

(block_id, algo, weights, labels, nodes, n_train, n_test, accuracy); ``weights`` and the ``labels`` they
answer for linear models, ``nodes`` for trees and forests.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, functions as F

from ..runtime import settle, working
from .blocks import mark_holdout
from .linear import fit_cascade, fit_logreg, fit_svm
from .scoring import predict_own
from .trees import fit_trees
from .voting import accuracy

MODEL_WIDTH = 10_000
NODES_TYPE = "array<struct<tree:int,node:int,feature:int,threshold:double,label:int>>"


FITTERS: dict[str, Callable[..., DataFrame]] = {
    "DT": fit_trees,
    "RF": partial(fit_trees, depth=5, min_leaf=5, n_trees=20),
    "LR": fit_logreg,
    "SVM": fit_svm,
    "CSVM": fit_cascade,
    "STUMP": partial(fit_trees, depth=1),
}


def fit_blocks(rows: DataFrame, algo: str, **params) -> DataFrame:
    """Fit one model inside every block of ``rows`` (block_id, u, label, x)."""
    fitted = FITTERS[algo](rows, **params)
    if "weights" not in fitted.columns:
        fitted = fitted.withColumn("weights", F.lit(None).cast("array<double>")).withColumn("labels", F.lit(None).cast("array<int>"))
    if "nodes" not in fitted.columns:
        fitted = fitted.withColumn("nodes", F.lit(None).cast(NODES_TYPE))
    return fitted.select("block_id", F.lit(algo).alias("algo"), "weights", "labels", "nodes")


def fit_and_score(rows: DataFrame, algo: str, share: float = 0.9, **params) -> DataFrame:
    """Fit on the first ``share`` of every block and score each model on the rest of its block."""
    with working(rows.select("block_id", "u", "label", "x")) as source:
        marked = mark_holdout(source, share)
        train = marked.filter("is_train").drop("is_train")
        models = fit_blocks(train, algo, ready=True, **params)
        held = marked.filter(~F.col("is_train"))
        scores = accuracy(predict_own(held, models), "block_id")
        sizes = train.groupBy("block_id").agg(F.count("*").alias("n_train"))
        return settle(
            models.join(sizes, "block_id").join(scores, "block_id", "left").withColumn(
                "n_test", F.coalesce("n_test", F.lit(0).cast("bigint"))
            ),
            MODEL_WIDTH,
            "models",
        )


def single_block(rows: DataFrame) -> DataFrame:
    """The whole table as one block."""
    return rows.withColumn("block_id", F.lit(0))
