"""Block ensembles for classification, and the whole-table runs they are compared with."""

from __future__ import annotations

from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import DataFrame, functions as F

from ..operators.baselines import full_classifier
from ..operators.blocks import (
    block_order,
    block_split,
    listed_budget,
    plan_lookup,
    predict_fraction,
    row_sample,
    row_split,
    select_blocks,
    subdivide,
)
from ..operators.models import MODEL_WIDTH, fit_and_score, fit_blocks, single_block
from ..operators.plugins import BlockClassifier, fit_and_score_custom, voted_answer
from ..operators.scoring import accuracy_matrix, predict_own, vote_tallies, voted_label, weighted_label
from ..operators.voting import accuracy, pooled_accuracy, trim_tails
from ..runtime import materialize, settle
from ..sources.store import append_metrics, metric_rows, write_models

CUTS = {"SVM": 8}  # smaller blocks that a run cuts a train block into, for fits whose cost grows faster than their rows


@dataclass
class Ensemble:
    """``models`` all fitted, ``kept`` after the trim, ``predicted`` rows or None, ``seconds`` to fit."""

    models: DataFrame
    kept: DataFrame
    predicted: DataFrame | None
    seconds: float

    def accuracy(self) -> DataFrame | None:
        """Row-weighted mean over the predict blocks: (n_test, accuracy)."""
        if self.predicted is None:
            return None
        return pooled_accuracy(accuracy(self.predicted, "block_id"))

    def metrics(self) -> dict[str, float]:
        """Counts of models and of those cut off, the range of kept scores, the accuracy and the seconds to fit."""
        fitted = self.models.count()
        kept = self.kept.agg(F.count("*"), F.min("accuracy"), F.max("accuracy")).first()
        found = {"fit_seconds": self.seconds, "models": fitted, "cut_models": fitted - kept[0], "kept_models": kept[0]}
        found |= {"score_low": kept[1], "score_high": kept[2]}
        if self.predicted is not None:
            found |= self.accuracy().first().asDict()
        return {name: value for name, value in found.items() if value is not None}


def predict_rows(rows: DataFrame, kept: DataFrame, weighted: bool = False) -> DataFrame:
    """Ensemble answer per row, with the vote counts it came from."""
    tallied, classes = vote_tallies(rows, kept, weighted)
    answer = weighted_label if weighted else voted_label
    return tallied.withColumn("prediction", answer(F.col("votes"), classes))


def run_ensemble(
    rows: DataFrame,
    train_ids: list[int],
    predict_ids: list[int],
    algo: str | BlockClassifier,
    tail: float = 0.05,
    use_score: bool = True,
    predicts: float | None = None,
    model_path: str | None = None,
    size: int = 0,
    weighted: bool = False,
    cut: int | None = None,
    metric_path: str | None = None,
    **params,
) -> Ensemble:
    """Fit a model in each train block, trim by hold-out score, vote on the predict blocks.

    ``algo`` names a fit or is a classifier of one's own, whose models vote with equal weight.
    ``predicts`` may be fractional: of ``ceil(predicts)`` blocks a share of the rows is used.
    Without predict blocks there is no accuracy. Every train block is first cut into ``cut`` smaller ones, by default
    as ``CUTS`` has it for the fit; each gets a model, so block ``b`` gives the models ``b * cut`` to ``b * cut + cut - 1``.
    ``model_path`` takes the kept models, ``metric_path`` the run's ``metrics``, both under ``size``.
    """
    begin = perf_counter()
    own = not isinstance(algo, str)
    if cut is None:
        cut = 1 if own else CUTS.get(algo, 1)
    if own and weighted:
        raise ValueError("classifiers of one's own vote with equal weight")
    train = select_blocks(rows, train_ids)
    if cut > 1:
        train = subdivide(train, cut)
    models = materialize(fit_and_score_custom(algo, train), "models") if own else fit_and_score(train, algo, **params)
    kept = models
    if use_score:
        kept = trim_tails(models, tail)
        kept = materialize(kept, "kept") if own else settle(kept, MODEL_WIDTH, "kept")
    seconds = perf_counter() - begin
    if model_path:
        write_models(kept, model_path, size)
    predicted = None
    if predict_ids:
        chosen = select_blocks(rows, predict_ids)
        if predicts is not None:
            chosen = predict_fraction(chosen, predicts)
        if own:
            predicted = algo.vote(chosen, kept).withColumn("prediction", voted_answer())
        else:
            predicted = predict_rows(chosen, kept, weighted)
    run = Ensemble(models, kept, predicted, seconds)
    if metric_path:
        name = type(algo).__name__ if own else algo
        append_metrics(metric_rows(rows.sparkSession, "ensemble", name, size, run.metrics()), metric_path)
    return run


def ids_by_rank(order: DataFrame) -> list[int]:
    """Block ids of one job in rank order; a list no longer than the number of blocks."""
    return [r.block_id for r in order.orderBy("rank").select("block_id").collect()]


def random_ids(ids: DataFrame, job: int, seed: int = 42) -> list[int]:
    return ids_by_rank(block_order(ids, [job], seed))


def listed_ids(requested: list[int], plan: DataFrame, tests: int = 0) -> dict[int, list[int]]:
    """Block list per requested size; no sizes: all of the plan."""
    spark = plan.sparkSession
    wanted = spark.createDataFrame([(s,) for s in requested], "size int") if requested else plan.select("size")
    found: dict[int, list[tuple[int, int]]] = {}
    for r in plan_lookup(wanted, plan, tests).collect():
        found.setdefault(r.size, []).append((r.rank, r.block_id))
    return {s: [b for _, b in sorted(v)] for s, v in found.items()}


def split_ids(ids: list[int], n_train: int, predicts: float) -> tuple[list[int], list[int]]:
    from math import ceil

    return ids[:n_train], ids[n_train : n_train + ceil(predicts)]


def run_listed(
    rows: DataFrame, plan: DataFrame, sizes: list[int], algo: str, subs: float, predicts: float, tail: float, **kw
) -> dict[int, Ensemble]:
    """Ensembles on the blocks a plan table lists for each size."""
    runs = {}
    for size, ids in listed_ids(sizes, plan).items():
        train, predict = split_ids(ids, listed_budget(len(ids), subs), predicts)
        runs[size] = run_ensemble(rows, train, predict, algo, tail, predicts=predicts, size=size, **kw)
    return runs


def run_random(
    rows: DataFrame,
    ids: DataFrame,
    sizes: list[int],
    algo: str,
    subs: float,
    predicts: float,
    tail: float,
    unit: float = 1.0,
    model_path: str | None = None,
    **kw,
) -> dict[int, Ensemble]:
    """Ensembles on randomly chosen blocks, ``size * unit * subs`` of them."""
    runs = {}
    for size in sizes:
        train, predict = split_ids(random_ids(ids, size), int(size * unit * subs), predicts)
        runs[size] = run_ensemble(
            rows, train, predict, algo, tail, predicts=predicts, model_path=model_path, size=size, **kw
        )
    return runs


def run_single(rows: DataFrame, algo: str, share: float = 0.9, **params) -> DataFrame:
    """Control: one model on ``share`` of all rows, tested on the others: (n_test, accuracy)."""
    train, test = row_split(single_block(rows), share)
    return accuracy(predict_own(test, fit_blocks(train, algo, **params)))


def run_matrix(rows: DataFrame, ids: DataFrame, algo: str, share: float = 0.8, **params) -> DataFrame:
    """Models of the train blocks, each scored on every test block."""
    roles = block_split(ids, share).collect()
    train = [r.block_id for r in roles if r.role == "train"]
    test = [r.block_id for r in roles if r.role == "test"]
    models = fit_blocks(select_blocks(rows, train), algo, **params)
    return accuracy_matrix(select_blocks(rows, test), models)


def random_rows(
    rows: DataFrame, ids: DataFrame, size: float, unit: float = 1.0, cluster_share: float = 1.0
) -> DataFrame:
    """``floor(size * unit * cluster_share)`` random blocks; size 0: all rows."""
    if size <= 0:
        return rows
    return select_blocks(rows, random_ids(ids, int(size))[: int(size * unit * cluster_share)])


def run_full_listed(rows: DataFrame, plan: DataFrame, sizes: list[int], algo: str, share: float = 0.9) -> dict:
    """Whole-table fits on the blocks a plan table lists: size -> (run, accuracy)."""
    listed = listed_ids(sizes, plan)
    return {size: full_classifier(select_blocks(rows, ids), algo, share) for size, ids in listed.items()}


def run_full_random(
    rows: DataFrame,
    ids: DataFrame,
    sizes: list[float],
    algo: str,
    unit: float = 1.0,
    cluster_share: float = 1.0,
    share: float = 0.9,
    sampled: bool = False,
) -> dict:
    """Whole-table fits on random blocks; ``sampled`` takes 5% of each size."""
    scale = 0.05 if sampled else 1.0
    return {
        size: full_classifier(random_rows(rows, ids, size * scale, unit, cluster_share), algo, share) for size in sizes
    }


def timed_sample(rows: DataFrame, share: float = 0.05) -> tuple[int, float]:
    """Rows in a sample and the seconds to draw it, without any model."""
    begin = perf_counter()
    n = row_sample(rows, share).count()
    return n, perf_counter() - begin


def timed_random_sample(
    rows: DataFrame, ids: DataFrame, size: int, cluster_share: float = 1.0, share: float = 0.05, metric_path: str | None = None
) -> tuple[int, float]:
    """The same on random blocks, as a whole-table run would choose them."""
    n, seconds = timed_sample(random_rows(rows, ids, size, cluster_share=cluster_share), share)
    if metric_path:
        values = {"sample_rows": n, "sample_seconds": seconds}
        append_metrics(metric_rows(rows.sparkSession, "sample", "none", size, values), metric_path)
    return n, seconds
