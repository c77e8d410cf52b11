"""Two-stage clustering over blocks, and the whole-table runs it is compared with."""

from __future__ import annotations

from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import DataFrame, functions as F

from ..operators.baselines import full_clusterer, ml_centres
from ..operators.blocks import listed_budget, select_blocks
from ..operators.clustermetrics import assign_global, centre_distance, purity_by_block
from ..operators.kmeans import block_bisect, block_kmeans, two_stage
from ..operators.plugins import BlockClusterer
from ..runtime import settle
from .classify import listed_ids, random_ids, random_rows

FITS = {"kmeans": block_kmeans, "bisectingkmeans": block_bisect}


@dataclass
class TwoStage:
    """``centres`` (centre_id, c); ``purity`` and ``distance`` one-row frames or None."""

    centres: DataFrame
    purity: DataFrame | None
    distance: DataFrame | None
    seconds: float


def run_two_stage(
    rows: DataFrame,
    train_ids: list[int],
    test_ids: list[int],
    algo: str | BlockClusterer = "kmeans",
    real: DataFrame | None = None,
    centres_path: str | None = None,
    **params,
) -> TwoStage:
    """Cluster inside each train block, cluster the pooled centres, judge on the test blocks.

    ``algo`` names a fit or is a clusterer of one's own, which then fits both stages. Purity is the plain
    mean of the test blocks' purities. ``real`` is (name, centre_id, c).
    """
    begin = perf_counter()
    fit = (lambda part: FITS[algo](part, **params)) if isinstance(algo, str) else algo.fit
    centres = settle(two_stage(select_blocks(rows, train_ids), fit), 64, "centres")
    seconds = perf_counter() - begin
    if centres_path:
        centres.write.mode("overwrite").parquet(centres_path)
    distance = None
    if real is not None:
        name, c = real.select("name", "c").first()
        found = centres.select(F.lit(name).alias("name"), "centre_id", "c")
        distance = centre_distance(real, found, len(c), centres.count())
    if not test_ids:
        return TwoStage(centres, None, distance, seconds)
    blocks = purity_by_block(assign_global(select_blocks(rows, test_ids), centres))
    return TwoStage(centres, blocks.agg(F.avg("purity").alias("purity")), distance, seconds)


def run_listed(
    rows: DataFrame, plan: DataFrame, sizes: list[int], subs: float, tests: int, algo: str = "kmeans", **kw
) -> dict[int, TwoStage]:
    """Two-stage runs on the blocks a plan table lists for each size, at least one to train."""
    runs = {}
    for size, ids in listed_ids(sizes, plan, tests).items():
        n = listed_budget(len(ids), subs, at_least_one=True)
        runs[size] = run_two_stage(rows, ids[:n], ids[n : n + tests], algo, **kw)
    return runs


def run_random(
    rows: DataFrame, ids: DataFrame, sizes: list[int], subs: float, tests: int, unit: float = 1.0,
    algo: str = "kmeans", centres_path: str | None = None, **kw
) -> dict[int, TwoStage]:
    """Two-stage runs on randomly chosen blocks."""
    runs = {}
    for size in sizes:
        order = random_ids(ids, size)
        n = max(1, int(size * unit * subs))
        path = f"{centres_path}/size={size}" if centres_path else None
        runs[size] = run_two_stage(rows, order[:n], order[n : n + tests], algo, centres_path=path, **kw)
    return runs


def run_full(rows: DataFrame, algo: str, real: DataFrame, share: float = 0.9):
    """Whole-table clustering: (run, purity or None, centre distance)."""
    run, quality = full_clusterer(rows, algo, share)
    name, c = real.select("name", "c").first()
    found = ml_centres(run, rows, name)
    return run, quality, centre_distance(real, found, len(c), found.count())


def run_full_listed(rows: DataFrame, plan: DataFrame, sizes: list[int], algo: str, real: DataFrame, share: float = 0.9):
    """Whole-table clusterings on the blocks a plan table lists; no sizes: the whole table."""
    if not sizes:
        return {0: run_full(rows, algo, real, share)}
    listed = listed_ids(sizes, plan)
    return {size: run_full(select_blocks(rows, ids), algo, real, share) for size, ids in listed.items()}


def run_full_random(
    rows: DataFrame,
    ids: DataFrame,
    sizes: list[float],
    algo: str,
    real: DataFrame,
    unit: float = 1.0,
    cluster_share: float = 1.0,
    share: float = 0.9,
    sampled: bool = False,
):
    """Whole-table clusterings on random blocks; ``sampled`` takes 5% of each size."""
    scale = 0.05 if sampled else 1.0
    return {
        size: run_full(random_rows(rows, ids, size * scale, unit, cluster_share), algo, real, share) for size in sizes
    }
