"""k-means inside every block, all blocks in the same jobs.

Rows never move: each round joins the small table of current centres, and only per-block
partial means are shuffled, so a block of any size, or one far larger than the rest, is
shared by many tasks. Blocks that have converged take no further part.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest, hex_slice
from ..functions.vectors import euclid_sql, nearest_distance_sql, nearest_sql
from ..runtime import settle, working

KEYS = ["block_id", "trial"]
NARROW = 64


def vector_dim(df: DataFrame, col: str = "x") -> int:
    first = df.select(F.size(col)).first()
    return first[0] if first else 0


def _order() -> Column:
    """Start order of the rows: the row hash, hashed anew for every further trial."""
    return F.when(F.col("trial") == 0, F.col("u")).otherwise(hex_slice(digest("start", "trial", "u"), 1, 15))


def _start(work: DataFrame, k: int, dim: int) -> DataFrame:
    """The row lowest in hash order, then always the row farthest from the chosen ones."""
    ordered = work.withColumn("o", _order())
    lowest = settle(ordered.groupBy(*KEYS).agg(F.min("o").alias("o")), 3, "lowest")
    first = ordered.join(lowest, [*KEYS, "o"]).groupBy(*KEYS).agg(F.array(F.first("x")).alias("centres"))
    state = settle(first, dim + 2, "centres")
    for chosen in range(1, k):
        away = nearest_distance_sql("x", "centres", chosen, dim)
        apart = ordered.join(state, KEYS).withColumn("away", F.expr(away))
        far = settle(apart.groupBy(*KEYS).agg(F.max("away").alias("away")), 3, "farthest")
        picked = apart.join(far, [*KEYS, "away"]).groupBy(*KEYS).agg(
            F.min_by(F.struct("centres", "x"), "o").alias("p")
        )
        both = picked.select(*KEYS, F.concat("p.centres", F.array("p.x")).alias("centres"))
        state = settle(both, dim * (chosen + 1) + 2, "centres")
    return state


def _round(work: DataFrame, state: DataFrame, k: int, dim: int, tol: float) -> DataFrame:
    """One step for the blocks still moving. Narrow sums have two numbers as their group key, the old centres come back
    by a join of the few sums; a cluster without rows keeps its centre."""
    moving = state.filter("moving").select(*KEYS, "centres")
    placed = work.join(moving, KEYS).withColumn("cluster", F.expr(nearest_sql("x", "centres", k, dim)))
    if k * dim <= NARROW:
        means = [
            ", ".join(f"avg(CASE WHEN cluster = {c} THEN x[{j}] END)" for j in range(dim)) for c in range(k)
        ]
        sums = F.expr(f"array({', '.join(f'array({m})' for m in means)})").alias("means")
        grouped = placed.groupBy(*KEYS).agg(sums).join(moving, KEYS)
        mean = "CASE WHEN means[{c}][0] IS NULL THEN centres[{c}] ELSE means[{c}] END"
    else:
        vectors = placed.groupBy(*KEYS, "centres", "cluster").agg(
            vector_to_array(Summarizer.mean(array_to_vector(F.col("x")))).alias("mean")
        )
        pairs = F.map_from_entries(F.collect_list(F.struct("cluster", "mean")))
        grouped = vectors.groupBy(*KEYS, "centres").agg(pairs.alias("means"))
        mean = "coalesce(means[{c}], centres[{c}])"
    following = ", ".join(mean.format(c=c) for c in range(k))
    shifts = ", ".join(euclid_sql(f"following[{c}]", f"centres[{c}]", dim) for c in range(k))
    moved = grouped.withColumn("following", F.expr(f"array({following})")).select(
        *KEYS, F.col("following").alias("centres"), F.expr(f"array_max(array({shifts})) > {tol!r}D").alias("moving")
    )
    return moved.unionByName(state.filter("not moving"))


def _lloyd(work: DataFrame, k: int, dim: int, iters: int, tol: float) -> DataFrame:
    state = _start(work, k, dim).withColumn("moving", F.lit(True))
    n = state.count()
    for _ in range(iters):
        state = settle(_round(work, state, k, dim, tol), k * dim + 3, "centres", most=n)
        if state.filter("moving").isEmpty():
            break
    return state.drop("moving")


def _trials(rows: DataFrame, trials: int) -> DataFrame:
    if trials == 1:
        return rows.withColumn("trial", F.lit(0))
    return rows.withColumn("trial", F.explode(F.array(*[F.lit(t) for t in range(trials)])))


def _long(state: DataFrame) -> DataFrame:
    return state.select("block_id", F.posexplode("centres").alias("centre_id", "c"))


def block_kmeans(rows: DataFrame, k: int = 2, iters: int = 100, tol: float = 1e-4) -> DataFrame:
    """Centres of every block: (block_id, centre_id, c). ``rows`` has block_id, u, x."""
    with working(rows.select("block_id", "u", "x")) as data:
        return _long(_lloyd(_trials(data, 1), k, vector_dim(data), iters, tol).drop("trial"))


def trial_sse(work: DataFrame, state: DataFrame, k: int, dim: int) -> DataFrame:
    """Sum of squared distances to the nearer centre: (block_id, trial, sse)."""
    away = F.expr(nearest_distance_sql("x", "centres", k, dim))
    return work.join(state, KEYS).groupBy(*KEYS).agg(F.sum(away).alias("sse"))


def bisect_trials(
    rows: DataFrame, trials: int = 2, iters: int = 5, tol: float = 1e-5, k: int = 2
) -> DataFrame:
    """All trials with their centres and error: (block_id, trial, centres, sse)."""
    with working(rows.select("block_id", "u", "x")) as data:
        dim = vector_dim(data)
        work = _trials(data, trials)
        state = _lloyd(work, k, dim, iters, tol)
        scores = settle(trial_sse(work, state, k, dim), 3, "sse")
    return state.join(scores, KEYS)


def best_trial(trials: DataFrame) -> DataFrame:
    """Per block the trial with the smallest error, the first one on ties."""
    picked = F.min_by(F.struct("trial", "centres", "sse"), F.struct(F.round("sse", 6), F.col("trial")))
    return trials.groupBy("block_id").agg(picked.alias("b")).select("block_id", "b.trial", "b.centres", "b.sse")


def block_bisect(rows: DataFrame, trials: int = 2, iters: int = 5, tol: float = 1e-5) -> DataFrame:
    """Best of several short 2-means runs per block: (block_id, centre_id, c)."""
    return _long(best_trial(bisect_trials(rows, trials, iters, tol)))


def pool_centres(centres: DataFrame) -> DataFrame:
    """Centres of all blocks as the rows of one new block."""
    return centres.select(
        F.lit(0).alias("block_id"),
        hex_slice(digest("pool", "block_id", "centre_id"), 9, 15).alias("u"),
        F.col("c").alias("x"),
    )


def two_stage(rows: DataFrame, fit) -> DataFrame:
    """Cluster every block, then cluster the pooled centres: (centre_id, c)."""
    return fit(pool_centres(fit(rows))).select("centre_id", "c")
