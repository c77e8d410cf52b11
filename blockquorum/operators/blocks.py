"""Blocks: assigning rows to them, choosing them, and splitting rows within them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import H_RANGE, below, digest, h32, hex_slice, row_key
from ..runtime import settle

U_BITS = 60
RANK_BITS = 12
RANK_ROWS = 100_000


def assign_blocks(df: DataFrame, key: Column | list[str], n_blocks: int, seed: int = 42) -> DataFrame:
    """Add ``row_key``, ``block_id`` (hash of the key) and the 60-bit order value ``u``."""
    key_col = row_key(*key) if isinstance(key, list) else key.cast("string")
    return (
        df.withColumn("row_key", key_col)
        .withColumn("_digest", digest(seed, "row_key"))
        .withColumn("block_id", F.pmod(hex_slice(F.col("_digest"), 1, 8), F.lit(n_blocks)).cast("int"))
        .withColumn("u", hex_slice(F.col("_digest"), 9, 15))
        .drop("_digest")
    )


def block_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("block_id").agg(F.count("*").alias("n_rows"))


def select_blocks(df: DataFrame, ids: list[int]) -> DataFrame:
    """Keep the given blocks. On a table partitioned by ``block_id`` nothing else is read."""
    return df.filter(F.col("block_id").isin([int(i) for i in ids]))


def block_order(ids: DataFrame, jobs: list[int], seed: int = 42) -> DataFrame:
    """A shuffled order of all block ids for every job: (job, block_id, rank from 1)."""
    per_job = ids.select("block_id", F.explode(F.array(*[F.lit(int(j)) for j in jobs])).alias("job"))
    order = Window.partitionBy("job").orderBy(digest(seed, "job", "block_id"), "block_id")
    return per_job.select("job", "block_id", F.row_number().over(order).alias("rank"))


def first_blocks(order: DataFrame, n: int | Column) -> DataFrame:
    return order.filter(F.col("rank") <= n)


def block_roles(order: DataFrame, n_train: int | Column, n_predict: int | Column) -> DataFrame:
    """The first ``n_train`` blocks train, the next ``n_predict`` predict, the rest is unused."""
    n_train = F.lit(n_train) if isinstance(n_train, int) else n_train
    n_predict = F.lit(n_predict) if isinstance(n_predict, int) else n_predict
    return order.withColumn(
        "role",
        F.when(F.col("rank") <= n_train, "train")
        .when(F.col("rank") <= n_train + n_predict, "predict")
        .otherwise("unused"),
    )


def plan_lookup(requested: DataFrame, plan: DataFrame, tests: int = 0) -> DataFrame:
    """Block list per requested size; a size missing from the plan takes blocks 0..size+tests-1."""
    fallback = F.sequence(F.lit(0), F.col("size") + F.lit(tests) - 1)
    return (
        requested.join(plan, "size", "left")
        .select("size", F.posexplode(F.coalesce("blocks", fallback)).alias("pos", "block_id"))
        .select("size", "block_id", (F.col("pos") + 1).alias("rank"))
    )


def plan_all(plan: DataFrame) -> DataFrame:
    """Every size of the plan with its blocks."""
    return plan_lookup(plan.select("size"), plan)


def block_budget(
    flow: str, size: Column, unit: float = 1.0, cluster_share: float = 1.0, subs: float = 1.0
) -> Column:
    """Number of train blocks for a data size, by kind of run. All casts truncate."""
    unit, cluster_share, subs, five = F.lit(float(unit)), F.lit(float(cluster_share)), F.lit(float(subs)), F.lit(0.05)
    rules = {
        "full": F.floor(size * unit * cluster_share),
        "full_sampled": F.floor(size * five * unit * cluster_share),
        "classify": F.floor(size * unit * subs),
        "cluster": F.greatest(F.lit(1).cast("bigint"), F.floor(size * unit * subs)),
        "mine_vote": F.ceil(size * five),
        "mine_recount": F.ceil(F.floor(size / 5) * 10 * five),
        "mine_full": size,
    }
    return rules[flow].cast("bigint")


def listed_budget(n_listed: int, subs: float, at_least_one: bool = False) -> int:
    """Train share of a block list; clustering keeps at least one block."""
    n = int(n_listed * subs)
    return max(1, n) if at_least_one else n


def predict_fraction(df: DataFrame, p: float) -> DataFrame:
    """Of ``ceil(p)`` predict blocks keep the share ``p / ceil(p)`` of the rows."""
    blocks = math.ceil(p)
    if blocks == 0:
        return df.filter(F.lit(False))
    return row_sample(df, p / blocks) if p < blocks else df


def _draw(seed: int | str) -> Column:
    """Uniform value of a row for one use: uses with different seeds choose independently of each other,
    of hold-outs and of block assignment."""
    return hex_slice(digest(seed, "u"), 1, 15)


def row_sample(df: DataFrame, share: float, seed: int | str = "sample") -> DataFrame:
    """Sample without replacement, by row hash. Sampling a sample again needs another seed."""
    return df.filter(below(_draw(seed), share))


def row_split(df: DataFrame, share: float, seed: int | str = "split") -> tuple[DataFrame, DataFrame | None]:
    """Random train/test rows; a negative share trains on its size and has no test part."""
    if share < 0:
        return df.filter(below(_draw(seed), -share)), None
    inside = below(_draw(seed), share)
    return df.filter(inside), df.filter(~inside)


def block_split(ids: DataFrame, share: float = 0.8, seed: int = 43) -> DataFrame:
    """Split whole blocks, not rows, into train and test."""
    inside = below(h32(seed, "block_id"), share, H_RANGE)
    return ids.withColumn("role", F.when(inside, "train").otherwise("test"))


def subdivide(df: DataFrame, factor: int | Column) -> DataFrame:
    """Cut every block into ``factor`` smaller ones, each still a random sample."""
    factor = F.lit(factor) if isinstance(factor, int) else factor
    return df.withColumn("block_id", (F.col("block_id") * factor + F.pmod(F.col("u"), factor)).cast("int"))


def _range_at(counts: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Per key, the range that holds place ``wanted``, and the places still to go inside it."""
    whole = Window.partitionBy(key)
    return (
        counts.withColumn("before", F.sum("n").over(whole.orderBy("range")) - F.col("n"))
        .withColumn("wanted", wanted)
        .filter((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n")))
        .select(key, "range", "n", (F.col("wanted") - F.col("before")).alias("still"))
    )


def rank_cut(df: DataFrame, share: float, key: str = "block_id") -> DataFrame:
    """Per block, the order value that ends the first ``floor(share * rows)`` rows: (key, cut).

    Exact, without ranking the rows of a block in one task: counts per hash range find the range
    that holds the cut, and ranges get finer until the few rows of one can be ranked.
    """
    rows, bits = df.select(key, "u"), RANK_BITS
    high = F.shiftright("u", U_BITS - bits).alias("range")
    counts = rows.groupBy(key, high).agg(F.count("*").alias("n"))
    holder = _range_at(counts, key, F.floor(F.sum("n").over(Window.partitionBy(key)) * F.lit(float(share))))
    while True:
        holder = settle(holder, 4, "ranges")
        inside = rows.select(key, "u", high).join(holder.select(key, "range", "still"), [key, "range"])
        if bits == U_BITS or holder.filter(F.col("n") > RANK_ROWS).isEmpty():
            break
        bits = min(U_BITS, bits + RANK_BITS)
        high = F.shiftright("u", U_BITS - bits).alias("range")
        counts = inside.groupBy(key, "still", high).agg(F.count("*").alias("n"))
        holder = _range_at(counts, key, F.col("still"))
    copies = inside.groupBy(key, "still", "u").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("u")) - F.col("n")
    ranked = copies.withColumn("before", before)
    return ranked.filter(F.col("before") < F.col("still")).groupBy(key).agg(F.max("u").alias("cut"))


def mark_holdout(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Add ``is_train``: the first ``share`` of every block's rows in hash order.

    Copies of one row key stay on one side.
    """
    cuts = settle(rank_cut(df, share), 2, "cuts")
    return df.join(cuts, "block_id", "left").withColumn(
        "is_train", F.coalesce(F.col("u") <= F.col("cut"), F.lit(False))
    ).drop("cut")
