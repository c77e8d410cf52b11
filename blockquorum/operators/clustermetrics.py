"""Quality of clusterings: purity, centre distance, squared error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import nearest_distance_sql, nearest_sql
from .kmeans import vector_dim


def centre_arrays(centres: DataFrame, key: str = "block_id") -> DataFrame:
    """(key, centre_id, c) to one row per key with ``centres`` in id order."""
    pairs = F.sort_array(F.collect_list(F.struct("centre_id", "c")))
    return centres.groupBy(key).agg(pairs.alias("s")).select(key, F.col("s.c").alias("centres"))


def assign_global(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Add ``cluster`` by the nearest of the few centres of one clustering."""
    found = sorted(centres.select("centre_id", "c").collect())
    constant = F.array(*[F.lit([float(v) for v in r.c]) for r in found])
    place = F.expr(nearest_sql("x", "_centres", len(found), vector_dim(rows)))
    return rows.withColumn("_centres", constant).withColumn("cluster", place).drop("_centres")


def assign_local(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """Add ``cluster`` by the nearest centre of the row's own block."""
    return rows.join(centre_arrays(centres), "block_id").withColumn(
        "cluster", F.expr(nearest_sql("x", "centres", k, vector_dim(rows)))
    ).drop("centres")


def _flipped(share: Column) -> Column:
    return F.greatest(share, 1 - share)


def purity(assigned: DataFrame) -> DataFrame:
    """For two clusters: share with cluster equal to label, or its complement if larger."""
    share = F.avg((F.col("cluster") == F.col("label")).cast("double"))
    return assigned.agg(share.alias("share")).select(_flipped(F.col("share")).alias("purity"))


def purity_by_block(assigned: DataFrame) -> DataFrame:
    """The same inside each block: (block_id, n_rows, purity)."""
    share = F.avg((F.col("cluster") == F.col("label")).cast("double"))
    return (
        assigned.groupBy("block_id")
        .agg(F.count("*").alias("n_rows"), share.alias("share"))
        .select("block_id", "n_rows", _flipped(F.col("share")).alias("purity"))
    )


def majority_purity(assigned: DataFrame) -> DataFrame:
    """For any number of clusters: share of rows with the majority label of their cluster."""
    counts = assigned.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"))


def centre_distance(real: DataFrame, found: DataFrame, dim: int, k: int) -> DataFrame:
    """Per name: sum over the real centres of the squared distance to the nearest found centre.

    ``real`` and ``found`` are (name, centre_id, c); one found centre may serve twice.
    """
    arrays = centre_arrays(found, "name")
    away = F.expr(nearest_distance_sql("c", "centres", k, dim))
    return real.join(arrays, "name").groupBy("name").agg(F.sum(away).alias("distance"))


def block_sse(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """Squared error of each block's own centres: (block_id, sse)."""
    away = F.expr(nearest_distance_sql("x", "centres", k, vector_dim(rows)))
    return rows.join(centre_arrays(centres), "block_id").groupBy("block_id").agg(F.sum(away).alias("sse"))
