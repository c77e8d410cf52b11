"""Shared storage for intermediate tables, and caching that is always released."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

SMALL_VALUES = 1_000_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
HELD_BYTES = 4 << 20  # of a cached table, a core, by the planner's estimate: above that it is cached on disk alone

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: spark.checkpoint.dir, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _local_dirs[app] = tempfile.mkdtemp(prefix="blockquorum-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/blockquorum/{app}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the planner the
    true size, so a small table is broadcast and a large one is not.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(
    df: DataFrame, width: int = 1, tag: str = "step", finish=None, schema=None, most: int | None = None
) -> DataFrame:
    """Fix the content of a table that holds one or a few rows per block.

    Up to ``SMALL_VALUES`` values (``width`` per row) it is kept as a local table, which joins
    without another job; a larger one is written to the shared folder. ``finish`` is a row-wise
    pandas step giving ``schema``, run in place on a small table and by Spark on a large one.
    ``most`` is a bound on the rows, if the caller knows one.
    """
    spark, limit = df.sparkSession, SMALL_VALUES // width
    held = None
    if most is None:
        held = df.limit(limit + 1).toArrow()
    elif most <= limit:
        held = df.toArrow()
    if held is None or held.num_rows > limit:
        if finish is None:
            return materialize(df, tag)
        return materialize(df.mapInPandas(lambda frames: (finish(f) for f in frames if len(f)), schema), tag)
    if finish is None:
        return spark.createDataFrame(held, df.schema)
    return spark.createDataFrame(pa.Table.from_pandas(finish(held.to_pandas()), preserve_index=False), schema)


def _fits(df: DataFrame, core_bytes: int) -> bool:
    """Does the planner expect less than ``core_bytes`` a core?"""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return expected < df.sparkSession.sparkContext.defaultParallelism * core_bytes


def is_small(df: DataFrame) -> bool:
    """Is the input too small to give every core a file split of its own?"""
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return _fits(df, split)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input one partition per core; leave larger ones as their files are split."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


def by_block(df: DataFrame) -> DataFrame:
    """The same for block rows, with neighbouring blocks together, so that sums per block
    combine well before a shuffle. Ranges have equal sizes: a large block, or copies of one row,
    spread over several partitions. Larger inputs are expected to be stored by block."""
    if not is_small(df):
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(n, "block_id", "u", F.monotonically_increasing_id())


@contextmanager
def arrow_bytes(spark: SparkSession, most: int):
    """Jobs run inside hand Python at most ``most`` bytes and a row at once; the session's own bound comes back after."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


@contextmanager
def cached(df: DataFrame):
    """Keep ``df`` while a loop reads it many times: a small table in memory, others on the executors' disks.

    Memory is no place for large ones: blocks in memory are whole partitions in pieces of 1 MB, which take two regions of a
    heap of up to 2 GB each, so that the heap runs full long before Spark spills.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK if _fits(df, HELD_BYTES) else StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def working(df: DataFrame, ready: bool = False):
    """Block rows for a loop: cached and laid out by block, unless the caller has done so."""
    if ready:
        yield df
    else:
        with cached(by_block(df)) as kept:
            yield kept
