"""Block tables, baskets, centres, itemsets, models and metrics on disk."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.itemkeys import basket_line, parse_basket
from ..operators.blocks import assign_blocks

COPIES = 10_000
CENTRES_SCHEMA = "name string, centres array<array<double>>"


def write_blocks(df: DataFrame, path: str, max_rows_per_file: int = 0) -> None:
    """Store rows under ``block_id=.../``. Blocks are brought together for writing; one that is
    too large for a task is split over several."""
    out = df.hint("rebalance", "block_id").write.mode("overwrite")
    out.option("maxRecordsPerFile", max_rows_per_file).partitionBy("block_id").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def number_copies(df: DataFrame) -> DataFrame:
    """The same rows with ``copy``, a number from 1 among rows of equal content. Equal rows cannot be told
    apart, so they are counted and dealt out again, in parts: however often a row occurs, no task gets all its
    copies, and the numbers do not depend on files or tasks. Null columns count as content."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    parts = counted.select(*df.columns, "__n", F.explode(F.expr(f"sequence(1, __n, {COPIES})")).alias("__from"))
    last = F.least(F.col("__from") + (COPIES - 1), F.col("__n"))
    return parts.hint("rebalance").select(*df.columns, F.explode(F.sequence("__from", last)).alias("copy"))


def _content_blocks(df: DataFrame, content: list[Column], n_blocks: int, seed: int) -> DataFrame:
    """``row_key``, ``block_id`` and ``u`` of rows that have no key: a hash of their content and the copy."""
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("none")) for c in content])
    return assign_blocks(number_copies(df).withColumn("__key", F.md5(text)), ["__key", "copy"], n_blocks, seed)


def read_vectors(spark: SparkSession, path: str, n_blocks: int = 1, seed: int = 42) -> DataFrame:
    """Plain labelled vectors without keys (first column label, second vector): (row_key, block_id, u,
    label, x). Vector columns become arrays. Rows keep their keys and blocks however the files are cut."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    df = spark.read.parquet(path)
    label, features = df.columns[:2]
    is_vector = isinstance(df.schema[features].dataType, VectorUDT)
    x = vector_to_array(features) if is_vector else F.col(features).cast("array<double>")
    rows = df.select(F.col(label).cast("int").alias("label"), x.alias("x"))
    content = [F.col("label").cast("string"), F.array_join(F.col("x").cast("array<string>"), ",", "null")]
    return _content_blocks(rows, content, n_blocks, seed).select("row_key", "block_id", "u", "label", "x")


def read_baskets(spark: SparkSession, path: str, n_blocks: int, seed: int = 42) -> DataFrame:
    """Basket lines from text: (row_key, block_id, u, items).

    A line's key is made of its content and its number among equal lines, so equal lines land in
    different blocks, and every line keeps its block however the files are cut.
    """
    rows = _content_blocks(spark.read.text(path), [F.col("value")], n_blocks, seed)
    return rows.select("row_key", "block_id", "u", parse_basket(F.col("value")).alias("items"))


def write_basket_lines(df: DataFrame, path: str, items: str = "items") -> None:
    df.select(basket_line(F.col(items)).alias("value")).write.mode("overwrite").text(path)


def parquet_baskets_to_text(spark: SparkSession, paths: list[str]) -> list[str]:
    """Every basket table (first column: items) becomes text lines at ``path + '.txt'``."""
    written = []
    for path in paths:
        df = spark.read.parquet(path)
        write_basket_lines(df, path + ".txt", df.columns[0])
        written.append(path + ".txt")
    return written


def write_centres(centres: DataFrame, path: str) -> None:
    """(name, centre_id, c) as one row per name."""
    rows = centres.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("centre_id", "c"))).alias("s"))
    rows.select("name", F.col("s.c").alias("centres")).write.mode("overwrite").parquet(path)


def read_centres(spark: SparkSession, file: str, source: str | None = None) -> DataFrame:
    """Centres of one data set: ``file`` with ``source`` as the name, or ``file:name``."""
    path, _, key = file.rpartition(":")
    if not path or "/" in key:
        path, key = file, None
    name = key or source
    df = spark.read.parquet(path).toDF("name", "centres")
    if name is not None:
        df = df.filter(F.col("name") == name)
    return df.select("name", F.posexplode("centres").alias("centre_id", "c"))


def itemset_line(itemset: Column, support: Column) -> Column:
    return F.format_string("%s: %s", itemset, support.cast("string"))


def write_itemsets(itemsets: DataFrame, path: str, support: str = "support") -> None:
    """``path/model`` keeps the table, ``path/text`` one file of ``{a,b}: support`` lines."""
    itemsets.write.mode("overwrite").parquet(path + "/model")
    stored = itemsets.sparkSession.read.parquet(path + "/model")
    lines = stored.select(itemset_line(F.col("itemset"), F.col(support)).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path + "/text")


def write_models(models: DataFrame, path: str, size: int) -> None:
    """Add an ensemble under ``size=<n>/``."""
    models.write.mode("overwrite").parquet(f"{path}/size={size}")


def read_models(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if size is None else df.filter(F.col("size") == size).drop("size")


def save_ml(model: MLWritable, folder: str, algo: str, source: str, size: int) -> str:
    """Save a Spark ML model under a name made of algorithm, source, size and time."""
    from datetime import datetime

    path = f"{folder}/spark_{algo}_{source}_{size}_{datetime.now():%Y%m%d-%H%M%S}.ml"
    model.write().overwrite().save(path)
    return path


METRICS_SCHEMA = "run string, algo string, size int, metric string, value double"


def metric_rows(spark: SparkSession, run: str, algo: str, size: int, values: dict[str, float]) -> DataFrame:
    rows = [(run, algo, size, name, float(v)) for name, v in values.items()]
    return spark.createDataFrame(rows, METRICS_SCHEMA)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)
