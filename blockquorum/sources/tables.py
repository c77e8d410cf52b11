"""Views over the given tables in the shapes the block operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.blocks import assign_blocks
from ..runtime import spread

LINE_BLOCKS = 40
VECTOR_BLOCKS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as labelled vectors: is the charged price above 50,000?"""
    line = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
        )
    )
    charged = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("int").alias("quantity"),
        (charged > 50000).cast("int").alias("label"),
        F.array(
            F.col("l_quantity") / 50,
            F.col("l_extendedprice") / 100000,
            F.col("l_discount") * 10,
            F.col("l_tax") * 10,
        ).alias("x"),
    )


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity"]


def line_blocks(spark: SparkSession, sf_dir: str, n_blocks: int = LINE_BLOCKS) -> DataFrame:
    rows = assign_blocks(line_rows(spark, sf_dir), LINE_KEY, n_blocks)
    return rows.select("row_key", "block_id", "u", "label", "x")


def vector_blocks(spark: SparkSession, sf_dir: str, n_blocks: int = VECTOR_BLOCKS) -> DataFrame:
    """Embeddings as labelled vectors of 64 doubles."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x")
    )
    return assign_blocks(vectors, ["vec_id"], n_blocks).select("row_key", "block_id", "u", "label", "x")


def text_blocks(spark: SparkSession, sf_dir: str, n_blocks: int = LINE_BLOCKS) -> DataFrame:
    """Documents with a quality label: (length, words, share of distinct lines)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    lines = F.split("text", "\n")
    rows = docs.join(labels, "doc_id").select(
        "doc_id",
        "label",
        F.array(
            F.col("n_chars").cast("double") / 1000,
            F.size(F.split("text", " ")).cast("double") / 100,
            F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        ).alias("x"),
    )
    return assign_blocks(rows, ["doc_id"], n_blocks).select("row_key", "block_id", "u", "label", "x")


def baskets(spark: SparkSession, sf_dir: str, kind: str = "p_type", n_blocks: int = LINE_BLOCKS) -> DataFrame:
    """One basket per order: the ranks of the part types (or brands) it holds."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), kind)
    names = part.select(kind).distinct()
    items = names.select(kind, F.row_number().over(Window.orderBy(kind)).alias("item"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    grouped = (
        line.join(part, "l_partkey")
        .join(items, kind)
        .groupBy(F.col("l_orderkey").alias("tid"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return assign_blocks(grouped, ["tid"], n_blocks).select("tid", "block_id", "u", "items")


def block_ids(spark: SparkSession, n_blocks: int) -> DataFrame:
    return spark.range(n_blocks).select(F.col("id").cast("int").alias("block_id"))


def real_centres(rows: DataFrame, name: str, dim: int) -> DataFrame:
    """Mean vector per label: (name, centre_id, c)."""
    means = F.array(*[F.avg(F.col("x")[j]) for j in range(dim)])
    return rows.groupBy(F.col("label").alias("centre_id")).agg(means.alias("c")).select(
        F.lit(name).alias("name"), "centre_id", "c"
    )
