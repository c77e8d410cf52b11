"""Reading, shared storage and graph helpers of the operators in this folder."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from blockquorum.runtime import materialize

BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, not only in rows, as texts may be long; a bound that
    the session has set stays."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES_KEY, None) is None:
        spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker. Functions travel to the workers by value, so what
    is kept in their modules would last for one task only."""
    holder = sys.modules.setdefault("blockquorum_worker_store", types.ModuleType("blockquorum_worker_store"))
    return holder.__dict__.setdefault(name, {})


class Memo:
    """A bounded dict in two halves: when the young one is full it becomes the old one, so what is in use stays."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """The keys that are in neither half; after this all others are in the young one."""
        if len(self.young) > self.most // 2:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``step`` to every Arrow batch; batches of no rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out

    return in_arrow(df, run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


_NOT_PIECES = re.compile(r"\s(?: |\Z|(?<!\n)\n|(?<=\n)\n(?:\s|\Z))")
_NOT_AFTER_WORDS = re.compile(r"(?<![0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])[.,]")


def pieces(text: str) -> list[str] | None:
    """A text cut before spaces and newlines, so that byte-level patterns (letters, numbers or marks with
    one space before them, else white space) split it at every cut: such a token starts at white space that
    follows a character which is none, and the last of two newlines is a token of its own. Where every full stop
    and comma follows a letter or digit, marks begin there too, and it is cut before them. None for texts with
    other runs of white space or with white space at the end."""
    if "\0" in text or _NOT_PIECES.search(text):
        return None
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n")
    if not _NOT_AFTER_WORDS.search(text):
        cut = cut.replace(",", "\0,").replace(".", "\0.")
    return cut.split("\0")


def crc_mod(col: str | Column, mod: int) -> Column:
    """crc32 of a value as text, modulo ``mod``; a null id counts as the text of no characters."""
    col = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(mod))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the least node.

    Alternating large and small stars: every round joins each edge to the least neighbour of its
    node, so no neighbour list is gathered, and is written to the shared folder. Nodes without
    an edge to another node are not returned.
    """
    cur = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = materialize(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        cur = materialize(small, "edges")
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError("components did not settle")


class Forest:
    """Union of row indices by least root, over numpy arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        self.root = root
