"""Own models per block.

A block classifier or clusterer is any object with the methods below, DataFrames in and out.
``PandasClassifier`` and ``PandasClusterer`` wrap a solver that wants the rows of a block as
arrays. A block of any size is solved whole, with one model: its rows go to a file of the task, which
the solver sees as an array, so a task holds no more of a block than its solver copies out of it. Only a
caller who gives ``max_rows`` gets blocks above that cut into sub-blocks, each again a random sample
and a block with a model of its own.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize, settle
from .blocks import mark_holdout
from .voting import accuracy

CENTRES = "block_id int, centre_id int, c array<double>"


class BlockClassifier(Protocol):
    def fit(self, rows: DataFrame) -> DataFrame:
        """(block_id, u, label, x) to one model row per block."""

    def predict(self, rows: DataFrame, models: DataFrame) -> DataFrame:
        """Rows with ``prediction`` by the model of their own block."""

    def vote(self, rows: DataFrame, models: DataFrame) -> DataFrame:
        """Rows with ``votes``, a map from label to the number of models that answer it."""


class BlockClusterer(Protocol):
    def fit(self, rows: DataFrame) -> DataFrame:
        """(block_id, u, x) to centres: (block_id, centre_id, c)."""


def largest_block(rows: DataFrame) -> int:
    return rows.groupBy("block_id").count().agg(F.max("count")).first()[0] or 0


def bounded_blocks(rows: DataFrame, max_rows: int | None) -> DataFrame:
    """Cut all blocks so that none has more than ``max_rows`` rows; without it all stay whole.

    The rows get a new order value from the old one and their running number, so that copies of
    one row part as well.
    """
    if max_rows is None or largest_block(rows) <= max_rows:
        return rows
    spare = 1
    while True:
        spare *= 2
        parts = F.when(F.col("n") <= max_rows, 1).otherwise(F.ceil(F.col("n") / max_rows) * spare).cast("int")
        sizes = settle(rows.groupBy("block_id").agg(F.count("*").alias("n")).withColumn("parts", parts), 3, "parts")
        most = sizes.agg(F.max("parts")).first()[0]
        fresh = F.pmod(F.xxhash64("u", F.monotonically_increasing_id()), F.lit(1 << 60))
        place = F.col("block_id") * most + F.pmod("u", "parts")
        cut = rows.withColumn("u", fresh).join(sizes, "block_id").withColumn("block_id", place.cast("int"))
        cut = materialize(cut.drop("n", "parts"), "sub")
        if largest_block(cut) <= max_rows:
            return cut


@contextmanager
def _matrix(batches: Iterator[pa.RecordBatch], labels: list[np.ndarray] | None = None):
    """The vectors of a block as one array, in a file that is gone with the task; ``labels`` takes those of its rows, by
    batch. A block never becomes an object per row."""
    with tempfile.TemporaryFile() as file:
        n = 0
        for batch in batches:
            file.write(np.ascontiguousarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), dtype=float))
            n += batch.num_rows
            if labels is not None:
                labels.append(batch.column("label").to_numpy(zero_copy_only=False).copy())
        file.flush()
        flat = np.memmap(file, dtype=float, mode="r+").view(np.ndarray) if file.tell() else np.empty(0)
        yield flat.reshape(n, -1)


class PandasClassifier:
    """``solve(x, y) -> model`` and ``apply(model, x) -> labels`` on numpy arrays."""

    def __init__(self, solve: Callable, apply: Callable, max_rows: int | None = None, model_bytes: int = 64_000_000):
        self.solve, self.apply, self.max_rows, self.model_bytes = solve, apply, max_rows, model_bytes

    def blocks(self, rows: DataFrame) -> DataFrame:
        return bounded_blocks(rows, self.max_rows)

    def fit(self, rows: DataFrame) -> DataFrame:
        if self.max_rows is not None and largest_block(rows) > self.max_rows:
            raise ValueError("a block has more than max_rows rows; pass the rows through blocks() first")
        solve = self.solve

        def per_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels: list[np.ndarray] = []
            with _matrix(batches, labels) as x:
                y = np.concatenate(labels)
                model = solve(x, y)
            columns = {"block_id": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {"n_train": pa.array([len(y)], pa.int64())})

        grouped = rows.select("block_id", "label", "x").groupBy("block_id")
        return materialize(
            grouped.applyInArrow(per_block, "block_id int, model binary, n_train bigint"), "plugin"
        )

    def predict(self, rows: DataFrame, models: DataFrame) -> DataFrame:
        apply = self.apply

        def per_batch(batches):
            for pdf in batches:
                out = pd.Series(0, index=pdf.index, dtype="int32")
                for blob, part in pdf.groupby("model"):
                    out[part.index] = np.asarray(apply(pickle.loads(blob), np.stack(part["x"])), dtype="int32")
                yield pdf.drop(columns="model").assign(prediction=out)

        joined = rows.join(models.select("block_id", "model"), "block_id")
        columns = [f for f in joined.schema.fields if f.name != "model"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", prediction int"
        return joined.mapInPandas(per_batch, schema)

    def vote(self, rows: DataFrame, models: DataFrame) -> DataFrame:
        """Rows with ``votes``: label to the number of ``models`` that answer it.

        The models are dealt by block to files of about ``model_bytes`` (a larger model has a file of its own size)
        and every task reads one file at a time, so neither the driver nor a task holds an ensemble of any size, and
        no pair of row and model is a row. Every file takes a pass over the rows, with the votes so far kept in a
        written table.
        """
        apply = self.apply
        sized = models.select("block_id", "model", F.octet_length("model").cast("bigint").alias("size"))
        total, count = sized.agg(F.sum("size"), F.count("*")).first()
        out = rows.withColumn("votes", F.expr("CAST(map() AS map<int,int>)"))
        n = max(1, min(count, -(-(total or 0) // self.model_bytes)))
        stored = materialize(sized.withColumn("part", F.pmod(F.hash("block_id"), F.lit(n))).drop("size"), "models")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        for part in range(n):
            chosen = stored.filter(F.col("part") == part).select("model")
            files = materialize(chosen.coalesce(1), "voters").inputFiles()

            def tally(batches, files=files):
                blobs = [b for f in files for b in read_column(f, "model")]
                held = [pickle.loads(b) for b in blobs]
                for pdf in batches:
                    if not len(pdf):
                        continue
                    x, votes = np.stack(pdf["x"]), [dict(v) for v in pdf["votes"]]
                    for model in held:
                        for own, answer in zip(votes, np.asarray(apply(model, x)).tolist()):
                            own[int(answer)] = own.get(int(answer), 0) + 1
                    yield pdf.assign(votes=votes)

            out = out.mapInPandas(tally, schema)
            if part + 1 < n:
                out = materialize(out, "votes")
        return out


class PandasClusterer:
    """``solve(x) -> centres`` on numpy arrays."""

    def __init__(self, solve: Callable, max_rows: int | None = None):
        self.solve, self.max_rows = solve, max_rows

    def fit(self, rows: DataFrame) -> DataFrame:
        solve = self.solve

        def per_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with _matrix(batches) as x:
                centres = np.asarray(solve(x), dtype=float)
            ids = {"block_id": pa.array([key[0].as_py()] * len(centres), pa.int32()), "centre_id": pa.array(range(len(centres)), pa.int32())}
            yield pa.RecordBatch.from_pydict(ids | {"c": pa.array(centres.tolist(), pa.list_(pa.float64()))})

        bounded = bounded_blocks(rows.select("block_id", "u", "x"), self.max_rows)
        return bounded.drop("u").groupBy("block_id").applyInArrow(per_block, CENTRES)


def read_column(file: str, name: str) -> list:
    """One column of a Parquet file in the shared folder, read inside a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    return pq.read_table(path, columns=[name], filesystem=system).column(0).to_pylist()


def voted_answer(votes: str = "votes") -> Column:
    """Label with most votes in a map of label to count, the smallest label on ties; null without votes."""
    entries = F.transform(F.map_entries(votes), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("label")))
    return F.array_min(entries)["label"]


def fit_and_score_custom(classifier: BlockClassifier, rows: DataFrame, share: float = 0.9) -> DataFrame:
    """Fit a plugged-in classifier on ``share`` of every block and score it on the others.

    A classifier with a method ``blocks`` first cuts the blocks to its liking.
    """
    cut = classifier.blocks(rows) if hasattr(classifier, "blocks") else rows
    marked = mark_holdout(cut, share)
    models = classifier.fit(marked.filter("is_train"))
    scores = accuracy(classifier.predict(marked.filter(~F.col("is_train")), models), "block_id")
    return models.join(scores, "block_id", "left")
