"""Logistic regression and linear SVM inside every block, all blocks in the same jobs.

Both are solved as a series of weighted least-squares problems: a round sums, per block,
``a * z z'`` and ``b * z`` over its rows (z = features and a constant 1; a, b from the
current margin), and a small linear system per block gives the next weights. For the SVM
this is the usual bound of the hinge by a parabola at the current margin, so the hinge loss
itself falls in every round. Only per-block sums are shuffled, never rows.

Up to ``UNROLL_DIM`` features the rows are packed once into numpy chunks, a few thousand rows of one block each,
and a round goes over the chunks; only rows with missing or infinite values stay rows and are summed by SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import dot_sql
from ..runtime import arrow_bytes, cached, materialize, settle, working
from .kmeans import vector_dim

UNROLL_DIM = 8
PACK_ROWS = 1 << 20  # rows a task holds at once while it packs them
CHUNK_ROWS = 1 << 16  # most rows of a chunk, and of the chunks that go to Spark at once
CHUNK_BYTES = 1 << 23  # of chunks that a task gets at once: in 64 MB, Spark's bound, they come near the rest of its memory
TILE_ROWS = 1 << 13  # rows of a chunk that a round computes at once
CASCADE_BYTES = 32 * 1024 * 1024
CASCADE_ROUNDS = 3
CASCADE_FIT_ROUNDS = 20
CASCADE_FIT_TOL = 1e-3
MIN_GAP = 1e-6
MOST_LOSS = 1e6  # of one row; a step that reaches it is worse than none


@dataclass(frozen=True)
class Loss:
    """Row terms a, b and loss from the margin ``m`` and the label ``y`` (0 or 1).

    ``arrays(m, y)`` computes them with numpy, ``sql`` holds the same three as SQL over m and y.
    Steps go ``stretch`` times as far as the solved system says.
    """

    ridge: float
    arrays: Callable
    sql: tuple[str, str, str]
    stretch: float = 1.0


def logistic_loss(ridge: float = 0.1) -> Loss:
    def arrays(m, y):
        p = 1.0 / (1.0 + np.exp(-m))
        a = np.maximum(p * (1.0 - p), 1e-12)
        return a, a * m + y - p, np.maximum(m, 0.0) - m * y + np.log1p(np.exp(-np.abs(m)))

    p = "(1D / (1D + exp(-m)))"
    a = f"greatest({p} * (1D - {p}), 1e-12D)"
    return Loss(ridge, arrays, (a, f"{a} * m + y - {p}", "greatest(m, 0D) - m * y + log1p(exp(-abs(m)))"))


def hinge_loss(c: float = 0.1) -> Loss:
    def arrays(m, y):
        sign = y * 2.0 - 1.0
        short = 1.0 - sign * m
        gap = np.maximum(np.abs(short), MIN_GAP)
        return c / (2.0 * gap), c * sign * (gap + 1.0) / (2.0 * gap), c * np.maximum(short, 0.0)

    sign = "(y * 2D - 1D)"
    short = f"(1D - {sign} * m)"
    gap = f"greatest(abs({short}), {MIN_GAP!r}D)"
    sql = (f"{c!r}D / (2D * {gap})", f"{c!r}D * {sign} * ({gap} + 1D) / (2D * {gap})", f"{c!r}D * greatest({short}, 0D)")
    return Loss(1.0, arrays, sql, stretch=1.8)


STATE_KEYS = ["block_id", "w", "base", "base_loss"]


def _exact_terms(term: str, power: int) -> tuple[str, str]:
    """A term as two whole numbers, of 2^(16 - power) and, for what that leaves, 2^(48 - power): their sums are equal
    for every order of the rows. Terms of 2^power fill 32 bits with the largest factor a loss gives them."""
    v = f"({term}) * {2.0 ** (16 - power)!r}D"
    return f"floor({v})", f"floor(({v} - floor({v})) * 4294967296D)"


def _reach(data: DataFrame, dim: int) -> list[int]:
    """Per feature the least power of two that no value passes, and 0 for the constant."""
    most = data.agg(*[F.max(F.abs(F.col("x")[j])) for j in range(dim)]).first()
    return [int(np.clip(np.ceil(np.log2(m)), -60, 60)) if m and np.isfinite(m) else 0 for m in most] + [0]


def _powers(dim: int, reach: list[int]) -> list[int]:
    """Power of two that bounds the factors of each summed term, the terms in the order of their sums."""
    pairs = [reach[i] + reach[j] for i in range(dim + 1) for j in range(i, dim + 1)]
    return [*pairs, *reach[: dim + 1], 0]


def _whole_names(n: int) -> list[str]:
    return [f"high{i}" for i in range(n)] + [f"low{i}" for i in range(n)]


def _sums_of_rows(data: DataFrame, state: DataFrame, loss: Loss, dim: int, reach: list[int]) -> DataFrame:
    """(block_id, sums of the whole numbers of every term), by SQL."""
    a, b, value = (F.expr(e) for e in loss.sql)
    rows = (
        data.join(state.select("block_id", "w"), "block_id")
        .select("block_id", "x", F.expr(dot_sql("x", "w", dim)).alias("m"), F.expr("double(label)").alias("y"))
        .select("block_id", "x", a.alias("a"), b.alias("b"), value.alias("value"))
    )
    z = [f"x[{j}]" for j in range(dim)] + ["1D"]
    terms = [f"a * {z[i]} * {z[j]}" for i in range(dim + 1) for j in range(i, dim + 1)]
    terms += [f"b * {z[i]}" for i in range(dim + 1)] + [f"least(value, {MOST_LOSS!r}D)"]
    whole = [_exact_terms(term, power) for term, power in zip(terms, _powers(dim, reach))]
    names = _whole_names(len(terms))
    sums = [F.expr(f"sum({v})").alias(name) for name, v in zip(names, [h for h, _ in whole] + [low for _, low in whole])]
    return rows.groupBy("block_id").agg(*sums)


def _is_plain(dim: int) -> Column:
    """Can a row be packed? Nulls, values that are not finite and other labels have rules of their own in SQL."""
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("label").isin(0, 1) & (F.size("x") == dim) & finite, F.lit(False))


def _pack(data: DataFrame, dim: int) -> DataFrame:
    """Rows as chunks of one block each: (block_id, x, y), x the doubles feature by feature, y a byte per row."""

    def chunks(block: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
        cuts = [(i, min(i + CHUNK_ROWS, end)) for s, end in zip(starts, [*starts[1:], len(block)]) for i in range(s, end, CHUNK_ROWS)]
        while cuts:
            n = max(1, sum(j - cuts[0][0] <= CHUNK_ROWS for _, j in cuts))
            mine, cuts = [order[i:j] for i, j in cuts[:n]], cuts[n:]
            yield pa.RecordBatch.from_pydict(
                {
                    "block_id": pa.array([block[m[0]] for m in mine], pa.int32()),
                    "x": pa.array([x[m].T.tobytes() for m in mine], pa.binary()),
                    "y": pa.array([y[m].tobytes() for m in mine], pa.binary()),
                }
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, x, y, n = np.empty(PACK_ROWS, np.int32), np.empty((PACK_ROWS, dim)), np.empty(PACK_ROWS, np.int8), 0
        for batch in batches:
            while batch.num_rows:
                now = batch.slice(0, PACK_ROWS - n)
                to = slice(n, n + now.num_rows)
                block[to], y[to] = now.column("block_id").to_numpy(), now.column("label").to_numpy()
                x[to] = now.column("x").flatten().to_numpy().reshape(-1, dim)
                n, batch = n + now.num_rows, batch.slice(now.num_rows)
                if n == PACK_ROWS:
                    yield from chunks(block, x, y)
                    n = 0
        if n:
            yield from chunks(block[:n], x[:n], y[:n])

    plain = data.filter(F.col("block_id").isNotNull() & _is_plain(dim)).select("block_id", "x", "label")
    return plain.mapInArrow(pack, "block_id int, x binary, y binary")


def _sums_of_chunks(packed: DataFrame, state: DataFrame, loss: Loss, dim: int, reach: list[int]) -> DataFrame:
    """The same as ``_sums_of_rows`` by numpy, a row per block and task; the arithmetic is that of the SQL."""
    upper = [(i, j) for i in range(dim + 1) for j in range(i, dim + 1)]
    scale = np.array([2.0 ** (16 - power) for power in _powers(dim, reach)])
    n = len(scale)

    def tile(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        m = x[0] * w[0] if dim else np.zeros(len(y))
        for j in range(1, dim):
            m = m + x[j] * w[j]
        a, b, value = loss.arrays(m + w[dim], y.astype(float))
        v = np.empty((n, len(y)))
        az = [a * x[j] for j in range(dim)] + [a]
        for k, (i, j) in enumerate(upper):
            np.multiply(az[i], x[j], out=v[k]) if j < dim else np.copyto(v[k], az[i])
        for j in range(dim):
            np.multiply(b, x[j], out=v[len(upper) + j])
        v[n - 2], v[n - 1] = b, np.minimum(value, MOST_LOSS)
        v *= scale[:, None]
        if not np.isfinite(v.sum()):
            v = np.nan_to_num(v, nan=0.0, posinf=2.0**62, neginf=-(2.0**62))
        high = np.floor(v)
        v -= high
        v *= 4294967296.0
        np.floor(v, out=v)
        return np.concatenate([high.astype(np.int64).sum(axis=1), v.astype(np.int64).sum(axis=1)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            sums = np.array(list(found.values()))
            columns = {"block_id": pa.array(list(found), pa.int32())}
            return pa.RecordBatch.from_pydict(columns | {name: pa.array(sums[:, i]) for i, name in enumerate(_whole_names(n))})

        for batch in batches:
            w_of = batch.column("w").to_pylist()
            for i, block in enumerate(batch.column("block_id").to_pylist()):
                y = np.frombuffer(batch.column("y")[i].as_buffer(), dtype=np.int8)
                x = np.frombuffer(batch.column("x")[i].as_buffer()).reshape(dim, len(y))
                with np.errstate(over="ignore", invalid="ignore"):
                    for at in range(0, len(y), TILE_ROWS):
                        sums = tile(x[:, at : at + TILE_ROWS], y[at : at + TILE_ROWS], np.array(w_of[i]))
                        found[block] = found[block] + sums if block in found else sums
            if len(found) > 10_000:
                yield out()
                found.clear()
        if found:
            yield out()

    schema = "block_id int, " + ", ".join(f"{name} bigint" for name in _whole_names(n))
    return packed.join(state.select("block_id", "w"), "block_id").mapInArrow(partial, schema)


def _exact_sums(parts: list[DataFrame], state: DataFrame, dim: int, reach: list[int]) -> DataFrame:
    """(state columns, sums) from the sums of whole numbers. They do not depend on how the rows are dealt to
    tasks, so fits repeat to the last bit."""
    powers = _powers(dim, reach)
    sums = [
        f"(double(sum(high{i})) + double(sum(low{i})) / 4294967296D) * {2.0 ** (power - 16)!r}D" for i, power in enumerate(powers)
    ]
    summed = reduce(DataFrame.unionByName, parts).groupBy("block_id").agg(F.expr(f"array({', '.join(sums)})").alias("sums"))
    return summed.join(state.select(*STATE_KEYS), "block_id")


@contextmanager
def _exact_summing(data: DataFrame, loss: Loss, dim: int, pack: bool):
    """A function from the state to the exact sums. Without ``pack`` all rows stay rows."""
    reach = _reach(data, dim)
    if not pack:
        yield lambda state: _exact_sums([_sums_of_rows(data, state, loss, dim, reach)], state, dim, reach)
        return
    odd = data.filter(~_is_plain(dim))
    with arrow_bytes(data.sparkSession, CHUNK_BYTES), cached(_pack(data, dim)) as packed:
        any_odd = not odd.isEmpty()

        def sums(state: DataFrame) -> DataFrame:
            parts = [_sums_of_chunks(packed, state, loss, dim, reach)]
            if any_odd:
                parts.append(_sums_of_rows(odd, state, loss, dim, reach))
            return _exact_sums(parts, state, dim, reach)

        yield sums


def _sums_by_batches(data: DataFrame, state: DataFrame, loss: Loss, dim: int) -> DataFrame:
    upper = np.triu_indices(dim + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block_id").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy().reshape(-1, dim)
            w = batch.column("w").flatten().to_numpy().reshape(-1, dim + 1)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            z = np.hstack([x, np.ones((len(x), 1))])
            with np.errstate(over="ignore"):
                a, b, value = loss.arrays((z * w).sum(axis=1), y)
            ids, out = np.unique(block), []
            for i in ids:
                mine = block == i
                zi = z[mine]
                gram = (zi * a[mine, None]).T @ zi
                out.append(np.concatenate([gram[upper], zi.T @ b[mine], [value[mine].sum()]]))
            yield pa.RecordBatch.from_pydict(
                {"block_id": pa.array(ids.astype(np.int32)), "part": pa.array([list(o) for o in out])}
            )

    joined = data.join(state.select("block_id", "w"), "block_id")
    parts = joined.mapInArrow(partial, "block_id int, part array<double>")
    summed = parts.groupBy("block_id").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("part")))).alias("sums")
    )
    return summed.join(state, "block_id")


def _next_weights(state: pd.DataFrame, dim: int, ridge: float, stretch: float, tol: float) -> pd.DataFrame:
    """Solve the small systems of many blocks; a step that raised the loss is halved instead."""
    n = dim + 1
    rows = np.triu_indices(n)
    sums = np.array(state["sums"].tolist(), dtype=float)
    w, base = (np.array(state[c].tolist(), dtype=float) for c in ("w", "base"))
    value = sums[:, -1] + 0.5 * ridge * (w * w).sum(axis=1)
    gram = np.zeros((len(w), n, n))
    gram[:, rows[0], rows[1]] = sums[:, : len(rows[0])]
    gram[:, rows[1], rows[0]] = sums[:, : len(rows[0])]
    gram[:, np.arange(n), np.arange(n)] += ridge
    target = sums[:, len(rows[0]) : -1]
    solved = np.linalg.solve(gram, target[:, :, None])[:, :, 0]
    before = state["base_loss"].to_numpy()
    better = value <= before
    following = np.where(better[:, None], w + stretch * (solved - w), (w + base) / 2)
    change = np.abs(w - base).max(axis=1)
    done = np.where(better, before - value <= tol * value, change <= tol * (1 + np.abs(base).max(axis=1)))
    base = np.where(better[:, None], w, base)
    return pd.DataFrame(
        {
            "block_id": state["block_id"].to_numpy(),
            "w": list(following),
            "base": list(base),
            "base_loss": np.where(better, value, before),
            "moving": ~done,
        }
    )


STATE = "block_id int, w array<double>, base array<double>, base_loss double, moving boolean"


def _solve_rounds(data: DataFrame, loss: Loss, dim: int, rounds: int, tol: float, pack: bool) -> DataFrame:
    if dim > UNROLL_DIM:
        return _rounds(data, lambda state: _sums_by_batches(data, state, loss, dim), loss, dim, rounds, tol)
    with _exact_summing(data, loss, dim, pack) as sums_of:
        return _rounds(data, sums_of, loss, dim, rounds, tol)


def _rounds(data: DataFrame, sums_of: Callable[[DataFrame], DataFrame], loss: Loss, dim: int, rounds: int, tol: float) -> DataFrame:
    def solve(sums: pd.DataFrame) -> pd.DataFrame:
        return _next_weights(sums, dim, loss.ridge, loss.stretch, tol)

    width = dim * dim + 4 * dim + 8
    zeros = F.expr(f"array_repeat(0D, {dim + 1})")
    blocks = data.select("block_id").distinct()
    moving = settle(
        blocks.select("block_id", zeros.alias("w"), zeros.alias("base"), F.expr("double('inf')").alias("base_loss")),
        width,
        "weights",
    )
    settled, n = [], moving.count()
    for _ in range(rounds):
        state = settle(sums_of(moving), width, "weights", solve, STATE, most=n)
        settled.append(state.filter("not moving"))
        moving = state.filter("moving").select(*STATE_KEYS)
        if moving.isEmpty():
            break
    settled.append(state.filter("moving"))
    return reduce(DataFrame.unionByName, settled).select("block_id", F.col("base").alias("weights"))


def fit_linear(rows: DataFrame, loss: Loss, rounds: int, tol: float, ready: bool = False, pack: bool = True) -> DataFrame:
    """Weights of every block, the constant last: (block_id, weights).

    ``rows`` has block_id, u, label (0 or 1) and x. A block with one label gets weights that
    answer that label. Rounds end when the loss falls by less than the share ``tol``. ``pack`` is for rows that are
    to be kept as packed copies; without it they are summed as they are.
    """
    with working(rows.select("block_id", "u", "label", "x"), ready) as data:
        return _solve_rounds(data, loss, vector_dim(data), rounds, tol, pack)


def label_values(rows: DataFrame) -> list[int]:
    return sorted(r.label for r in rows.select("label").distinct().collect() if r.label is not None)


def _answers(negative: int, positive: int) -> Column:
    return F.array(F.lit(negative).cast("int"), F.lit(positive).cast("int")).alias("labels")


def _one_against_rest(data: DataFrame, classes: list[int], fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One set of weights per class, all classes of all blocks in the same rounds. Rows are multiplied
    inside the tasks that sum them, not in what is shuffled or cached."""
    k, n = F.posexplode(F.array(*[F.lit(c) for c in classes])).alias("k", "class"), len(classes)
    every = data.select("block_id", "u", "label", "x", k).select(
        (F.col("block_id") * n + F.col("k")).cast("int").alias("block_id"),
        "u",
        (F.col("label") == F.col("class")).cast("int").alias("label"),
        "x",
    )
    own = fit(every).select(
        F.floor(F.col("block_id") / n).cast("int").alias("block_id"), F.struct(F.pmod("block_id", F.lit(n)).alias("k"), "weights").alias("s")
    )
    flat = F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["weights"]))
    return own.groupBy("block_id").agg(flat.alias("weights")).withColumn("labels", F.array(*[F.lit(c).cast("int") for c in classes]))


def fit_logreg(
    rows: DataFrame, ridge: float = 0.1, rounds: int = 25, tol: float = 1e-6, ready: bool = False
) -> DataFrame:
    """(block_id, weights, labels). Two labels, whatever their values, have one set of weights, which
    answers the larger label above zero; more have a set per label, one after another in ``weights``."""
    with working(rows.select("block_id", "u", "label", "x"), ready) as data:
        classes = label_values(data)
        fit = lambda part, pack=True: fit_linear(part, logistic_loss(ridge), rounds, tol, ready=True, pack=pack)
        if len(classes) > 2:
            return _one_against_rest(data, classes, lambda part: fit(part, pack=False))
        negative, positive = (0, 1) if set(classes) <= {0, 1} else (classes[0], classes[-1])
        y = (F.col("label") == positive).cast("int")
        return fit(data.withColumn("label", y)).select("block_id", "weights", _answers(negative, positive))


def _svm_recoded(data: DataFrame) -> tuple[DataFrame, Column]:
    """Label 0 (the smallest one, if there is no 0) against all others, as 0 and 1, and the labels to answer:
    of several others the smallest."""
    classes = label_values(data)
    negative = 0 if not classes or set(classes) <= {0, 1} or 0 in classes else classes[0]
    positive = next((c for c in classes if c != negative), 1 if negative == 0 else negative)
    return data.withColumn("label", (F.col("label") != negative).cast("int")), _answers(negative, positive)


def fit_svm(
    rows: DataFrame, c: float = 0.1, rounds: int = 100, tol: float = 1e-5, ready: bool = False
) -> DataFrame:
    """(block_id, weights, labels): label 0 against any other (see ``svm_labels``)."""
    with working(rows.select("block_id", "u", "label", "x"), ready) as data:
        recoded, answers = _svm_recoded(data)
        return fit_linear(recoded, hinge_loss(c), rounds, tol, ready=True).select("block_id", "weights", answers)


def svm_labels(label: Column) -> Column:
    """Label 0 becomes -1, any other +1."""
    return F.when(label == 0, -1).otherwise(1)


def cascade_batches(rows: DataFrame, dim: int, max_bytes: int = CASCADE_BYTES) -> DataFrame:
    """Sub-blocks needed so that 32 bytes per value stay within the limit: (block_id, batches)."""
    size = F.count("*") * F.lit(32 * dim)
    batches = F.when(size > max_bytes, F.expr(f"(count(*) * {32 * dim}) div {max_bytes} + 1")).otherwise(1)
    return rows.groupBy("block_id").agg(batches.cast("int").alias("batches"))


def fit_cascade(
    rows: DataFrame,
    c: float = 0.1,
    max_bytes: int = CASCADE_BYTES,
    rounds: int = 100,
    tol: float = 1e-5,
    ready: bool = False,
) -> DataFrame:
    """SVM that first fits sub-blocks of large blocks and keeps only their margin rows.

    After at most three such reductions one SVM per block is fitted on all rows that remain.
    """
    with working(rows.select("block_id", "u", "label", "x"), ready) as given:
        rest, answers = _svm_recoded(given)
        dim = vector_dim(rest)
        for _ in range(CASCADE_ROUNDS):
            batches = settle(cascade_batches(rest, dim, max_bytes), 2, "batches")
            most = batches.agg(F.max("batches")).first()[0]
            if not most or most == 1:
                break
            parts = (
                rest.join(batches, "block_id")
                .withColumn("parent", F.col("block_id"))
                .withColumn("block_id", (F.col("block_id") * most + F.pmod("u", "batches")).cast("int"))
            )
            local = fit_linear(parts, hinge_loss(c), CASCADE_FIT_ROUNDS, CASCADE_FIT_TOL, ready=True)
            score = F.expr(f"(label * 2 - 1) * ({dot_sql('x', 'weights', dim)})")
            on_margin = parts.join(local, "block_id").filter((score <= 1) | (F.col("batches") == 1))
            rest = materialize(on_margin.select(F.col("parent").alias("block_id"), "u", "label", "x"), "margin")
        return fit_linear(rest, hinge_loss(c), rounds, tol).select("block_id", "weights", answers)


def weight_stats(models: DataFrame) -> DataFrame:
    """Spread and size of the weights per model."""
    long = models.select("block_id", F.explode("weights").alias("weight"))
    return long.groupBy("block_id").agg(
        F.count("*").alias("n_weights"),
        F.count_if(F.col("weight") != 0).alias("n_nonzero"),
        F.avg("weight").alias("mean"),
        F.stddev_pop("weight").alias("spread"),
        F.min("weight").alias("lowest"),
        F.max("weight").alias("highest"),
    )
