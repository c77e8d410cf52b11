"""The same tasks on all rows at once with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import dist
from time import perf_counter

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.itemkeys import itemset_key
from ..functions.vectors import nearest_distance_sql, nearest_sql
from ..runtime import cached, spread
from .blocks import row_split
from .clustermetrics import purity
from .voting import accuracy

CLASSIFIERS = {
    "DT": lambda: DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=10, seed=42),
    "LR": lambda: LogisticRegression(family="binomial", maxIter=500, regParam=0.1),
    "RF": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=42),
    "SVM": lambda: LinearSVC(maxIter=10, regParam=0.1, tol=1e-6),
}
CLUSTERERS = {
    "kmeans": lambda: KMeans(k=2, maxIter=100, tol=1e-4, seed=42),
    "bisectingkmeans": lambda: BisectingKMeans(k=2, maxIter=10, seed=42),
}
LAYOUT_ROWS = 20_000
LAYOUT_PARTS = 256  # partitions from which on they grow instead, up to LAYOUT_MOST rows: every one sends a result per round
LAYOUT_MOST = 1_000_000


@dataclass
class FullRun:
    """``centres`` are those of the fit that counts, where it is not the model's."""

    model: Model
    seconds: float
    predicted: DataFrame | None
    centres: list[list[float]] | None = None


def with_features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("x"))


def layout_parts(n_rows: int) -> int:
    least, most = (max(1, -(-n_rows // size)) for size in (LAYOUT_MOST, LAYOUT_ROWS))
    return max(least, min(most, LAYOUT_PARTS))


def fixed_layout(rows: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order on every cluster: seeded starts and samples of
    Spark ML then find the same models."""
    n = layout_parts(rows.count())
    return rows.repartition(n, "u").sortWithinPartitions("u", *[c for c in ("row_key",) if c in rows.columns])


def run_full(rows: DataFrame, estimator: Estimator, share: float = 0.9) -> FullRun:
    """Fit any estimator on a random share of the rows and apply it to the others.

    A negative share trains on its size and applies nothing.
    """
    train, test = row_split(rows, share)
    with cached(with_features(fixed_layout(train))) as kept:  # rows are moved without their features
        kept.count()
        begin = perf_counter()
        model = Pipeline(stages=[estimator]).fit(kept)
        seconds = perf_counter() - begin
    return FullRun(model, seconds, None if test is None else model.transform(with_features(test)))


def full_classifier(rows: DataFrame, algo: str, share: float = 0.9) -> tuple[FullRun, DataFrame | None]:
    """Whole-table classifier with its test accuracy: (n_test, accuracy)."""
    run = run_full(rows, CLASSIFIERS[algo](), share)
    return run, None if run.predicted is None else accuracy(run.predicted)


def _farthest_kmeans(rows: DataFrame, k: int, iters: int, tol: float) -> tuple[list[list[float]], float]:
    """Centres and cost of k-means from the first row in hash order and those farthest from it; fewer than
    ``k`` centres if there are no rows. Each round is one aggregation to k x dim values."""
    with cached(rows.select("u", "x")) as kept:
        first = kept.agg(F.min_by("x", "u"), F.min_by(F.size("x"), "u")).first()
        centres, dim = ([] if first[0] is None else [list(first[0])]), first[1]

        def held() -> DataFrame:
            return kept.select("u", "x", F.lit(centres).alias("centres"))

        def away() -> Column:
            return F.expr(nearest_distance_sql("x", "centres", len(centres), dim))

        while 0 < len(centres) < k:
            far = held().agg(F.max_by("x", F.struct(away(), -F.col("u")))).first()[0]
            centres = [*centres, list(far)]
        if not centres:
            return [], 0.0
        cluster = F.expr(nearest_sql("x", "centres", k, dim)).alias("cluster")
        for _ in range(iters):
            means = held().select("x", cluster).groupBy("cluster").agg(F.array(*[F.avg(F.col("x")[j]) for j in range(dim)]))
            moved = {r[0]: list(r[1]) for r in means.collect()}
            following = [moved.get(c, centre) for c, centre in enumerate(centres)]
            shift = max(dist(p, q) for p, q in zip(centres, following))
            centres = following
            if shift <= tol:
                break
        return centres, held().agg(F.sum(away())).first()[0]


def _farthest_start(rows: DataFrame, run: FullRun, share: float) -> FullRun:
    """``run``, or k-means of the same rows from a start that draws nothing, if that costs less: it finds far
    clusters that seeded starts may miss."""
    fitted = run.model.stages[-1]
    train, test = row_split(rows, share)
    begin = perf_counter()
    centres, cost = _farthest_kmeans(train, fitted.getK(), fitted.getMaxIter(), fitted.getTol())
    seconds = run.seconds + perf_counter() - begin
    if not centres or cost >= fitted.summary.trainingCost:
        return replace(run, seconds=seconds)
    nearest = F.expr(nearest_sql("x", "centres", len(centres), len(centres[0]))).alias("prediction")
    placed = None
    if test is not None:
        placed = test.select("*", F.lit(centres).alias("centres")).select(*test.columns, nearest)
    return FullRun(run.model, seconds, placed, centres)


def full_clusterer(rows: DataFrame, algo: str, share: float = 0.9) -> tuple[FullRun, DataFrame | None]:
    """Whole-table clustering with the purity of the test rows. k-means starts twice, from a seed and from
    the farthest rows; the fit of the lower training cost counts."""
    run = run_full(rows, CLUSTERERS[algo](), share)
    if algo == "kmeans":
        run = _farthest_start(rows, run, share)
    if run.predicted is None:
        return run, None
    return run, purity(run.predicted.withColumnRenamed("prediction", "cluster"))


def ml_centres(run: FullRun, rows: DataFrame, name: str) -> DataFrame:
    found = run.model.stages[-1].clusterCenters() if run.centres is None else run.centres
    return rows.sparkSession.createDataFrame(
        [(name, i, [float(v) for v in c]) for i, c in enumerate(found)],
        "name string, centre_id int, c array<double>",
    )


def label_auc(predicted: DataFrame) -> float:
    """Area under ROC with the 0/1 prediction itself as the score."""
    scored = predicted.withColumn("score", F.col("prediction").cast("double"))
    return BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(scored)


def label_auc_table(predicted: DataFrame) -> DataFrame:
    """The same by counting: half the sum of the two class recalls."""
    right = (F.col("prediction").cast("int") == F.col("label")).cast("double")
    recalls = predicted.agg(
        F.avg(F.when(F.col("label") == 1, right)).alias("tpr"),
        F.avg(F.when(F.col("label") != 1, right)).alias("tnr"),
    )
    return recalls.select(((F.col("tpr") + F.col("tnr")) / 2).alias("auc"))


def full_itemsets(baskets: DataFrame, minsup: float = 0.15) -> DataFrame:
    """Itemsets of more than one item frequent in the whole table: (items, itemset, support)."""
    model = FPGrowth(itemsCol="items", minSupport=minsup).fit(spread(baskets.select("items")))
    return model.freqItemsets.filter(F.size("items") > 1).select(
        F.sort_array("items").alias("items"), itemset_key(F.col("items")).alias("itemset"), F.col("freq").alias("support")
    )
