"""Models fitted by Spark against plain numpy on small blocks."""

import numpy as np
import pytest
from helpers import ROWS, arrays, block_rows
from pyspark.sql import functions as F

from blockquorum.operators import baselines, linear, models, scoring, trees, voting
from blockquorum.operators.kmeans import bisect_trials, block_kmeans
from blockquorum.runtime import materialize


def logistic_gradient(w, x, y, ridge):
    z = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-z @ w))
    return z.T @ (p - y) + ridge * w


def hinge_value(w, x, y, c):
    z = np.hstack([x, np.ones((len(x), 1))])
    return 0.5 * w @ w + c * np.maximum(0, 1 - (2 * y - 1) * (z @ w)).sum()


def hinge_best(x, y, c, rounds=20000):
    """Averaged subgradient descent."""
    z, s = np.hstack([x, np.ones((len(x), 1))]), 2 * y - 1
    w, best = np.zeros(z.shape[1]), np.inf
    for t in range(1, rounds + 1):
        bad = s * (z @ w) < 1
        w = w - (w - c * (s[bad, None] * z[bad]).sum(axis=0)) / (t + 10)
        best = min(best, hinge_value(w, x, y, c))
    return best


@pytest.mark.parametrize("dim", [3, 12])
def test_logreg_is_stationary(spark, dim):
    df, rows = block_rows(spark, dim=dim)
    for r in linear.fit_logreg(df, tol=1e-12).collect():
        x, y, _ = arrays(rows, r.block_id)
        assert np.abs(logistic_gradient(np.array(r.weights), x, y, 0.1)).max() < 1e-4


@pytest.mark.parametrize("dim", [3, 12])
def test_svm_reaches_the_least_hinge_loss(spark, dim):
    df, rows = block_rows(spark, dim=dim)
    for r in linear.fit_svm(df).collect():
        x, y, _ = arrays(rows, r.block_id)
        assert hinge_value(np.array(r.weights), x, y, 0.1) <= hinge_best(x, y, 0.1) * 1.002


def test_both_sum_paths_agree(spark, monkeypatch):
    df, _ = block_rows(spark)
    by_columns = {r.block_id: r.weights for r in linear.fit_svm(df).collect()}
    monkeypatch.setattr(linear, "UNROLL_DIM", 0)
    for r in linear.fit_svm(df).collect():
        assert np.allclose(r.weights, by_columns[r.block_id], atol=1e-6)


def test_large_tables_take_the_written_path(spark, monkeypatch):
    from blockquorum import runtime

    df, _ = block_rows(spark)
    small = sorted(linear.fit_logreg(df).collect())
    tree = sorted(trees.fit_trees(df, depth=3).collect())
    centres = sorted(block_kmeans(df).collect())
    monkeypatch.setattr(runtime, "SMALL_VALUES", 1)
    for a, b in zip(small, sorted(linear.fit_logreg(df).collect())):
        assert np.allclose(a.weights, b.weights)
    assert tree == sorted(trees.fit_trees(df, depth=3).collect())
    for a, b in zip(centres, sorted(block_kmeans(df).collect())):
        assert np.allclose(a.c, b.c)


def test_cascade_is_close_to_one_fit(spark):
    df, rows = block_rows(spark, n=300)
    whole = {r.block_id: np.array(r.weights) for r in linear.fit_svm(df).collect()}
    for r in linear.fit_cascade(df, max_bytes=32 * 3 * 150).collect():
        x, y, _ = arrays(rows, r.block_id)
        z = np.hstack([x, np.ones((len(x), 1))])
        agree = (z @ np.array(r.weights) > 0) == (z @ whole[r.block_id] > 0)
        assert agree.mean() > 0.95


def test_single_label_block(spark):
    rows = [(f"{i}", 0, i, 1, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, ROWS)
    for algo in ("LR", "SVM", "DT", "RF", "CSVM"):
        fitted = models.fit_blocks(df, algo).withColumn("accuracy", F.lit(1.0))
        said = scoring.predict_own(df, fitted).select("prediction").distinct().collect()
        assert [r.prediction for r in said] == [1], algo


@pytest.mark.parametrize("bins", [2, 7, 32])
def test_bins_by_halving_count_the_cuts_below(spark, bins):
    """Equal to the lambda over the cuts, with ties, infinite values and features without values; no lambda is left in the plan."""
    values = [None, float("-inf"), 0.0, 1.0, 1.0, 2.5, float("inf")]
    rows = [(f"{i}", i % 3, i, i % 2, [values[i % 7], float(i % 11), None if i % 3 else 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, ROWS)
    data, _ = trees.bin_rows(df, 3, bins)
    assert "lambda" not in data._jdf.queryExecution().optimizedPlan().toString()
    counted = F.expr(f"array({', '.join(f'size(filter(cuts[{j}], c -> c < x[{j}]))' for j in range(3))})")
    wanted = df.join(trees.feature_cuts(df, 3, bins), "block_id").select("block_id", "u", "label", counted.alias("bins"))
    assert sorted(data.collect(), key=lambda r: r.u) == sorted(wanted.collect(), key=lambda r: r.u)


def test_rows_are_packed_in_bounded_pieces(spark, monkeypatch):
    """However the rows fall into pieces, a piece handed on is bounded, every row is in one, and fits are equal to the last bit."""
    df, rows = block_rows(spark, n_blocks=5)
    wanted = sorted(linear.fit_svm(df, rounds=5).collect())
    monkeypatch.setattr(linear, "PACK_ROWS", 100)
    monkeypatch.setattr(linear, "CHUNK_ROWS", 16)
    packed = linear._pack(df.coalesce(1), 3).collect()
    assert max(len(r.y) for r in packed) <= 16
    found = sorted((r.block_id, y, *x) for r in packed for y, x in zip(r.y, np.frombuffer(r.x).reshape(3, -1).T.tolist()))
    assert found == sorted((r[1], r[3], *r[4]) for r in rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sorted(linear.fit_svm(df, rounds=5).collect()) == wanted
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_large_tables_are_cached_on_disk_alone(spark, monkeypatch):
    from blockquorum import runtime

    df = spark.range(1000)
    with runtime.cached(df) as kept:
        assert kept.storageLevel.useMemory
    monkeypatch.setattr(runtime, "HELD_BYTES", 1)
    with runtime.cached(df.withColumn("twice", F.col("id") * 2)) as kept:
        assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
        assert kept.agg(F.sum("twice")).first()[0] == 999_000


def gini_tree(bins, y, depth, min_leaf, classes):
    """Nodes of a tree over binned features: {node: (feature, bin, label)}."""
    found, todo = {}, [(1, np.arange(len(y)), 0)]
    while todo:
        node, idx, level = todo.pop()
        counts = np.array([(y[idx] == c).sum() for c in classes])
        label, best = classes[counts.argmax()], None
        if level < depth:
            for f in range(bins.shape[1]):
                for b in np.unique(bins[idx, f]):
                    left = bins[idx, f] <= b
                    l = np.array([(y[idx][left] == c).sum() for c in classes])
                    r = counts - l
                    if l.sum() < min_leaf or r.sum() < min_leaf:
                        continue
                    gain = round((l**2).sum() / l.sum() + (r**2).sum() / r.sum() - (counts**2).sum() / counts.sum(), 6)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b)
        if best is None:
            found[node] = (-1, None, label)
            continue
        found[node] = (best[1], best[2], label)
        left = bins[idx, best[1]] <= best[2]
        todo += [(2 * node, idx[left], level + 1), (2 * node + 1, idx[~left], level + 1)]
    return found


@pytest.mark.parametrize("labels", [2, 4])
def test_tree_equals_brute_force(spark, labels):
    df, _ = block_rows(spark, labels=labels)
    binned, _ = trees.bin_rows(df, 3)
    classes = list(range(labels))
    by_block = {}
    for r in binned.collect():
        by_block.setdefault(r.block_id, []).append(r)
    for model in trees.fit_trees(df, depth=4, min_leaf=5).collect():
        mine = by_block[model.block_id]
        expected = gini_tree(np.array([r.bins for r in mine]), np.array([r.label for r in mine]), 4, 5, classes)
        assert {n.node: (n.feature, n.label) for n in model.nodes} == {k: (v[0], v[2]) for k, v in expected.items()}


def test_bins_keep_order_and_size(spark):
    df, rows = block_rows(spark, n=2000)
    binned, thresholds = trees.bin_rows(df, 3)
    x, _, u = arrays(rows, 1)
    value = {(int(u[i]), f): x[i, f] for i in range(len(u)) for f in range(3)}
    top = {(r.feature, r.bin): r.threshold for r in thresholds.filter("block_id = 1").collect()}
    for r in binned.filter("block_id = 1").collect():
        for f in range(3):
            assert value[r.u, f] <= top.get((f, r.bins[f]), np.inf)
            lower = [t for (g, b), t in top.items() if g == f and b < r.bins[f]]
            assert not lower or value[r.u, f] > max(lower)


def test_far_off_values_do_not_cost_the_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 100, 2000)
    rows = [(str(i), 0, int(u), int(v > 50), [float(v)]) for i, (v, u) in enumerate(zip(x, rng.choice(1 << 60, 2000, replace=False)))]

    def accuracy(rows):
        return models.fit_and_score(spark.createDataFrame(rows, ROWS), "DT").first().accuracy

    far = [(*rows[0][:4], [1e6]), *rows[1:]]
    assert accuracy(rows) > 0.97 and abs(accuracy(far) - accuracy(rows)) < 0.01


@pytest.mark.parametrize("kind", ["lognormal", "ties", "constant"])
def test_cuts_are_values_at_equal_ranks(spark, kind):
    rng = np.random.default_rng(4)
    x = {"lognormal": rng.lognormal(sigma=4, size=999), "ties": rng.integers(0, 5, 999).astype(float), "constant": np.ones(50)}[kind]
    df = spark.createDataFrame([(str(i), 0, i, 0, [float(v)]) for i, v in enumerate(x)], ROWS)
    cuts = trees.feature_cuts(df, 1, 8).first().cuts[0]
    ordered = np.sort(x)
    assert cuts == [ordered[-(-k * len(x) // 8) - 1] for k in range(1, 8)]


def test_forest_beats_chance_and_repeats(spark):
    df, _ = block_rows(spark, n=300)
    first = models.fit_and_score(df, "RF")
    again = models.fit_and_score(df, "RF")
    assert sorted(first.collect()) == sorted(again.collect())
    assert first.agg(F.min("accuracy")).first()[0] > 0.7
    assert all(len({n.tree for n in r.nodes}) == 20 for r in first.collect())


def test_forest_keeps_each_row_once(spark):
    df, rows = block_rows(spark, n=1500)
    drawn = trees.bootstrap(trees.bin_rows(df, 3)[0], 20, seed=7)
    draws = np.array([r.draws for r in drawn.collect()])
    assert draws.shape == (len(rows), 20)
    shares = [(draws == k).mean() for k in range(4)]
    assert np.allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.01)
    assert abs(np.corrcoef(draws.T)[np.triu_indices(20, 1)]).max() < 0.1


def test_forest_counts_equal_rows_once(spark):
    """What the levels unfold is bounded by the bins, not by the rows, and loses no draw."""
    df, rows = block_rows(spark, n=1500)
    drawn = trees.bootstrap(trees.bin_rows(df, 3, bins=4)[0], 5, seed=7)
    want = {}
    for r in drawn.collect():
        cell = want.setdefault((r.block_id, r.label, *r.bins), np.zeros(5, dtype=int))
        cell += r.draws
    got = {(r.block_id, r.label, *r.bins): r.draws for r in trees.cells(drawn, 5).collect()}
    assert got.keys() == want.keys() and all(got[k] == list(want[k]) for k in want)
    assert len(got) <= 3 * 2 * 4**3 < len(rows)


def test_forest_nodes_split_and_answer_as_counted_by_hand(spark):
    df, _ = block_rows(spark, n=200)
    binned = trees.bin_rows(df, 3)[0]
    rows = trees.bootstrap(binned, 3, seed=7).join(df.select("block_id", "u", "x"), ["block_id", "u"]).collect()
    for model in trees.fit_trees(df, depth=3, min_leaf=5, n_trees=3).collect():
        nodes = {(n.tree, n.node): n for n in model.nodes}
        assert {t for t, _ in nodes} == {0, 1, 2} and max(n for _, n in nodes) > 3
        reached = {}
        for r in (r for r in rows if r.block_id == model.block_id):
            for t, times in enumerate(r.draws):
                at = 1
                while times:
                    reached.setdefault((t, at), []).extend([r.label] * times)
                    n = nodes[t, at]
                    if n.feature < 0:
                        break
                    at = 2 * at + int(r.x[n.feature] > n.threshold)
        assert reached.keys() == nodes.keys()
        for at, labels in reached.items():
            assert len(labels) >= 5 and nodes[at].label == min(set(labels), key=lambda c: (-labels.count(c), c))


@pytest.mark.parametrize("algo, pair", [("LR", (0, 2)), ("LR", (-1, 1)), ("SVM", (3, 7)), ("CSVM", (0, 2))])
def test_other_labels_are_answered(spark, algo, pair):
    df, _ = block_rows(spark, n_blocks=2)
    other = df.withColumn("label", F.when(F.col("label") == 0, pair[0]).otherwise(pair[1]))
    fitted = models.fit_and_score(other, algo)
    plain, found = (sorted(x.select("block_id", "accuracy").collect()) for x in (models.fit_and_score(df, algo), fitted))
    assert found == plain and min(r.accuracy for r in found) > 0.8
    assert scoring.vote_tallies(other, fitted)[1] == sorted(pair)


def test_logistic_fit_of_several_labels(spark):
    df, _ = block_rows(spark, labels=4)
    fitted = models.fit_and_score(df, "LR")
    assert all(r["labels"] == [0, 1, 2, 3] and len(r.weights) == 16 for r in fitted.collect())
    assert fitted.agg(F.min("accuracy")).first()[0] > 0.45  # one set against the rest cannot do better on ordered labels
    assert sorted(r.block_id for r in fitted.collect()) == [0, 1, 2]


def test_one_model_vote_equals_the_model(spark):
    df, _ = block_rows(spark)
    one = models.fit_and_score(df, "DT").filter("block_id = 1")
    tallied, classes = scoring.vote_tallies(df, one)
    voted = tallied.withColumn("vote", scoring.voted_label(F.col("votes"), classes))
    own = scoring.predict_own(df, one).select("row_key", "prediction")
    assert voted.join(own, "row_key").filter("vote != prediction").count() == 0


def test_vote_parts_add_up(spark):
    df, _ = block_rows(spark)
    fitted = models.fit_and_score(df, "DT")
    whole, _ = scoring.vote_tallies(df, fitted)
    parts, _ = scoring.vote_tallies(df, fitted, max_values=1)
    assert len(scoring.survey(fitted, 1)[1]) == 3
    assert sorted(whole.select("row_key", "votes").collect()) == sorted(parts.select("row_key", "votes").collect())


def test_models_survive_a_write(spark, tmp_path):
    from blockquorum.sources.store import read_models, write_models

    df, _ = block_rows(spark)
    fitted = models.fit_and_score(df, "DT")
    write_models(fitted, str(tmp_path / "m"), 50)
    stored = read_models(spark, str(tmp_path / "m"), 50)
    columns = sorted(fitted.columns)
    assert sorted(stored.select(columns).collect()) == sorted(fitted.select(columns).collect())


def lloyd(x, u, iters):
    c = [x[u.argmin()]]
    c.append(x[((x - c[0]) ** 2).sum(axis=1).argmax()])
    c = np.array(c)
    for _ in range(iters):
        near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(2)])
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    return c


@pytest.mark.parametrize("dim", [3, 40])
def test_kmeans_equals_brute_force(spark, dim):
    df, rows = block_rows(spark, dim=dim)
    found = {}
    for r in block_kmeans(df, iters=4, tol=0.0).collect():
        found[r.block_id, r.centre_id] = r.c
    for b in range(3):
        x, _, u = arrays(rows, b)
        assert np.allclose([found[b, 0], found[b, 1]], lloyd(x, u, 4))


def test_kmeans_with_three_centres(spark):
    df, _ = block_rows(spark)
    found = block_kmeans(df, k=3).groupBy("block_id").count().collect()
    assert sorted(r["count"] for r in found) == [3, 3, 3]


def test_copies_give_one_filled_cluster(spark):
    rows = [(f"{i}", 0, i, 0, [1.0, 2.0]) for i in range(20)]
    found = block_kmeans(spark.createDataFrame(rows, ROWS)).collect()
    assert all(r.c == [1.0, 2.0] for r in found) and len(found) == 2


def test_bisect_keeps_the_better_trial(spark):
    from blockquorum.operators.kmeans import best_trial

    df, _ = block_rows(spark)
    every = materialize(bisect_trials(df))
    least = {r.block_id: r.s for r in every.groupBy("block_id").agg(F.min("sse").alias("s")).collect()}
    for r in best_trial(every).collect():
        assert abs(r.sse - least[r.block_id]) < 1e-6


def kept_scores(spark, scores, tail=0.05):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "block_id int, accuracy double")
    return sorted(r.accuracy for r in voting.trim_tails(df, tail).collect())


def test_tail_trim_edges(spark):
    assert kept_scores(spark, [0.5]) == [0.5]
    assert kept_scores(spark, [0.5, 0.6]) == [0.5, 0.6]
    assert kept_scores(spark, [0.5, 0.6, 0.7]) == [0.6]
    assert kept_scores(spark, [0.5, 0.5, 0.6, 0.7]) == [0.5, 0.5, 0.6]
    assert len(kept_scores(spark, [i / 100 for i in range(60)], 0.1)) == 48


def test_score_at_equals_sorting(spark):
    near = [0.25 + i * 2**-50 for i in range(40)]
    scores = sorted(near + [0.0, 1.0, 0.9, 0.9, 0.9])
    df = spark.createDataFrame([(v,) for v in scores], "accuracy double").groupBy("accuracy").agg(F.count("*").alias("n"))
    df = df.cache()
    for place in (1, 2, 21, 41, 42, 44, 45):
        assert voting.score_at(df, place) == scores[place - 1]
    empty = spark.createDataFrame([(0, None)], "block_id int, accuracy double")
    assert voting.trim_tails(empty, 0.1).count() == 0


def test_whole_kmeans_equals_plain_rounds(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(9, 1, (12, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "u bigint, x array<double>")
    centres, cost = baselines._farthest_kmeans(df, 2, 100, 1e-4)
    own = np.array([points[0], points[((points - points[0]) ** 2).sum(1).argmax()]])
    for _ in range(100):
        near = ((points[:, None] - own) ** 2).sum(2).argmin(1)
        own = np.array([points[near == c].mean(0) for c in range(2)])
    assert np.allclose(centres, own, atol=1e-6)
    assert abs(cost - ((points[:, None] - own) ** 2).sum(2).min(1).sum()) < 1e-6
    assert baselines._farthest_kmeans(df.filter("u < 0"), 2, 100, 1e-4) == ([], 0.0)


def test_vote_tie_takes_the_smaller_label(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("a", 0), ("b", 1)], "row_key string, prediction int")
    assert sorted(map(tuple, voting.majority_vote(df).collect())) == [("a", 0), ("b", 1)]


def test_weighted_vote(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("b", 0, 0.9), ("b", 1, 0.2)], "row_key string, prediction int, score double")
    assert sorted(map(tuple, voting.weighted_vote(df).collect())) == [("a", 1), ("b", 0)]


def test_linear_fits_repeat_to_the_last_bit(spark):
    """However the rows are dealt to tasks."""
    from blockquorum.operators import linear

    df, _ = block_rows(spark, n_blocks=2, n=300, dim=3, seed=5)
    wide = df.withColumn("x", F.expr("array(x[0] * 1e5, x[1] * 1e-4, x[2])"))
    for rows in (df, wide):
        first, other = (
            {r.block_id: r.weights for r in linear.fit_svm(part, rounds=30, ready=True).collect()}
            for part in (rows.repartition(1), rows.repartition(7, "u"))
        )
        assert first == other


@pytest.mark.parametrize("loss", [linear.hinge_loss(), linear.logistic_loss()])
def test_packed_sums_equal_sums_of_rows(spark, monkeypatch, loss):
    """Chunks of any size, with missing, infinite and odd rows beside them, give the sums of the plain rows."""
    df, _ = block_rows(spark, n_blocks=3, n=200, dim=3, seed=6)
    odd = spark.createDataFrame(
        [("a", 0, 1, 1, [1.0, None, 2.0]), ("b", 0, 2, None, [1.0, 3.0, 2.0]), ("c", 1, 3, 0, [float("nan"), 3.0, 2.0])]
        + [("d", 7, 4, 1, [0.5, None, 2.0]), ("e", None, 5, 1, [0.5, 1.0, 2.0]), ("f", 1, 6, 3, [0.5, 1.0, 2.0])],
        ROWS,
    )
    rows = df.unionByName(odd).repartition(3)
    state = spark.createDataFrame(
        [(b, [0.3, -1.5, 0.7, 0.1 * b], [0.0] * 4, 1.0) for b in (0, 1, 2, 7)],
        "block_id int, w array<double>, base array<double>, base_loss double",
    )
    for name, n in (("PACK_ROWS", 150), ("CHUNK_ROWS", 70), ("TILE_ROWS", 32)):
        monkeypatch.setattr(linear, name, n)

    def found(pack):
        with linear._exact_summing(rows, loss, 3, pack) as sums_of:
            return {r.block_id: np.array(r.sums, dtype=float) for r in sums_of(state).collect()}

    packed, plain = found(True), found(False)
    assert set(packed) == set(plain) == {0, 1, 2, 7}
    for b in plain:
        near = 0 if loss.stretch > 1 else 1e-9  # the exponentials of the logistic loss may differ in their last bit
        assert np.allclose(packed[b], plain[b], rtol=near, atol=near, equal_nan=True)


@pytest.mark.parametrize(("rows", "parts"), [(0, 1), (1, 1), (20_001, 2), (5_120_000, 256), (36_000_000, 256), (300_000_000, 300)])
def test_large_tables_get_larger_partitions(rows, parts):
    assert baselines.layout_parts(rows) == parts


def test_rows_move_without_their_features(spark):
    df, _ = block_rows(spark)
    plan = baselines.with_features(baselines.fixed_layout(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("features") < plan.index("RepartitionByExpression")
    run, found = baselines.full_classifier(df, "LR")
    assert "features" in run.predicted.columns and found.first().n_test > 0
