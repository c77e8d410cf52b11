"""Blocks, itemsets, stores and runs: edges, skew and plans."""

import hashlib
import itertools
import math
import pickle

import numpy as np
import pytest
from helpers import ROWS, block_rows
from pyspark.sql import functions as F

from blockquorum.functions.itemkeys import itemset_key, parse_basket
from blockquorum.operators import baselines, blocks, itemsets, plugins
from blockquorum.plans import classify, cluster, mine
from blockquorum.sources import store
from blockquorum.sources.tables import baskets, block_ids, line_blocks, real_centres, text_blocks, vector_blocks


def plan_text(df):
    return df._jdf.queryExecution().toString()


def test_chosen_blocks_prune_partitions(spark, sf_dir, tmp_path):
    store.write_blocks(line_blocks(spark, sf_dir), str(tmp_path / "b"))
    stored = store.read_blocks(spark, str(tmp_path / "b"))
    text = plan_text(blocks.select_blocks(stored, [3, 7]).select("label"))
    assert "PartitionFilters: [block_id" in text and "block_id#" in text
    assert "ReadSchema: struct<label:int>" in text
    assert stored.count() == line_blocks(spark, sf_dir).count()


def hot_rows(spark, n=900):
    """One block with most rows, a third of all rows copies of one row."""
    rng = np.random.default_rng(1)
    rows = [("copy", 0, 5 << 50, 1, [1.0, 0.0])] * (n // 3)
    for i in range(n - len(rows)):
        x = rng.normal(size=2)
        rows.append((f"{i}", int(i % 10 == 0), int(rng.integers(1 << 60)), int(x.sum() > 0), [float(v) for v in x]))
    return spark.createDataFrame(rows, ROWS), rows


def test_holdout_is_exact_and_keeps_copies_together(spark):
    df, rows = hot_rows(spark)
    marked = blocks.mark_holdout(df).collect()
    for b in (0, 1):
        mine = sorted(r[2] for r in rows if r[1] == b)
        take = int(len(mine) * 0.9)
        for r in marked:
            if r.block_id == b:
                rank = 1 + sum(v < r.u for v in mine)
                assert r.is_train == (rank <= take)


def test_hot_block_and_copies_fit(spark):
    df, _ = hot_rows(spark)
    run = classify.run_ensemble(df, [0, 1], [0, 1], "DT", use_score=False)
    assert run.predicted.count() == df.count()
    assert run.accuracy().first().accuracy > 0.8
    assert blocks.block_counts(df).agg(F.sum("n_rows")).first()[0] == df.count()


def test_no_row_shuffle_while_fitting(spark, tmp_path):
    """Above the stored rows only small sums are exchanged."""
    from blockquorum.operators import kmeans

    df, _ = block_rows(spark)
    store.write_blocks(df, str(tmp_path / "b"))
    work = kmeans._trials(store.read_blocks(spark, str(tmp_path / "b")), 1)
    state = kmeans._start(work, 2, 3).withColumn("moving", F.lit(True))
    text = kmeans._round(work, state, 2, 3, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("p,n", [(0, 0), (1.0, None), (0.5, None)])
def test_predict_fraction_edges(spark, p, n):
    df, rows = block_rows(spark)
    kept = blocks.predict_fraction(df, p).count()
    drawn = [int(hashlib.md5(f"sample:{r[2]}".encode()).hexdigest()[:15], 16) for r in rows]
    assert kept == (n if n is not None else len([d for d in drawn if p >= 1 or d < p * 2**60]))


def test_negative_split_has_no_test_rows(spark):
    df, _ = block_rows(spark)
    train, test = blocks.row_split(df, -0.5)
    assert test is None and 0 < train.count() < df.count()
    run, quality = baselines.full_classifier(df, "DT", -0.9)
    assert quality is None and run.model is not None


def test_missing_size_takes_the_first_blocks(spark):
    plan = spark.createDataFrame([(2, [9, 4])], "size int, blocks array<int>")
    found = classify.listed_ids([2, 3], plan, tests=1)
    assert found == {2: [9, 4], 3: [0, 1, 2, 3]}
    assert classify.listed_ids([], plan) == {2: [9, 4]}


def test_numeric_item_order(spark):
    df = spark.createDataFrame([("10 2 2 33",)], "value string").select(parse_basket(F.col("value")).alias("i"))
    assert df.select("i", itemset_key(F.col("i")).alias("k")).first() == ([2, 10, 33], "{2,10,33}")


def brute_itemsets(rows, least):
    counts = {}
    for items in rows:
        for k in range(1, len(items) + 1):
            for s in itertools.combinations(items, k):
                counts[s] = counts.get(s, 0) + 1
    return {s: n for s, n in counts.items() if n >= least}


def random_baskets(spark, n=400, n_items=12, n_blocks=4, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i % n_blocks), sorted({int(v) for v in rng.geometric(0.2, size=6) % n_items})) for i in range(n)]
    rows += [(1, [2, 3, 5])] * (n // 2)
    return spark.createDataFrame(rows, "block_id int, items array<int>"), rows


def test_local_itemsets_equal_brute_force(spark):
    df, rows = random_baskets(spark)
    least = itemsets.support_threshold(len(rows), 0.1, 4)
    found = {}
    for r in itemsets.local_itemsets(df, 0.1, 4).collect():
        found.setdefault(r.block_id, {})[tuple(r["items"])] = r.support
    for b in range(4):
        assert found[b] == brute_itemsets([i for c, i in rows if c == b], least)


def test_recount_of_all_blocks_equals_whole_table(spark):
    df, rows = random_baskets(spark)
    local = itemsets.local_itemsets(df, 0.1, 4, min_size=2)
    exact = itemsets.recount_itemsets(df, itemsets.candidate_itemsets(local), 0.1)
    whole = baselines.full_itemsets(df, 0.1)
    assert sorted((r.itemset, r.support) for r in exact.collect()) == sorted(
        (r.itemset, r.support) for r in whole.collect()
    )


def test_one_block_equals_fpgrowth(spark):
    df, _ = random_baskets(spark, n_blocks=1)
    one = df.withColumn("block_id", F.lit(0))
    local = itemsets.local_itemsets(one, 0.05, 1, min_size=2)
    whole = baselines.full_itemsets(one, 0.05)
    assert sorted((r.itemset, r.support) for r in local.collect()) == sorted(
        (r.itemset, r.support) for r in whole.collect()
    )


def test_long_baskets_equal_fpgrowth(spark):
    """Baskets of half of all items: with no frequent pair, and with many long itemsets."""
    rng = np.random.default_rng(8)
    rows = [(0, sorted(int(v) for v in rng.choice(60, 30, replace=False))) for _ in range(80)]
    rows += [(0, list(range(10, 18)))] * 40 + [(0, [])] * 3
    df = spark.createDataFrame(rows, "block_id int, items array<int>")
    for share in (0.6, 0.25):
        local = itemsets.local_itemsets(df, share, 1, min_size=2, least=math.ceil(share * len(rows)))
        whole = baselines.full_itemsets(df, share)
        assert sorted((r.itemset, r.support) for r in local.collect()) == sorted(
            (r.itemset, r.support) for r in whole.collect()
        )


def test_least_counts_baskets_of_one_block(spark):
    df, rows = random_baskets(spark)
    found = itemsets.local_itemsets(df, 1.0, 4, least=20).filter("block_id = 1").collect()
    assert {tuple(r["items"]): r.support for r in found} == brute_itemsets([i for c, i in rows if c == 1], 20)


def test_rare_pairs_are_filtered_before_they_are_counted(spark, monkeypatch):
    """Long baskets with few frequent pairs, copies of baskets, two blocks: no frequent pair is missing, few others stay."""
    rng = np.random.default_rng(4)
    rows = [(i % 2, sorted(int(v) for v in rng.choice(300, 60, replace=False))) for i in range(160)]
    rows += [(0, sorted({3, 7, 11, 200, *rng.choice(300, 50).tolist()})) for _ in range(14)] + [rows[0], rows[1]] * 5
    rows += [(1, [5, 9, 40])] * 3 + [(1, [5, 9, *range(100, 100 + i)]) for i in range(14)]
    df = spark.createDataFrame(rows, "block_id int, items array<int>")
    plain = sorted((r.block_id, r.itemset, r.support) for r in itemsets.local_itemsets(df, 1.0, 2, least=15).collect())
    pairs = {b: brute_pairs([i for c, i in rows if c == b]) for b in (0, 1)}
    monkeypatch.setattr(itemsets, "PLAIN_PAIRS", 0)
    made = []
    real = itemsets.likely_pairs
    monkeypatch.setattr(itemsets, "likely_pairs", lambda *a: made.append(real(*a)) or made[0])
    found = itemsets.local_itemsets(df, 1.0, 2, least=15)
    assert sorted((r.block_id, r.itemset, r.support) for r in found.collect()) == plain
    likely = {(r.block_id, r.node, r["item"]) for r in made[0].collect()}
    frequent = {(b, *p) for b in pairs for p, n in pairs[b].items() if n >= 15}
    assert frequent and frequent <= likely and len(likely) < sum(map(len, pairs.values())) / 4


def brute_pairs(rows):
    counts = {}
    for items in rows:
        for pair in itertools.combinations(items, 2):
            counts[pair] = counts.get(pair, 0) + 1
    return counts


def test_baskets_that_repeat_an_item_are_counted_plainly(spark, monkeypatch):
    df = spark.createDataFrame([(0, [1, 1, 2])] * 3 + [(0, [1, 2, 4])], "block_id int, items array<int>")
    plain = sorted((r.itemset, r.support) for r in itemsets.local_itemsets(df, 1.0, 1, least=3).collect())
    monkeypatch.setattr(itemsets, "PLAIN_PAIRS", 0)
    assert sorted((r.itemset, r.support) for r in itemsets.local_itemsets(df, 1.0, 1, least=3).collect()) == plain


def test_vote_mean_is_an_integer(spark):
    rows = [(0, [1, 2], "{1,2}", 3), (1, [1, 2], "{1,2}", 4), (2, [1, 3], "{1,3}", 9), (2, [1], "{1}", 9)]
    local = spark.createDataFrame(rows, "block_id int, items array<int>, itemset string, support bigint")
    assert [tuple(r) for r in itemsets.vote_itemsets(local, 3, 0.5).collect()] == [("{1,2}", 2, 3)]


def test_nothing_frequent(spark):
    df = spark.createDataFrame([(0, [1]), (0, [2])], "block_id int, items array<int>")
    assert itemsets.local_itemsets(df, 1.0, 1).count() == 0


def test_itemset_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "i")
    found = mine.run_vote(baskets(spark, sf_dir), block_ids(spark, 40), 0.08, 0.5, path=path)
    stored = spark.read.parquet(path + "/model")
    assert sorted(stored.collect()) == sorted(found.collect())
    lines = {r.value for r in spark.read.text(path + "/text").collect()}
    assert lines == {f"{r.itemset}: {r.support}" for r in found.collect()}


def test_centres_file_by_key(spark, sf_dir, tmp_path):
    path = str(tmp_path / "centres")
    store.write_centres(real_centres(line_blocks(spark, sf_dir), "lines", 4), path)
    by_key = store.read_centres(spark, path + ":lines").collect()
    assert by_key == store.read_centres(spark, path, "lines").collect() and len(by_key) == 2
    assert store.read_centres(spark, path + ":other").count() == 0


def test_equal_basket_lines_spread_over_blocks(spark, tmp_path):
    spark.createDataFrame([("1 2 3",)] * 400, "value string").write.text(str(tmp_path / "t"))
    found = store.read_baskets(spark, str(tmp_path / "t"), 8)
    assert found.select("block_id").distinct().count() == 8


def test_keyless_rows_keep_their_blocks_in_other_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COPIES", 7)
    lines = spark.createDataFrame([("1 2 3",)] * 100 + [("4",)] * 3 + [("",)] + [(f"{i} 9",) for i in range(50)], "value string")
    vectors = spark.createDataFrame([(i % 2, [float(i % 5), None]) for i in range(60)] + [(None, None)] * 2, "label int, x array<double>")
    seen = []
    for n in (1, 9):
        lines.repartition(n).write.text(str(tmp_path / f"t{n}"))
        vectors.repartition(n).write.parquet(str(tmp_path / f"v{n}"))
        baskets = store.read_baskets(spark, str(tmp_path / f"t{n}"), 8)
        plain = store.read_vectors(spark, str(tmp_path / f"v{n}"), 4)
        seen.append([sorted(map(str, found.collect())) for found in (baskets, plain)])
        assert baskets.select("row_key").distinct().count() == 154
        assert plain.select("row_key").distinct().count() == 62
    assert seen[0] == seen[1]


def test_two_stage_by_size(spark, tmp_path):
    df, _ = block_rows(spark, n_blocks=5)
    ids = block_ids(spark, 5)
    real = real_centres(df, "made", 3)
    path = str(tmp_path / "c")
    runs = cluster.run_random(df, ids, [1, 3], 1.0, 2, real=real, centres_path=path)
    for run in runs.values():
        assert run.centres.count() == 2
        assert 0.5 <= run.purity.first().purity <= 1
        assert run.distance.first().distance >= 0
    assert spark.read.parquet(path).select("size").distinct().count() == 2


def test_full_run_saves_its_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df, _ = block_rows(spark)
    run, quality = classify.run_full_random(df, block_ids(spark, 3), [2], "DT")[2]
    path = store.save_ml(run.model, str(tmp_path), "DT", "made", 2)
    assert PipelineModel.load(path).stages[0].depth == run.model.stages[0].depth
    assert quality.first().accuracy > 0.7


@pytest.mark.parametrize("algo", ["DT", "LR", "RF", "SVM"])
def test_ensemble_quality(spark, algo):
    rows = line_blocks(spark, "/root/testdata/sf0.01")
    run = classify.run_ensemble(rows, list(range(10)), [38, 39], algo, predicts=1.5)
    assert run.accuracy().first().accuracy >= 0.9
    assert run.models.count() == (80 if algo == "SVM" else 10)  # SVM blocks are cut eight ways


def test_plugin_cuts_large_blocks(spark):
    df, rows = hot_rows(spark)
    cut = plugins.bounded_blocks(df, 100)
    assert cut.count() == len(rows)
    assert cut.groupBy("block_id").count().agg(F.max("count")).first()[0] <= 100
    sure = plugins.PandasClassifier(lambda x, y: int(y.mean() > 0.5), lambda m, x: np.full(len(x), m), max_rows=100)
    with pytest.raises(ValueError):
        sure.fit(df)
    scored = plugins.fit_and_score_custom(sure, df)
    assert scored.agg(F.sum("n_train") + F.sum("n_test")).first()[0] == len(rows)
    assert scored.filter("n_train > 100").isEmpty()
    found = plugins.PandasClusterer(lambda x: [x.mean(axis=0)], max_rows=100).fit(df)
    assert found.count() == cut.select("block_id").distinct().count()


def test_plugin_solvers_get_whole_arrays(spark):
    """A block comes as Arrow buffers, not as an object per row."""
    df, rows = block_rows(spark, n_blocks=3, n=40)
    seen = lambda x, y=None: (x.dtype.str, x.flags.c_contiguous, x.flags.writeable, x.shape, None if y is None else y.dtype.str)
    fitted = plugins.PandasClassifier(seen, None).fit(df)
    assert {r.block_id: pickle.loads(r.model) for r in fitted.collect()} == {
        b: ("<f8", True, True, (n, 3), "<i4") for b, n in ((0, 80), (1, 40), (2, 40))
    }
    centres = plugins.PandasClusterer(lambda x: [x.mean(axis=0), x.max(axis=0)]).fit(df)
    text = centres._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in text and "FlatMapGroupsInPandas" not in text
    for r in centres.collect():
        x = np.array([row[4] for row in rows if row[1] == r.block_id])
        assert np.allclose(r.c, x.mean(axis=0) if r.centre_id == 0 else x.max(axis=0))


def test_plugins_solve_blocks_of_any_size_whole(spark):
    """A block of more than a million rows is one block to its solver, with one model."""
    from blockquorum.registry.queries import apply_class_means, solve_class_means

    n = 1_050_000
    x = F.array(F.col("id").cast("double"), F.lit(1.0))
    df = spark.range(n).select(F.lit(4).alias("block_id"), F.col("id").alias("u"), (F.col("id") % 2).cast("int").alias("label"), x.alias("x"))
    (centre,) = plugins.PandasClusterer(lambda x: [x.mean(axis=0), x.max(axis=0)][:1]).fit(df).collect()
    assert (centre.block_id, centre.centre_id) == (4, 0) and np.allclose(centre.c, [(n - 1) / 2, 1.0])
    plugin = plugins.PandasClassifier(solve_class_means, apply_class_means)
    (model,) = plugin.fit(plugin.blocks(df)).collect()
    assert (model.block_id, model.n_train) == (4, n)
    means = pickle.loads(model.model)
    assert np.allclose([means[0][0], means[1][0]], [(n - 2) / 2, n / 2])


def test_text_and_vector_sources(spark, sf_dir):
    assert text_blocks(spark, sf_dir).filter("size(x) != 3").count() == 0
    assert vector_blocks(spark, sf_dir).filter("size(x) != 64").count() == 0
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert line_blocks(spark, sf_dir).select("row_key").distinct().count() == n


def test_checkpoint_folder_is_used(spark):
    from blockquorum.runtime import fresh_path

    assert fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_holdout_refines_dense_ranges(spark, monkeypatch):
    df, rows = hot_rows(spark)
    wanted = sorted(blocks.mark_holdout(df).select("row_key", "u", "is_train").collect())
    monkeypatch.setattr(blocks, "RANK_ROWS", 1)
    monkeypatch.setattr(blocks, "RANK_BITS", 7)
    assert sorted(blocks.mark_holdout(df).select("row_key", "u", "is_train").collect()) == wanted


def test_draws_for_different_uses_are_independent(spark, sf_dir):
    rows = line_blocks(spark, sf_dir)
    n = rows.count()
    half = blocks.row_sample(rows, 0.5)
    assert abs(blocks.row_sample(half, 0.5, seed="again").count() - n / 4) < n / 40
    train, test = blocks.row_split(blocks.row_sample(rows, 0.2), 0.9)
    assert test.count() > 0 and abs(train.count() - 0.18 * n) < n / 40


def test_own_classifier_votes_from_several_files(spark):
    """Votes of stored models in several files are those of all models, and go through trim and vote."""
    from blockquorum.registry.queries import apply_class_means, solve_class_means

    df, rows = block_rows(spark, n_blocks=6, n=60)
    one = plugins.PandasClassifier(solve_class_means, apply_class_means)
    many = plugins.PandasClassifier(solve_class_means, apply_class_means, model_bytes=400)
    models = one.fit(df.filter("block_id < 5")).cache()
    assert models.agg(F.sum(F.octet_length("model"))).first()[0] > 800
    test = df.filter("block_id = 5").select("row_key", "x")
    first, other = ({r.row_key: dict(r.votes) for r in p.vote(test, models).collect()} for p in (one, many))
    assert first == other and all(sum(v.values()) == 5 for v in first.values())
    run = classify.run_ensemble(df, list(range(5)), [5], many, tail=0.1)
    scores = sorted(r.accuracy for r in run.models.collect())
    kept = sorted(r.accuracy for r in run.kept.collect())  # one goes at each end, but for ties with those that stay
    assert kept == [s for s in scores if scores[1] <= s <= scores[3]] and run.accuracy().first().accuracy > 0.8
    with pytest.raises(ValueError):
        classify.run_ensemble(df, [0], [5], many, weighted=True)
