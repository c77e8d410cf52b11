"""Registered queries run the whole job."""

import numpy as np
import pytest

from blockquorum.plans import classify
from blockquorum.registry import queries
from blockquorum.sources import store


def test_svm_auc_takes_the_listed_blocks_of_the_other_ensembles(spark, sf_dir, monkeypatch):
    asked = []

    class Run:
        predicted = None

    monkeypatch.setattr(queries.classify, "run_ensemble", lambda rows, train, predict, *rest, **kw: asked.append((list(train), list(predict))) or Run)
    monkeypatch.setattr(queries, "_areas", lambda predicted: None)
    queries.svm_auc(spark, sf_dir)
    queries.label_auc(spark, sf_dir)
    assert asked[0] == asked[1] == (list(range(30)), list(range(30, 40)))


def brute_kmeans(x, u, rounds=100, tol=1e-4):
    """Two centres: from the row lowest in hash order and the one farthest from it, until none moves."""
    first = x[np.argmin(u)]
    away = ((x - first) ** 2).sum(axis=1)
    far = np.flatnonzero(away >= away.max() - 1e-9)
    c = np.stack([first, x[far[np.argmin(u[far])]]])
    for _ in range(rounds):
        to = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[to == k].mean(axis=0) if (to == k).any() else c[k] for k in (0, 1)])
        moved, c = np.sqrt(((new - c) ** 2).sum(axis=1)).max(), new
        if moved <= tol:
            break
    return c


def test_whole_kmeans_as_brute_force(spark, sf_dir):
    rows = queries.line_blocks(spark, sf_dir).select("block_id", "u", "x").toPandas()
    found = queries.QUERIES["block_kmeans"](spark, sf_dir).toPandas()
    place, value = [c for c in found.columns if c not in ("block_id", "centre_id")]
    for block, part in rows.groupby("block_id"):
        want = brute_kmeans(np.stack(part["x"].to_numpy()), part["u"].to_numpy())
        got = found[found["block_id"] == block].sort_values(["centre_id", place])[value].to_numpy()
        assert got == pytest.approx(want.ravel(), abs=1e-4)


def test_svm_ensemble_votes_as_its_stored_models(spark, tmp_path):
    rows = queries.line_blocks(spark, "/root/testdata/sf0.01")
    paths = {"model_path": str(tmp_path / "models"), "metric_path": str(tmp_path / "metrics")}
    run = classify.run_ensemble(rows, list(range(12)), [38, 39], "SVM", 0.05, size=12, **paths)
    kept = store.read_models(spark, paths["model_path"], 12).orderBy("block_id").collect()
    assert {m.block_id // 8 for m in kept} == set(range(12)) and len(kept) > 80  # eight models a train block, but the tails
    w = np.array([m.weights for m in kept])
    found = run.predicted.select("label", "x", "prediction", "votes").toPandas()
    ones = ((np.stack(found["x"]) @ w[:, :-1].T + w[:, -1]) > 0).sum(axis=1)
    assert [v[1] for v in found["votes"]] == ones.tolist()
    assert found["prediction"].tolist() == (2 * ones > len(kept)).astype(int).tolist()
    stored = {r.metric: r.value for r in spark.read.parquet(paths["metric_path"]).collect()}
    assert stored["models"] - stored["cut_models"] == stored["kept_models"] == len(kept)
    assert stored["accuracy"] == pytest.approx((found["prediction"] == found["label"]).mean())
    assert stored["n_test"] == len(found)
    area = queries._areas(run.predicted).first()
    right = found["prediction"] == found["label"]
    assert area.auc == pytest.approx(right.groupby(found["label"]).mean().mean(), abs=1e-5)
    assert area.auc == area.auc_curve > 0.8
