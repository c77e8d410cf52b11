"""Toxicity and language: held-out accuracy, edges, and what may be learned from."""

import zlib

import numpy as np
import pytest

from blockquorum.llm import languages, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(spark, larger):
    docs, labels = larger
    got = toxicity.decide(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.6 and (clean.predicted == 0).mean() >= 0.97
    assert toxic.score.mean() > clean.score.mean() + 0.4
    assert ((got.score >= toxicity.DECISION) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_does_not_read_held_out_labels(spark, larger):
    docs, labels = larger
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 4) = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = (toxicity.training_rows(docs, x) for x in (labels, flipped))
    assert one[0] == two[0] and (one[1] == two[1]).all()


def test_long_texts_pool_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(0)
    items = [" ".join(rng.choice([f"word{i}" for i in range(30)], n)) for n in (0, 1, 2, 3, 5000)] + ["bad idiot things " * 3]
    model = toxicity.train([*items, "idiot scum", "nice day"] * 10, np.array(([0] * 5 + [1, 1, 0]) * 10), epochs=2)
    whole = toxicity.Scorer(model).texts(items)[0]
    monkeypatch.setattr(toxicity, "PIECE", 64)
    monkeypatch.setattr(toxicity, "MOST_KNOWN", 10)
    assert np.allclose(toxicity.Scorer(model).texts(items)[0], whole, atol=1e-5)
    one_by_one = np.array([toxicity.Scorer(model).texts([t])[0][0] for t in items])
    assert np.allclose(one_by_one, whole, atol=1e-5)


def test_toxicity_edges(spark, hard, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.decide(hard, none).collect()} == {0.0}
    one_class = spark.createDataFrame([(1, 1), (7, 1), (7, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    got = toxicity.decide(hard, one_class).collect()
    assert len(got) == hard.count() and {r.predicted for r in got} == {1}
    both = spark.createDataFrame([(i, i % 2) for i in range(-6, 13)], "doc_id long, toxic int")
    assert toxicity.decide(hard, both).count() == hard.count()
    kept = toxicity.keep_clean(hard, hard, none)
    assert kept.columns == hard.columns and kept.count() == hard.count()
    assert toxicity.decide(empty, both).count() == 0


def test_language_held_out(spark, larger):
    docs, _ = larger
    got = languages.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != languages.UND)]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def slow_distribution(counts, context):
    """Probabilities of all bytes by the definition; counts: context -> {byte: n}."""
    own = counts.get(context, {})
    lower = slow_distribution(counts, context[1:]) if context else np.full(256, 1 / 256)
    if not own:
        return lower
    total, kinds = sum(own.values()), len(own)
    unseen = np.array([s not in own for s in range(256)])
    out = np.where(unseen, kinds / (total + kinds) * lower / lower[unseen].sum(), 0)
    for s, n in own.items():
        out[s] = n / (total + kinds)
    return out


def test_code_lengths_by_definition(monkeypatch):
    monkeypatch.setattr(languages, "LEAST_CONTEXT", 1)
    train, text = b"abracadabra abba", b"abrax!cab"
    counts: dict[int, dict[int, int]] = {}
    for size, values, n in languages.gram_counts(languages._HEAD + train):
        counts[size] = dict(zip(values.tolist(), n.tolist()))
    model = languages.build(["x"], [counts])
    by_context: dict[bytes, dict[int, int]] = {}
    data = languages._HEAD + train
    for k in range(languages.ORDER + 1):
        for i in range(languages.ORDER, len(data)):
            own = by_context.setdefault(data[i - k : i], {})
            own[data[i]] = own.get(data[i], 0) + 1
    data, want = languages._HEAD + text, 0.0
    for i in range(languages.ORDER, len(data)):
        want -= np.log2(slow_distribution(by_context, data[i - languages.ORDER : i])[data[i]])
    assert languages.code_lengths(model, [text])[0, 0] == pytest.approx(want, rel=1e-4)
    monkeypatch.setattr(languages, "PIECE", 3)
    assert languages.code_lengths(model, [b"", text, b"a"])[1, 0] == pytest.approx(want, rel=1e-4)


def test_language_edges(spark, hard, empty):
    got = {str(r.doc_id) + str(i): r for i, r in enumerate(languages.identify(hard).collect())}
    assert len(got) == hard.count()
    no_letter = [r for r in got.values() if r.doc_id in (9, 1, 2)]
    assert {(r.lang_pred, r.score) for r in no_letter} == {(languages.UND, 0.0)}
    assert {r.lang_pred for r in got.values()} <= {"en", "fr", "de", languages.UND}
    assert languages.identify(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, "some text"), (2, "en", None)], "doc_id long, lang string, text string")
    assert {r.lang_pred for r in languages.identify(nothing).collect()} == {languages.UND}
