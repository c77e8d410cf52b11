"""Training samples under their byte bounds."""

import pytest

from blockquorum.llm import languages, toxicity


def test_only_texts_that_do_not_fit_are_left_out(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (900 if i % 10 == 0 else 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_TRAIN_BYTES", 10**9)
    short = sum(len(t) == 5 for t in toxicity.training_rows(docs, labels)[0])
    monkeypatch.setattr(toxicity, "MOST_TRAIN_BYTES", 500)
    assert short and [len(t) for t in toxicity.training_rows(docs, labels)[0]] == [5] * short
    monkeypatch.setattr(toxicity, "MOST_TRAIN_BYTES", 2)
    with pytest.raises(ValueError):
        toxicity.training_rows(docs, labels)


def test_every_language_is_learned_from(spark):
    rows = [(i, lang, word * 200) for i, (lang, word) in enumerate([("en", "the "), ("fr", "les "), ("de", "und ")])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert list(languages.learn(docs, train_bytes=1).langs) == ["de", "en", "fr"]
