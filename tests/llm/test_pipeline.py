"""The stages of the pipeline after the classifier, in a row, on rows that are hard."""

import corpus_pipeline
from blockquorum.runtime import materialize


def after_the_first(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = docs.columns
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == before or name == corpus_pipeline.STAGES[-1][0]
    return docs


def test_hard_rows_through_the_stages(spark, sf_dir, hard):
    out = after_the_first(spark, hard, sf_dir).collect()
    # 3 and the rows of 7 hold one text; 1, 2 and 9 have no words; rows with a null id stay
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, [-5, 1, 3, 8, 11, 12, None, None]))
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by_id[1].n_tokens == 0 and by_id[8].text == "x" * 3000
    assert "4539148803436467" not in by_id[12].text
    assert all(r.bucket == 1 and r.score == 2.0 for r in out)  # extra columns as they were


def test_empty_table_through_the_stages(spark, sf_dir, empty):
    assert after_the_first(spark, empty, sf_dir).count() == 0
