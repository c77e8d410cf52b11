"""Cut ranks by the skip list, rearranged texts and back."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from blockquorum.llm import middle


@given(st.lists(st.integers(1, 9), max_size=400), st.data())
@settings(max_examples=80, deadline=None)
def test_place_is_the_sum_of_the_first_widths(widths, data):
    units = middle.SkipList(np.array(widths, dtype=np.int64))
    rank = data.draw(st.integers(0, len(widths)))
    assert units.place(rank) == sum(widths[:rank])


def test_long_lists_have_express_lanes_and_few_steps():
    n = 300_000
    units = middle.SkipList(np.full(n, 3))
    assert len(units.lanes) > 5
    widths = [lane[0] for lane in units.lanes]
    assert all(int(w.sum()) == n for w in widths)  # every lane passes all units
    for rank in (0, 1, n // 2 + 1, n - 1, n):
        assert units.place(rank) == 3 * rank
    with pytest.raises(IndexError):
        units.place(n + 1)


def brute(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def rows_of(df):
    back = middle.restored(F.col("form"), F.col("output"))
    return [tuple(r) for r in df.withColumn("back", back).collect()]


def check(df, pairs):
    want = sorted(((d, *brute(d, t), t or "") for d, t in pairs), key=repr)
    assert sorted(rows_of(df), key=repr) == want


def test_documents_as_brute_force(documents):
    df, rows = documents
    check(middle.transform(df), rows)
    forms = {r.form for r in middle.transform(df).select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_hard_rows(hard, hard_rows):
    check(middle.transform(hard), [(r[0], r[1]) for r in hard_rows])


def test_texts_with_marks_or_parts_of_marks(spark):
    given_ = [(i, t) for i, t in enumerate(["<P>", "a<S>b", "x<M", "<", "<P<S<M", "P>S>M>", "<<P>", "ab<"] * 5)]
    check(middle.transform(spark.createDataFrame(given_, "doc_id long, text string")), given_)


def test_units_of_a_pattern(spark):
    given_ = [(i, "Two words, and  Ünï \U0001f600 more.\n" * i) for i in range(12)]
    df = middle.transform(spark.createDataFrame(given_, "doc_id long, text string"), unit=r"\w+\s*", plain_percent=0)
    pattern = middle.unit_pattern(r"\w+\s*")
    for doc_id, n, form, prefix, mid, _, back in rows_of(df):
        text = given_[doc_id][1]
        ends = [0, *(m.end() for m in pattern.finditer(text))]
        assert back == text and n == len(ends) - 1
        if form != "plain":
            assert prefix in ends and prefix + mid in ends
    with pytest.raises(ValueError):
        middle.unit_pattern(r"\w*")


def test_other_marks_and_empty_table(spark, empty):
    marks = ("[a.b]", "(c|d)", "$e")
    df = spark.createDataFrame([(i, "some text of some length") for i in range(40)], "doc_id long, text string")
    found = middle.transform(df, plain_percent=0, spm_percent=50, marks=marks)
    back = found.select("form", middle.restored(F.col("form"), F.col("output"), marks).alias("back")).collect()
    assert {r.form for r in back} == {"psm", "spm"} and {r.back for r in back} == {"some text of some length"}
    assert middle.transform(empty).count() == 0
