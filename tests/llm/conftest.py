import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The small documents table, and it as a list of (doc_id, text) in id order."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows, ids out of order."""
    long_text = "The thing of that and the other to be in it was for with. " * 2500 + "end\n"
    same = "The same words of the text and the words that it repeats to the end of it."
    return [
        (7, same, "en", "a", len(same)),
        (7, same, "en", "a", len(same)),
        (3, same, "en", None, None),
        (9, None, None, "b", None),
        (None, same + " and more", "en", "b", 3),
        (None, None, None, None, None),
        (1, "", "fr", "a", 0),
        (2, " \t\n ", "fr", "a", 4),
        (-5, long_text, "en", "c", len(long_text)),
        (8, "x" * 3000, "de", "c", 3000),
        (11, "Ünïcode \U0001f600 　 text\x00 end  ", "de", "c", 1),
        (12, "+1 (663) 555-6869 or 4539148803436467 on 1985-02-28", "en", "c", 51),
    ]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The rows with extra columns that carry names the operators use themselves."""
    rows = [(*r, "extra", 1, 2.0) for r in hard_rows]
    return spark.createDataFrame(rows, DOCUMENTS + ", fp string, bucket int, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
