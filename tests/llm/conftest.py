import pytest

CLASH = ("score", "kept", "start", "part", "digest", "key", "order", "label", "n", "found", "h1", "end", "n_words", "_gone", "_found", "dim", "v")


@pytest.fixture(scope="session")
def spark():
    from ledgerlens import session
    s = session.build(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"wort{k % 977} and{k % 31}" for k in range(60_000))
    rows = [(1, "The quick brown fox. " * 30, "en", "a", 1), (1, "The quick brown fox. " * 30, "en", "a", 1), (2, None, None, None, None),
            (3, "", "en", "b", 0), (None, "a text without an id but with a few words", "en", "b", 40), (4, long_text, "de", "b", len(long_text)),
            (5, "   \n\t  ", "fr", None, 7), (6, "x" * 300_000, "en", "c", 300_000), (7, "one", "en", "c", 3), (8, "one", "en", "c", 3),
            (1, "another text under the same id, longer than the others", "en", "a", 1), (9, "é ß Σ　日本 😀 <|endoftext|>\r\n  x", "xx", "q", 1),
            (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return docs.select("*", *(F.lit(7).alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r["doc_id"], r["text"]) for r in odd_docs.collect()]


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
