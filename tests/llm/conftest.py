import pytest

#: Nulls, empty and very long texts, ties, repeated rows; the extra columns have names that operators use inside or return.
EDGE = [
    (0, "the quick brown fox jumps over the lazy dog"),
    (1, None),
    (2, ""),
    (3, " \n\t \r\n "),
    (4, "The Quick brown fox jumps over the lazy dog"),
    (5, "one"),
    (6, "naïve café 漢字 \U0001f600 <|endoftext|> it's 12345   end"),
    (7, "word " * 40_000),
    (8, "long" * 30_000),
    (9, "the quick brown fox jumps over the lazy dog\n\nsecond line here\nsecond line here"),
    (9, "the quick brown fox jumps over the lazy dog\n\nsecond line here\nsecond line here"),
    (None, "a text without an id, with some words in it"),
    (None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "x", 1, "k", True, "n") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int, label string, kept boolean, h string").repartition(3)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
