"""Rows whose id is null or shared are documents of their own."""

from collections import Counter

import pytest

import corpus_pipeline
from lexspan.llm.decontamination import contaminated
from lexspan.llm.line_dedup import dedup_lines, op8_line_dedup

PASSAGE = " ".join(f"w{i}" for i in range(40))
LONG = [f"t{i}" for i in range(120)]
ROWS = [
    (None, "first of a\nnothing else has this\na shared line of words"),
    (None, "first of b\nunlike any other\na shared line of words\nnor this one"),
    (None, "copies of one line"),
    (None, "copies of one line"),
    (None, "copies of one line"),
    (None, None),
    (None, None),
    (7, "seven begins\nits own second line"),
    (7, "another seven\nthe second of another\nits own second line"),
    (8, "its own second line\nmore"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n_chars long").repartition(3)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_lines(spark, df):
    got = texts(dedup_lines(df))
    assert got[None, "copies of one line"] == 1 and got[None, None] == 2
    left = Counter(line for (_, t), n in got.items() for line in (t or "").split("\n") * n)
    # each line with words is there once
    assert left == Counter({x for _, t in ROWS if t for x in t.split("\n")}) + Counter({"": 2})
    assert got[8, "more"] == 1


def test_query_counts_copies(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, op8_line_dedup(spark, str(tmp_path)).collect()))
    assert sum(got.values()) == len(ROWS)
    assert got[None, 1, 0, 0, ""] == 1 and got[None, 1, 1, 1, "0"] == 2 and got[None, 0, 0, 0, ""] == 2
    assert sum(r[2] * n for r, n in got.items()) == 2 + 1 + 2


def test_near(spark, df):
    near = lambda k: " ".join([*LONG[:k], "other", *LONG[k + 1 :]])
    rows = [(None, near(5)), (None, near(60)), (None, near(60)), (None, "a different text, kept as it is"), (None, None), (None, ""), (None, ""), (3, near(10)), (3, "three is another text too"), (2, near(90)), (2, near(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = texts(corpus_pipeline.near(spark, docs, ""))
    assert sum(n for (i, t), n in got.items() if t and t.startswith("t0")) == 1
    assert {i for i, t in got if t and t.startswith("t0")} == {2}
    assert got - Counter({k: n for k, n in got.items() if k[0] == 2}) == Counter({(None, "a different text, kept as it is"): 1, (None, None): 1, (None, ""): 2, (3, "three is another text too"): 1})
    only = texts(corpus_pipeline.near(spark, docs.where("doc_id IS NULL"), ""))
    assert sum(n for (_, t), n in only.items() if t and t.startswith("t0")) == 1


def test_benchmark(spark, tmp_path):
    rows = [(None, "x " + PASSAGE + " y"), (None, "clean"), (4, PASSAGE), (4, "also clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id, r.n_shared) for r in contaminated(docs, items).collect()) == {(None, 1, 36): 1, (4, 1, 36): 1}
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert texts(corpus_pipeline.benchmark(spark, docs, str(tmp_path))) == {(None, "clean"): 1, (4, "also clean"): 1}
