"""Each stage of the pipeline against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspan.llm.common import settled

from . import test_decontamination, test_line_dedup, test_lsh_forest


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = settled(stage(spark, docs, sf), name)
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "bpe"]
    assert all(stages[n].columns == stages["documents"].columns for n in ("quality", "lines", "near", "benchmark"))


def test_quality_keeps_rows_as_they_are(stages):
    assert 0 < stages["quality"].count() < stages["documents"].count()
    assert set(texts(stages["quality"])) <= set(texts(stages["documents"]))


def test_lines(stages):
    rows = texts(stages["quality"])
    assert sorted(texts(stages["lines"]), key=repr) == test_line_dedup.rebuilt(rows, test_line_dedup.all_pairs(rows))
    assert all(r.n_chars == len(r.text) for r in stages["lines"].collect())


def test_near(stages):
    rows = texts(stages["lines"])
    kept = {i for (i, _, _, keep), _ in test_lsh_forest.all_pairs(rows).items() if keep}
    assert texts(stages["near"]) == [r for r in rows if r[0] in kept]


def test_benchmark(spark, sf, stages):
    rows = texts(stages["near"])
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {p[0] for p in test_decontamination.all_pairs(rows, items)}
    assert bad and texts(stages["benchmark"]) == [r for r in rows if r[0] not in bad]


def test_bpe_and_run(spark, sf, stages):
    assert sorted(r.doc_id for r in stages["bpe"].collect()) == [i for i, _ in texts(stages["benchmark"])]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages["bpe"].collect()))


def test_odd_rows_pass(spark, sf, edge):
    """Nulls, empty texts and repeated rows go through every stage; one of two equal rows of an id stays."""
    docs = edge
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = settled(stage(spark, docs, sf), name)
    got = [r.doc_id for r in docs.collect()]
    assert got.count(1) == got.count(2) == got.count(3) == 1 and got.count(9) == 1


def test_any_column_names_and_empty_tables(spark, sf):
    """Names with dots and names that stages use inside come through every stage untouched, and so does a table without rows."""
    odd = ["meta.source", "__row", "row", "whole", "gone", "apart", "judged", "rest", "h", "nameless", "n_removed"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    docs = docs.toDF(*docs.columns).select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in odd])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settled(stage(spark, docs, sf), name)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in odd), name
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).collect() == []
