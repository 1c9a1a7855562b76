"""The ordinal classifier: what it learns, and odd rows."""

import random

import numpy as np
import pytest

from lexspan.llm.ordinal import classify, features, fit, graded, op9_ordinal_quality, train

from .conftest import EDGE


def corpus(n, seed):
    """Texts of three grades: rows of one word, texts with a bad word, plain ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        g = i % 3
        t = [r.choice(words) for _ in range(80)]
        if g == 0:
            t = [r.choice(words)] * 80
        if g == 1:
            t[r.randrange(80)] = r.choice(["vile", "nasty", "foul"])
        out.append((i, " ".join(t), g))
    return out


def test_held_out_accuracy():
    rows, later = corpus(1500, 1), corpus(600, 2)
    model = fit([features(t) for _, t, _ in rows], np.array([g for *_, g in rows]), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    p = model.probabilities(np.array([model.weights[features(t)].sum() for _, t, _ in later]))
    assert (np.diff(p, axis=1) <= 0).all()
    grade = p.sum(axis=1)
    y = np.array([g for *_, g in later])
    assert ((grade > 1.5) == (y == 2)).mean() > 0.95 and ((grade < 0.5) == (y == 0)).mean() > 0.95


def test_edge_cases(spark, edge):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 1, 1), (2, None, None), (None, 1, 0), (9, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(edge, graded(labels), 3)
    got = classify(edge, model).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in EDGE)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert classify(edge.limit(0), model).collect() == []
    blank = train(edge, graded(labels.limit(0)), 3)
    assert all((r.expected_grade, r.tail_probability) == (pytest.approx(1.0), pytest.approx(1 / 3)) for r in classify(edge, blank).collect())


def test_sample_is_bounded(spark):
    rows = corpus(90, 3)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    a, b = train(df, ratings, 3, sample=40), train(df.repartition(5), ratings.repartition(4), 3, sample=40)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_query(spark, sf, documents):
    got = op9_ordinal_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in documents)
    labels = {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [r.kept for r in got if labels.get(r.doc_id) == (1, 0)]
    junk = [r.kept for r in got if labels.get(r.doc_id, (1, 0))[0] == 0]
    assert np.mean(clean) > 0.9 and np.mean(junk) < 0.3
