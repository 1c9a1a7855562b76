"""Language-model scores: the base by hand, the model by what it must be."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from lexspan.llm import maxent
from lexspan.llm.maxent import op6_maxent_lm, score_texts

from .conftest import EDGE


def by_hand(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def same(rows, want):
    key = lambda r: repr((r[:5], round(r[5], 3)))
    got = sorted((tuple(r)[:6] for r in rows), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_edge_cases(edge):
    rows = score_texts(edge, rounds=2).collect()
    same(rows, by_hand(EDGE))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert score_texts(edge.limit(0)).collect() == []


def test_only_held_out_texts(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "a b c") for i in held]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)} and all(r.score <= 0 for r in got)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 50, 700)
    h = np.sort(rng.choice(10**6, 700, replace=False))
    order = np.argsort(-n, kind="stable")
    place = np.empty(maxent.TOP, np.int64)
    top = order[: maxent.TOP]
    by_hash = np.argsort(h[top])
    place = by_hash
    other = rng.integers(0, maxent.OTHER, 700).astype(np.int8)
    totals = np.ones(maxent.OTHER)
    for i in order[maxent.TOP :]:
        totals[other[i]] += n[i] + 1
    model = maxent.Model(h[top][by_hash], place, totals, rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32), rng.normal(size=(maxent.INNER, maxent.MEMBERS)).astype(np.float32))
    # every word, and an unknown one of each class, after the same two words
    words = np.concatenate([h, np.full(maxent.OTHER, -5)])
    classes = np.concatenate([other, np.arange(maxent.OTHER)]).astype(np.int8)
    counts = np.concatenate([n, np.zeros(maxent.OTHER, np.int64)])
    codes = np.stack([np.full(len(words), 3), np.full(len(words), maxent.TOP + 2), model.coded(words, classes)], axis=1).ravel()
    logs = maxent.log10_probabilities(model, codes, np.repeat(np.arange(len(words)) * 3, 3), np.repeat(counts, 3))
    assert abs((10 ** logs[2::3]).sum() - 1) < 1e-4


def test_learns_context(spark):
    """Two languages, told apart by the word before: the model must beat counts on held-out texts."""
    random.seed(2)
    sides = [[f"{c}{i}" for i in range(60)] for c in "xy"]
    rows = [(i, " ".join(random.choice(sides[i % 2]) for _ in range(300))) for i in range(1000)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.15  # log10(2) = 0.30 at most


def test_rare_features_keep_their_moves(spark):
    """What one task alone has seen moves as far as if there were no other tasks."""
    rare, other = ["r1", "r2", "r3"], ["o1", "o2", "o3"]
    texts = [" ".join(rare * 40)] + [" ".join(other * 40)] * 7
    words = sorted((maxent.hashed([w.encode()])[0][0], i) for i, w in enumerate(rare + other))
    zeros = lambda: (np.zeros((maxent.ROWS, maxent.CLASSES), np.float32), np.zeros((maxent.INNER, maxent.MEMBERS), np.float32))
    model = maxent.Model(np.array([w for w, _ in words]), np.array([i for _, i in words]), np.ones(maxent.OTHER), *zeros())
    ones = tuple(x + 1 for x in zeros())
    moved = lambda rows: maxent._round(model, ones, spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in rows], len(rows)), "text string"))[0].outer
    alone, together = moved(texts[:1]), moved(texts)
    assert np.abs(alone[1]).max() > 0.1
    np.testing.assert_allclose(together[1:4], alone[1:4], rtol=1e-5)  # the words before: r1, r2, r3


def test_query(spark, sf, documents):
    rows = op6_maxent_lm(spark, sf).collect()
    same(rows, by_hand(documents))
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_small_partitions_share_tasks(spark):
    """A round has no more tasks than the texts ask for, and tokens are those of bytes.split()."""
    import pyarrow as pa

    assert maxent.few_tasks(spark.range(1000).repartition(211), 12).rdd.getNumPartitions() == 12
    texts = ["  Foo bar\x0b\x0cB  ", "", None, "x", " \n ", "É A\x1cb c \u0085d\n", "İI"]
    flat, sizes = maxent._tokens(pa.record_batch({"text": pa.array(texts)}))
    want = [[*(t or "").encode().lower().split(), b""] for t in texts]
    assert flat.cast(pa.binary()).to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    h, other, at = maxent.hashed(flat)
    assert [maxent.zlib.crc32(w[-3:]) % maxent.OTHER for t in want for w in t] == other[at].tolist()
