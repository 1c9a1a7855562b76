"""Near-duplicates against all pairs."""

import random
from collections import Counter

import pyarrow as pa
import numpy as np

from lexspan.llm import lsh_forest
from lexspan.llm.components import components
from lexspan.llm.lsh_forest import near_duplicates, op10_lsh_forest

from .conftest import EDGE


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})


def all_pairs(rows):
    """By row: (doc_id, n_shingles, component_id, kept)."""
    sets = [(i, grams(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, s) in enumerate(sets):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return Counter((i, len(s), least.get(root(n)) if s else i, i == (least.get(root(n)) if s else i)) for n, (i, s) in enumerate(sets))


def test_edge_cases(spark, edge):
    assert Counter(map(tuple, near_duplicates(edge).collect())) == all_pairs(EDGE)
    assert near_duplicates(edge.limit(0)).collect() == []


def test_groups(spark):
    random.seed(7)
    word = lambda: random.choice("abcdefgh") + str(random.randrange(3000))
    rows = []
    for size in (1, 1, 2, 3, 5, 60):
        base = [word() for _ in range(120)]
        for _ in range(size):
            t = list(base)
            for _ in range(random.randrange(4)):
                t[random.randrange(len(t))] = word()
            rows.append(" ".join(t))
    common = " ".join(word() for _ in range(20))  # a passage that unlike texts share
    rows += [common + " " + " ".join(word() for _ in range(90)) for _ in range(80)]
    rows += [rows[0]] * 40
    random.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter(map(tuple, near_duplicates(df).collect())) == all_pairs(rows)


def test_star_keeps_every_link(spark):
    """Variants linked to one base and hardly to each other: none is lost, however many stand between it and the base."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(base)]
    for n in range(2500):
        t = list(base)
        for at in rng.choice(200, 5, replace=False):
            t[at] = f"x{n}y{at}"
        rows.append(" ".join(t))
    whole = grams(rows[0])
    linked = {i for i, t in enumerate(rows) if 100 * len(whole & grams(t)) >= 75 * len(whole | grams(t))}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert len(linked) > 1000 and {i for i in linked if got[i] != 0} == set()


def test_neighbours_look_past_unlike_rows():
    n = 6
    rng = np.random.default_rng(0)
    own, other = rng.bytes(lsh_forest.BIT_SKETCH), rng.bytes(lsh_forest.BIT_SKETCH)
    key = b"\0" * lsh_forest.KEY
    table = pa.table({"tree": pa.array([0] * n, pa.int32()), "key": [key] * n, "digest": [bytes([i]) * 16 for i in range(n)], "sketch": [own, other, own, other, other, own], "label": [bytes([i]) * 16 for i in range(n)]})
    i, j = lsh_forest.pairs_within(table, 0, every=False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 2), (1, 3), (2, 5), (3, 4)]
    i, j = lsh_forest.pairs_within(table, 5, every=False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(2, 5)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {"x": "x", "y": "x"}
    assert components(links.limit(0)).collect() == []


def test_query(spark, sf, documents):
    assert Counter(map(tuple, op10_lsh_forest(spark, sf).collect())) == all_pairs(documents)


def test_pairs_of_crowds_stay_inside_blocks(spark):
    """Copies of one text that are alike but not linked: full sets are compared in their blocks, so no table of pairs arises, and the links among them are found."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(300):
        t = list(base)
        for at in rng.choice(150, 4, replace=False):
            t[at] = f"x{n}y{at}"
        rows.append(" ".join(t))
    rows += [rows[7] + " more", rows[200] + " words"]
    want = all_pairs(list(enumerate(rows)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, near_duplicates(df).collect())) == want
    sets = [np.sort(np.array([hash(g) for g in grams(t)], np.int64)) for t in rows]
    labels = [bytes([i % 256, i // 256]) * 8 for i in range(len(rows))]
    table = pa.table({"digest": labels + labels, "label": labels + labels, "asks": [False] * len(rows) + [True] * len(rows), "grams": pa.array([x.tolist() for x in sets + sets], pa.list_(pa.int64()))})
    found = lsh_forest.linked_sets(table)
    got = set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    of = [set(x.tolist()) for x in sets]
    assert got == {(min(labels[i], labels[j]), max(labels[i], labels[j])) for i in range(len(rows)) for j in range(i) if 100 * len(of[i] & of[j]) >= 75 * len(of[i] | of[j])}
    # in a full region each row is paired once before the region is searched whole, not with all 32 behind it
    n = 100
    rows = pa.table({"tree": pa.array([0] * n, pa.int32()), "key": [b"\0" * lsh_forest.KEY] * n, "digest": [bytes([i]) * 16 for i in range(n)], "sketch": [b"\1" * lsh_forest.BYTE_SKETCH] * n, "label": [bytes([i]) * 16 for i in range(n)]})
    assert len(lsh_forest.pairs_within(rows, 0, every=True)[0]) == n - 1
