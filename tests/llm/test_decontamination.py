"""Containment search against all pairs."""

from lexspan.llm.decontamination import contaminated, op2_benchmark_containment, partition_of

from .conftest import EDGE


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def all_pairs(docs, items, least=0.75):
    out, sets = {}, {}
    for d, t in docs:
        if d is not None:
            sets[d] = sets.get(d, set()) | grams(t)
    for i, t in items:
        g = grams(t)
        for d, s in sets.items():
            if i is not None and g and len(g & s) >= least * len(g):
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (len(g & s) / len(g), len(g & s), len(g)))
    return {(d, i, n, k) for (d, i), (_, k, n) in out.items()}


def rows(df):
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in df.collect()}


def test_edge_cases(spark, edge):
    passage = " ".join(f"w{i}" for i in range(70))
    docs = [*EDGE, (20, "x " * 20_000 + passage + " y" * 20_000), (21, passage[: len(passage) // 2]), (22, "Z " + passage.replace("w40", "other")), (23, "one two three")]
    items = [(0, passage), (0, passage), (1, "the QUICK brown fox jumps over"), (2, None), (3, ""), (None, passage), (4, "one"), (5, "one two three"), (6, "word " * 9), (7, passage[10:60]), (1, "quite another text of the same number")]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, part string").repartition(3)
    b = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, grams double")
    assert rows(contaminated(d, b)) == all_pairs(docs, items)
    assert (20, 0, 66, 66) in rows(contaminated(d, b)) and (22, 0, 66, 61) in rows(contaminated(d, b))
    assert rows(contaminated(edge.limit(0), b)) == rows(contaminated(d, b.limit(0))) == set()


def test_partitions():
    assert [partition_of(n) for n in (1, 8, 9, 16, 17, 1000)] == [8, 8, 16, 16, 32, 1024]


def test_query(spark, sf, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = all_pairs(documents, items)
    assert want and rows(op2_benchmark_containment(spark, sf)) == want
