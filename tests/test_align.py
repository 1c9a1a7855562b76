import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.functions import align as A
from lexspan.functions.draws import numbered
from lexspan.operators import scoring as S


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def random_pairs(n, size=12, seed=3):
    rng = random.Random(seed)
    return [([rng.choice("abcd") for _ in range(rng.randint(0, size))], [rng.choice("abcde") for _ in range(rng.randint(0, size))]) for _ in range(n)]


def replay(ref, hyp, ops):
    i = j = 0
    for op in ops:
        if op in "ES":
            assert (ref[i] == hyp[j]) == (op == "E")
        i += op in "ESD"
        j += op in "ESI"
    assert (i, j) == (len(ref), len(hyp))


def test_alignment_is_optimal_and_consistent():
    pairs = random_pairs(400)
    for (r, h), ops in zip(pairs, A.align_words(pairs)):
        replay(r, h, ops)
        assert len(ops.replace("E", "")) == brute_distance(r, h)


def test_large_pairs_follow_the_same_rule():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (7, 30), (50, 41), (200, 230)]:
        r, h = rng.integers(0, 6, n), rng.integers(0, 6, m)
        assert A._ops_one(r, h) == A._ops_batch([r], [h])[0]


def test_tie_rule():
    assert A.align_words([(["a", "b", "c", "d", "e"], ["a", "c", "x", "e"]), ([], ["a"]), (["a"], []), ([], [])]) == ["EDESE", "I", "D", ""]


def test_native_distance_matches_brute_force(spark):
    pairs = random_pairs(300, 40, 5) + [([f"w{i}" for i in range(900)], [f"w{i * 2}" for i in range(700)])]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, r array<string>, h array<string>")
    got = {x["i"]: x["errors"] for x in A.with_edit_distance(df, F.col("r"), F.col("h")).collect()}
    assert got == {i: brute_distance(r, h) for i, (r, h) in enumerate(pairs)}


def test_chunks(spark):
    df = spark.createDataFrame([("EEDSSIE",), ("",)], "ops string").select(A.alignment_chunks(F.col("ops")).alias("c"))
    first, second = [r["c"] for r in df.collect()]
    assert [tuple(c) for c in first] == [
        ("equal", 0, 2, 0, 2), ("delete", 2, 3, 2, 2), ("substitute", 3, 5, 2, 4), ("insert", 5, 5, 4, 5), ("equal", 5, 6, 5, 6)]
    assert second == []


# a hypothesis that runs in circles, one that drops the beginning, one in the wrong script
CIRCLES = [
    ("फ़ाइल को save करके window बंद कीजिए", "फाइल को सेव करके विंडो बंद कीजिए", "फाइल को save करके save करके save करके save करके window"),
    ("loop के बाद print लिखिए", "लूप के बाद प्रिंट लिखिए लिखिए लिखिए लिखिए लिखिए", "के बाद print लिखिए"),
    ("यहाँ नया folder बनाइए", "यहाँ नया folder बनाइए", "yahan naya folder banaiye aur phir folder folder folder"),
]


def test_errors_per_word_of_looping_hypotheses(spark):
    rows = [(i, k, e[0], e[1 + k]) for i, e in enumerate(CIRCLES) for k in (0, 1)]
    df = S.word_errors(S.with_normalized(spark.createDataFrame(rows, "i int, k int, ref string, hyp string")))
    for r in df.collect():
        ref, hyp = r["nref"].split(), r["nhyp"].split()
        assert (r["errors"], r["ref_len"]) == (brute_distance(ref, hyp), len(ref))
    far = {(r["i"], r["k"]): r["errors"] / r["ref_len"] for r in df.collect()}
    assert far[0, 1] > 0.8 and far[1, 0] >= 1.0 and far[2, 0] == 0.0 and far[2, 1] > 1.5


def test_score_table_identity_and_edges(spark):
    rows = [
        ("m", "C0", "test", "u1", "open the file now", "open file now now", 3, None),
        ("m", "C0", "test", "u2", "", "extra words", None, None),
        ("m", "C1", "test", "u1", "", "", 5, True),
        ("m", "C1", "test", "u2", "", "x", 6, False),
    ]
    pairs = spark.createDataFrame(rows, "model string, cond string, split string, utt_id string, ref string, hyp string, prompt_tokens int, fallback boolean")
    vocab = S.keyword_vocabulary(spark.createDataFrame([("File Name",)], "keyword string"))
    out = {r["cond"]: r for r in S.score_table(pairs, vocab).collect()}
    c0 = out["C0"]
    assert (c0["k_n"], c0["u_n"], c0["lat_n"], c0["n"]) == (1, 3, 4, 2)
    total = c0["k_n"] + c0["u_n"]
    assert abs(c0["wer"] - (c0["k_wer"] * c0["k_n"] + c0["u_wer"] * c0["u_n"] + c0["ins_rate"] * total) / total) < 1e-12
    assert c0["fallback_rate"] is None and c0["mean_prompt_tokens"] == 1.5
    c1 = out["C1"]
    assert c1["wer"] is None and c1["k_wer"] is None and c1["ins_rate"] == 1.0 and c1["fallback_rate"] == 0.5


@pytest.mark.parametrize("held", [1, 1_000_000])
def test_words_are_counted_in_the_tasks(spark, monkeypatch, held):
    """Counts per word match brute force, however many a task holds, and no row per word is made for the shuffle."""
    monkeypatch.setattr(S, "COUNTED_WORDS", held)
    rng = random.Random(6)
    rows = [(f"C{i % 2}", " ".join(rng.choices("abcd", k=rng.randint(0, 9))), " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for i in range(60)]
    df = S.with_alignment(spark.createDataFrame(rows, "cond string, nref string, nhyp string"))
    found = S._step_counts(df, ["cond"], {"chars": F.length("nref")})
    want, sums = collections.Counter(), collections.defaultdict(lambda: np.zeros(4, int))
    for (c, r, h), ops in zip(rows, A.align_words([(r.split(), h.split()) for _, r, h in rows])):
        for w, step in zip(r.split(), ops.replace("I", "")):
            want[c, w, step != "E"] += 1
        sums[c] += [ops.count("I"), len(ops.replace("E", "")), len(r.split()), len(r)]
    got = found.collect()
    assert {(x["cond"], x["word"], x["wrong"]): x["n"] for x in got if x["word"] is not None} == dict(want)
    assert {x["cond"]: [x["n"], x["errors"], x["ref_words"], x["chars"]] for x in got if x["word"] is None} == {c: list(v) for c, v in sums.items()}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_segment_rollup(spark):
    df = spark.createDataFrame([([(-0.5, 1.0), (None, 2.0), (-1.5, None)],), ([(None, None)],), ([],)],
                               "s array<struct<avg_logprob:double,compression_ratio:double>>")
    lp, cr = S.segment_rollup(F.col("s"))
    assert [tuple(r) for r in df.select(lp, cr).collect()] == [(-1.0, 2.0), (None, None), (None, None)]


def test_distances_of_many_sizes_match_brute_force(monkeypatch):
    """Short, long and very long pairs at once, however the work is cut."""
    pairs = random_pairs(300) + random_pairs(60, 150, 2) + random_pairs(6, 700, 4) + [([], []), (["a"], []), ([], ["b"])]
    of = pa.list_(pa.string())
    codes = A._coded_words(pa.array([r for r, _ in pairs], of), pa.array([h for _, h in pairs], of))
    want = [brute_distance(r, h) for r, h in pairs]
    for lanes, masks, blocks, bits in [(1024, 1 << 20, 8, 16_384), (7, 4, 8, 16_384), (7, 1 << 18, 0, 50)]:
        for name, v in {"_LANES": lanes, "_MASKS": masks, "_BLOCKS": blocks, "_LONG_BITS": bits}.items():
            monkeypatch.setattr(A, name, v)
        assert A.distances(*codes).tolist() == want


def test_letters_and_words_of_columns(spark):
    rows = [(0, "naïve café", "naive cafe"), (1, "", "क ख"), (2, None, "x"), (3, "a" * 200 + "🙂", "a" * 190), (4, "eins zwei drei", "eins drei drei vier")]
    df = spark.createDataFrame(rows, "i int, r string, h string").select("i", A.word_distance("r", "h").alias("w"), A.letter_distance("r", "h").alias("c"))
    assert sorted(map(tuple, df.collect())) == [(0, 2, 2), (1, 2, 3), (2, None, None), (3, 1, 11), (4, 2, 7)]


def test_digests_of_numbered_places():
    prefixes = [b"00000001_000002-C0-", b"00000001_000002-C11-", b"x" * 53, b""]
    counts = np.array([1203, 11, 120, 3])
    want = [int(hashlib.md5(p + str(i).encode()).hexdigest()[:4], 16) for p, n in zip(prefixes, counts) for i in range(1, n + 1)]
    assert numbered(prefixes, counts).tolist() == want
