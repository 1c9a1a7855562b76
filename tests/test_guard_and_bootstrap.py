import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.functions.draws import draws
from lexspan.operators import bootstrap as B
from lexspan.operators import guard as G
from lexspan.plans.comparisons import near_normal


WORDS = " ".join("abcdefghijklmnop")


# at and just past each threshold: 0.25 of log probability, compression 2, one and a half times the words
@pytest.mark.parametrize("text,lp,cr,base,blp,want", [
    ("a b", -0.75, 1.0, "a b", -0.5, False),
    ("a b", -0.7501, 1.0, "a b", -0.5, True),
    ("a b", None, 1.0, "a b", -0.5, False),
    ("a b", -9.0, 1.0, "a b", None, False),
    ("a b", -0.5, 2.0, "a b", -0.5, False),
    ("a b", -0.5, 2.0001, "a b", -0.5, True),
    ("a b", -0.5, None, "a b", -0.5, False),
    (WORDS[:17], -0.5, 1.0, WORDS[:11], -0.5, False),
    (WORDS[:19], -0.5, 1.0, WORDS[:11], -0.5, True),
    (WORDS, -0.5, 1.0, " \t", -0.5, False),
    (WORDS, -0.5, 1.0, None, -0.5, False),
    (None, 0.5, 1.0, WORDS, -0.5, False),
])
def test_should_revert(spark, text, lp, cr, base, blp, want):
    df = spark.createDataFrame([(text, lp, cr, base, blp)], "t string, lp double, cr double, b string, bl double")
    assert df.select(G.should_revert(*[F.col(c) for c in ("t", "lp", "cr", "b", "bl")])).first()[0] is want


HYP = "utt_id string, hyp string, avg_logprob double, compression_ratio double, errors int, ref_len int"


def test_guard_without_baseline_keeps_the_hypothesis(spark):
    base = spark.createDataFrame([("a", "base", -0.1, 1.0, 1, 4)], HYP)
    prompted = spark.createDataFrame([("a", "x", -0.2, 9.0, 2, 4), ("b", "y", -0.2, 9.0, 3, 5)], HYP)
    out = {r["utt_id"]: (r["hyp"], r["fallback"]) for r in G.apply_guard(prompted, base).collect()}
    assert out == {"a": ("base", True), "b": ("y", False)}


def test_sweep_equals_guarding_every_cell(spark):
    rng = np.random.default_rng(0)
    make = lambda: spark.createDataFrame([
        (f"u{i}", " ".join(["w"] * int(rng.integers(0, 9))), None if i % 9 == 0 else float(-rng.random()), float(1 + 2 * rng.random()), int(rng.integers(0, 9)), 8)
        for i in range(120)], HYP)
    base, prompted = make().filter("utt_id <> 'u5'"), make()
    table = {r["cell"]: r for r in G.sweep_guard(prompted, base).collect()}
    assert len(table) == 36
    cells = G.config_grid(spark.range(1)).collect()
    errors = {r["utt_id"]: r["errors"] for r in base.collect()}
    for c in (cells[0], cells[17], cells[35]):
        rows = G.apply_guard(prompted, base, c["d_logprob"], c["max_cr"], c["len_ratio"]).collect()
        e = sum(errors[r["utt_id"]] if r["fallback"] else r["errors"] for r in rows)
        assert table[c["cell"]]["wer"] == pytest.approx(e / sum(r["ref_len"] for r in rows))
        assert table[c["cell"]]["fallback_rate"] == pytest.approx(sum(r["fallback"] for r in rows) / len(rows))


def test_first_of_equal_cells_wins(spark):
    t = spark.createDataFrame([(2, 0.5), (1, 0.5), (3, 0.7)], "cell int, wer double")
    assert G.best_config(t, ["cell"]).first()["cell"] == 1


def test_final_spans_without_an_index(spark):
    span = spark.createDataFrame([(1, 0, 0.0, 25.0, "base", -0.1, 1.0), (2, 0, 0.0, 25.0, "base", -0.1, 1.0)],
                                 "lecture_id int, index int, start_s double, end_s double, text string, avg_logprob double, compression_ratio double")
    cond = spark.createDataFrame([(1, 0, "better", -0.1, 1.1, 7, ["u1"])],
                                 "lecture_id int, index int, text string, avg_logprob double, compression_ratio double, prompt_tokens int, retrieved_unit_ids array<string>")
    out = {r["lecture_id"]: r for r in G.final_spans(span, cond).collect()}
    assert out[1]["text"] == "better" and out[1]["retrieved_unit_ids"] == ["u1"] and out[1]["compression_ratio"] == 1.1
    assert out[2]["text"] == "base" and out[2]["retrieved_unit_ids"] == [] and out[2]["safeguard_fallback"] is False


def pairs(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("a->b", f"00000001_{i:06d}", int(rng.integers(0, 6)), int(rng.integers(0, 5)), int(rng.integers(1, 20))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "contrast string, utt_id string, e_a int, e_b int, n int")


def numpy_bootstrap(rows, n_boot, seed=9):
    a, b, n = (np.array([r[k] for r in rows], float) for k in (2, 3, 4))
    idx = np.random.default_rng(seed).integers(0, len(n), (n_boot, len(n)))
    bs = (b[idx].sum(1) - a[idx].sum(1)) / n[idx].sum(1)
    d = b / n - a / n
    return b.sum() / n.sum() - a.sum() / n.sum(), np.percentile(bs, [2.5, 97.5]), d.mean(), np.percentile(d[idx].mean(1), [2.5, 97.5])


@pytest.mark.parametrize("form", ["hash", "class"])
def test_bootstrap_forms_agree_with_numpy(spark, form):
    rows, df = pairs(spark)
    r = B.bootstrap_by_hash(df, 1000).first() if form == "hash" else B.bootstrap_by_class(df, 4000).first()
    delta, ci, macro, mci = numpy_bootstrap(rows, 4000)
    assert r["corpus_delta"] == pytest.approx(delta, abs=1e-8) and r["macro_delta"] == pytest.approx(macro, abs=1e-8)
    width = ci[1] - ci[0]
    assert abs(r["ci_low"] - ci[0]) < 0.12 * width and abs(r["ci_high"] - ci[1]) < 0.12 * width
    assert abs(r["macro_ci_low"] - mci[0]) < 0.12 * (mci[1] - mci[0])


def test_outcomes_count_every_row(spark):
    _, df = pairs(spark, 300)
    c = sorted(B.outcome_classes(df).collect(), key=lambda r: r["before"])
    assert sum(r["rows"] for r in c) == 300 == c[0]["size"] and len(c) < 300
    assert [r["before"] for r in c] == [sum(x["rows"] for x in c[:i]) for i in range(len(c))]


def test_bootstrap_is_repeatable(spark):
    _, df = pairs(spark, 80)
    assert B.bootstrap_by_class(df, 200, chunk=64).first() == B.bootstrap_by_class(df.repartition(5), 200, chunk=64).first()


def test_contrasts_leave_out_unscored_sides(spark):
    df = spark.createDataFrame([("C0", "u", 1, 4), ("C4", "u", 2, 4), ("C0", "v", 1, 3), ("C2", "v", 0, 3)], "cond string, utt_id string, errors int, ref_len int")
    got = {tuple(r) for r in B.contrast_pairs(df).collect()}
    assert got == {("C0->C4", "u", 1, 4, 2), ("C0->C2", "v", 1, 3, 0)}


def test_pairs_are_scored_once_for_intervals_and_their_check(spark):
    """Both are read off the outcomes: before, the check of the intervals scored all pairs again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("C0->C1", f"u{i}", i % 3, 5 + i % 7, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "contrast string, utt_id string, e_a int, n int, e_b int")
    got = near_normal(df.mapInArrow(counted, df.schema)).collect()
    assert len(got) == 1 and all(got[0][c] for c in got[0].asDict() if c.endswith("near"))
    assert seen.value == 400


def test_two_scores_of_a_condition_are_an_error(spark):
    df = spark.createDataFrame([("C0", "u", 1, 4), ("C0", "u", 2, 4), ("C1", "u", 2, 4)], "cond string, utt_id string, errors int, ref_len int")
    with pytest.raises(Exception, match="several scores of a condition"):
        B.contrast_pairs(df, [("C0", "C1")]).collect()


def test_contrast_pairs_carry_further_columns_of_the_baseline(spark):
    """Model and split come along with the pairs: no second scan of the scores tells them."""
    rows = [("C0", "u", 1, 4, "m", "dev"), ("C1", "u", 2, 4, "m", "dev"), ("C0", "v", 0, 3, "n", "test"), ("C1", "v", 3, 3, "n", "test")]
    df = spark.createDataFrame(rows, "cond string, utt_id string, errors int, ref_len int, model string, split string")
    got = B.contrast_pairs(df, [("C0", "C1")], also=["model", "split"])
    assert sorted(map(tuple, got.collect())) == [("C0->C1", "u", 1, 4, 2, "m", "dev"), ("C0->C1", "v", 0, 3, 3, "n", "test")]


def test_wins_and_losses(spark):
    df = spark.createDataFrame([(f"u{i}", float(i % 5), 1, 2, 3) for i in range(10)], "utt_id string, delta double, e_a int, e_b int, ref_len int")
    out = B.wins_and_losses(df, 2).collect()
    assert [(r["side"], r["utt_id"]) for r in out] == [("win", "u0"), ("win", "u5"), ("loss", "u9"), ("loss", "u4")]


def test_decode_settings_take_the_language_first(spark):
    rows = [("C0", "hi", 1, 120, 5, 10), ("C0", "auto", 1, 120, 5, 10), ("C4", "hi", 2, 120, 4, 10), ("C4", "hi", 1, 200, 4, 10), ("C4", "auto", 1, 120, 0, 10)]
    got = G.decode_settings(spark.createDataFrame(rows, "cond string, lang string, k int, cap int, errors int, ref_len int"), ["hi", "auto"], [1, 2, 3], [120, 200]).collect()
    assert [tuple(r) for r in got] == [("hi", 0.5, 1, 200, 0.4)]


def test_contrasts_in_one_pass_equal_each_by_itself(spark):
    """Contrasts of equal and of other sizes, one of the list without pairs."""
    rng = np.random.default_rng(2)
    rows = [(c, f"u{i:04d}", int(rng.integers(0, 6)), int(rng.integers(1, 20)), int(rng.integers(0, 5))) for c, n in (("a->b", 90), ("a->c", 90), ("b->c", 37)) for i in range(n)]
    df = spark.createDataFrame(rows, "contrast string, utt_id string, e_a int, n int, e_b int")
    together = B.bootstrap_contrasts(df, ["a->b", "a->c", "b->c", "x->y"], 300)
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, B.bootstrap_by_hash(df, 300).collect()))
    assert B.bootstrap_contrasts(df.limit(0), ["a->b"], 20).collect() == []


def test_draws_are_the_parts_of_each_digest():
    for size, rep in ((1, 0), (5, 3), (4001, 9999), (50_003, 123)):
        want = []
        for q in range((size + 3) // 4):
            digest = hashlib.md5(f"1337-{rep}-{q}".encode()).hexdigest()
            want += [int(digest[8 * i : 8 * i + 8], 16) % size for i in range(4)]
        assert draws(1337, rep, size).tolist() == want[:size]


def test_no_draw_or_place_becomes_a_row(spark):
    """Broadcast places of a table of 2 million pairs were more than the driver holds."""
    _, df = pairs(spark, 40)
    for out in (B.bootstrap_by_hash(df, 20), B.bootstrap_contrasts(df, [df.first()["contrast"]], 20)):
        plan = out._jdf.queryExecution().toString()
        assert "place" not in plan and "md5" not in plan
