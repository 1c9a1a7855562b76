"""Guard, sweep, bootstrap and error-review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.operators import bootstrap as B
from lexspan.operators import guard as G
from lexspan.operators import quality as Q
from lexspan.operators import scoring as S
from lexspan.plans.base import (
    HYPS, hypotheses, nhyps_sql, norm_sql, query, table, tokens_sql, with_, word_distance_sql, words_sql,
)
from lexspan.plans.texts import SCORES, vocabulary
from lexspan.session import durable

FIRES = f"""coalesce(p.avg_logprob < b.avg_logprob - 0.25::DOUBLE, false) OR coalesce(p.compression_ratio > 2.0::DOUBLE, false)
    OR coalesce(len({tokens_sql('b.hyp')}) > 0 AND len({tokens_sql('p.hyp')}) > 1.5::DOUBLE * len({tokens_sql('b.hyp')}), false)"""
# the baseline lost some of its rows
BASE = "base_ AS (SELECT * FROM hyps WHERE cond = 'C0' AND length(ref) % 31 <> 0), prompted AS (SELECT * FROM hyps WHERE cond = 'C4')"


def base_and_prompted(spark, sf):
    base = hypotheses(spark, sf, ("C0",)).filter(F.length("ref") % 31 != 0)
    return base, hypotheses(spark, sf, ("C4",))


@query("flt3_should_revert", with_(HYPS, body=f"SELECT p.utt_id, {FIRES} AS revert FROM hyps p JOIN hyps b USING (utt_id) WHERE p.cond = 'C4' AND b.cond = 'C0'"))
def flt3(spark, sf):
    b = hypotheses(spark, sf, ("C0",)).select("utt_id", F.col("hyp").alias("bh"), F.col("avg_logprob").alias("bl"))
    p = hypotheses(spark, sf, ("C4",)).join(b, "utt_id")
    return p.select("utt_id", G.should_revert(F.col("hyp"), F.col("avg_logprob"), F.col("compression_ratio"), F.col("bh"), F.col("bl")).alias("revert"))


@query("jn2_apply_guard", with_(HYPS, BASE, f"j AS (SELECT p.utt_id, p.hyp, b.hyp AS bh, b.utt_id IS NOT NULL AND ({FIRES}) AS fallback FROM prompted p LEFT JOIN base_ b ON p.utt_id = b.utt_id)",
                                body="SELECT utt_id, CASE WHEN fallback THEN bh ELSE hyp END AS hyp, fallback FROM j"))
def jn2(spark, sf):
    base, prompted = base_and_prompted(spark, sf)
    return G.apply_guard(prompted, base).select("utt_id", "hyp", "fallback")


# conversation turns as spans; some were never conditioned
SPAN_PASSES = f"""b_ AS (SELECT conv_id AS lecture_id, turn AS index, turn * 25.0::DOUBLE AS start_s, turn * 25.0::DOUBLE + 25 AS end_s, text, -(length(text) % 100) / 100.0::DOUBLE AS avg_logprob,
    CASE WHEN length(text) % 9 <> 0 THEN 1 + (length(text) % 50) / 40.0::DOUBLE END AS compression_ratio FROM conversations),
c_ AS (SELECT lecture_id, index, CASE WHEN length(text) % 6 = 0 THEN text || ' ' || text ELSE reverse(text) END AS text, avg_logprob - (length(text) % 40) / 100.0::DOUBLE AS avg_logprob,
    compression_ratio - 0.2::DOUBLE AS compression_ratio, (length(text) % 200)::INT AS prompt_tokens, ['u' || index, 'u' || (index + 1)] AS retrieved_unit_ids FROM b_ WHERE lecture_id % 4 <> 0),
j_ AS (SELECT b.*, p.lecture_id IS NOT NULL AS has, p.text AS ct, p.avg_logprob AS cl, p.compression_ratio AS cc, p.prompt_tokens, p.retrieved_unit_ids,
    p.lecture_id IS NOT NULL AND (coalesce(p.avg_logprob < b.avg_logprob - 0.25::DOUBLE, false) OR coalesce(p.compression_ratio > 2.0::DOUBLE, false)
      OR coalesce(len({tokens_sql('b.text')}) > 0 AND len({tokens_sql('p.text')}) > 1.5::DOUBLE * len({tokens_sql('b.text')}), false)) AS rev
  FROM b_ b LEFT JOIN c_ p USING (lecture_id, index)),
final_ AS (SELECT lecture_id, index, start_s, end_s, CASE WHEN has AND NOT rev THEN ct ELSE text END AS text, text AS baseline_text,
    coalesce(array_to_string(retrieved_unit_ids, '|'), '') AS retrieved_unit_ids, coalesce(prompt_tokens, 0) AS prompt_tokens,
    CASE WHEN has THEN cl ELSE avg_logprob END AS avg_logprob, CASE WHEN has THEN cc ELSE compression_ratio END AS compression_ratio, rev AS safeguard_fallback, has FROM j_)"""


def span_passes(spark, sf):
    n = F.length("text")
    base = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("lecture_id"), F.col("turn").alias("index"), (F.col("turn") * 25.0).alias("start_s"), (F.col("turn") * 25.0 + 25).alias("end_s"), "text",
        (-(n % 100) / 100.0).alias("avg_logprob"), F.when(n % 9 != 0, 1 + (n % 50) / 40.0).alias("compression_ratio"))
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    cond = base.filter("lecture_id % 4 <> 0").select(
        "lecture_id", "index", F.when(n % 6 == 0, F.concat_ws(" ", "text", "text")).otherwise(F.reverse("text")).alias("text"),
        (F.col("avg_logprob") - (n % 40) / 100.0).alias("avg_logprob"), (F.col("compression_ratio") - 0.2).alias("compression_ratio"),
        (n % 200).cast("int").alias("prompt_tokens"), F.array(u(F.col("index")), u(F.col("index") + 1)).alias("retrieved_unit_ids"))
    return base, cond


@query("prj1_final_text", with_(SPAN_PASSES, body="SELECT * EXCLUDE (has) FROM final_ WHERE has"))
def prj1(spark, sf):
    base, cond = span_passes(spark, sf)
    kept = base.join(cond.select("lecture_id", "index"), ["lecture_id", "index"], "left_semi")
    return G.final_spans(kept, cond).withColumn("retrieved_unit_ids", F.array_join("retrieved_unit_ids", "|"))


@query("prj2_no_index_branch", with_(SPAN_PASSES, body="SELECT * EXCLUDE (has) FROM final_"))
def prj2(spark, sf):
    return G.final_spans(*span_passes(spark, sf)).withColumn("retrieved_unit_ids", F.array_join("retrieved_unit_ids", "|"))


@query("agg8_lecture_stats", with_(SPAN_PASSES, f"""tok_ AS (SELECT lecture_id, has, safeguard_fallback, start_s, end_s, index, {{words}} AS w FROM final_),
agg_ AS (SELECT lecture_id, count(*) AS n_spans, bool_or(has) AS conditioned, sum(safeguard_fallback::INT)::BIGINT AS fb, max(end_s) AS dur, sum(len(w)) AS t,
  sum(len(list_filter(w, lambda x: regexp_matches(x, '[a-z]')))) AS l FROM tok_ GROUP BY lecture_id)""".replace("{words}", words_sql(norm_sql("text"))),
    body="""SELECT lecture_id, n_spans, round_even(dur / greatest(1, n_spans), 2) AS mean_span_s, conditioned, fb AS safeguard_fallbacks,
      round_even(fb::DOUBLE / greatest(1, n_spans), 4) AS safeguard_fallback_rate, 0.0::DOUBLE AS dev, CASE WHEN t > 0 THEN round_even(l::DOUBLE / t, 4) ELSE 0 END AS lat,
      CASE WHEN t > 0 THEN round_even((t - l)::DOUBLE / t, 4) ELSE 0 END AS other FROM agg_"""))
def agg8(spark, sf):
    base, cond = span_passes(spark, sf)
    marked = cond.select("lecture_id").distinct().withColumn("conditioned", F.lit(True))
    final = G.final_spans(base, cond).join(marked, "lecture_id", "left").withColumn("conditioned", F.coalesce("conditioned", F.lit(False)))
    durations = base.groupBy("lecture_id").agg(F.max("end_s").alias("duration_s"))
    return S.lecture_stats(final, durations)


# --- sweeps ------------------------------------------------------------------------
SCORED = HYPS + ",\n" + nhyps_sql() + f""",
scored_ AS ({word_distance_sql('nh')}),
scored AS (SELECT model, cond, utt_id, hyp, avg_logprob, compression_ratio, errors::INT AS errors, len(r)::INT AS ref_len, split FROM scored_)"""
GRID = """grid AS (SELECT (row_number() OVER () - 1)::INT AS cell, d AS d_logprob, c AS max_cr, l AS len_ratio FROM
  (SELECT d, c, l FROM (VALUES (0, 0.05::DOUBLE), (1, 0.10), (2, 0.15), (3, 0.25)) a(i, d), (VALUES (0, 2.0::DOUBLE), (1, 2.4), (2, 100.0)) b(j, c), (VALUES (0, 1.5::DOUBLE), (1, 2.0), (2, 100.0)) e(k, l) ORDER BY i, j, k))"""
SWEEP = SCORED + ",\n" + GRID + f""",
pair_ AS (SELECT p.*, b.errors AS be, b.avg_logprob AS bl, len({tokens_sql('b.hyp')}) AS bw, len({tokens_sql('p.hyp')}) AS pw FROM scored p JOIN scored b USING (utt_id) WHERE p.cond = 'C4' AND b.cond = 'C0'),
cells_ AS (SELECT grid.*, p.errors, p.be, p.ref_len, coalesce(p.avg_logprob < p.bl - d_logprob, false) OR coalesce(p.compression_ratio > max_cr, false) OR (bw > 0 AND pw > len_ratio * bw) AS rev FROM pair_ p, grid),
sweep_ AS (SELECT cell, d_logprob, max_cr, len_ratio, sum(CASE WHEN rev THEN be ELSE errors END)::DOUBLE / sum(ref_len) AS wer, avg(rev::INT) AS fallback_rate FROM cells_ GROUP BY ALL)"""


def scored(spark, sf, *conds):
    n = S.with_normalized(hypotheses(spark, sf, conds or tuple(f"C{i}" for i in range(8)), normalized=True))
    return S.word_errors(n)


def sweep(spark, sf):
    return G.sweep_guard(scored(spark, sf, "C4"), scored(spark, sf, "C0"))


@query("swp1_guard_sweep", with_(SWEEP, body="SELECT cell, d_logprob, max_cr, len_ratio, round_even(wer, 9) AS wer, round_even(fallback_rate, 9) AS fallback_rate FROM sweep_"))
def swp1(spark, sf):
    return sweep(spark, sf).withColumn("wer", F.bround("wer", 9)).withColumn("fallback_rate", F.bround("fallback_rate", 9))


@query("top6_best_config", with_(SWEEP, body="SELECT cell, d_logprob, max_cr, len_ratio, round_even(wer, 9) AS wer FROM sweep_ ORDER BY sweep_.wer, cell LIMIT 1"))
def top6(spark, sf):
    return G.best_config(sweep(spark, sf), ["cell", "d_logprob", "max_cr", "len_ratio"]).withColumn("wer", F.bround("wer", 9))


@query("jn13_config_grid", with_(GRID, body="SELECT event_type, cell, d_logprob, max_cr, len_ratio, count(*) FILTER (value > len_ratio) AS n_over FROM events, grid GROUP BY ALL"))
def jn13(spark, sf):
    # each row is folded to its class before it meets the grid
    e = table(spark, sf, "events").groupBy("event_type", *[(F.col("value") > v).alias(f"o{i}") for i, v in enumerate(G.GRID_LEN_RATIO)]).agg(F.count(F.lit(1)).alias("n"))
    over = F.coalesce(*[F.when(F.col("len_ratio") == v, F.col(f"o{i}")) for i, v in enumerate(G.GRID_LEN_RATIO)])
    return G.config_grid(e).groupBy("event_type", "cell", "d_logprob", "max_cr", "len_ratio").agg(F.sum(F.when(over, F.col("n")).otherwise(0)).alias("n_over"))


# a trial's setting is read off its utterance: two languages, then three numbers of units and two prompt lengths
SETTINGS = """tr_ AS (SELECT *, CASE WHEN (substr(md5(utt_id), 1, 1)) < '8' THEN 'hi' ELSE 'auto' END AS lang,
  ('0x' || substr(md5(utt_id), 2, 1))::INT % 3 + 1 AS k, CASE WHEN substr(md5(utt_id), 3, 1) < '8' THEN 120 ELSE 200 END AS cap FROM scored),
ln_ AS (SELECT lang, sum(errors)::DOUBLE / sum(ref_len) AS wer FROM tr_ WHERE cond = 'C0' GROUP BY lang),
best_ AS (SELECT lang, wer FROM ln_ ORDER BY wer, lang DESC LIMIT 1),
gr_ AS (SELECT lang, k, cap, sum(errors)::DOUBLE / sum(ref_len) AS wer FROM tr_ WHERE cond = 'C4' GROUP BY lang, k, cap)"""


@query("swp2_condition_choice", with_(SCORED, SETTINGS, body="""SELECT b.lang, round_even(b.wer, 9) AS c0_wer, g.k, g.cap, round_even(g.wer, 9) AS c4_wer
  FROM best_ b JOIN gr_ g USING (lang) ORDER BY g.wer, g.k, g.cap LIMIT 1"""))
def swp2(spark, sf):
    digit = lambda i: F.substring(F.md5("utt_id"), i, 1)
    trials = scored(spark, sf, "C0", "C4").select(
        "cond", "errors", "ref_len", F.when(digit(1) < "8", "hi").otherwise("auto").alias("lang"),
        (F.conv(digit(2), 16, 10).cast("int") % 3 + 1).alias("k"), F.when(digit(3) < "8", 120).otherwise(200).alias("cap"))
    out = G.decode_settings(trials, ["hi", "auto"], [1, 2, 3], [120, 200])
    return out.select("lang", F.bround("c0_wer", 9).alias("c0_wer"), "k", "cap", F.bround("c4_wer", 9).alias("c4_wer"))


# --- paired comparison -------------------------------------------------------------
def cond(df, c):
    return df.filter(F.col("cond") == c)


@query("jn3_paired_alignment", with_(SCORED, body="""SELECT a.utt_id, a.errors AS e_a, b.errors AS e_b, a.ref_len AS n FROM scored a JOIN scored b USING (utt_id)
  WHERE a.cond = 'C0' AND b.cond = 'C4' AND length(b.hyp) % 7 <> 0"""))
def jn3(spark, sf):
    return B.align_pairs(scored(spark, sf, "C0"), scored(spark, sf, "C4").filter(F.length("hyp") % 7 != 0))


def boot_sql(contrasts, n_boot: int, prefix: str = "") -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in contrasts)
    return with_(SCORED, f"""con_ AS (SELECT * FROM (VALUES {pairs}) v(x, y)),
p_ AS (SELECT {prefix.replace("model", "a.model").replace("split", "a.split")}x || '->' || y AS contrast, a.utt_id, a.errors AS e_a, b.errors AS e_b, a.ref_len AS n,
    b.errors / greatest(a.ref_len, 1)::DOUBLE - a.errors / greatest(a.ref_len, 1)::DOUBLE AS d
  FROM con_ JOIN scored a ON a.cond = x JOIN scored b ON b.cond = y AND a.utt_id = b.utt_id),
pl_ AS (SELECT contrast, e_a, e_b, n, d, row_number() OVER (PARTITION BY contrast ORDER BY n, e_a, e_b) - 1 AS pos, count(*) OVER (PARTITION BY contrast) AS size FROM p_),
dq_ AS (SELECT size, rep, q, md5(concat_ws('-', 1337, rep, q)) AS h FROM (SELECT DISTINCT size FROM pl_), unnest(range(0, {n_boot})) r(rep), unnest(range(0, (size + 3) // 4)) s(q)),
dr_ AS (SELECT size, rep, (('0x' || substr(h, 8 * i + 1, 8))::BIGINT) % size AS pos FROM dq_, unnest(range(0, 4)) t(i) WHERE 4 * q + i < size),
sm_ AS (SELECT contrast, rep, sum(e_b - e_a)::DOUBLE / sum(n) AS corpus, sum(d) / count(*) AS macro FROM pl_ JOIN dr_ USING (size, pos) GROUP BY ALL),
ci_ AS (SELECT contrast, quantile_cont(corpus, 0.025) AS lo, quantile_cont(corpus, 0.975) AS hi, avg((corpus < 0)::INT) AS pi, quantile_cont(macro, 0.025) AS mlo, quantile_cont(macro, 0.975) AS mhi FROM sm_ GROUP BY contrast),
ob_ AS (SELECT contrast, count(*) AS n, sum(e_b)::DOUBLE / sum(n) - sum(e_a)::DOUBLE / sum(n) AS cd, avg(d) AS md, avg((d > 0)::INT) AS dg, avg((d < 0)::INT) AS im FROM p_ GROUP BY contrast)""",
        body="""SELECT contrast, n, round_even(cd, 9) AS corpus_delta, round_even(lo, 9) AS ci_low, round_even(hi, 9) AS ci_high, round_even(pi, 9) AS p_improve, round_even(md, 9) AS macro_delta,
  round_even(mlo, 9) AS macro_ci_low, round_even(mhi, 9) AS macro_ci_high, round_even(dg, 9) AS degraded, round_even(im, 9) AS improved, lo > 0 OR hi < 0 AS significant FROM ob_ JOIN ci_ USING (contrast)""")


@query("agg14_paired_bootstrap", boot_sql([("C0", "C4")], B.N_BOOT))
def agg14(spark, sf):
    return B.bootstrap_by_hash(B.contrast_pairs(scored(spark, sf, "C0", "C4"), [("C0", "C4")]))


# The numbers of another generator can't be had in SQL. So each end of an interval is held against the
# normal one, from the standard error of a ratio of sums or of a mean: both must lie within a quarter of that error.
def near_normal_sql(contrasts) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in contrasts)
    return with_(SCORED, f"""con_ AS (SELECT * FROM (VALUES {pairs}) v(x, y)),
p_ AS (SELECT x || '->' || y AS contrast, a.errors AS e_a, b.errors AS e_b, a.ref_len AS n,
    b.errors / greatest(a.ref_len, 1)::DOUBLE - a.errors / greatest(a.ref_len, 1)::DOUBLE AS d
  FROM con_ JOIN scored a ON a.cond = x JOIN scored b ON b.cond = y AND a.utt_id = b.utt_id)""",
        body="""SELECT contrast, count(*) AS n, round_even(sum(e_b)::DOUBLE / sum(n) - sum(e_a)::DOUBLE / sum(n), 9) AS corpus_delta, round_even(avg(d), 9) AS macro_delta,
  round_even(avg((d > 0)::INT), 9) AS degraded, round_even(avg((d < 0)::INT), 9) AS improved,
  true AS low_is_near, true AS high_is_near, true AS macro_low_is_near, true AS macro_high_is_near FROM p_ GROUP BY contrast""")


def near_normal(pairs):
    # both forms read the outcomes, so the pairs are scored once
    classes = durable(B.outcome_classes(pairs))
    found = B.bootstrap_of_classes(classes)
    rows, d, x, n = F.col("rows"), F.col("d"), F.col("e_b") - F.col("e_a"), F.col("n")
    mean = F.sum(rows * d) / F.sum(rows)
    centred = classes.join(classes.groupBy("contrast").agg(mean.alias("mean")), "contrast")
    se = centred.groupBy("contrast").agg(
        F.sum(rows * n).alias("w"), F.sum(rows * x).alias("x"), F.sum(rows * x * x).alias("xx"), F.sum(rows * x * n).alias("xn"), F.sum(rows * n * n).alias("nn"),
        (F.sqrt(F.sum(rows * (d - F.col("mean")) * (d - F.col("mean")))) / F.sum(rows)).alias("macro_se"))
    r = F.col("x") / F.col("w")
    se = se.select("contrast", "macro_se", (F.sqrt(F.greatest(F.lit(0.0), F.col("xx") - 2 * r * F.col("xn") + r * r * F.col("nn"))) / F.col("w")).alias("se"))
    near = lambda end, centre, sign, e: F.abs(F.col(end) - F.col(centre) - sign * 1.959964 * F.col(e)) <= F.col(e) / 4 + 1e-8
    return found.join(se, "contrast").select(
        "contrast", "n", "corpus_delta", "macro_delta", "degraded", "improved",
        near("ci_low", "corpus_delta", -1, "se").alias("low_is_near"), near("ci_high", "corpus_delta", 1, "se").alias("high_is_near"),
        near("macro_ci_low", "macro_delta", -1, "macro_se").alias("macro_low_is_near"), near("macro_ci_high", "macro_delta", 1, "macro_se").alias("macro_high_is_near"))


@query("agg14_bootstrap_large_form", near_normal_sql([("C0", "C4")]))
def agg14_large(spark, sf):
    return near_normal(B.contrast_pairs(scored(spark, sf, "C0", "C4"), [("C0", "C4")]))


@query("agg15_contrasts", boot_sql(B.CONTRASTS, B.N_BOOT))
def agg15(spark, sf):
    return B.bootstrap_contrasts(B.contrast_pairs(scored(spark, sf)), [f"{a}->{b}" for a, b in B.CONTRASTS])


@query("agg15_contrasts_by_class", near_normal_sql(B.CONTRASTS))
def agg15_by_class(spark, sf):
    return near_normal(B.contrast_pairs(scored(spark, sf)))


DELTAS = SCORED + """,
dl_ AS (SELECT a.utt_id, (b.errors - a.errors)::DOUBLE / a.ref_len AS delta, a.errors AS e_a, b.errors AS e_b, a.ref_len FROM scored a JOIN scored b USING (utt_id)
  WHERE a.cond = 'C0' AND b.cond = 'C4' AND a.ref_len <> 0)"""


def deltas(spark, sf):
    return B.paired_deltas(scored(spark, sf, "C0"), scored(spark, sf, "C4"))


@query("agg17_delta_counts", with_(DELTAS, body="SELECT count(*) FILTER (delta < 0) AS better, count(*) FILTER (delta > 0) AS worse, count(*) FILTER (delta = 0) AS unchanged, count(*) AS n FROM dl_"))
def agg17(spark, sf):
    return B.delta_counts(deltas(spark, sf))


@query("top5_wins_and_losses", with_(DELTAS, body="""SELECT 'win' AS side, utt_id, round_even(delta, 9) AS delta, e_a, e_b, ref_len FROM (FROM dl_ ORDER BY delta, utt_id LIMIT 30)
  UNION ALL SELECT 'loss', utt_id, round_even(delta, 9), e_a, e_b, ref_len FROM (FROM dl_ ORDER BY delta DESC, utt_id DESC LIMIT 30)"""))
def top5(spark, sf):
    return B.wins_and_losses(deltas(spark, sf)).withColumn("delta", F.bround("delta", 9))


@query("jn15_error_review", with_(DELTAS, body="""SELECT d.utt_id, round_even(delta, 9) AS delta, s.ref, b.hyp AS base_hyp, s.hyp AS sys_hyp FROM dl_ d
  JOIN hyps s ON s.utt_id = d.utt_id AND s.cond = 'C4' JOIN hyps b ON b.utt_id = d.utt_id AND b.cond = 'C0'"""))
def jn15(spark, sf):
    base, system = hypotheses(spark, sf, ("C0",)), hypotheses(spark, sf, ("C4",)).withColumn("retrieved", F.lit(None).cast("array<string>"))
    return B.error_review(deltas(spark, sf), base, system).select("utt_id", F.bround("delta", 9).alias("delta"), "ref", "base_hyp", "sys_hyp")


# --- result tables and checks -------------------------------------------------------
def contrast_cis(spark, sf, n_boot):
    """Bootstrap rows of each model and split, its name before the contrast."""
    pairs = B.contrast_pairs(scored(spark, sf), also=["model", "split"])
    key = F.concat_ws("/", "model", "split", "contrast")
    out = B.bootstrap_by_hash(pairs.select(key.alias("contrast"), "utt_id", "e_a", "n", "e_b"), n_boot)
    part = F.split("contrast", "/")
    return out.withColumns({"model": part[0], "split": part[1], "contrast": part[2]})


DOC_SQL = " ".join(f"WHEN '{c}' THEN '{t + (' **(topline, oracle)**' if c == 'C6' else '')}'" for c, t in Q.CONDITIONS.items())
CIS = boot_sql(B.CONTRASTS, 200, "model || '/' || split || '/' || ")
PARTS = "string_split(contrast, '/')[1] AS model, string_split(contrast, '/')[2] AS split, string_split(contrast, '/')[3] AS contrast"
PCT = lambda c, d=2: f"CASE WHEN {c} IS NULL THEN '—' ELSE printf('%.{d}f', {c} * 100) END AS "


@query("dq5_results_table", with_(
    HYPS, *SCORES, f"ci0_ AS ({CIS})", f"ci_ AS (SELECT * EXCLUDE (contrast), {PARTS} FROM ci0_)",
    body=f"""SELECT model, split, cond, CASE cond {DOC_SQL} END AS prompt, {PCT('wer')}wer, {PCT('wer_sa')}wer_sa, {PCT('k_wer')}k_wer, {PCT('u_wer')}u_wer, {PCT('cer')}cer,
  {PCT('script_fidelity', 1)}script_fidelity,
  CASE WHEN cond = 'C0' THEN 'ref' WHEN corpus_delta IS NULL THEN '—' ELSE printf('%+.2f [%+.2f, %+.2f]', corpus_delta * 100, ci_low * 100, ci_high * 100) END AS delta,
  CASE WHEN degraded IS NULL THEN '—' ELSE printf('%.0f', degraded * 100) END AS worse_pct, {PCT('fallback_rate', 1)}fallback_pct
  FROM score_ LEFT JOIN (SELECT model, split, contrast[5:] AS cond, corpus_delta, ci_low, ci_high, degraded FROM ci_ WHERE contrast LIKE 'C0->%') USING (model, split, cond)""", recursive=True))
def dq5(spark, sf):
    return Q.results_table(S.score_table(hypotheses(spark, sf, normalized=True), vocabulary(spark, sf)), contrast_cis(spark, sf, 200))


NAMED_SQL = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in Q.NAMED_CONTRASTS.items())


@query("dq5_contrast_list", with_(
    f"ci0_ AS ({CIS})", f"ci_ AS (SELECT * EXCLUDE (contrast), {PARTS} FROM ci0_)",
    body=f"""SELECT model, split, contrast, printf('- **%s** (%s): ΔWER %+.2f [95%% CI %+.2f, %+.2f], P(improve)=%.3f', CASE contrast {NAMED_SQL} END, contrast, corpus_delta * 100, ci_low * 100, ci_high * 100, p_improve) AS line
  FROM ci_ WHERE contrast IN ({', '.join(f"'{c}'" for c in Q.NAMED_CONTRASTS)})"""))
def dq5_list(spark, sf):
    return Q.contrast_list(contrast_cis(spark, sf, 200))


EXPECTED_SQL = ", ".join(f"('{'dev' if s == 'test' else 'test'}', '{c}', '{m}', {v}::DOUBLE)" for (s, c), vs in Q.EXPECTED.items() for m, v in zip(Q.METRICS, vs))
METRIC_ROWS = SCORED + """,
m_ AS (SELECT split, cond, sum(errors)::DOUBLE / sum(ref_len) * 500 AS wer, avg(length(hyp)) AS k_wer, avg(errors) * 20 AS u_wer, avg(ref_len) * 5 AS script FROM scored WHERE NOT (split = 'dev' AND cond = 'C3') GROUP BY ALL)"""


def metric_rows(spark, sf):
    return scored(spark, sf).filter("NOT (split = 'dev' AND cond = 'C3')").groupBy("split", "cond").agg(
        (F.sum("errors") / F.sum("ref_len") * 500).alias("wer"), F.avg(F.length("hyp")).alias("k_wer"), (F.avg("errors") * 20).alias("u_wer"), (F.avg("ref_len") * 5).alias("script"))


@query("dq3_regression_check", with_(METRIC_ROWS, f"e_ AS (SELECT * FROM (VALUES {EXPECTED_SQL}) v(split, cond, metric, expected))",
    "g_ AS (UNPIVOT (SELECT split, cond, wer, k_wer, u_wer, script FROM m_) ON wer, k_wer, u_wer, script INTO NAME metric VALUE got)",
    body="SELECT split, cond, metric, expected, round_even(got, 9) AS got, CASE WHEN got IS NULL THEN 'MISSING' WHEN abs(got - expected) > 30 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM e_ LEFT JOIN g_ USING (split, cond, metric)"))
def dq3(spark, sf):
    rows = [("dev" if s == "test" else "test", c, *v) for (s, c), v in Q.EXPECTED.items()]
    expected = spark.createDataFrame(rows, "split string, cond string, " + ", ".join(f"{m} double" for m in Q.METRICS))
    return Q.regression_check(metric_rows(spark, sf), expected, ["split", "cond"], Q.METRICS, 30.0).withColumn("got", F.bround("got", 9))


def _claims_sql() -> str:
    rows = []
    for i, (s, a, m, g, b) in enumerate(Q.CLAIMS):
        s = "dev" if s == "test" else "test"
        val = lambda c: f"(SELECT {m} FROM m_ WHERE split = '{s}' AND cond = '{c}')"
        rows.append(f"SELECT {i + 1} AS claim, '{s}' AS split, '{a}.{m} {g} {b}.{m}' AS rule, CASE WHEN {val(a)} {g} {val(b)} THEN 'PASS' WHEN {val(a)} IS NULL OR {val(b)} IS NULL THEN 'SKIP' ELSE 'FAIL' END AS verdict")
    return " UNION ALL ".join(rows)


@query("dq4_directional_claims", with_(METRIC_ROWS, body=_claims_sql()))
def dq4(spark, sf):
    claims = [("dev" if s == "test" else "test", a, m, g, b) for s, a, m, g, b in Q.CLAIMS]
    return Q.directional_claims(metric_rows(spark, sf), claims)


@query("prj3_relative_change", """WITH a AS (SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS new_, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS old_ FROM orders GROUP BY o_custkey)
SELECT o_custkey, round_even(new_ / 3e7 * 100, 6) AS new_pct, CASE WHEN coalesce(old_, 0) <> 0 THEN round_even((new_ - old_) / old_ * 100, 6) ELSE 0 END AS change FROM a""")
def prj3(spark, sf):
    s = lambda v: F.sum(F.when(F.col("o_orderstatus") == v, F.col("o_totalprice")))
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(s("F").alias("new"), s("O").alias("old"))
    return a.select("o_custkey", F.bround(Q.percent(F.col("new") / 3e7), 6).alias("new_pct"), F.bround(Q.relative_change(F.col("new"), F.col("old")), 6).alias("change"))
