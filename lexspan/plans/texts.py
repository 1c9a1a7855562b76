"""Text, alignment and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.functions import align as A
from lexspan.functions import text as X
from lexspan.operators import scoring as S
from lexspan.plans.base import (
    HYPS, NOISE, UTTS, hash_sql, hypotheses, mixed_script, mixed_script_sql, nhyps_sql, norm_sql, query, table, tokens_sql,
    utterances, with_, word_distance_sql, words_sql,
)
from lexspan.functions.seeded import seeded_hash

MIXED = f"""mixed AS (SELECT doc_id, {mixed_script_sql('text', 'doc_id % 2 = 1')} AS text FROM documents),
mixed_n AS (SELECT doc_id, {norm_sql('text')} AS n FROM mixed)"""
DEV_SQL = r"[\x{900}-\x{97f}]"


def mixed_docs(spark, sf):
    """Documents, every second one respelt in Devanagari."""
    return table(spark, sf, "documents").select("doc_id", mixed_script(F.col("text"), F.col("doc_id") % 2 == 1).alias("text"))


@query("txt1_normalize", with_(MIXED, body="SELECT doc_id, n AS normalized FROM mixed_n"))
def txt1(spark, sf):
    return mixed_docs(spark, sf).select("doc_id", X.normalize(F.col("text")).alias("normalized"))


@query("txt2_script_of", with_(
    MIXED, f"w AS (SELECT unnest({words_sql('n')}) AS word FROM mixed_n)",
    body=f"""SELECT CASE WHEN regexp_matches(word, '{DEV_SQL}') THEN 'dev' WHEN regexp_matches(word, '[a-z]') THEN 'lat' ELSE 'other' END AS script,
      count(*) AS n_words FROM w GROUP BY 1"""))
def txt2(spark, sf):
    words = mixed_docs(spark, sf).select(F.explode(X.norm_words(X.normalize(F.col("text")))).alias("word"))
    return words.groupBy(X.script_of(F.col("word")).alias("script")).agg(F.count(F.lit(1)).alias("n_words"))


@query("txt3_script_mix", with_(
    MIXED, f"w AS (SELECT doc_id, {words_sql('n')} AS w FROM mixed_n)",
    f"c AS (SELECT doc_id, len(w) AS t, len(list_filter(w, lambda x: regexp_matches(x, '{DEV_SQL}'))) AS d, "
    f"len(list_filter(w, lambda x: NOT regexp_matches(x, '{DEV_SQL}') AND regexp_matches(x, '[a-z]'))) AS l FROM w)",
    body="""SELECT doc_id, CASE WHEN t > 0 THEN d / t::DOUBLE ELSE 0 END AS dev, CASE WHEN t > 0 THEN l / t::DOUBLE ELSE 0 END AS lat,
      CASE WHEN t > 0 THEN (t - d - l) / t::DOUBLE ELSE 0 END AS other FROM c"""))
def txt3(spark, sf):
    n = X.with_script_counts(mixed_docs(spark, sf), F.col("text"))
    return n.select("doc_id", *[F.when(F.col("total") > 0, F.col(k) / F.col("total")).otherwise(0.0).alias(k) for k in ("dev", "lat", "other")])


@query("txt4_word_count", f"SELECT doc_id, len({tokens_sql('text')}) AS n_words FROM documents")
def txt4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


def _romanize_sql(x: str) -> str:
    out = f"translate({x}, '{''.join(X.SIGN_FOLD)}', '{''.join(X.SIGN_FOLD.values())}')"
    # RE2 has no lookahead: mark every consonant, then take the mark back before a sign
    out = rf"regexp_replace({out}, '([\x{{915}}-\x{{939}}])', '\1अ', 'g')"
    out = rf"regexp_replace({out}, '([\x{{915}}-\x{{939}}])अ([\x{{93e}}-\x{{94d}}\x{{962}}\x{{963}}])', '\1\2', 'g')"
    for src, dst in X.ROMAN_MULTI.items():
        out = f"replace({out}, '{src}', '{dst}')"
    kept = {k: v for k, v in X.ROMAN_SINGLE.items() if v}
    gone = "".join(k for k, v in X.ROMAN_SINGLE.items() if not v)
    return f"translate({out}, '{''.join(kept)}{gone}', '{''.join(kept.values())}')"


def skeleton_ctes(source: str, column: str, name: str, extra: str) -> str:
    """Skeleton words of a normalised column, word by word."""
    key = "k"
    for src, dst in X.DIGRAPHS:
        key = f"replace({key}, '{src}', '{dst}')"
    key = f"translate({key}, '{X.SKELETON_FROM}', '{X.SKELETON_TO}')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        key = f"regexp_replace({key}, '{c}{c}+', '{c}', 'g')" if c not in "aeiouycqzwm" else key
    return f"""{name}_a AS (SELECT {extra}, string_split(regexp_replace({_romanize_sql(column)}, '[^a-z ]', '', 'g'), ' ') AS ks FROM {source}),
{name} AS (SELECT {extra}, list_filter(list_transform(ks, lambda k: CASE WHEN {key} = '' THEN k[1:1] ELSE {key} END), lambda s: s <> '') AS sk FROM {name}_a)"""


@query("txt5_romanize", with_(MIXED, body=f"SELECT doc_id, {_romanize_sql('n')} AS latin FROM mixed_n"))
def txt5(spark, sf):
    return mixed_docs(spark, sf).select("doc_id", X.romanize(X.normalize(F.col("text"))).alias("latin"))


@query("txt6_skeleton", with_(
    MIXED, f"words_ AS (SELECT DISTINCT unnest({words_sql('n')}) AS word FROM mixed_n)",
    skeleton_ctes("words_", "word", "sk_", "word"), body="SELECT word, coalesce(sk[1], '') AS key FROM sk_"))
def txt6(spark, sf):
    words = mixed_docs(spark, sf).select(F.explode(X.norm_words(X.normalize(F.col("text")))).alias("word")).distinct()
    return words.select("word", X.skeleton(F.col("word")).alias("key"))


@query("txt7_normalize_sa", with_(
    MIXED, skeleton_ctes("mixed_n", "n", "sk_", "doc_id"), body="SELECT doc_id, array_to_string(sk, ' ') AS sa FROM sk_"))
def txt7(spark, sf):
    n = mixed_docs(spark, sf).select("doc_id", X.normalize(F.col("text")).alias("n"))
    return X.with_normalized_sa(n, "n", "sa").select("doc_id", "sa")


@query("txt9_word_edit_distance", with_(
    HYPS, nhyps_sql(), f"d AS ({word_distance_sql('nh')})", body="SELECT cond, utt_id, errors::INT AS errors, len(r)::INT AS ref_len FROM d"))
def txt9(spark, sf):
    return S.word_errors(S.with_normalized(hypotheses(spark, sf, normalized=True))).select("cond", "utt_id", "errors", "ref_len")


# SQL twin of the alignment: distance rows, then the walk back from the end.
ALIGN = nhyps_sql() + """,
pre_ AS (SELECT row_number() OVER () AS key, *, list_transform(range(1, least(len(r), len(h)) + 1), lambda i: r[i] = h[i]) AS e FROM nh),
pre AS (SELECT * EXCLUDE (e), CASE WHEN list_contains(e, false) THEN list_position(e, false) - 1 ELSE len(e) END AS pre FROM pre_),
suf_ AS (SELECT *, list_transform(range(0, least(len(r), len(h)) - pre), lambda i: r[len(r) - i] = h[len(h) - i]) AS e FROM pre),
suf AS (SELECT * EXCLUDE (e), CASE WHEN list_contains(e, false) THEN list_position(e, false) - 1 ELSE len(e) END AS suf FROM suf_),
mid AS (SELECT *, r[pre + 1 : len(r) - suf] AS rm, h[pre + 1 : len(h) - suf] AS hm FROM suf),
dp(key, i, rm, hm, cells) AS (
  SELECT key, 0, rm, hm, range(0, len(hm) + 1) FROM mid
  UNION ALL
  SELECT key, i + 1, rm, hm, list_reduce(
      list_transform(hm, lambda x, k: least(cells[k + 1] + 1, cells[k] + (CASE WHEN x = rm[i + 1] THEN 0 ELSE 1 END))),
      lambda a, x: list_append(a, least(a[-1] + 1, x)), [(i + 1)::BIGINT])
  FROM dp WHERE i < len(rm)),
mat AS (SELECT key, list(cells ORDER BY i) AS m FROM dp GROUP BY key),
start_ AS (SELECT key, rm, hm, m FROM mid JOIN mat USING (key)),
walk(key, i, j, op) AS (
  SELECT key, len(rm), len(hm), '' FROM start_
  UNION ALL
  SELECT key, CASE WHEN nxt = 'I' THEN i ELSE i - 1 END, CASE WHEN nxt = 'D' THEN j ELSE j - 1 END, nxt
  FROM (SELECT w.key, i, j, CASE
      WHEN j = 0 OR (i > 0 AND m[i + 1][j + 1] = m[i][j + 1] + 1) THEN 'D'
      WHEN i = 0 OR (j > 1 AND m[i + 1][j] = m[i][j] - 1) THEN 'I'
      WHEN rm[i] = hm[j] THEN 'E' ELSE 'S' END AS nxt
    FROM walk w JOIN start_ s ON w.key = s.key WHERE i > 0 OR j > 0))"""


OPS = """steps AS (SELECT key, i, j, op, row_number() OVER (PARTITION BY key ORDER BY i DESC, j DESC) AS back FROM walk WHERE op <> ''),
mids AS (SELECT key, string_agg(op, '' ORDER BY i, j) AS ops FROM steps GROUP BY key)"""


@query("txt10_alignment", with_(
    HYPS, ALIGN, OPS,
    body="""SELECT cond, utt_id, repeat('E', pre::INT) || coalesce(ops, '') || repeat('E', suf::INT) AS ops,
      len(replace(coalesce(ops, ''), 'E', ''))::INT AS errors FROM mid LEFT JOIN mids USING (key)""", recursive=True))
def txt10(spark, sf):
    a = S.with_alignment(S.with_normalized(hypotheses(spark, sf, normalized=True)))
    return a.select("cond", "utt_id", "ops", A.ops_errors(F.col("ops")).alias("errors"))


# runs of equal steps: a step's place minus its place among equal ones is the same all through a run
@query("txt10_alignment_chunks", with_(
    HYPS, ALIGN, OPS, """all_ AS (SELECT cond, utt_id, repeat('E', pre::INT) || coalesce(ops, '') || repeat('E', suf::INT) AS ops FROM mid LEFT JOIN mids USING (key)),
ch_ AS (SELECT cond, utt_id, p, ops[p] AS op, p - row_number() OVER (PARTITION BY cond, utt_id, ops[p] ORDER BY p) AS run,
  count(*) FILTER (ops[p] <> 'I') OVER w AS r, count(*) FILTER (ops[p] <> 'D') OVER w AS h
  FROM all_, unnest(range(1, length(ops) + 1)) t(p) WINDOW w AS (PARTITION BY cond, utt_id ORDER BY p))""",
    body="""SELECT cond, utt_id, CASE op WHEN 'E' THEN 'equal' WHEN 'S' THEN 'substitute' WHEN 'D' THEN 'delete' ELSE 'insert' END AS type,
      (min(r) - (op <> 'I')::INT)::INT AS ref_start, max(r)::INT AS ref_end, (min(h) - (op <> 'D')::INT)::INT AS hyp_start, max(h)::INT AS hyp_end
      FROM ch_ GROUP BY cond, utt_id, op, run""", recursive=True))
def txt10_chunks(spark, sf):
    a = S.with_alignment(S.with_normalized(hypotheses(spark, sf, normalized=True)))
    return a.select("cond", "utt_id", F.explode(A.alignment_chunks(F.col("ops"))).alias("c")).select("cond", "utt_id", "c.*")


@query("agg1_wer", with_(
    HYPS, nhyps_sql(), f"d AS ({word_distance_sql('nh')})",
    body="SELECT model, cond, split, round_even(sum(errors)::DOUBLE / sum(len(r)), 9) AS wer FROM d GROUP BY model, cond, split"))
def agg1(spark, sf):
    return S.corpus_wer(S.with_normalized(hypotheses(spark, sf, normalized=True)), S.GROUP).withColumn("wer", F.bround("wer", 9))


ACCENTS, ASCII_FOR_ACCENTS = "ñêüöóéèßçíäáúàâëîïôûù", "ABCDEFGHIJKLMNOPQRSTU"


@query("agg2_cer", with_(
    HYPS, nhyps_sql(), f"c AS (SELECT *, translate(nref, '{ACCENTS}', '{ASCII_FOR_ACCENTS}') AS a, translate(nhyp, '{ACCENTS}', '{ASCII_FOR_ACCENTS}') AS b FROM nh)",
    body="SELECT model, cond, split, round_even(sum(levenshtein(a, b))::DOUBLE / sum(len(nref)), 9) AS cer FROM c GROUP BY model, cond, split"))
def agg2(spark, sf):
    return S.corpus_cer(S.with_normalized(hypotheses(spark, sf, normalized=True)), S.GROUP).withColumn("cer", F.bround("cer", 9))


# references in Latin script against hypotheses half of which are respelt
MIXED_HYPS = f"mh AS (SELECT * REPLACE ({mixed_script_sql('hyp', hash_sql('utt_id') + ' % 2 = 1')} AS hyp) FROM hyps)"


def mixed_hypotheses(spark, sf):
    return hypotheses(spark, sf).withColumn("hyp", mixed_script(F.col("hyp"), seeded_hash(F.col("utt_id")) % 2 == 1))


@query("agg3_wer_sa", with_(
    HYPS, MIXED_HYPS, f"mn AS (SELECT *, {norm_sql('ref')} AS nref, {norm_sql('hyp')} AS nhyp FROM mh)",
    skeleton_ctes("mn", "nref", "skr", "model, cond, split, utt_id, nhyp"),
    skeleton_ctes("(SELECT *, sk AS r FROM skr)", "nhyp", "skh", "model, cond, split, utt_id, r"),
    "p AS (SELECT *, sk AS h FROM skh)", f"d AS ({word_distance_sql('p')})",
    body="SELECT model, cond, split, round_even(sum(errors)::DOUBLE / sum(len(r)), 9) AS wer_sa FROM d GROUP BY model, cond, split"))
def agg3(spark, sf):
    return S.corpus_wer_sa(S.with_normalized(mixed_hypotheses(spark, sf)), S.GROUP).withColumn("wer_sa", F.bround("wer_sa", 9))


VOCAB = f"vocab AS (SELECT DISTINCT unnest({words_sql(norm_sql('text'))}) AS word FROM benchmark)"


def vocabulary(spark, sf):
    return S.keyword_vocabulary(table(spark, sf, "benchmark"), "text")


SPLIT_STEPS = """ops_ AS (SELECT key, i, op FROM (SELECT w.key, w.i + CASE WHEN w.op = 'I' THEN 0 ELSE 1 END AS i, w.op FROM walk w WHERE w.op <> '')),
bad AS (SELECT key, i FROM ops_ WHERE op IN ('D', 'S')),
ins_ AS (SELECT key, count(*) AS ins FROM ops_ WHERE op = 'I' GROUP BY key),
rw AS (SELECT key, model, cond, split, r[p] AS word, p - pre AS i FROM mid, unnest(range(1, len(r) + 1)) t(p)),
st AS (SELECT rw.*, bad.key IS NOT NULL AS err, v.word IS NOT NULL AS k FROM rw LEFT JOIN bad ON rw.key = bad.key AND rw.i = bad.i LEFT JOIN vocab v ON rw.word = v.word),
agg AS (SELECT model, cond, split, count(*) FILTER (k) AS k_n, count(*) FILTER (k AND err) AS k_err, count(*) FILTER (NOT k) AS u_n,
  count(*) FILTER (NOT k AND err) AS u_err, count(*) FILTER (regexp_matches(word, '[a-z]')) AS lat_n,
  count(*) FILTER (regexp_matches(word, '[a-z]') AND NOT err) AS lat_ok FROM st GROUP BY ALL),
inst AS (SELECT model, cond, split, sum(coalesce(ins, 0)) AS ins FROM mid LEFT JOIN ins_ USING (key) GROUP BY ALL)"""


@query("agg4_k_u_wer", with_(
    HYPS, ALIGN, VOCAB, SPLIT_STEPS,
    body="""SELECT model, cond, split, CASE WHEN k_n > 0 THEN round_even(k_err::DOUBLE / k_n, 9) END AS k_wer, k_n,
      CASE WHEN u_n > 0 THEN round_even(u_err::DOUBLE / u_n, 9) END AS u_wer, u_n, round_even(ins::DOUBLE / greatest(1, k_n + u_n), 9) AS ins_rate,
      CASE WHEN lat_n > 0 THEN round_even(lat_ok::DOUBLE / lat_n, 9) END AS script_fidelity, lat_n FROM agg JOIN inst USING (model, cond, split)""",
    recursive=True))
def agg4(spark, sf):
    a = S.with_alignment(S.with_normalized(hypotheses(spark, sf, normalized=True)))
    out = S.vocabulary_errors(a, vocabulary(spark, sf), S.GROUP)
    return out.select(*S.GROUP, F.bround("k_wer", 9).alias("k_wer"), "k_n", F.bround("u_wer", 9).alias("u_wer"), "u_n",
                      F.bround("ins_rate", 9).alias("ins_rate"), F.bround("script_fidelity", 9).alias("script_fidelity"), "lat_n")


@query("agg5_condition_summary", with_(
    HYPS, body="""SELECT model, cond, split, count(*) AS n, round_even(avg(coalesce(prompt_tokens, 0)), 9) AS mean_prompt_tokens,
      round_even(avg(fallback::INT), 9) AS fallback_rate FROM hyps GROUP BY model, cond, split"""))
def agg5(spark, sf):
    out = S.condition_summary(hypotheses(spark, sf))
    return out.withColumn("mean_prompt_tokens", F.bround("mean_prompt_tokens", 9)).withColumn("fallback_rate", F.bround("fallback_rate", 9))


SCORES = [ALIGN, VOCAB, SPLIT_STEPS,
          f"d1_ AS ({word_distance_sql('nh')})",
          "w1_ AS (SELECT model, cond, split, count(*) AS n, sum(errors)::DOUBLE / nullif(sum(len(r)), 0) AS wer FROM d1_ GROUP BY ALL)",
          f"""w2_ AS (SELECT model, cond, split, sum(levenshtein(translate(nref, '{ACCENTS}', '{ASCII_FOR_ACCENTS}'), translate(nhyp, '{ACCENTS}', '{ASCII_FOR_ACCENTS}')))::DOUBLE
  / nullif(sum(len(nref)), 0) AS cer FROM nh GROUP BY ALL)""",
          f"mn AS (SELECT *, {norm_sql('ref')} AS nref, {norm_sql('hyp')} AS nhyp FROM hyps)",
          skeleton_ctes("mn", "nref", "skr", "model, cond, split, utt_id, nhyp"),
          skeleton_ctes("(SELECT *, sk AS r FROM skr)", "nhyp", "skh", "model, cond, split, utt_id, r"),
          "p3_ AS (SELECT *, sk AS h FROM skh)", f"d3_ AS ({word_distance_sql('p3_')})",
          "w3_ AS (SELECT model, cond, split, sum(errors)::DOUBLE / nullif(sum(len(r)), 0) AS wer_sa FROM d3_ GROUP BY ALL)",
          "w5_ AS (SELECT model, cond, split, avg(coalesce(prompt_tokens, 0)) AS mean_prompt_tokens, avg(fallback::INT) AS fallback_rate FROM hyps GROUP BY ALL)",
          """score_ AS (SELECT model, cond, split, n, wer, wer_sa, cer, k_err::DOUBLE / nullif(k_n, 0) AS k_wer, k_n, u_err::DOUBLE / nullif(u_n, 0) AS u_wer, u_n,
  ins::DOUBLE / greatest(1, k_n + u_n) AS ins_rate, lat_ok::DOUBLE / nullif(lat_n, 0) AS script_fidelity, lat_n, mean_prompt_tokens, fallback_rate
  FROM agg JOIN inst USING (model, cond, split) JOIN w1_ USING (model, cond, split) JOIN w2_ USING (model, cond, split) JOIN w3_ USING (model, cond, split) JOIN w5_ USING (model, cond, split))"""]
RATES = ["wer", "wer_sa", "cer", "k_wer", "u_wer", "ins_rate", "script_fidelity", "mean_prompt_tokens", "fallback_rate"]


@query("agg5_score_table", with_(
    HYPS, *SCORES, body=f"SELECT * REPLACE ({', '.join(f'round_even({c}, 9) AS {c}' for c in RATES)}) FROM score_", recursive=True))
def score_table(spark, sf):
    out = S.score_table(hypotheses(spark, sf, normalized=True), vocabulary(spark, sf))
    return out.withColumns({c: F.bround(c, 9) for c in RATES})


@query("jn11_vocabulary_membership", with_(
    UTTS, VOCAB, f"w AS (SELECT utt_id, unnest({words_sql(norm_sql('ref'))}) AS word FROM utts)",
    body="""SELECT w.utt_id, count(*) FILTER (v.word IS NOT NULL) AS k_words, count(*) FILTER (v.word IS NULL) AS u_words
      FROM w LEFT JOIN vocab v USING (word) GROUP BY w.utt_id"""))
def jn11(spark, sf):
    return S.vocabulary_membership(utterances(spark, sf), vocabulary(spark, sf), "utt_id", "ref")


@query("agg12_keyword_vocabulary", with_(VOCAB, body="SELECT word FROM vocab"))
def agg12(spark, sf):
    return vocabulary(spark, sf)


@query("agg13_segment_rollup", """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, list_transform(ls, lambda l: CASE WHEN len(l) % 3 <> 0 THEN -len(l) / 16.0::DOUBLE END) AS lp,
  list_transform(ls, lambda l: CASE WHEN len(l) % 4 <> 0 THEN len(l) / 8.0::DOUBLE END) AS cr FROM s)
SELECT doc_id, round_even(list_avg(lp), 9) AS avg_logprob, list_max(cr) AS compression_ratio FROM x""")
def agg13(spark, sf):
    seg = F.transform(F.split("text", "\n"), lambda l: F.struct(
        F.when(F.length(l) % 3 != 0, -F.length(l) / F.lit(16.0)).alias("avg_logprob"),
        F.when(F.length(l) % 4 != 0, F.length(l) / F.lit(8.0)).alias("compression_ratio")))
    docs = table(spark, sf, "documents").select("doc_id", seg.alias("segments"))
    lp, cr = S.segment_rollup(F.col("segments"))
    return docs.select("doc_id", F.bround(lp, 9).alias("avg_logprob"), cr.alias("compression_ratio"))


@query("agg16_text_profile", with_(
    MIXED, f"w AS (SELECT doc_id, {words_sql('n')} AS w FROM mixed_n)",
    f"c AS (SELECT len(w) AS t, len(list_filter(w, lambda x: regexp_matches(x, '{DEV_SQL}'))) AS d, "
    f"len(list_filter(w, lambda x: NOT regexp_matches(x, '{DEV_SQL}') AND regexp_matches(x, '[a-z]'))) AS l FROM w)",
    body="""SELECT count(*) AS n, round_even(avg(CASE WHEN t > 0 THEN d::DOUBLE / t ELSE 0 END), 9) AS dev, round_even(avg(CASE WHEN t > 0 THEN l::DOUBLE / t ELSE 0 END), 9) AS lat,
      round_even(avg(CASE WHEN t > 0 THEN (t - d - l)::DOUBLE / t ELSE 0 END), 9) AS other,
      (SELECT count(*) FROM mixed WHERE regexp_matches(text, '{digit}')) AS with_digits FROM c""".replace("{digit}", S.DIGIT)))
def agg16(spark, sf):
    out = S.text_profile(mixed_docs(spark, sf), "text")
    return out.select("n", *[F.bround(c, 9).alias(c) for c in ("dev", "lat", "other")], "with_digits")


@query("top8_review_sample", with_(
    HYPS, f"n AS (SELECT *, {norm_sql('ref')} AS nref, {norm_sql('hyp')} AS nhyp FROM hyps WHERE cond = 'C0' AND {hash_sql('utt_id', chr(39) + 'eval' + chr(39))} % 3 = 0)",
    body="SELECT utt_id, ref, nref, hyp, nhyp FROM n ORDER BY utt_id LIMIT 20"))
def top8(spark, sf):
    h = hypotheses(spark, sf, ("C0",)).withColumn("in_eval", seeded_hash(F.col("utt_id"), "eval") % 3 == 0)
    return S.review_sample(h)


DOC_LINES = """lines_ AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""


@query("txt13_prose_prompt", with_(
    DOC_LINES, "p AS (SELECT doc_id, list_filter(list_transform(ls, lambda l: trim(l)), lambda l: l <> '') AS p FROM lines_)",
    f"j AS (SELECT doc_id, p, array_to_string(p, ' ') AS t FROM p)", f"k AS (SELECT *, {tokens_sql('t')} AS w FROM j)",
    body=f"SELECT doc_id, CASE WHEN len(p) = 0 THEN '{X.GENERIC_PROMPT}' WHEN len(w) <= 200 THEN t ELSE array_to_string(w[-200:], ' ') END AS prompt FROM k"))
def txt13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.prose_prompt(F.split("text", "\n")).alias("prompt"))


@query("txt14_keyword_prompt", with_(
    DOC_LINES, "f AS (SELECT doc_id, flatten(list_transform(ls, lambda l: string_split(l, ' '))) AS ks FROM lines_)",
    "g AS (SELECT doc_id, list_filter(ks, lambda k, i: list_position(ks, k) = i) AS ks FROM f)", "t AS (SELECT doc_id, array_to_string(ks, ', ') AS t FROM g)",
    f"k AS (SELECT *, {tokens_sql('t')} AS w FROM t)",
    body="SELECT doc_id, CASE WHEN len(w) <= 200 THEN t ELSE array_to_string(w[-200:], ' ') END AS prompt FROM k"))
def txt14(spark, sf):
    lists = F.transform(F.split("text", "\n"), lambda l: F.split(l, " "))
    return table(spark, sf, "documents").select("doc_id", X.keyword_prompt(lists).alias("prompt"))


@query("txt15_keep_last_tokens", with_(
    f"k AS (SELECT doc_id, text, {tokens_sql('text')} AS w FROM documents)",
    body="SELECT doc_id, len(w) AS n_tokens, CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(w[-200:], ' ') END AS kept FROM k"))
def txt15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"), X.keep_last_tokens(F.col("text"), 200).alias("kept"))


# a merge list in a table: the most frequent pairs of letters, then of such a pair and a letter behind it
MERGES = """lw_ AS (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part),
l2_ AS (SELECT substr(w, i, 1) AS a, substr(w, i + 1, 1) AS b, count(*) AS n FROM lw_, unnest(range(1, length(w))) t(i) GROUP BY ALL),
m2_ AS (SELECT a AS "left", b AS "right", row_number() OVER (ORDER BY n DESC, a, b) AS rank FROM l2_),
l3_ AS (SELECT substr(w, i, 2) AS a, substr(w, i + 2, 1) AS b, count(*) AS n FROM lw_, unnest(range(1, length(w) - 1)) t(i) GROUP BY ALL),
m3_ AS (SELECT a AS "left", b AS "right", 1000 + row_number() OVER (ORDER BY n DESC, a, b) AS rank FROM l3_ WHERE a IN (SELECT "left" || "right" FROM m2_ WHERE rank <= 30)),
merges AS (SELECT * FROM m2_ WHERE rank <= 30 UNION ALL SELECT * FROM m3_ WHERE rank <= 1030)"""


def merges(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    n = F.count(F.lit(1)).alias("n")

    def pairs(size: int):
        at = words.select("w", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1))), lambda i: i <= F.length("w") - size)).alias("i"))
        return at.select(F.substr("w", F.col("i"), F.lit(size)).alias("left"), F.substr("w", F.col("i") + size, F.lit(1)).alias("right")).groupBy("left", "right").agg(n)

    order = [F.desc("n"), F.col("left"), F.col("right")]
    two = pairs(1).orderBy(*order).limit(30)
    three = pairs(2).join(two.select(F.concat("left", "right").alias("left")), "left", "left_semi").orderBy(*order).limit(30)
    both = two.withColumn("step", F.lit(0)).unionByName(three.withColumn("step", F.lit(1)))
    return both.select(F.struct("step", -F.col("n"), "left", "right").alias("rank"), "left", "right")


@query("txt15_keep_last_subwords", with_(MERGES, f"""steps_ AS (SELECT list(struct_pack(f := '<' || "left" || '><' || "right" || '>', t := '<' || "left" || "right" || '>') ORDER BY rank) AS ms FROM merges),
w_ AS (SELECT conv_id, turn, text, {tokens_sql('text')} AS ws FROM conversations),
x_ AS (SELECT conv_id, turn, i, list_reduce(list_prepend('<' || array_to_string(string_split(ws[i], ''), '><') || '>', list_transform(ms, lambda m: m.f || chr(1) || m.t)),
  lambda acc, m: replace(acc, split_part(m, chr(1), 1), split_part(m, chr(1), 2))) AS s FROM w_, steps_, unnest(range(1, len(ws) + 1)) t(i)),
y_ AS (SELECT conv_id, turn, flatten(list(list_transform(string_split(s[2:-2], '><'), lambda p, j: CASE WHEN j = 1 THEN ' ' || p ELSE p END) ORDER BY i)) AS parts FROM x_ GROUP BY ALL)""",
    body="SELECT conv_id, turn, CASE WHEN len(parts) <= 60 THEN text ELSE ltrim(array_to_string(parts[-60:], '')) END AS kept FROM w_ JOIN y_ USING (conv_id, turn)"))
def txt15_subwords(spark, sf):
    subwords = X.merged_subwords(F.col("steps"))
    return table(spark, sf, "conversations").withColumn("steps", X.merge_list(merges(spark, sf))).select("conv_id", "turn", X.keep_last_subwords(F.col("text"), 60, subwords).alias("kept"))


@query("txt16_condition_prompt", with_(
    "c_ AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in NOISE) + ") v(cond))",
    "lines_ AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda l: true) AS ls FROM conversations)",
    """src AS (SELECT conv_id, turn, cond, CASE cond WHEN 'C2' THEN array_to_string(list_filter(ks, lambda k, i: list_position(ks, k) = i), ', ')
        WHEN 'C3' THEN array_to_string(list_filter(list_transform(ls, lambda l: trim(l)), lambda l: l <> ''), ' ')
        ELSE array_to_string(list_filter(list_transform(ls[-2:], lambda l: trim(l)), lambda l: l <> ''), ' ') END AS t
      FROM (SELECT *, flatten(list_transform(ls, lambda l: string_split(l, ' '))) AS ks FROM lines_), c_)""",
    f"k AS (SELECT *, {tokens_sql('t')} AS w FROM src)",
    body=f"""SELECT conv_id, turn, cond, CASE WHEN cond = 'C0' THEN NULL WHEN cond = 'C1' THEN '{X.GENERIC_PROMPT}'
      WHEN t = '' AND cond <> 'C2' THEN '{X.GENERIC_PROMPT}' WHEN len(w) <= 200 THEN t ELSE array_to_string(w[-200:], ' ') END AS prompt FROM k"""))
def txt16(spark, sf):
    lines = F.split("text", "\n")
    c = table(spark, sf, "conversations").select("conv_id", "turn", lines.alias("ls"), F.explode(F.array(*[F.lit(x) for x in NOISE])).alias("cond"))
    kws = F.transform("ls", lambda l: F.split(l, " "))
    last2 = F.when(F.size("ls") <= 2, F.col("ls")).otherwise(F.slice("ls", -2, 2))
    return c.select("conv_id", "turn", "cond", X.condition_prompt(F.col("cond"), kws, F.col("ls"), last2).alias("prompt"))


@query("txt17_slugify", r"""WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(CASE WHEN coalesce(url, '') = '' THEN 'unit' ELSE url END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN s[1:32] = '' THEN 'unit' ELSE s[1:32] END AS slug FROM s""")
def txt17(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slugify(F.col("url")).alias("slug"))


@query("txt18_clean_pages", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(html, '</p>'), lambda x: x), chr(10) || chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM pages),
t AS (SELECT page_id, regexp_replace(t, '\A[\s]+|[\s]+\z', '', 'g') AS t FROM p)
SELECT page_id, CASE WHEN t = '' THEN NULL ELSE t END AS whole, CASE WHEN t = '' THEN NULL ELSE t[1:2000] END AS cleaned, length(t) > 2000 AS truncated FROM t""")
def txt18(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.split("html", "</p>").alias("parts"))
    p = p.withColumn("all", X.clean_pages(F.col("parts"), None)).withColumn("cut", X.clean_pages(F.col("parts"), 2000))
    return p.select("page_id", F.col("all.text").alias("whole"), F.col("cut.text").alias("cleaned"), "cut.truncated")


@query("txt19_mmss", "SELECT event_id, printf('%02d:%02d', trunc(value * 10)::BIGINT // 60, trunc(value * 10)::BIGINT % 60) AS stamp FROM events")
def txt19(spark, sf):
    return table(spark, sf, "events").select("event_id", X.mmss(F.col("value") * 10).alias("stamp"))


@query("mth1_realtime", """SELECT o_orderkey, round_even(sqrt(o_totalprice) * 3, 1) AS elapsed_s,
  CASE WHEN sqrt(o_totalprice) * 3 <> 0 THEN round_even(o_custkey::DOUBLE / (sqrt(o_totalprice) * 3), 2) END AS realtime_factor,
  CASE WHEN o_custkey <> 0 THEN round_even((sqrt(o_totalprice) * 3) / o_custkey, 3) END AS rtf FROM orders""")
def mth1(spark, sf):
    elapsed, factor, rtf = S.realtime(F.col("o_custkey").cast("double"), F.sqrt("o_totalprice") * 3)
    return table(spark, sf, "orders").select("o_orderkey", elapsed.alias("elapsed_s"), factor.alias("realtime_factor"), rtf.alias("rtf"))
