"""Stand-in tables for the registered queries, in Spark and in SQL.

The given tables hold no lectures, so each concept is derived from them: a
conversation is a lecture, its turns are spans, its sentences are utterances,
and hypotheses are the utterances with seeded word noise. Every derivation is
row-local and covers whole tables and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.functions.draws import numbered
from lexspan.functions.seeded import seeded_hash
from lexspan.functions.text import DEVANAGARI_DIGITS, PUNCTUATION, normalize
from lexspan.session import by_rows, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


TEXT_KEYS = {"conversations": ["conv_id", "turn"], "documents": ["doc_id"], "pages": ["page_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Text tables are spread over the cores when their files give
    fewer splits than that, since the work per row is heavy; a table of many
    splits is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_KEYS:
        return spread(df, TEXT_KEYS[name])
    return df


# --- SQL building blocks -----------------------------------------------------
def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::BIGINT"


WS_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm_sql(x: str) -> str:
    src = (DEVANAGARI_DIGITS + PUNCTUATION).replace("'", "''")
    dst = "0123456789" + " " * len(PUNCTUATION)
    return (
        f"trim(regexp_replace(translate(lower(nfc_normalize(coalesce({x}, ''))), '{src}', '{dst}'), "
        f"'{WS_SQL}+', ' ', 'g'))"
    )


def words_sql(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS_SQL}+'), lambda w: w <> '')"


def word_distance_sql(source: str, r: str = "r", h: str = "h") -> str:
    """Select everything of ``source`` plus the word edit distance of two lists.

    DuckDB's levenshtein counts bytes, so every shared word gets one ASCII code
    (sentences share far fewer than the 124 available)."""
    return f"""
  SELECT * EXCLUDE (v_), levenshtein(
      array_to_string(list_transform({r}, lambda x: chr(CASE WHEN list_contains(v_, x) THEN list_position(v_, x)::INT + 2 ELSE 2 END)), ''),
      array_to_string(list_transform({h}, lambda x: chr(CASE WHEN list_contains(v_, x) THEN list_position(v_, x)::INT + 2 ELSE 1 END)), '')) AS errors
  FROM (SELECT *, list_distinct(list_intersect({r}, {h})) AS v_ FROM {source})"""


# --- utterances ----------------------------------------------------------------
UTTS = """sents_ AS (
  SELECT conv_id, turn, role, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS sents
  FROM conversations),
durs_ AS (SELECT *, list_transform(sents, lambda s: 0.5::DOUBLE * len(regexp_split_to_array(s, ' +'))) AS durs FROM sents_),
utts AS (
  SELECT printf('%08d_%06d', conv_id, turn * 1000 + i - 1) AS utt_id, printf('%08d', conv_id) AS lecture_id, conv_id, turn, role,
    sents[i] AS ref, turn * 1000.0::DOUBLE + coalesce(list_sum(durs[1:i-1]), 0) AS "start", turn * 1000.0::DOUBLE + list_sum(durs[1:i]) AS "end"
  FROM durs_, unnest(range(1, len(sents) + 1)) AS t(i))"""


#: Turns of a task: some 80,000 hypotheses.
TURNS = 2_000


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """utt_id, lecture_id, conv_id, turn, role, ref, start, end."""
    sents = F.filter(F.transform(F.split("text", "[.\\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    durs = F.transform("sents", lambda s: F.size(F.split(s, " +")) * F.lit(0.5))
    add = lambda a, v: a + v
    until = lambda i: F.col("turn") * F.lit(1000.0) + F.aggregate(F.slice("durs", F.lit(1), i), F.lit(0.0), add)
    turns = by_rows(spark.read.parquet(f"{sf}/conversations.parquet"), TEXT_KEYS["conversations"], TURNS)
    return (
        turns
        .select("conv_id", "turn", "role", sents.alias("sents"))
        .withColumn("durs", durs)
        .select("conv_id", "turn", "role", F.explode(F.transform(
            "sents", lambda s, i: F.struct(i.alias("no"), s.alias("ref"), until(i).alias("start"), until(i + 1).alias("end"))
        )).alias("u"))
        .select(
            F.format_string("%08d_%06d", "conv_id", F.col("turn") * 1000 + F.col("u.no")).alias("utt_id"),
            F.format_string("%08d", "conv_id").alias("lecture_id"), "conv_id", "turn", "role", "u.ref", "u.start", "u.end",
        )
    )


def utt_block(column: str = "utt_id") -> Column:
    """Lecture and thousand of the zero-padded sequence: at most 10 000 ids."""
    return F.substring(column, 1, 11)


# --- hypotheses ------------------------------------------------------------------
NOISE = {"C0": 9000, "C1": 9600, "C2": 12000, "C3": 8100, "C4": 6000, "C5": 7500, "C6": 4800, "C7": 6900}
SPLIT_SQL = "CASE WHEN role = 'user' THEN 'dev' ELSE 'test' END"

HYPS = UTTS + """,
noise_ AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {n})" for c, n in NOISE.items()) + """) v(cond, noise)),
raw_ AS (
  SELECT utts.*, cond, noise, """ + hash_sql("utt_id", "cond") + """ AS hs,
    list_transform(regexp_split_to_array(ref, ' +'), lambda w, i: {'w': w, 'h': ('0x' || substr(md5(concat_ws('-', utt_id, cond, i)), 1, 4))::INT}) AS ws
  FROM utts, noise_),
once_ AS (
  SELECT *, flatten(list_transform(ws, lambda x: CASE
      WHEN x.h * 3 < noise THEN [] WHEN x.h * 3 < noise * 2 THEN [reverse(x.w)]
      WHEN x.h < noise THEN [x.w, x.w] ELSE [x.w] END)) AS out_
  FROM raw_),
hyps AS (
  SELECT 'm1' AS model, cond, """ + SPLIT_SQL + """ AS split, utt_id, lecture_id, ref,
    array_to_string(CASE WHEN hs % 29 = 0 THEN list_concat(out_, out_) ELSE out_ END, ' ') AS hyp,
    CASE WHEN hs % 17 <> 0 THEN -(hs % 1000) / 1000.0::DOUBLE END AS avg_logprob,
    CASE WHEN hs % 19 <> 0 THEN 1 + (hs % 1300) / 1000.0::DOUBLE END AS compression_ratio,
    CASE WHEN cond <> 'C0' THEN (hs % 200)::INT END AS prompt_tokens,
    CASE WHEN cond = 'C7' THEN hs % 5 = 0 END AS fallback
  FROM once_)"""


@F.arrow_udf(T.StringType())
def with_noise(utt_id: pa.Array, cond: pa.Array, ref: pa.Array, again: pa.Array) -> pa.Array:
    """The words of a reference, some left out, turned round or said twice as the digests of their places say; all of it once more if ``again``."""
    conds = cond.to_pylist()
    words = [re.split(" +", r) if "  " in r else r.split(" ") for r in ref.to_pylist()]
    counts = np.array([len(w) for w in words], np.int64)
    h = numbered([f"{u}-{c}-".encode() for u, c in zip(utt_id.to_pylist(), conds)], counts)
    noise = np.repeat(np.array([NOISE[c] for c in conds], np.int64), counts)
    ends = np.cumsum(counts)
    changed = np.flatnonzero(h < noise)
    row = np.searchsorted(ends, changed, side="right")
    place = changed - (ends - counts)[row]
    kind = np.where(h[changed] * 3 < noise[changed], 0, np.where(h[changed] * 3 < noise[changed] * 2, 1, 2))
    # from the last to the first, so that places before stay as they are
    for i, at, k in zip(row[::-1].tolist(), place[::-1].tolist(), kind[::-1].tolist()):
        w = words[i]
        if k == 0:
            del w[at]
        elif k == 1:
            w[at] = w[at][::-1]
        else:
            w.insert(at, w[at])
    return pa.array([" ".join(w + w if a else w) for w, a in zip(words, again.to_pylist())], pa.string())


def hypotheses(spark: SparkSession, sf: str, conds: tuple[str, ...] = tuple(NOISE), normalized: bool = False) -> DataFrame:
    """Noisy copies of every utterance, one per condition; ``normalized`` adds nref, made once per utterance."""
    refs = utterances(spark, sf)
    refs = refs.withColumn("nref", normalize(F.col("ref"))) if normalized else refs
    u = refs.select("*", F.explode(F.array(*[F.lit(c) for c in conds])).alias("cond")).withColumn(
        "hs", seeded_hash(F.col("utt_id"), F.col("cond")))
    hs = F.col("hs")
    return u.select(
        F.lit("m1").alias("model"), "cond", F.when(F.col("role") == "user", "dev").otherwise("test").alias("split"),
        "utt_id", "lecture_id", "ref", *(["nref"] if normalized else []), with_noise("utt_id", "cond", "ref", hs % 29 == 0).alias("hyp"),
        F.when(hs % 17 != 0, -(hs % 1000) / 1000.0).alias("avg_logprob"),
        F.when(hs % 19 != 0, 1 + (hs % 1300) / 1000.0).alias("compression_ratio"),
        F.when(F.col("cond") != "C0", (hs % 200).cast("int")).alias("prompt_tokens"),
        F.when(F.col("cond") == "C7", hs % 5 == 0).alias("fallback"),
    )


def nhyps_sql(name: str = "nh", source: str = "hyps") -> str:
    """CTE with normalised texts and word lists r, h."""
    return f"""{name}_ AS (SELECT *, {norm_sql('ref')} AS nref, {norm_sql('hyp')} AS nhyp FROM {source}),
{name} AS (SELECT *, {words_sql('nref')} AS r, {words_sql('nhyp')} AS h FROM {name}_)"""


# --- corpus files ------------------------------------------------------------------
CORPUS = UTTS + """,
text_ AS (SELECT utt_id AS utt, ref AS transcript FROM utts),
segments_ AS (SELECT utt_id AS utt, lecture_id AS rec, "start", "end" FROM utts WHERE """ + hash_sql("utt_id", "'seg'") + """ % 50 <> 0),
recordings_ AS (SELECT printf('%08d', c_custkey) AS rec, '/audio/' || c_name || '.wav' AS path FROM customer WHERE c_acctbal > 0),
joined AS (
  SELECT utt, s.rec, path, "start", "end", transcript, s.utt IS NOT NULL AS has_segment, r.rec IS NOT NULL AS has_wav
  FROM (SELECT t.utt, t.transcript FROM text_ t) t LEFT JOIN segments_ s USING (utt) LEFT JOIN recordings_ r ON s.rec = r.rec),
flagged AS (
  SELECT *, CASE WHEN NOT has_segment THEN 'no_segment' WHEN NOT has_wav THEN 'no_wav_entry'
      WHEN NOT ("end" - "start" BETWEEN 2.0 AND 28.0) THEN 'duration'
      WHEN len(""" + tokens_sql("transcript") + """) < 4 THEN 'too_few_words' END AS reason FROM joined),
kept AS (
  SELECT utt AS utt_id, rec AS lecture_id, path AS wav, "start", "end", round_even(("end" - "start")::DOUBLE, 2) AS dur, transcript AS ref
  FROM flagged WHERE reason IS NULL)"""


def corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text, segments, recordings): some utterances lack a segment, and the
    lectures of customers in debt lack a recording."""
    u = utterances(spark, sf)
    text = u.select(F.col("utt_id").alias("utt"), F.col("ref").alias("transcript"))
    segments = u.filter(seeded_hash(F.col("utt_id"), "seg") % 50 != 0).select(
        F.col("utt_id").alias("utt"), F.col("lecture_id").alias("rec"), "start", "end")
    recordings = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.format_string("%08d", "c_custkey").alias("rec"), F.concat(F.lit("/audio/"), "c_name", F.lit(".wav")).alias("path"))
    return text, segments, recordings


# --- spans, notes, units ------------------------------------------------------------
SPANS = """spans AS (
  SELECT conv_id AS lecture_id, turn AS index, turn * 25.0::DOUBLE AS start_s, turn * 25.0::DOUBLE + 25 AS end_s, text, role,
    list_transform(range(0, 3), lambda j: 'u' || (('0x' || substr(md5(concat_ws('-', conv_id, turn, j)), 1, 8))::BIGINT % 25)) AS retrieved_unit_ids
  FROM conversations),
lectures AS (SELECT conv_id AS lecture_id, any_value(conv_id % 5)::INT AS subject_id, 'Lecture ' || conv_id AS lecture_title, max(turn) * 25.0::DOUBLE + 25 AS duration_s
  FROM conversations GROUP BY conv_id),
subjects AS (SELECT r_regionkey AS subject_id, r_name AS subject_name FROM region),
units AS (SELECT n_regionkey AS subject_id, 'u' || n_nationkey AS unit_id, 'k' || n_nationkey AS unit_key, n_name AS title, n_nationkey AS order_index FROM nation),
notes_ AS (SELECT *, """ + hash_sql("conv_id", "turn", "'note'") + """ AS h FROM conversations WHERE role = 'user'),
notes AS (
  SELECT conv_id * 100 + turn AS note_id, conv_id AS lecture_id, (conv_id % 5)::INT AS subject_id,
    CASE WHEN h % 13 <> 0 THEN CASE WHEN h % 7 = 0 THEN turn + h % 3 ELSE turn END END AS raw_first,
    CASE WHEN h % 11 <> 0 THEN CASE WHEN h % 7 = 0 THEN turn ELSE turn + h % 3 END END AS raw_last,
    'topic ' || turn AS topic, text AS markdown, CASE WHEN h % 3 <> 0 THEN ' k' || (h % 25) || ' ' END AS suggested_unit_key,
    CASE WHEN h % 9 = 0 THEN NULL WHEN h % 10 = 0 THEN 'gone' ELSE 'u' || (h % 13) END AS unit_id,
    turn * 25.0::DOUBLE AS start_s, CASE WHEN h % 4 <> 0 THEN turn * 25.0::DOUBLE + 25 END AS end_s
  FROM notes_),
ranged AS (
  SELECT *, least(coalesce(raw_first, 0), coalesce(raw_last, raw_first, 0)) AS first_span,
    greatest(coalesce(raw_first, 0), coalesce(raw_last, raw_first, 0)) AS last_span FROM notes)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    ids = F.transform(F.array(*[F.lit(j) for j in range(3)]), lambda j: F.concat(
        F.lit("u"), (seeded_hash(F.col("conv_id"), F.col("turn"), j) % 25).cast("string")))
    return c.select(F.col("conv_id").alias("lecture_id"), F.col("turn").alias("index"), (F.col("turn") * 25.0).alias("start_s"),
                    (F.col("turn") * 25.0 + 25).alias("end_s"), "text", "role", ids.alias("retrieved_unit_ids"))


def lectures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("lecture_id")).agg(
        (F.max("turn") * 25.0 + 25).alias("duration_s")).select(
        "lecture_id", (F.col("lecture_id") % 5).cast("int").alias("subject_id"),
        F.concat(F.lit("Lecture "), F.col("lecture_id").cast("string")).alias("lecture_title"), "duration_s")


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("subject_id"), F.col("r_name").alias("subject_name"))


def units(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("subject_id"), F.concat(F.lit("u"), n).alias("unit_id"), F.concat(F.lit("k"), n).alias("unit_key"),
        F.col("n_name").alias("title"), F.col("n_nationkey").alias("order_index"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    h, turn = F.col("h"), F.col("turn")
    swapped = h % 7 == 0
    return table(spark, sf, "conversations").filter("role = 'user'").withColumn(
        "h", seeded_hash(F.col("conv_id"), turn, "note")).select(
        (F.col("conv_id") * 100 + turn).alias("note_id"), F.col("conv_id").alias("lecture_id"),
        (F.col("conv_id") % 5).cast("int").alias("subject_id"),
        F.when(h % 13 != 0, F.when(swapped, turn + h % 3).otherwise(turn)).alias("raw_first"),
        F.when(h % 11 != 0, F.when(swapped, turn).otherwise(turn + h % 3)).alias("raw_last"),
        F.concat(F.lit("topic "), turn.cast("string")).alias("topic"), F.col("text").alias("markdown"),
        F.when(h % 3 != 0, F.concat(F.lit(" k"), (h % 25).cast("string"), F.lit(" "))).alias("suggested_unit_key"),
        F.when(h % 9 == 0, F.lit(None).cast("string")).when(h % 10 == 0, "gone").otherwise(F.concat(F.lit("u"), (h % 13).cast("string"))).alias("unit_id"),
        (turn * 25.0).alias("start_s"), F.when(h % 4 != 0, turn * 25.0 + 25).alias("end_s"))


def ranged_notes(spark: SparkSession, sf: str) -> DataFrame:
    from lexspan.operators.coverage import span_range

    first, last = span_range(F.col("raw_first"), F.col("raw_last"))
    return notes(spark, sf).withColumn("first_span", first).withColumn("last_span", last)


# --- vectors --------------------------------------------------------------------------
VECTORS = """items AS (
  SELECT vec_id AS id, label AS subject_id, vec_id % 7 AS lecture_id, CASE WHEN vec_id % 3 = 0 THEN 'note' ELSE 'span' END AS kind,
    CASE WHEN vec_id % 5 <> 0 THEN 'Lecture ' || (vec_id % 7) END AS lecture_title, CASE WHEN vec_id % 11 <> 0 THEN vec_id * 3.0::DOUBLE END AS start_s,
    vec_id * 3.0::DOUBLE + 25 AS end_s, CASE WHEN vec_id % 3 = 0 THEN vec_id END AS note_id, 'text of ' || vec_id AS text, embedding::DOUBLE[] AS embedding
  FROM embeddings),
questions AS (
  SELECT vec_id AS question_id, label AS subject_id, CASE WHEN vec_id % 4 = 3 THEN vec_id % 7 END AS only_lecture,
    vec_id % 2 = 1 AS wants_notes, embedding::DOUBLE[] AS vector FROM embeddings)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("id"), F.col("label").alias("subject_id"), (v % 7).alias("lecture_id"),
        F.when(v % 3 == 0, "note").otherwise("span").alias("kind"),
        F.when(v % 5 != 0, F.concat(F.lit("Lecture "), (v % 7).cast("string"))).alias("lecture_title"),
        F.when(v % 11 != 0, v * 3.0).alias("start_s"), (v * 3.0 + 25).alias("end_s"), F.when(v % 3 == 0, v).alias("note_id"),
        F.concat(F.lit("text of "), v.cast("string")).alias("text"), F.col("embedding").cast("array<double>").alias("embedding"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every item asks, with its own vector."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("question_id"), F.col("label").alias("subject_id"), F.when(v % 4 == 3, v % 7).alias("lecture_id"),
        (v % 2 == 1).alias("wants_notes"), F.col("embedding").cast("array<double>").alias("vector"))


# --- mixed-script text ------------------------------------------------------------------
LATIN_KEYS, DEVANAGARI_KEYS = "abcdefghiklmnoprstuvy", "ाबचदेफगहिकलमनोपरसतुवय"


def mixed_script(text: Column, devanagari: Column) -> Column:
    """Latin letters respelt with Devanagari ones where ``devanagari`` holds."""
    return F.when(devanagari, F.translate(F.lower(text), LATIN_KEYS, DEVANAGARI_KEYS)).otherwise(text)


def mixed_script_sql(text: str, devanagari: str) -> str:
    return f"CASE WHEN {devanagari} THEN translate(lower({text}), '{LATIN_KEYS}', '{DEVANAGARI_KEYS}') ELSE {text} END"
