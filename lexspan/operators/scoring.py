"""Error rates of hypotheses against references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexspan.functions.align import (
    alignment_ops, char_edit_distance, with_edit_distance, word_distance, words_and_steps,
)
from lexspan.functions.text import norm_words, normalize, script_of, with_script_counts, with_skeletons

GROUP = ["model", "cond", "split"]

# decimal digits of all scripts, and what else counts as a digit: superscripts, subscripts, circled and bracketed ones, and a few scripts' own
DIGIT = ("[\\p{Nd}\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c\u2488-\u2490"
         "\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792]")


def with_normalized(pairs: DataFrame, compose: bool = True) -> DataFrame:
    """Add nref, unless it is there, and nhyp."""
    if "nref" not in pairs.columns:
        pairs = pairs.withColumn("nref", normalize(F.col("ref"), compose))
    return pairs.withColumn("nhyp", normalize(F.col("hyp"), compose))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def word_errors(pairs: DataFrame) -> DataFrame:
    """errors and ref_len of every pair (needs nref, nhyp)."""
    spaces = F.length("nref") - F.length(F.translate("nref", " ", ""))
    return pairs.withColumn("errors", word_distance("nref", "nhyp")).withColumn("ref_len", F.when(F.col("nref") == "", 0).otherwise(spaces + 1))


def per_utterance(pairs: DataFrame) -> DataFrame:
    """utt_id, errors, ref_len and wer (NULL for an empty reference)."""
    return word_errors(pairs).withColumn("wer", _ratio(F.col("errors"), F.col("ref_len")))


def corpus_wer(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Σ edits / Σ reference words."""
    return word_errors(pairs).groupBy(*by).agg(_ratio(F.sum("errors"), F.sum("ref_len")).alias("wer"))


def corpus_cer(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Σ character edits / Σ reference characters; spaces count."""
    return pairs.groupBy(*by).agg(
        _ratio(F.sum(char_edit_distance(F.col("nref"), F.col("nhyp"))), F.sum(F.length("nref"))).alias("cer")
    )


def corpus_wer_sa(pairs: DataFrame, by: list[str], transliterate: bool = True) -> DataFrame:
    """Word error rate over script-agnostic text."""
    return script_agnostic_errors(pairs, transliterate).groupBy(*by).agg(
        _ratio(F.sum("sa_errors"), F.sum("sa_len")).alias("wer_sa")
    )


def script_agnostic_errors(pairs: DataFrame, transliterate: bool = True) -> DataFrame:
    """sa_errors and sa_len of every pair over consonant skeletons."""
    sk = with_skeletons(with_skeletons(pairs, "nref", "sk_ref", transliterate), "nhyp", "sk_hyp", transliterate)
    return with_edit_distance(sk, F.col("sk_ref"), F.col("sk_hyp"), "sa_errors", "sa_len").drop("sk_ref", "sk_hyp")


def keyword_vocabulary(keywords: DataFrame, column: str = "keyword", compose: bool = True) -> DataFrame:
    """Distinct normalised tokens of all keywords; several words count singly."""
    return keywords.select(F.explode(norm_words(normalize(F.col(column), compose))).alias("word")).distinct()


def vocabulary_membership(texts: DataFrame, vocabulary: DataFrame, key: str, column: str) -> DataFrame:
    """How many normalised words of each text are in the vocabulary, and how many are not; a text without words gives no row."""
    words = texts.select(key, F.explode(norm_words(normalize(F.col(column)))).alias("word"))
    words = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    known = vocabulary.select("word").distinct().withColumn("__k", F.lit(1))
    k = F.coalesce(F.sum(F.when(F.col("__k") == 1, F.col("n"))), F.lit(0))
    return words.join(known, "word", "left").groupBy(key).agg(k.alias("k_words"), (F.sum("n") - k).alias("u_words"))


def with_alignment(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ops", alignment_ops("nref", "nhyp"))


#: Reference words that a task counts before it passes the counts on.
COUNTED_WORDS = 1_000_000


def _step_counts(aligned: DataFrame, by: list[str], totals: dict[str, Column] | None = None) -> DataFrame:
    """Counts per group, reference word and whether the step that consumed it was an error, and the group's totals.

    Words are counted in the tasks, so no row per word is made. A row without a word carries a group's insertions, its
    errors and reference words, and the sums of ``totals``. So each alignment is made once and read once.
    """
    totals = totals or {}
    more = list(totals)
    sums = ["errors", "ref_words", *more]
    rows = aligned.select(*by, "nref", "ops", *[v.cast("long").alias(c) for c, v in totals.items()])
    types = rows.schema
    schema = T.StructType([types[c] for c in by] + [T.StructField("word", T.StringType()), T.StructField("wrong", T.BooleanType())]
                          + [T.StructField(c, T.LongType()) for c in ["n", *sums]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Table] = []
        groups: list[pa.Table] = []
        held = 0

        def counted() -> pa.RecordBatch:
            w = pa.concat_tables(words).group_by([*by, "word", "wrong"]).aggregate([("n", "sum")])
            g = pa.concat_tables(groups).group_by(by).aggregate([(c, "sum") for c in ["n", *sums]])
            columns = []
            for f in schema:
                parts = [t[f.name] if f.name in t.column_names else t[f.name + "_sum"] if f.name + "_sum" in t.column_names else None for t in (w, g)]
                kind = to_arrow_type(f.dataType)
                columns.append(pa.concat_arrays([pa.nulls(t.num_rows, kind) if p is None else c.cast(kind)
                                                 for p, t in zip(parts, (w, g)) for c in ([p] if p is None else p.chunks)] or [pa.nulls(0, kind)]))
            return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

        for b in batches:
            if not b.num_rows:
                continue
            text, at, step, s_at = words_and_steps(b.column("nref"), b.column("ops"))
            row = np.repeat(np.arange(b.num_rows), np.diff(s_at))
            sizes = lambda some: np.bincount(row[some], minlength=b.num_rows)
            inserted = step == ord("I")
            of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(at)))
            words.append(pa.table([*[b.column(c).take(of) for c in by], text, pa.array(step[~inserted] != ord("E")), pa.array(np.ones(len(text), np.int64))],
                                  names=[*by, "word", "wrong", "n"]))
            groups.append(pa.table([*[b.column(c) for c in by], pa.array(sizes(inserted)), pa.array(sizes(step != ord("E"))), pa.array(sizes(~inserted)),
                                    *[b.column(c) for c in more]], names=[*by, "n", *sums]))
            held += len(text)
            if held >= COUNTED_WORDS:
                yield counted()
                words, groups, held = [], [], 0
        if groups:
            yield counted()

    return rows.mapInArrow(count, schema).groupBy(*by, "word", "wrong").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


def _split_columns(counts: DataFrame, vocabulary: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Error split by vocabulary membership, insertion rate and script fidelity from step counts.

    Only the counts meet the vocabulary, so a frequent word crosses the join once per group and step.
    """
    known = vocabulary.select("word").distinct().withColumn("__k", F.lit(True))
    marked = counts.join(known, "word", "left")
    word = F.col("word").isNotNull()
    k, err = word & F.coalesce(F.col("__k"), F.lit(False)), F.col("wrong")
    u = word & ~k
    lat = word & (script_of(F.col("word")) == "lat")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    split = marked.groupBy(*by).agg(
        add(k).alias("k_n"), add(k & err).alias("k_err"), add(u).alias("u_n"), add(u & err).alias("u_err"),
        add(lat).alias("lat_n"), add(lat & ~err).alias("lat_ok"), add(~word).alias("ins"), *more,
    )
    return split.withColumns({
        "k_wer": _ratio(F.col("k_err"), F.col("k_n")), "u_wer": _ratio(F.col("u_err"), F.col("u_n")),
        "ins_rate": F.col("ins") / F.greatest(F.lit(1), F.col("k_n") + F.col("u_n")),
        "script_fidelity": _ratio(F.col("lat_ok"), F.col("lat_n")),
    })


def vocabulary_errors(aligned: DataFrame, vocabulary: DataFrame, by: list[str]) -> DataFrame:
    """Error split by vocabulary membership, insertion rate, script fidelity."""
    return _split_columns(_step_counts(aligned, by), vocabulary, by).select(
        *by, "k_wer", "k_n", "u_wer", "u_n", "ins_rate", "script_fidelity", "lat_n")


def condition_summary(pairs: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Utterances, mean prompt tokens (NULL counts 0), fallback rate where flagged."""
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col("prompt_tokens"), F.lit(0))).alias("mean_prompt_tokens"),
        F.avg(F.col("fallback").cast("int")).alias("fallback_rate"),
    )


def score_table(pairs: DataFrame, vocabulary: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """The full score row per group, from one pass over the alignments."""
    n = script_agnostic_errors(with_alignment(with_normalized(pairs)))
    totals = {
        "pairs": F.lit(1), "sa_errors": F.col("sa_errors"), "sa_len": F.col("sa_len"),
        "char_errors": char_edit_distance(F.col("nref"), F.col("nhyp")), "ref_chars": F.length("nref"),
        "tokens": F.coalesce(F.col("prompt_tokens"), F.lit(0)), "fell": F.col("fallback").cast("int"), "flagged": F.col("fallback").isNotNull().cast("int"),
    }
    out = _split_columns(_step_counts(n, by, totals), vocabulary, by, *[F.sum(c).alias(c) for c in ["errors", "ref_words", *totals]])
    return out.select(
        *by, F.col("pairs").alias("n"), _ratio(F.col("errors"), F.col("ref_words")).alias("wer"), _ratio(F.col("sa_errors"), F.col("sa_len")).alias("wer_sa"),
        _ratio(F.col("char_errors"), F.col("ref_chars")).alias("cer"), "k_wer", "k_n", "u_wer", "u_n", "ins_rate", "script_fidelity", "lat_n",
        (F.col("tokens") / F.col("pairs")).alias("mean_prompt_tokens"), _ratio(F.col("fell"), F.col("flagged")).alias("fallback_rate"),
    )


def segment_rollup(segments: Column) -> tuple[Column, Column]:
    """(mean of known avg_logprob, max of known compression_ratio) of an array of
    ``struct<avg_logprob, compression_ratio>``; NULL when there is none."""
    lp = F.filter(F.transform(segments, lambda s: s["avg_logprob"]), lambda v: v.isNotNull())
    cr = F.filter(F.transform(segments, lambda s: s["compression_ratio"]), lambda v: v.isNotNull())
    mean = F.when(F.size(lp) > 0, F.aggregate(lp, F.lit(0.0), lambda a, v: a + v) / F.size(lp))
    return mean, F.array_max(cr)


def lecture_stats(spans: DataFrame, durations: DataFrame, compose: bool = True) -> DataFrame:
    """Per lecture: spans, mean span length, fallbacks, script mix of the whole
    text. Token counts add over spans, so no text is ever concatenated."""
    sums = with_script_counts(spans, F.col("text"), compose).groupBy("lecture_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.bool_or(F.col("conditioned")).alias("conditioned"),
        F.sum(F.col("safeguard_fallback").cast("int")).alias("safeguard_fallbacks"),
        *[F.sum(k).alias(k) for k in ("dev", "lat", "other", "total")],
    )
    share = lambda k: F.bround(F.when(F.col("total") > 0, F.col(k) / F.col("total")).otherwise(0.0), 4)
    return sums.join(durations, "lecture_id").select(
        "lecture_id", "n_spans", F.bround(F.col("duration_s") / F.greatest(F.lit(1), F.col("n_spans")), 2).alias("mean_span_s"),
        "conditioned", "safeguard_fallbacks",
        F.bround(F.col("safeguard_fallbacks") / F.greatest(F.lit(1), F.col("n_spans")), 4).alias("safeguard_fallback_rate"),
        *[share(k).alias(k) for k in ("dev", "lat", "other")],
    )


def realtime(audio_s: Column, elapsed_s: Column) -> tuple[Column, Column, Column]:
    """(elapsed, audio per elapsed second, elapsed per audio second), rounded."""
    return (
        F.bround(elapsed_s, 1),
        F.when(elapsed_s != 0, F.bround(audio_s / elapsed_s, 2)),
        F.when(audio_s != 0, F.bround(elapsed_s / audio_s, 3)),
    )


def text_profile(rows: DataFrame, column: str, compose: bool = True) -> DataFrame:
    """Mean script shares per row, and rows that contain a digit."""
    share = lambda k: F.avg(F.when(F.col("total") > 0, F.col(k) / F.col("total")).otherwise(0.0))
    return with_script_counts(rows.select(column), F.col(column), compose).agg(
        F.count(F.lit(1)).alias("n"), *[share(k).alias(k) for k in ("dev", "lat", "other")],
        F.sum(F.col(column).rlike(DIGIT).cast("int")).alias("with_digits"),
    )


def review_sample(rows: DataFrame, n: int = 20, compose: bool = True) -> DataFrame:
    """The first ``n`` evaluated rows, raw and normalised, for reading."""
    return rows.filter("in_eval").orderBy("utt_id").limit(n).select(
        "utt_id", "ref", normalize(F.col("ref"), compose).alias("nref"), "hyp", normalize(F.col("hyp"), compose).alias("nhyp")
    )
