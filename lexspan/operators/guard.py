"""Choosing between a baseline and a conditioned hypothesis, and tuning the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import word_count

# fixed values
D_LOGPROB, MAX_CR, LEN_RATIO = 0.25, 2.0, 1.5
GRID_D_LOGPROB = (0.05, 0.10, 0.15, 0.25)
GRID_MAX_CR = (2.0, 2.4, 100.0)
GRID_LEN_RATIO = (1.5, 2.0, 100.0)


def should_revert(
    text: Column, logprob: Column, compression: Column,
    base_text: Column, base_logprob: Column,
    d_logprob: float = D_LOGPROB, max_cr: float = MAX_CR, len_ratio: float = LEN_RATIO,
) -> Column:
    """True when confidence drops, compression explodes or the text runs away.
    A clause whose inputs are missing does not fire."""
    base_words = word_count(base_text)
    off = F.lit(False)
    return (
        F.coalesce(logprob < base_logprob - F.lit(d_logprob), off)
        | F.coalesce(compression > F.lit(max_cr), off)
        | F.coalesce((base_words > 0) & (word_count(text) > F.lit(len_ratio) * base_words), off)
    )


def _with_baseline(prompted: DataFrame, base: DataFrame) -> DataFrame:
    b = base.select("utt_id", F.col("hyp").alias("base_hyp"), F.col("avg_logprob").alias("base_logprob"),
                    F.lit(True).alias("has_base"))
    return prompted.join(b, "utt_id", "left")


def apply_guard(prompted: DataFrame, base: DataFrame, d_logprob: float = D_LOGPROB, max_cr: float = MAX_CR,
                len_ratio: float = LEN_RATIO) -> DataFrame:
    """Fall back to the baseline hypothesis where the guard fires; without a
    baseline row there is nothing to fall back to."""
    revert = should_revert(F.col("hyp"), F.col("avg_logprob"), F.col("compression_ratio"),
                           F.col("base_hyp"), F.col("base_logprob"), d_logprob, max_cr, len_ratio)
    fallback = F.coalesce(F.col("has_base"), F.lit(False)) & revert
    keep = [c for c in prompted.columns if c not in ("hyp", "fallback")]
    return _with_baseline(prompted, base).select(
        *keep, F.when(fallback, F.col("base_hyp")).otherwise(F.col("hyp")).alias("hyp"), fallback.alias("fallback")
    )


def final_spans(spans: DataFrame, conditioned: DataFrame) -> DataFrame:
    """Final text per span: conditioned unless reverted; a span without a
    conditioned pass (no index) keeps its baseline, no units and no flag.

    ``spans``: lecture_id, index, start_s, end_s, text, avg_logprob, compression_ratio.
    ``conditioned``: lecture_id, index, text, avg_logprob, compression_ratio,
    retrieved_unit_ids, prompt_tokens.
    """
    c = conditioned.select(
        "lecture_id", "index", F.col("text").alias("c_text"), F.col("avg_logprob").alias("c_lp"),
        F.col("compression_ratio").alias("c_cr"), "retrieved_unit_ids", "prompt_tokens", F.lit(True).alias("has_c"),
    )
    j = spans.join(c, ["lecture_id", "index"], "left")
    has = F.coalesce(F.col("has_c"), F.lit(False))
    reverted = has & should_revert(F.col("c_text"), F.col("c_lp"), F.col("c_cr"), F.col("text"), F.col("avg_logprob"))
    return j.select(
        "lecture_id", "index", "start_s", "end_s",
        F.when(has & ~reverted, F.col("c_text")).otherwise(F.col("text")).alias("text"),
        F.col("text").alias("baseline_text"),
        F.coalesce("retrieved_unit_ids", F.array().cast("array<string>")).alias("retrieved_unit_ids"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.when(has, F.col("c_lp")).otherwise(F.col("avg_logprob")).alias("avg_logprob"),
        F.when(has, F.col("c_cr")).otherwise(F.col("compression_ratio")).alias("compression_ratio"),
        reverted.alias("safeguard_fallback"),
    )


def config_grid(rows: DataFrame, d_logprob=GRID_D_LOGPROB, max_cr=GRID_MAX_CR, len_ratio=GRID_LEN_RATIO) -> DataFrame:
    """Every row with every grid cell, numbered in grid order."""
    cells = [(d, c, r) for d in d_logprob for c in max_cr for r in len_ratio]
    grid = F.array(*[
        F.struct(F.lit(i).alias("cell"), F.lit(d).alias("d_logprob"), F.lit(c).alias("max_cr"), F.lit(r).alias("len_ratio"))
        for i, (d, c, r) in enumerate(cells)
    ])
    return rows.select("*", F.explode(grid).alias("__g")).select(*rows.columns, "__g.*")


def sweep_guard(prompted: DataFrame, base: DataFrame, d_logprob=GRID_D_LOGPROB, max_cr=GRID_MAX_CR,
                len_ratio=GRID_LEN_RATIO) -> DataFrame:
    """Word error rate and fallback rate of every threshold cell.

    Both inputs are already scored (utt_id, hyp, avg_logprob, compression_ratio,
    errors, ref_len). A cell's outcome for a row depends only on which
    thresholds the row exceeds, so rows are first folded into those few
    classes; the grid then meets the classes and never the rows.
    """
    b = base.select("utt_id", F.col("hyp").alias("base_hyp"), F.col("avg_logprob").alias("base_logprob"),
                    F.col("errors").alias("base_errors"))
    j = prompted.join(b, "utt_id", "left")
    words, base_words = word_count(F.col("hyp")), word_count(F.col("base_hyp"))

    def passed(tests: list[Column]) -> Column:
        return F.concat(*[F.when(F.coalesce(t, F.lit(False)), "1").otherwise("0") for t in tests])

    classes = (
        j.select(
            passed([F.col("avg_logprob") < F.col("base_logprob") - F.lit(d) for d in d_logprob]).alias("lp"),
            passed([F.col("compression_ratio") > F.lit(c) for c in max_cr]).alias("cr"),
            passed([(base_words > 0) & (words > F.lit(r) * base_words) for r in len_ratio]).alias("lr"),
            F.col("base_errors").isNotNull().alias("has_base"),
            F.col("errors"), F.coalesce("base_errors", F.lit(0)).alias("base_errors"), "ref_len",
        )
        .groupBy("lp", "cr", "lr", "has_base")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"), F.sum("base_errors").alias("base_errors"),
             F.sum("ref_len").alias("ref_len"))
    )
    cells = config_grid(classes, d_logprob, max_cr, len_ratio)

    def fired(flags: str, value: str, options) -> Column:
        at = F.coalesce(*[F.when(F.col(value) == F.lit(o), F.lit(i + 1)) for i, o in enumerate(options)])
        return F.substring(F.col(flags), at, F.lit(1)) == "1"

    revert = F.col("has_base") & (
        fired("lp", "d_logprob", d_logprob) | fired("cr", "max_cr", max_cr) | fired("lr", "len_ratio", len_ratio)
    )
    return cells.groupBy("cell", "d_logprob", "max_cr", "len_ratio").agg(
        (F.sum(F.when(revert, F.col("base_errors")).otherwise(F.col("errors"))) / F.sum("ref_len")).alias("wer"),
        (F.sum(F.when(revert, F.col("n")).otherwise(0)) / F.sum("n")).alias("fallback_rate"),
    )


def best_config(table: DataFrame, keys: list[str], value: str = "wer", ordinal: str = "cell", by: list[str] | None = None) -> DataFrame:
    """The row with the smallest value, the first in grid order on ties."""
    pick = F.min_by(F.struct(*keys, value), F.struct(value, ordinal)).alias("b")
    return table.groupBy(*(by or [])).agg(pick).select(*(by or []), "b.*")


def decode_settings(trials: DataFrame, languages: list[str], ks: list[int], caps: list[int]) -> DataFrame:
    """One row: the language with the least error of C0, then of its (k, cap) trials the one with the least error of C4.

    ``trials``: cond, lang, k, cap, errors, ref_len. Ties go to the first language of the list and to the first cell of
    the grid, k before cap. A setting that was not tried is not chosen.
    """
    first = lambda c, options: F.array_position(F.array(*map(F.lit, options)), F.col(c))
    wer = (F.sum("errors") / F.sum("ref_len")).alias("wer")
    by_lang = trials.filter("cond = 'C0'").groupBy("lang").agg(wer).filter(first("lang", languages) > 0)
    best = by_lang.agg(F.min_by(F.struct("lang", "wer"), F.struct("wer", first("lang", languages))).alias("b"))
    lang = best.select("b.lang", F.col("b.wer").alias("c0_wer"))
    cells = trials.filter("cond = 'C4'").groupBy("lang", "k", "cap").agg(wer).filter((first("k", ks) > 0) & (first("cap", caps) > 0))
    pick = F.min_by(F.struct("k", "cap", "wer"), F.struct("wer", first("k", ks), first("cap", caps))).alias("p")
    return cells.join(lang, "lang").groupBy("lang", "c0_wer").agg(pick).select("lang", "c0_wer", "p.k", "p.cap", F.col("p.wer").alias("c4_wer"))
