"""Utterance manifests: reject rules, splits, stratified samples, course lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.seeded import md5_mod, seeded_digest
from lexspan.functions.text import word_count
from lexspan.operators.ordered import first_n, ordered
from lexspan.session import durable

# fixed values
SEED = 1337
MIN_DUR, MAX_DUR, MIN_WORDS = 2.0, 28.0, 4
DEV_FRACTION = 0.30
N_TITLE_UTTS = 2



def join_corpus(text: DataFrame, segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Transcript ⋈ segment ⋈ recording; misses stay as rows with NULLs."""
    seg = segments.withColumn("has_segment", F.lit(True))
    rec = recordings.withColumn("has_wav", F.lit(True))
    return (
        text.join(seg, "utt", "left").join(rec, "rec", "left")
        .select("utt", "rec", "path", "start", "end", "transcript",
                F.coalesce("has_segment", F.lit(False)).alias("has_segment"),
                F.coalesce("has_wav", F.lit(False)).alias("has_wav"))
    )


def with_reject_reason(joined: DataFrame) -> DataFrame:
    """The first rule an utterance fails, NULL for a survivor."""
    dur = F.col("end") - F.col("start")
    return joined.withColumn(
        "reason",
        F.when(~F.col("has_segment"), "no_segment")
        .when(~F.col("has_wav"), "no_wav_entry")
        .when(~F.coalesce(dur.between(MIN_DUR, MAX_DUR), F.lit(False)), "duration")
        .when(word_count(F.col("transcript")) < MIN_WORDS, "too_few_words"),
    )


def survivors(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("reason").isNull()).select(
        F.col("utt").alias("utt_id"), F.col("rec").alias("lecture_id"), F.col("path").alias("wav"),
        "start", "end", F.bround(F.col("end") - F.col("start"), 2).alias("dur"), F.col("transcript").alias("ref"),
    )


def skip_report(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def lecture_split(rows: DataFrame, seed: int = SEED, fraction: float = DEV_FRACTION) -> DataFrame:
    """Lecture-disjoint dev/test: the first ``max(1, int(fraction * n))`` lectures
    of a seeded order are dev."""
    lectures = (
        rows.select("lecture_id").distinct()
        .withColumn("digest", F.concat(seeded_digest(seed, F.col("lecture_id")), F.lit("-"), F.col("lecture_id")))
        .withColumn("one", F.lit(1))
    )
    ranked = ordered(lectures, ["one"], ["digest"], F.substring("digest", 1, 4), position="place", total="n")
    n_dev = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)))
    split = ranked.select("lecture_id", F.when(F.col("place") < n_dev, "dev").otherwise("test").alias("split"))
    return rows.join(split, "lecture_id")


def mark_title_source(rows: DataFrame, n: int = N_TITLE_UTTS) -> DataFrame:
    """Flag the first ``n`` utterances of every lecture by utt_id."""
    openers = first_n(rows.select("lecture_id", "utt_id"), ["lecture_id"], [F.col("utt_id")], n).select(
        "utt_id", F.lit(True).alias("opener")
    )
    return rows.join(openers, "utt_id", "left").select(
        *rows.columns, F.coalesce("opener", F.lit(False)).alias("title_source")
    )


def stratified_sample(rows: DataFrame, n: int, stratum: str = "lecture_id", id_col: str = "utt_id",
                      seed: int = SEED) -> DataFrame:
    """Proportional sample of ``n`` rows by largest remainder.

    Each stratum gets the floor of its exact share, and the strata with the
    largest remainders (ties by name) one more. Fewer than ``n`` strata can get one more,
    so only the first ``n`` by remainder are ranked. Inside a stratum rows follow a seeded
    order, ranked in blocks of its digests.
    """
    # the counts are read several times below: keep them, not the way to them
    counts = durable(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("c")))
    total = counts.agg(F.sum("c")).scalar()
    exact = F.lit(n) * F.col("c") / total
    shares = counts.withColumn("floor", F.least(F.floor(exact), F.col("c"))).withColumn("remainder", exact - F.floor(exact))
    missing = F.lit(n) - shares.agg(F.sum("floor")).scalar()
    first = shares.orderBy(F.desc("remainder"), stratum).limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("remainder"), stratum))
    more = first.select(stratum, place.alias("place")).filter(F.col("place") <= missing).select(stratum, F.lit(1).alias("more"))
    quota = shares.join(more, stratum, "left").select(
        stratum, "c", F.when(total <= n, F.col("c")).otherwise(F.col("floor") + F.coalesce("more", F.lit(0))).alias("quota"))
    keyed = rows.withColumn("__digest", F.concat(seeded_digest(seed, F.col(id_col)), F.lit("-"), F.col(id_col))).join(quota, stratum)
    # as many leading digits as leave about 65 536 rows per block
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / 65_536) / 4)).cast("int")
    ranked = ordered(keyed, [stratum], ["__digest"], F.substring("__digest", F.lit(1), digits), position="__place")
    return ranked.filter(F.col("__place") < F.col("quota")).select(*rows.columns)


def mark_in_eval(rows: DataFrame, samples: list[DataFrame], id_col: str = "utt_id") -> DataFrame:
    """Flag rows that belong to any of the samples."""
    ids = samples[0].select(id_col)
    for s in samples[1:]:
        ids = ids.union(s.select(id_col))
    ids = ids.distinct().withColumn("__hit", F.lit(True))
    return rows.join(ids, id_col, "left").select(*rows.columns, F.coalesce("__hit", F.lit(False)).alias("in_eval"))


def build_manifest(text: DataFrame, segments: DataFrame, recordings: DataFrame, n_dev: int = 60, n_test: int = 150,
                   seed: int = SEED) -> DataFrame:
    """The whole manifest: reject, split by lecture, mark openers, sample.

    The split and marked rows are stored once; both samples and the final flag
    read them from there."""
    rows = survivors(with_reject_reason(join_corpus(text, segments, recordings)))
    rows = durable(mark_title_source(lecture_split(rows, seed)))
    pool = rows.filter(~F.col("title_source"))
    samples = [stratified_sample(pool.filter(F.col("split") == s), n, seed=seed) for s, n in (("dev", n_dev), ("test", n_test))]
    return mark_in_eval(rows, samples)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Counts, hours and durations per (split, in_eval) with subtotals and total."""
    return manifest.groupingSets(
        [["split", "in_eval"], ["split"], []], "split", "in_eval"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.sum("dur") / 3600, 6).alias("hours"),
        F.bround(F.sum("dur") / 60, 6).alias("minutes"),
        F.bround(F.avg("dur"), 6).alias("mean_dur"),
        # durations carry two decimals inside a fixed range, so the exact
        # percentile keeps at most a few thousand distinct values
        F.bround(F.percentile("dur", 0.5), 6).alias("median_dur"),
    )


def course_of(lectures: DataFrame, mapping: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Lecture to course: the explicit map, else the first matching pattern, else
    the lower-cased text before the first ``_``, ``-`` or ``.``."""
    lec = F.col("lecture_id")
    guess = F.lower(F.element_at(F.split(lec, "[_\\-.]"), 1))
    for pattern, course in reversed(rules):
        guess = F.when(lec.rlike(pattern), F.lit(course)).otherwise(guess)
    explicit = mapping.select("lecture_id", F.col("course_id").alias("mapped"))
    return lectures.join(explicit, "lecture_id", "left").select(
        *lectures.columns, F.coalesce("mapped", guess).alias("course_id"), F.col("mapped").isNotNull().alias("explicit")
    )


def mismatched_pairs(courses: DataFrame, block: Column) -> DataFrame:
    """Every course with another one: number ``md5(id) mod (n-1)`` among the
    others in sorted order. With all courses numbered, that number is the partner's
    own place, shifted by one past the course itself, so an equi-join suffices."""
    ids = courses.select("course_id").distinct().withColumn("one", F.lit(1))
    ranked = ordered(ids, ["one"], ["course_id"], block, position="place", total="n").filter("n > 1")
    pick = md5_mod(F.col("course_id"), F.col("n") - 1)
    wanted = ranked.withColumn("pick", pick).select(
        "course_id", F.when(F.col("pick") < F.col("place"), F.col("pick")).otherwise(F.col("pick") + 1).alias("place")
    )
    return wanted.join(ranked.select(F.col("course_id").alias("other_id"), "place"), "place").select("course_id", "other_id")


def course_gaps(needed: DataFrame, available: DataFrame) -> DataFrame:
    """Courses needed but missing, and available but unused."""
    a, b = needed.select("course_id").distinct(), available.select("course_id").distinct()
    return a.join(b, "course_id", "left_anti").withColumn("status", F.lit("missing")).union(
        b.join(a, "course_id", "left_anti").withColumn("status", F.lit("unused"))
    )


def set_difference(needed: DataFrame, available: DataFrame) -> DataFrame:
    """Course ids in the first set only."""
    return needed.select("course_id").exceptAll(available.select("course_id"))


def validate_mapping(manifest: DataFrame, mapping: DataFrame, rules: list[tuple[str, str]], courses: DataFrame) -> DataFrame:
    """Per lecture: course, evaluated utterances, mapped explicitly?, syllabus present?"""
    per_lecture = manifest.groupBy("lecture_id").agg(
        F.sum(F.coalesce(F.col("in_eval"), F.lit(False)).cast("long")).alias("eval_utts")
    )
    have = courses.select("course_id").distinct().withColumn("__have", F.lit(True))
    return course_of(per_lecture, mapping, rules).join(have, "course_id", "left").select(
        "lecture_id", "course_id", "eval_utts", F.col("explicit").alias("mapped"),
        F.col("__have").isNotNull().alias("has_syllabus"),
    )


def course_totals(validated: DataFrame) -> DataFrame:
    """Evaluated utterances and lectures of each course, from ``validate_mapping``."""
    return validated.groupBy("course_id").agg(F.sum("eval_utts").alias("eval_utts"), F.count(F.lit(1)).alias("n_lectures"))


def mapping_complete(validated: DataFrame, courses: DataFrame, least: int = 2) -> DataFrame:
    """One row: lectures, courses, syllabi, and whether every lecture is mapped to a course with a syllabus and
    there are the ``least`` syllabi that a mismatched control needs."""
    have = courses.agg(F.countDistinct("course_id").alias("n_syllabi"))
    per = validated.groupBy("course_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("mapped") & F.col("has_syllabus")).alias("ok"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lectures"), F.count(F.lit(1)).alias("n_courses"), F.coalesce(F.min("ok"), F.lit(True)).alias("ok"))
    n = have.scalar()
    return one.select("n_lectures", "n_courses", n.alias("n_syllabi"), (F.col("ok") & (n >= least)).alias("complete"))
