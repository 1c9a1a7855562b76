"""Notes, the units they belong to, and how much of a syllabus they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import strip

RANGE_BLOCK = 256  # spans per join block


def span_range(first: Column, last: Column) -> tuple[Column, Column]:
    """Proposed (first, last): missing first is 0, missing last is first, swapped if reversed."""
    f = F.coalesce(first, F.lit(0))
    l = F.coalesce(last, f)
    return F.least(f, l), F.greatest(f, l)


def notes_in_range(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Range join: every span with ``first <= index <= last`` in the note's lecture.

    Ranges are clipped to the lecture, cut into blocks of spans and equi-joined
    on (lecture, block); the exact bounds are checked afterwards. A long lecture
    is thereby spread over its blocks.
    """
    bounds = spans.groupBy("lecture_id").agg(F.min("index").alias("lo"), F.max("index").alias("hi"))
    clipped = notes.join(bounds, "lecture_id").withColumn("lo", F.greatest("lo", "first_span")).withColumn(
        "hi", F.least("hi", "last_span")
    ).filter(F.col("lo") <= F.col("hi"))
    blk = lambda c: F.floor(F.col(c) / RANGE_BLOCK)
    pieces = clipped.withColumn("blk", F.explode(F.sequence(blk("lo"), blk("hi"))))
    placed = spans.withColumn("blk", blk("index"))
    return pieces.join(placed, ["lecture_id", "blk"]).filter(F.col("index").between(F.col("lo"), F.col("hi"))).drop("blk", "lo", "hi")


def note_votes(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Votes of each retrieved unit for each note, and where it was first seen."""
    hits = notes_in_range(notes.select("note_id", "lecture_id", "first_span", "last_span"),
                          spans.select("lecture_id", "index", "retrieved_unit_ids"))
    return (
        hits.select("note_id", "index", F.posexplode("retrieved_unit_ids").alias("at", "unit_id"))
        .groupBy("note_id", "unit_id")
        .agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("index", "at")).alias("seen"))
    )


def attribute_units(notes: DataFrame, spans: DataFrame, units: DataFrame) -> DataFrame:
    """Unit of every note: the majority of its spans' retrieved units among the
    subject's valid ones (ties to the first seen); without votes the suggested
    unit key; else NULL.

    ``notes``: note_id, lecture_id, subject_id, first_span, last_span,
    suggested_unit_key. ``units``: subject_id, unit_id, unit_key, order_index.
    """
    subject_of = notes.select("note_id", "subject_id")
    valid = units.select("subject_id", "unit_id")
    winner = (
        note_votes(notes, spans).join(subject_of, "note_id").join(valid, ["subject_id", "unit_id"], "left_semi")
        .groupBy("note_id")
        .agg(F.max_by("unit_id", F.struct("votes", (-F.col("seen.index")).alias("i"), (-F.col("seen.at")).alias("a"))).alias("voted"))
    )
    # of units with one key the last in syllabus order counts
    by_key = units.groupBy("subject_id", F.col("unit_key").alias("key")).agg(F.max_by("unit_id", F.struct("order_index", "unit_id")).alias("suggested"))
    n = notes.withColumn("key", strip(F.coalesce("suggested_unit_key", F.lit(""))))
    return n.join(winner, "note_id", "left").join(by_key, ["subject_id", "key"], "left").select(
        *notes.columns, F.coalesce("voted", "suggested").alias("unit_id")
    )


def note_times(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Start of the first and end of the last span, NULL where absent."""
    a = spans.select("lecture_id", F.col("index").alias("first_span"), "start_s")
    b = spans.select("lecture_id", F.col("index").alias("last_span"), "end_s")
    return notes.join(a, ["lecture_id", "first_span"], "left").join(b, ["lecture_id", "last_span"], "left").select(
        *notes.columns, "start_s", "end_s"
    )


def unit_links(units: DataFrame, lectures: DataFrame, notes: DataFrame) -> DataFrame:
    """Units LEFT JOIN the subject's notes: one row per unit and note.

    Written as notes ⋈ units plus the units without notes: an inner join can
    split the notes of a unit that holds most of them, an outer one could not.
    """
    n = notes.select("note_id", "lecture_id", "topic", "start_s", "unit_id").join(
        lectures.select("lecture_id", "lecture_title", "subject_id"), "lecture_id"
    )
    u = units.select("subject_id", "unit_id", "unit_key", "title")
    bare = u.join(n.select("subject_id", "unit_id").distinct(), ["subject_id", "unit_id"], "left_anti")
    return n.join(u, ["subject_id", "unit_id"]).unionByName(bare, allowMissingColumns=True)


def unit_coverage(units: DataFrame, lectures: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per unit: note count and covered flag. The covered and the
    outstanding list are the two halves; the notes themselves are ``unit_links``."""
    # notes are counted per unit before they meet the units, so a unit holding
    # most of the notes costs one row in the join
    counts = (
        notes.filter(F.col("unit_id").isNotNull()).select("lecture_id", "unit_id")
        .groupBy("lecture_id", "unit_id").agg(F.count(F.lit(1)).alias("c"))
        .join(lectures.select("lecture_id", "subject_id"), "lecture_id")
        .groupBy("subject_id", "unit_id").agg(F.sum("c").alias("c"))
    )
    return units.select("subject_id", "unit_id", "unit_key", "title", "order_index").join(
        counts, ["subject_id", "unit_id"], "left"
    ).select("subject_id", "unit_id", "unit_key", "title", "order_index",
             F.coalesce("c", F.lit(0)).alias("note_count"), F.col("c").isNotNull().alias("covered"))


def subject_coverage(subjects: DataFrame, units: DataFrame, lectures: DataFrame, notes: DataFrame) -> DataFrame:
    """Per subject: total and covered units, fraction (NULL without units), and
    notes without a unit. Notes naming a unit outside the syllabus count nowhere."""
    totals = unit_coverage(units, lectures, notes).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("total_units"), F.sum(F.col("covered").cast("int")).alias("covered_units")
    )
    loose = (
        notes.filter(F.col("unit_id").isNull()).groupBy("lecture_id").agg(F.count(F.lit(1)).alias("c"))
        .join(lectures.select("lecture_id", "subject_id"), "lecture_id")
        .groupBy("subject_id").agg(F.sum("c").alias("unattributed_notes"))
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return subjects.join(totals, "subject_id", "left").join(loose, "subject_id", "left").select(
        "subject_id", "subject_name", z("total_units"), z("covered_units"),
        F.bround(F.col("covered_units") / F.col("total_units"), 4).alias("coverage_fraction"), z("unattributed_notes"),
    )


def coverage_sentence(subjects: DataFrame, units: DataFrame, lectures: DataFrame, notes: DataFrame) -> DataFrame:
    """The coverage answer of each subject, listing unit titles in syllabus order.
    The lists hold the titles of one syllabus, never notes."""
    lists = unit_coverage(units, lectures, notes).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("covered").cast("int")).alias("done_n"),
        F.array_sort(F.collect_list(F.when(F.col("covered"), F.struct("order_index", "title")))).alias("done"),
        F.array_sort(F.collect_list(F.when(~F.col("covered"), F.struct("order_index", "title")))).alias("left"),
    )
    titles = lambda c, none: F.when(
        F.size(c) > 0, F.array_join(F.transform(c, lambda u: u["title"]), ", ")).otherwise(none)
    text = F.format_string(
        "**%d of %d syllabus units covered.**\n\n**Covered:** %s\n\n**Outstanding:** %s",
        "done_n", "total", titles("done", "nothing yet"), titles("left", "nothing — the syllabus is complete"),
    )
    none = ("No syllabus has been uploaded for this subject yet, so I can't tell you what's been covered. "
            "Upload the syllabus PDF and I'll track it against your lectures.")
    return subjects.join(lists, "subject_id", "left").select(
        "subject_id", F.when(F.col("total").isNull(), none).otherwise(text).alias("answer")
    )


# --- nested notes -----------------------------------------------------------------
def nest_notes(notes: DataFrame, terms: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Notes with their terms and outcomes as arrays (a handful per note)."""
    t = terms.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("term", "definition"))).alias("terms"))
    o = outcomes.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("text", "bloom_level"))).alias("outcomes"))
    empty = lambda s: F.array().cast(f"array<struct<{s}>>")
    return notes.join(t, "note_id", "left").join(o, "note_id", "left").select(
        *notes.columns, F.coalesce("terms", empty("term:string,definition:string")).alias("terms"),
        F.coalesce("outcomes", empty("text:string,bloom_level:string")).alias("outcomes"),
    )


def flatten_terms(nested: DataFrame) -> DataFrame:
    return nested.select("note_id", "lecture_id", F.explode("terms").alias("t")).select("note_id", "lecture_id", "t.term", "t.definition")


def flatten_outcomes(nested: DataFrame) -> DataFrame:
    """Outcomes as rows; a missing level reads "understand"."""
    return nested.select("note_id", "lecture_id", F.explode("outcomes").alias("o")).select(
        "note_id", "lecture_id", "o.text", F.coalesce("o.bloom_level", F.lit("understand")).alias("bloom_level")
    )


# --- rendered text ------------------------------------------------------------------
def render_transcript(spans: DataFrame) -> DataFrame:
    """``[span i | Xs-Ys] text``, whole seconds: a row for each span."""
    line = F.format_string("[span %d | %ds-%ds] %s", F.col("index").cast("long"),
                           F.rint("start_s").cast("long"), F.rint("end_s").cast("long"), F.col("text"))
    return spans.select("lecture_id", "index", line.alias("line"))


def full_transcript(spans: DataFrame) -> DataFrame:
    """The text of each span, NULL as empty: a row for each span."""
    return spans.select("lecture_id", "index", F.coalesce("text", F.lit("")).alias("line"))


def join_lines(lines: DataFrame, separator: str) -> DataFrame:
    """A lecture's lines in index order as one string. It is as long as the lecture: take the rows where that may be too much."""
    return lines.groupBy("lecture_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "line"))), lambda s: s["line"]), separator).alias("text"),
    )


def nested_transcripts(lectures: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per lecture with title, status, duration, the joined text and its spans as an array in index order.

    ``lectures``: lecture_id, lecture_title, status, duration_s. A lecture without spans has an empty text and an
    empty array. A row is as long as its lecture: ``full_transcript`` gives the same as rows.
    """
    columns = [c for c in spans.columns if c not in ("lecture_id", "index")]
    span = F.struct("index", *columns)
    of_lecture = spans.groupBy("lecture_id").agg(F.array_sort(F.collect_list(span), lambda x, y: F.when(x["index"] < y["index"], -1).when(x["index"] > y["index"], 1).otherwise(0)).alias("spans"))
    none = F.array().cast(of_lecture.schema["spans"].dataType)
    whole = lectures.select("lecture_id", "lecture_title", "status", "duration_s").join(of_lecture, "lecture_id", "left").withColumn("spans", F.coalesce("spans", none))
    text = F.array_join(F.transform("spans", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return whole.select("lecture_id", F.col("lecture_title").alias("title"), "status", "duration_s", text.alias("text"), "spans")


def render_units(subjects: DataFrame, units: DataFrame) -> DataFrame:
    """``- key: title`` lines of each subject's syllabus."""
    line = F.concat(F.lit("- "), "unit_key", F.lit(": "), "title")
    lists = units.groupBy("subject_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", line.alias("l")))), lambda u: u["l"]), "\n").alias("t")
    )
    return subjects.select("subject_id").join(lists, "subject_id", "left").select(
        "subject_id", F.coalesce("t", F.lit("(no syllabus attached to this subject)")).alias("units_text")
    )
