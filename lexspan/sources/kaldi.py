"""Speech-corpus files: ``text``, ``wav.scp`` and ``segments``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.functions.text import is_blank, strip, tokens


def _head(line: Column) -> Column:
    return F.substring_index(line, " ", 1)


def _rest(line: Column) -> Column:
    return F.when(F.instr(line, " ") > 0, F.substr(line, F.instr(line, " ") + 1)).otherwise(F.lit(""))


def parse_text(lines: DataFrame) -> DataFrame:
    """``value`` lines to (utt, transcript): id up to the first space, rest stripped."""
    v = F.col("value")
    return lines.filter(~is_blank(v)).select(_head(v).alias("utt"), strip(_rest(v)).alias("transcript"))


def parse_wavscp(lines: DataFrame) -> DataFrame:
    """(rec, path); the path is the first ``*.wav`` token, so pipes work too."""
    v = F.col("value")
    path = F.regexp_extract(_rest(v), r"\S+\.wav", 0)
    return lines.filter(~is_blank(v)).select(_head(v).alias("rec"), path.alias("path")).filter(F.col("path") != "")


def parse_segments(lines: DataFrame) -> DataFrame:
    t = tokens(F.col("value"))
    return lines.filter(~is_blank(F.col("value"))).select(
        t[0].alias("utt"), t[1].alias("rec"), t[2].cast("double").alias("start"), t[3].cast("double").alias("end")
    )


def read_corpus(spark: SparkSession, text: str, wavscp: str, segments: str | None = None):
    """(text, recordings, segments); without a segments file every transcribed
    recording is one utterance from 0.0 to its (still unknown) end."""
    txt = parse_text(spark.read.text(text))
    rec = parse_wavscp(spark.read.text(wavscp))
    seg = parse_segments(spark.read.text(segments)) if segments else whole_recordings(txt, rec)
    return txt, rec, seg


def whole_recordings(text: DataFrame, recordings: DataFrame) -> DataFrame:
    return text.join(recordings, text["utt"] == recordings["rec"], "left_semi").select(
        "utt", F.col("utt").alias("rec"), F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("end")
    )


def fill_open_ends(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """NULL ends take the recording length from (rec, frames, samplerate)."""
    length = F.col("frames") / F.col("samplerate")
    return segments.join(lengths, "rec", "left").select(
        "utt", "rec", "start", F.coalesce(F.col("end"), length).alias("end")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path`` as (file, line_no, value), numbered from 0 in each file.

    Lines are numbered inside each split of a file, and the splits' counts are added up in the order of their offsets,
    so a huge file is never gathered in one task.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    counts = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # ids of one split follow each other without a gap: they come from one task, line by line
    return rows.join(starts, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "value")


def discover(lines: DataFrame, n_head: int = 5) -> DataFrame:
    """Per file: number of lines and the first ``n_head`` of them.

    ``lines`` is (file, line_no, value). Counts combine map-side and the head is
    a per-task top-n, so a huge file never gathers in one task.
    """
    from lexspan.operators.ordered import first_n

    heads = (
        first_n(lines, ["file"], [F.col("line_no")], n_head)
        .groupBy("file")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda s: s["value"]).alias("head"))
    )
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines")).join(heads, "file", "left")


def prefix_groups(ids: DataFrame, column: str, pattern: str, n: int = 10) -> DataFrame:
    """The ``n`` largest groups of ids by the first capture of ``pattern``."""
    return (
        ids.filter(F.col(column).rlike(pattern))
        .groupBy(F.regexp_extract(column, pattern, 1).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n_ids"))
        .orderBy(F.desc("n_ids"), "prefix")
        .limit(n)
    )


LAST_FIELD_PREFIX = "^(.*)_[^_]+$"
FIRST_FIELD_PREFIX = "^([^_]+)"

LISTING_SCHEMA = T.StructType([T.StructField("path", T.StringType(), False)])


def resolve_paths(wanted: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Resolve ``path`` against the files that exist.

    The path itself (below ``root`` when relative) wins; otherwise the first file
    in sorted order with the same base name; otherwise ``resolved`` is NULL and
    ``missing`` says which base name was not found.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    want = wanted.withColumn("full", full).withColumn("base", base(F.col("path")))
    exact = listing.select(F.col("path").alias("full"), F.lit(True).alias("exists"))
    by_base = listing.groupBy(base(F.col("path")).alias("base")).agg(F.min("path").alias("first_hit"))
    return (
        want.join(exact, "full", "left")
        .join(by_base, "base", "left")
        .select(
            *wanted.columns,
            F.when(F.col("exists"), F.col("full")).otherwise(F.col("first_hit")).alias("resolved"),
            F.when(F.col("exists").isNull() & F.col("first_hit").isNull(), F.col("base")).alias("missing"),
        )
    )


def list_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Recursive file listing as a DataFrame, without reading any content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(root).select(F.regexp_replace("path", "^file:", "").alias("path"))
    )
