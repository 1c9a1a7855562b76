"""Manifests, hypotheses, syllabi, score and contrast files with fixed schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.jsons import is_json
from lexspan.functions.text import is_blank
from lexspan.sources.kaldi import read_lines

MANIFEST = (
    "utt_id string, lecture_id string, wav string, start double, end double, dur double, ref string, "
    "n_segments int, split string, title_source boolean, in_eval boolean"
)
HYPOTHESIS = (
    "utt_id string, lecture_id string, course_id string, ref string, hyp string, avg_logprob double, "
    "compression_ratio double, prompt_tokens int, retrieved array<string>, prompt_course string, fallback boolean"
)
SYLLABUS = (
    "course_id string, title string, provenance string, source_url string, "
    "units array<struct<unit_id:string,title:string,prose:string,keywords:array<string>>>"
)
SCORES = (
    "model string, cond string, split string, n long, wer double, wer_sa double, cer double, k_wer double, "
    "k_n long, u_wer double, u_n long, ins_rate double, script_fidelity double, lat_n long, "
    "mean_prompt_tokens double, fallback_rate double"
)
CONTRAST = (
    "n double, corpus_delta double, ci array<double>, p_improve double, macro_delta double, "
    "macro_ci array<double>, degraded double, improved double"
)
HYP_KEYS = ["model", "cond", "split"]


#: Fields that a record must name, whatever their value.
MANIFEST_FIELDS = ("utt_id", "split")
COURSE_FIELDS = ("course_id", "title", "provenance", "units")
UNIT_FIELDS = ("unit_id", "title", "prose", "keywords")
_WHOLE = "__whole"


def _missing(text: Column, fields: tuple[str, ...]) -> Column:
    """The first of these fields that a JSON object doesn't name, NULL if it names all."""
    named = F.json_object_keys(text)
    return F.coalesce(*[F.when(~F.array_contains(named, f), F.lit(f)) for f in fields])


def checked_records(lines: DataFrame, schema: str, required: tuple[str, ...], units: tuple[str, ...] = ()) -> DataFrame:
    """Each record with what is wrong with it: the other columns of ``lines``, value, record, problem.

    ``value`` is a JSON text. The problem is "not a JSON record" (broken text, another type, a field of a
    wrong type), "missing <field>", "unit missing <field>" for an element of ``units``, or NULL. Blank
    lines are left out, so records and rejects add up to the others.
    """
    place = [c for c in lines.columns if c != "value"]
    kept = lines.filter(~is_blank(F.col("value")))
    parsed = F.from_json("value", f"{schema}, {_WHOLE} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _WHOLE})
    rows = kept.select(*place, "value", parsed.alias("record"))
    problem = F.when(~is_json(F.col("value")) | F.json_object_keys("value").isNull() | F.col(f"record.{_WHOLE}").isNotNull(), "not a JSON record")
    problem = problem.otherwise(F.concat(F.lit("missing "), _missing(F.col("value"), required)))
    if units:
        each = F.from_json(F.get_json_object("value", "$.units"), "array<string>")
        bad = F.filter(F.transform(each, lambda u: F.concat(F.lit("unit missing "), _missing(u, units))), F.isnotnull)
        problem = F.coalesce(problem, F.get(bad, F.lit(0)))
    return rows.select(*place, "value", F.col("record").dropFields(_WHOLE).alias("record"), problem.alias("problem"))


def good_records(checked: DataFrame) -> DataFrame:
    return checked.filter("problem IS NULL").select("record.*")


def rejects(checked: DataFrame) -> DataFrame:
    """Broken records: where they stand, what is wrong, and their text."""
    return checked.filter("problem IS NOT NULL").drop("record")


def strict_records(checked: DataFrame) -> DataFrame:
    """The records; the first broken one ends the job with its place and problem."""
    place = [F.col(c).cast("string") for c in checked.columns if c not in ("value", "record", "problem")]
    error = F.raise_error(F.concat_ws(": ", *place, "problem"))
    return checked.withColumn("record", F.when(F.col("problem").isNotNull(), error.cast(checked.schema["record"].dataType)).otherwise(F.col("record"))).select("record.*")


def store_checked(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) from one scan of the source: both are written by one job, under ``path``."""
    checked.withColumn("rejected", F.col("problem").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(path)
    stored = checked.sparkSession.read.schema(checked.withColumn("rejected", F.lit(True)).schema).parquet(path)
    part = lambda flag: stored.filter(F.col("rejected") == flag).drop("rejected")
    return good_records(part(False)), rejects(part(True))


def check_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of manifests, checked: file, line_no from 0, value, record, problem."""
    lines = [read_lines(spark, p) for p in paths]
    return checked_records(reduce(DataFrame.unionByName, lines), MANIFEST, MANIFEST_FIELDS)


def check_syllabi(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Syllabus files, one course each, checked: file, value, record, problem."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return checked_records(files, SYLLABUS, COURSE_FIELDS, UNIT_FIELDS)


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(MANIFEST).json(paths)


def union_manifests(base: DataFrame, packed: DataFrame) -> DataFrame:
    """Union of manifests whose columns differ; absent columns become NULL."""
    return base.unionByName(packed, allowMissingColumns=True)


def select_split(manifest: DataFrame, split: str) -> DataFrame:
    """Rows of one split that are evaluated; a missing flag counts as evaluated."""
    return manifest.filter((F.col("split") == split) & F.coalesce(F.col("in_eval"), F.lit(True)))


def parse_syllabi(docs: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to courses; one row per document."""
    return docs.select(F.from_json(column, SYLLABUS).alias("c")).select("c.*")


def read_syllabi(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(SYLLABUS).option("multiLine", "true").json(paths)


def explode_units(courses: DataFrame) -> DataFrame:
    """One row per unit with its place in the course."""
    return courses.select("course_id", F.posexplode("units").alias("unit_order", "u")).select(
        "course_id", "unit_order", "u.unit_id", "u.title", "u.prose", "u.keywords"
    )


def pending_sets(requested: DataFrame, existing: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Requested hypothesis sets still to be decoded; all of them when forced."""
    wanted = requested.select(*keys).distinct()
    return wanted if force else wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def write_hypotheses(hyps: DataFrame, path: str, force: bool = False) -> None:
    """Store hypotheses as one partition per key. An existing key is kept unless
    forced; forcing replaces only the partitions that are written."""
    spark = hyps.sparkSession
    out = hyps
    if not force:
        try:
            stored = spark.read.parquet(path).select(*HYP_KEYS).distinct()
            out = hyps.join(stored, HYP_KEYS, "left_anti")
        except Exception as exc:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    (
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*HYP_KEYS).parquet(path)
    )


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", "true").csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema(SCORES).csv(path)


def score_lines(scores: DataFrame) -> DataFrame:
    """Score rows as CSV text, in the fixed column order."""
    names = [f.split()[0] for f in SCORES.split(", ")]
    return scores.select(F.to_csv(F.struct(*[F.col(n) for n in names])).alias("value"))


def parse_score_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_csv("value", SCORES).alias("s")).select("s.*")


def parse_contrasts(docs: DataFrame, column: str = "value") -> DataFrame:
    """A ``{"A->B": {...}}`` document to one row per contrast."""
    return docs.select(F.explode(F.from_json(column, f"map<string,struct<{_inline(CONTRAST)}>>")).alias("contrast", "s")).select(
        "contrast", "s.*"
    )


def _inline(ddl: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (f.strip().split(" ", 1) for f in ddl.split(", ")))


def contrast_lines(contrasts: DataFrame) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in CONTRAST.split(", ")]
    return contrasts.select(F.to_json(F.create_map(F.col("contrast"), F.struct(*names))).alias("value"))
