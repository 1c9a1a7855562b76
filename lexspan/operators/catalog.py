"""Listings, partial updates, upserts and deletes over the application tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.jsons import is_json
from lexspan.session import durable

# fixed values
AUDIO_SUFFIXES = [".m4a", ".mp3", ".wav", ".aac", ".ogg", ".opus", ".flac", ".mp4", ".3gp", ".amr", ".webm"]
SYLLABUS_SUFFIXES = [".pdf"]
LIST_MAX = 200
ACTIVE = ["queued", "running"]


def file_suffix(name: Column) -> Column:
    """Lower-cased last suffix of a file name, "" without one."""
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+?(\.[^.]+)$", 1))


def accepted_upload(name: Column, allowed: list[str] = AUDIO_SUFFIXES) -> Column:
    return file_suffix(name).isin(allowed)


def list_jobs(jobs: DataFrame, subject_id=None, lecture_id=None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first, with any of three equality filters, at most 200 rows."""
    out = jobs
    for column, value in (("subject_id", subject_id), ("lecture_id", lecture_id), ("status", status)):
        if value:
            out = out.filter(F.col(column) == value)
    return out.orderBy(F.desc("created_at"), "id").limit(min(limit, LIST_MAX))


def newest_first(rows: DataFrame, created: str = "created_at", *ties: str, within: str | None = None) -> DataFrame:
    """Newest first, all rows; ``within`` lists the rows of each parent together."""
    return rows.orderBy(*([within] if within else []), F.desc(created), *ties)


def in_index_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*columns)


def requeue_stale(jobs: DataFrame, message: str = "requeued after restart") -> DataFrame:
    stale = F.col("status").isin(ACTIVE)
    return jobs.withColumn("message", F.when(stale, F.lit(message)).otherwise(F.col("message"))).withColumn(
        "status", F.when(stale, "queued").otherwise(F.col("status"))
    )


def clamp_progress(fraction: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)), 4)


def patch(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only the non-NULL fields of a patch overwrite."""
    p = patches.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return base.join(p, key, "left").select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def with_child_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, counted in one grouped pass."""
    c = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(c, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_presence(parents: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    return parents.join(others.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def delete_cascade(tables: dict[str, DataFrame], doomed: DataFrame, parent: str, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Remove parent rows and, table by table, everything that hangs on them.

    ``doomed`` holds the parent's key column. ``links`` are (child, foreign key,
    parent table, parent key) in top-down order.
    """
    gone = {parent: doomed}
    out = dict(tables)
    key = doomed.columns[0]
    out[parent] = tables[parent].join(doomed, key, "left_anti")
    for child, fk, up, up_key in links:
        dead = gone[up].select(F.col(up_key).alias(fk)).distinct()
        out[child] = tables[child].join(dead, fk, "left_anti")
        gone[child] = tables[child].join(dead, fk, "left_semi")
    return out


def null_dangling(rows: DataFrame, fk: str, parents: DataFrame, key: str) -> DataFrame:
    """A reference whose parent is gone becomes NULL."""
    alive = parents.select(F.col(key).alias(fk)).distinct().withColumn("__alive", F.lit(True))
    return rows.join(alive, fk, "left").select(
        *[F.when(F.col("__alive"), F.col(fk)).alias(fk) if c == fk else F.col(c) for c in rows.columns]
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str | list[str]) -> DataFrame:
    """Incoming rows replace stored rows of the same id."""
    return stored.join(incoming, key, "left_anti").unionByName(incoming)


def replace_by_key(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Drop everything stored under the incoming keys, then add the new rows."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


BUCKET = "__bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_stored(spark, path: str, key: str) -> DataFrame:
    """Rows kept by ``write_replacing``."""
    return spark.read.parquet(path).filter(F.col(key).isNotNull()).drop(BUCKET)


def write_replacing(rows: DataFrame, keys: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Put ``rows`` in place of everything stored under the ``keys``, also under keys without new rows.

    Storage is cut into hash buckets of the key. The buckets of the keys are written anew from their other rows and the
    new ones; a row without key keeps a bucket that has become empty from being left as it was.
    """
    spark = rows.sparkSession
    keys = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    touched = keys.select(_bucket(key, buckets).alias(BUCKET)).distinct()
    new = rows.filter(F.col(key).isNotNull()).withColumn(BUCKET, _bucket(key, buckets))
    marks = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], BUCKET)
    new = new.unionByName(marks)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.parquet(path).join(touched, BUCKET, "left_semi").filter(F.col(key).isNotNull())
        new = stored.join(keys, key, "left_anti").unionByName(new)
    # the buckets are read and written: what they will hold is kept elsewhere first
    durable(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def unit_keys(prefix: Column, order_index: Column) -> Column:
    return F.format_string("%s-u%02d", F.substring(prefix, 1, 12), order_index)


def number_units(units: DataFrame, parent: str, order: list[str], prefix: Column) -> DataFrame:
    """Units with their key: the place among the parent's units. A syllabus holds a handful of units, one window is enough."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return units.withColumn("unit_key", unit_keys(prefix, place))


def parse_iso(c: Column) -> tuple[Column, Column]:
    """(timestamp, rejected): ISO-8601 date or date-time, invalid text rejected."""
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    ts = F.try_to_timestamp(F.when(iso, F.regexp_replace(c, "T", " ")))
    return ts, c.isNotNull() & (F.trim(c) != "") & ts.isNull()


def read_json(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def write_json(c: Column) -> Column:
    """JSON text; characters outside ASCII are kept as they are."""
    return F.to_json(c)


def json_value(c: Column) -> Column:
    """A JSON text as a variant of any shape: lists, dicts and citation arrays need no schema. NULL for NULL and for broken text."""
    return F.when(is_json(c), F.try_parse_json(c))


def broken_json(c: Column) -> Column:
    """True for text that isn't JSON; a NULL column and the JSON null aren't broken."""
    return c.isNotNull() & ~is_json(c)


def json_path(value: Column, path: str, kind: str = "string") -> Column:
    """What lies at a path of a variant, NULL where there is nothing of that kind."""
    return F.try_variant_get(value, path, kind)


def json_elements(df: DataFrame, keys: list[str], value: str, path: str = "$") -> DataFrame:
    """(keys, pos, element): the elements of the array at a path of a variant column; rows without one give none."""
    inner = F.try_variant_get(F.col(value), path, "array<variant>")
    return df.select(*keys, F.posexplode(inner).alias("pos", "element"))


def json_shape(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The schema that all values of a variant column share, by key; merged map-side."""
    return df.groupBy(*(keys or [])).agg(F.schema_of_variant_agg(value).alias("shape"))
