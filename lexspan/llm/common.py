"""What several operators of this package share: words, byte-balanced slices, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.session import shared_root, ship_package

#: Bytes of text that one step inside a task handles at once.
SLICE_BYTES = 1 << 20
#: Shuffle files of a written table are removed with the end of the write, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The seed of every hash of a shingle.
MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor loses nothing. What it shuffled goes with the write."""
    conf, folder = df.sparkSession.conf, shared_folder(df.sparkSession, name)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def released(*done: DataFrame) -> None:
    """Empties the folders of settled tables that nothing reads any more."""
    for df in done:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns can't clash; makes the package known to the workers."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_key(name: Column, text: Column) -> Column:
    """Tells rows apart where ids are null or shared: 64 bits of hash of id and text."""
    return F.xxhash64(name.cast("long"), text.cast("string"))


def apart(text: Column) -> Column:
    """0 for a text with words; a text without any isn't a copy of another, so it gets a number of its own."""
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) != "", F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.split() cuts at exactly these six bytes."""
    return text.encode().lower().split() if text else []


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``limit`` bytes of text; a longer text makes a piece of its own."""
    for batch in batches:
        text = batch.column("text")
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mix of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: the distinct words are found by Arrow, and only these are hashed."""
    import xxhash

    if not tokens:
        return np.zeros(0, np.uint64)
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    own = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[np.asarray(coded.indices)]


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of ``size`` words, in order; a shorter sequence gives one shingle, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = scrambled(out * MIX + hashes[i : n - k + 1 + i])
    return out
