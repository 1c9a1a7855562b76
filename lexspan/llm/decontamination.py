"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item of m shingles inside a document of n has a Jaccard similarity of about m / n with it,
too little for MinHash when the document is long. So items are partitioned by size, and for each
partition documents are read in windows of twice its largest size that advance by that size: an item
lies wholly inside one of them, and its similarity to that window is bounded below however long the document is.
Items and windows meet where any of their minima agree.

A minimum that a window shares with an item is the value of a shingle of both. So only windows that hold
a shingle that is some item's minimum can match, and only for these minima are computed. Such
shingles are found through a bitmap of fixed size, whatever the number of items; the search itself
is a shuffled join on (partition, hash function, minimum), and so is the verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import id_and_text, scrambled, settled, shingles, slices, word_hashes, words

SHINGLE = 5
CONTAINMENT = 0.75
#: Hash functions of a signature.
HASHES = 64
#: Bits of a bitmap; 1 MiB, whatever the number of items.
BITS = 1 << 23


def _seeds(k: int) -> np.ndarray:
    return scrambled(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def partition_of(size: int) -> int:
    """The largest size of the partition: the next power of two, 8 at least."""
    return max(8, 1 << (size - 1).bit_length())


def signature(values: np.ndarray, k: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """By hash function: the least hash, and the shingle that has it."""
    mixed = scrambled(values[None, :] ^ _seeds(k)[:, None])
    at = mixed.argmin(axis=1)
    return mixed[np.arange(k), at], values[at]


def _bitmap(values: DataFrame, col: str) -> np.ndarray:
    """One bit for each value's low bits. At most BITS / 64 rows come to the driver."""
    bit = F.pmod(F.col(col), F.lit(BITS))
    held = values.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod({col}, 64) AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[held["at"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return out


def _in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & np.uint64(BITS - 1)
    return (bitmap[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """By item: item_id, its distinct shingles, its partition and its signature; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = {"item_id": [], "grams": [], "part": [], "minima": [], "origins": []}
            for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                grams = np.unique(shingles(word_hashes(words(text)), SHINGLE))
                if name is not None and len(grams):
                    minima, origins = signature(grams)
                    out["item_id"].append(name)
                    out["part"].append(partition_of(len(grams)))
                    for key, value in (("grams", grams), ("minima", minima), ("origins", origins)):
                        out[key].append(value.view(np.int64))
            types = {"item_id": pa.int64(), "part": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.list_(pa.int64()))) for k, v in out.items()})

    return id_and_text(benchmark, id_col, text_col).mapInArrow(run, "item_id long, grams array<long>, part long, minima array<long>, origins array<long>")


def _searched(texts: DataFrame, parts: list[int], minimal: np.ndarray, any_gram: np.ndarray) -> DataFrame:
    """By document that has a window with a possible match: the keys of its windows' minima, and its shingles that may be an item's."""
    sc = texts.sparkSession.sparkContext
    maps = sc.broadcast((minimal, any_gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimal, any_gram = maps.value
        for part in slices(batches):
            names, nameless = part.column("doc").to_pylist(), part.column("no_id").to_pylist()
            tokens = [words(t) for t in part.column("text").to_pylist()]
            hashed = word_hashes([w for t in tokens for w in t])
            ids, no_id, keys, found, at = [], [], [], [], 0
            for name, none, t in zip(names, nameless, tokens, strict=True):
                grams = shingles(hashed[at : at + len(t)], SHINGLE)
                at += len(t)
                near = np.flatnonzero(_in(minimal, grams))
                if not len(near):
                    continue
                mine: set[tuple[int, int, int]] = set()
                for size in parts:
                    # windows [i * size, i * size + 2 * size) that hold a place of near: the last two that start at or before it
                    for i in np.unique(np.concatenate([near // size, near // size - 1])).tolist():
                        if i >= 0:
                            minima, origins = signature(grams[i * size : i * size + 2 * size])
                            hit = np.flatnonzero(_in(minimal, origins))
                            mine.update((size, k, v) for k, v in zip(hit.tolist(), minima[hit].view(np.int64).tolist(), strict=True))
                if mine:
                    ids.append(name)
                    no_id.append(none)
                    keys.append([{"part": p, "k": k, "minimum": v} for p, k, v in sorted(mine)])
                    found.append(np.unique(grams[_in(any_gram, grams)]).view(np.int64))
            key = pa.struct([("part", pa.int64()), ("k", pa.int32()), ("minimum", pa.int64())])
            yield pa.RecordBatch.from_pydict({"doc": pa.array(ids, pa.int64()), "no_id": pa.array(no_id, pa.bool_()), "keys": pa.array(keys, pa.list_(key)), "grams": pa.array(found, pa.list_(pa.int64()))})

    return texts.mapInArrow(run, "doc long, no_id boolean, keys array<struct<part: long, k: int, minimum: long>>, grams array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item of which it holds enough: doc_id, item_id, n_item, n_shared, containment.

    Words are those of ``words``; a set holds the distinct five-word shingles; n_item is the size of the
    item's set, n_shared how many of these the document has; containment, their ratio, is ``least`` or
    more. An item of fewer than five words is one shingle and is found in documents of just these words.
    Null or empty texts and items, and items without an id, give no row. Rows that share an id count as one
    document (its shingles together); texts without an id are documents of their own, equal ones one, repeated items give one row; an item id with several texts counts each text's
    own containment and returns the largest. Empty tables give an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    items = items_of(benchmark).withColumn("text_no", F.xxhash64("grams")).dropDuplicates(["item_id", "text_no"])
    parts = sorted(r[0] for r in items.select("part").distinct().collect())  # powers of two: at most sixty
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    minimal = _bitmap(items.select(F.explode("origins").alias("v")), "v")
    any_gram = _bitmap(items.select(F.explode("grams").alias("v")), "v")
    no_id = F.isnull("doc_id")
    texts = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc"), no_id.alias("no_id"), "text")
    hits = settled(_searched(texts, parts, minimal, any_gram), "decontamination")
    keys = items.select("item_id", "text_no", "part", F.posexplode("minima").alias("k", "minimum"))
    candidates = hits.select("doc", "no_id", F.explode("keys").alias("key")).select("doc", "no_id", "key.*").distinct().join(keys, ["part", "k", "minimum"]).select("doc", "no_id", "item_id", "text_no").distinct()
    own = hits.select("doc", "no_id", F.explode("grams").alias("gram")).distinct()
    theirs = items.select("item_id", "text_no", F.size("grams").cast("long").alias("n_item"), F.explode("grams").alias("gram"))
    shared = candidates.join(theirs, ["item_id", "text_no"]).join(own, ["doc", "no_id", "gram"]).groupBy("doc", "no_id", "item_id", "text_no", "n_item").agg(F.count("*").alias("n_shared"))
    enough = shared.where(F.col("n_shared") >= F.lit(least) * F.col("n_item"))
    best = enough.groupBy("doc", "no_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("b"))
    return best.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "item_id", "b.n_item", "b.n_shared", "b.containment")


def op2_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
