"""Token-id files: documents encoded, ordered by doc_id, packed by Simple-8b and read back.

Texts are shuffled once, by range of doc_id, and sorted inside each range; each task then
encodes its documents and writes blocks of whole documents. A block is the binary value of
one row of a Parquet file, so Spark's committer keeps the files whole when a task is
repeated, on any file system that Spark writes to. Rows carry the part (order of ranges),
the block's place in it and the ids before it in the part; only one number per part, its
sum of ids, is needed to find where each document starts.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.common import id_and_text, shared_folder, slices
from lexspan.llm.simple8b import read_block, write_block
from lexspan.llm.units import Memory


#: Ids after which a block is closed.
BLOCK = 1 << 16
END = 1
BLOCKS = "block long, first long, n_docs int, n_ids long, payload binary"
#: Words whose normal form is their lower case, and the pieces of that: letters, single digits, others.
_PLAIN = regex.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = regex.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


@cache
def _encoder(vocabulary: str) -> Callable[[str], bytes]:
    """One encoder in each Python worker, whose memory is kept over tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    from lexspan.llm.transducer import letters_of_bytes

    whole = Tokenizer.from_file(vocabulary)
    whole.no_truncation()
    whole.no_padding()
    letters, model = letters_of_bytes(), whole.model
    packed = lambda ids: array("I", ids).tobytes()
    tokenize = model.tokenize

    def one(x: str) -> bytes:
        """A piece's ids; printable ASCII stands for itself in the vocabulary."""
        return packed([t.id for t in tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(letters))])

    piece = Memory(one)

    def word(w: str) -> bytes:
        """Pieces of a plain word go to the library's model one by one, other words whole."""
        if w.isalpha() and w.isascii():
            return piece[w.lower()]
        if _PLAIN.fullmatch(w) and "<|" not in w:
            return b"".join(map(piece.__getitem__, _PIECES.findall(w.lower())))
        return packed(whole.encode(w, add_special_tokens=False).ids)

    memory = Memory(word, 400_000)
    return lambda text: b"".join(map(memory.__getitem__, text.replace("\n", " ").split(" ")))


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each document's ids, and ``end_id`` after them, in ascending doc_id.

    ``vocabulary``: a tokenizers file whose pre-tokenizer drops white space, so that words are
    encoded one by one. Null text is encoded as the empty one. Null ids come first; rows of one
    id are ordered by text, null first. An empty table gives files without blocks.
    """
    end = array("I", [] if end_id is None else [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        block, first, names, sizes, parts, held = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            payload = write_block(names, sizes, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pylist(
                [{"block": block, "first": first, "n_docs": len(names), "n_ids": held, "payload": payload}],
                pa.schema([("block", pa.int64()), ("first", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]),
            )

        for part in slices(batches):
            for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = (encode(text) if text else b"") + end
                names.append(name)
                sizes.append(len(raw) // 4)
                parts.append(raw)
                held += len(raw) // 4
                if held >= BLOCK:
                    yield closed()
                    block, first, names, sizes, parts, held = block + 1, first + held, [], [], [], 0
        if names:
            yield closed()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = ordered.mapInArrow(run, BLOCKS).withColumn("part", F.spark_partition_id())
    blocks.write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with ``with_ids`` its ids.

    Files without blocks give an empty result.
    """
    blocks = spark.read.schema(f"{BLOCKS}, part int").parquet(folder)
    # one row per part, as many as the writing job had partitions: this side is small by construction
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("base") + F.col("first")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                names, sizes, ids = read_block(payload.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": pa.array(names, pa.int64()), "start": pa.array(start + starts), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(sums, pa.int64())}
                if with_ids:
                    out["ids"] = pa.LargeListArray.from_arrays(np.append(0, ends), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(spark, folder)
