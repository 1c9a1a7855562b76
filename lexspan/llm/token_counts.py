"""Token counts: lengths of encodings, without the ids.

Documents stay where they were read; nothing is shuffled. Each task takes its Arrow
batches in slices balanced by bytes and splits every text at safe boundaries. The distinct units of a
slice that the worker doesn't remember go to the library in batches, balanced by bytes
again; only their lengths are kept, and a text's count is the sum over its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import id_and_text, slices
from lexspan.llm.units import LONGEST, REMEMBERED, led, units

LIMIT = 512
#: Text that one call of the library gets.
BATCH_BYTES = 1 << 18


def _batches(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in order, in runs of about ``limit`` characters; a longer one is a run of its own."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


class UnitCounts:
    """Lengths of the encodings of texts, by batch calls over their units; lengths of short units are remembered.

    ``encode``: a list of texts to a list of lengths.
    """

    def __init__(self, encode: Callable[[list[str]], list[int]], entries: int = REMEMBERED):
        self.encode, self.entries = encode, entries
        self.known: tuple[dict[str, int], dict[str, int]] = {}, {}

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [units(t) for t in texts]
        unseen = [list(set().union(*(c[kind] for c in cut)) - self.known[kind].keys()) for kind in (0, 1)]
        asked = unseen[0] + ["".join(led(w)) for w in unseen[1]]
        lengths = [n for batch in _batches(asked) for n in self.encode(batch)]
        for kind, fresh in enumerate((lengths[: len(unseen[0])], lengths[len(unseen[0]) :])):
            self.known[kind].update(zip(unseen[kind], fresh, strict=True))
        out = [sum(map(self.known[0].__getitem__, some)) + sum(map(self.known[1].__getitem__, after)) for some, after in cut]
        for kind in (0, 1):  # longer units were needed for this slice only
            if len(self.known[kind]) > self.entries:
                self.known[kind].clear()
            for unit in unseen[kind]:
                if len(unit) > LONGEST:
                    self.known[kind].pop(unit, None)
        return out


@cache
def _counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """One counter in each Python worker, whose memory is kept over tasks."""
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(ids) for batch in _batches(texts) for ids in model.encode(batch, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    whole.no_truncation()
    whole.no_padding()
    return UnitCounts(lambda batch: [len(e) for e in whole.encode_batch_fast(batch, add_special_tokens=False)])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary``: a byte-level ``.json`` file, read by tokenizers, or a ``.model`` file, read
    by sentencepiece, whose texts are encoded whole, since its pieces depend on the text's start.
    Null or empty text: zeros, false. Null ids, repeated rows and ties: each row is counted by
    itself. An empty table gives an empty result; other columns aren't read. Special strings in
    a text count as the library's default has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            n = pa.array(count([t or "" for t in texts]), pa.int64())
            size = pa.array((len(t.encode()) if t else 0 for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n], ["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
