"""Repetition coverage: how many of a text's characters lie inside n-grams and lines that the text has already had.

Documents stay where they were read; nothing is shuffled. A slice of documents becomes one
array of word numbers (exact, by Arrow's dictionary). One array of prefix sums gives the rolling
hash of every window of any length; hashes are sorted together with the document's number, so
equal neighbours are repeats inside one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm.common import id_and_text, scrambled, slices

#: n-gram lengths, and the share of a text's characters that may lie inside repeats of each. A header that comes again as a footer of a short text stays below.
LIMITS = {5: 0.30, 7: 0.28, 10: 0.25}
LINE_LIMIT = 0.30
BASE_WORDS, BASE_WINDOW = 50, 3
SYMBOLS = b"#*$%&|<>"
#: Odd, so that its powers have inverses modulo 2**64.
ROLL = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(values: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hash of every window of each length over the values: (prefix[i + n] - prefix[i]) / ROLL**i."""
    n = len(values)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled(values.astype(np.uint64) + np.uint64(1)) * _powers(ROLL, n), dtype=np.uint64)])
    back = _powers(pow(ROLL, -1, 1 << 64), n)
    return {k: (sums[k:] - sums[:-k]) * back[: n - k + 1] if n >= k else np.zeros(0, np.uint64) for k in lengths}


def repeats(hashes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """By window: does it lie in one document and repeat an earlier window of it; is it one of several equal ones."""
    later, several = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    inside = np.flatnonzero(owner[: len(hashes)] == owner[length - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    key = scrambled(hashes[inside]) + scrambled(owner[inside].astype(np.uint64) + np.uint64(ROLL))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later[inside[order[1:][same]]] = True
    several |= later
    several[inside[order[:-1][same]]] = True
    return later, several


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """By word: is it in a window of the given length that starts at one of these places."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str | None], limits: dict[int, float]) -> dict[str, np.ndarray]:
    raw = [t.encode() if t else b"" for t in texts]
    tokens = [r.split() for r in raw]
    docs, n_words = len(texts), np.array([len(t) for t in tokens], np.int64)
    flat = [w for t in tokens for w in t]
    n, owner = len(flat), np.repeat(np.arange(docs), n_words)
    ids = np.asarray(pa.array(flat, pa.binary()).dictionary_encode().indices).astype(np.int64)
    size = np.fromiter(map(len, flat), np.int64, n)
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(flat), np.uint8) & 0xC0) != 0x80)])
    ends = np.cumsum(size)
    chars = heads[ends] - heads[ends - size] if n else size
    per_doc = lambda x: np.bincount(owner, x, docs).astype(np.int64) if n else np.zeros(docs, np.int64)
    word_chars = per_doc(chars)
    dup_lines, dup_line_chars = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for d, t in enumerate(texts):
        seen: set[str] = set()
        for line in t.split("\n") if t else []:
            own = line.encode().split()
            if own and line in seen:
                dup_lines[d] += 1
                dup_line_chars[d] += sum(len(w.decode()) for w in own)
            elif own:
                seen.add(line)
    share = lambda x: x / np.maximum(word_chars, 1)
    hashes = window_hashes(ids, (BASE_WINDOW, *limits))
    several = repeats(hashes[BASE_WINDOW], owner, BASE_WINDOW)[1]
    n_repeat = per_doc(covered(several, BASE_WINDOW, n).astype(np.int64))
    cover = {k: share(per_doc(covered(repeats(hashes[k], owner, k)[0], k, n) * chars)) for k in limits}
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raw], np.int64),
        "n_dup_lines": dup_lines,
        "n_repeat_words": n_repeat,
        "line_cover": share(dup_line_chars),
    } | {f"cover_{k}": v for k, v in cover.items()}


def repetition_rules(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, shares of characters inside repeats, base_failed, kept.

    line_cover and cover_n are shares of word_chars: characters of lines, and of words inside
    n-word windows, that the text has had before. kept: not base_failed, and no share above its
    limit. base_failed: fewer than 50 words, or over half of them in 3-word windows that come
    twice or more. Null or empty text: zeros, base_failed. A text shorter than a window has no
    such window. Null ids, repeated rows and ties: each row is measured by itself. An empty table
    gives an empty result; other columns aren't read.
    """
    limits = limits or LIMITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            m = measure(part.column("text").to_pylist(), limits)
            failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            kept = ~failed & (m["line_cover"] <= line_limit)
            for k, most in limits.items():
                kept &= m[f"cover_{k}"] <= most
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in m.items()} | {"base_failed": pa.array(failed), "kept": pa.array(kept)})

    covers = "".join(f", cover_{k} double" for k in limits)
    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_cover double{covers}, base_failed boolean, kept boolean"
    )


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
