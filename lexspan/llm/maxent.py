"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class, context). Classes are bins of frequent words, whose
members have their own weights, and classes of all other words by their ending, whose members share the
class by their counts. Weights belong to context features: the word before, the word before
that (a skip), both together (hashed), and none.

Training goes over all training texts in rounds, one more for each doubling of the texts. A task starts from the current weights
and Adagrad squares, takes its texts in mini-batches, and returns how far both moved, and by row of the tables how many tokens
used it. A row's moves are averaged over the tasks that used it, weighted by these tokens: what few texts have isn't
thinned by the others. What a task returns has the model's fixed size.

Counts of words can't be broadcast, their number grows with the corpus. Documents are dealt into
bundles of a fixed size in bytes; each bundle's distinct words meet the counts in a join by word and come back
to the bundle, where they are looked up. Texts are shuffled once for that. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import id_and_text, scrambled, settled, slices

#: Words of a class, classes of frequent words, classes of other words.
MEMBERS, FREQUENT, OTHER = 32, 16, 16
CLASSES, TOP = FREQUENT + OTHER, FREQUENT * MEMBERS
#: Context ids: frequent words, classes of others, the start of a text.
CONTEXTS = TOP + OTHER + 1
#: Rows of hashed word pairs, and rows of hashed pairs of feature and class.
PAIRS, INNER = 4096, 8192
ROWS = 1 + 2 * CONTEXTS + PAIRS
ROUNDS, BATCH, RATE = 3, 4096, 0.4
BUNDLE_BYTES = 8 << 20
#: Tasks of a round at least, where there are as many partitions, and tasks whose moves are averaged together first.
TASKS, TOGETHER = 8, 64
#: Rows of the tables in what a task returns at once.
BLOCK = 512
#: Distinct words that a task holds before it passes them on; a bundle's word may then come in several rows.
HELD_WORDS = 2_000_000


def endings(words: pa.Array) -> np.ndarray:
    """The classes of words by their last three bytes."""
    coded = pc.binary_slice(words, -3, None).dictionary_encode()
    return np.array([zlib.crc32(e) % OTHER for e in coded.dictionary.to_pylist()], np.int8)[np.asarray(coded.indices)]


def distinct(tokens: pa.Array | list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens, their 64-bit hashes as signed integers; by token, which of them it is."""
    import xxhash

    coded = (tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.binary())).dictionary_encode()
    own = coded.dictionary.cast(pa.binary())
    return own, np.fromiter(map(xxhash.xxh64_intdigest, own.to_pylist()), np.uint64, len(own)).view(np.int64), np.asarray(coded.indices)


def hashed(tokens: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens' 64-bit hashes, and their classes by ending; by token, which of them it is."""
    own, h, at = distinct(tokens)
    return h, endings(own), at


@dataclass
class Model:
    top: np.ndarray  # hashes of frequent words, sorted
    place: np.ndarray  # their ranks
    totals: np.ndarray  # by class of other words: sum of count + 1, and one for all unknown words
    outer: np.ndarray  # feature rows x classes
    inner: np.ndarray  # rows of feature and class x members

    def coded(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """By word: rank if frequent, else TOP + class of others."""
        if not len(self.top):
            return TOP + other.astype(np.int64)
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[at] == h, self.place[at], TOP + other.astype(np.int64))


def features(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By token: four rows of the outer table. first: the place where the token's text starts."""
    at = np.arange(len(codes))
    one = np.where(at - 1 >= first, codes[np.maximum(at - 1, 0)], CONTEXTS - 1)
    two = np.where(at - 2 >= first, codes[np.maximum(at - 2, 0)], CONTEXTS - 1)
    pair = scrambled((one * CONTEXTS + two).astype(np.uint64)) % np.uint64(PAIRS)
    return np.stack([np.zeros_like(one), 1 + one, 1 + CONTEXTS + two, 1 + 2 * CONTEXTS + pair.astype(np.int64)], axis=1)


def inner_rows(rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the inner table: without context each class has its own, the others are hashed."""
    hashed_rows = FREQUENT + (scrambled((rows * FREQUENT + cls[:, None]).astype(np.uint64)) % np.uint64(INNER - FREQUENT)).astype(np.int64)
    hashed_rows[:, 0] = cls
    return hashed_rows


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = table.take(rows[:, 0], axis=0)
    for f in range(1, rows.shape[1]):
        z += table.take(rows[:, f], axis=0)
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _added(table: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """An Adagrad step with the sums of grad by row; used counts the tokens of each."""
    for f in range(rows.shape[1]):
        column = rows[:, f].astype(np.uint16)
        if (column == column[0]).all():
            hit, total, n = column[:1], grad.sum(axis=0, keepdims=True), len(column)
        else:
            order = np.argsort(column, kind="stable")  # a radix sort, for 16 bits
            own = column[order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            hit, total, n = own[start], np.add.reduceat(grad.take(order, axis=0), start, axis=0), np.diff(start, append=len(own))
        used[hit] += n
        moved = squares.take(hit, axis=0) + total * total
        squares[hit] = moved
        table[hit] -= RATE * total / np.sqrt(moved)


def trained(model: Model, codes: np.ndarray, first: np.ndarray, squares: tuple[np.ndarray, np.ndarray], used: tuple[np.ndarray, np.ndarray]) -> None:
    """Mini-batches over tokens in their order; moves the model's tables, squares and used in place."""
    for at in range(0, len(codes), BATCH):
        lo = max(0, at - 2)
        own, rows = codes[at : at + BATCH], features(codes[lo : at + BATCH], first[lo : at + BATCH] - lo)[at - lo :]
        cls = np.where(own < TOP, own // MEMBERS, FREQUENT + own - TOP)
        p = _softmax(_summed(model.outer, rows))
        p[np.arange(len(own)), cls] -= 1
        known = np.flatnonzero(own < TOP)
        if len(known):
            inner = inner_rows(rows[known], cls[known])
            q = _softmax(_summed(model.inner, inner))
            q[np.arange(len(known)), own[known] % MEMBERS] -= 1
            _added(model.inner, squares[1], used[1], inner, q)
        _added(model.outer, squares[0], used[0], rows, p)


def log10_probabilities(model: Model, codes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes))
    for at in range(0, len(codes), BATCH):
        lo = max(0, at - 2)
        own, rows = codes[at : at + BATCH], features(codes[lo : at + BATCH], first[lo : at + BATCH] - lo)[at - lo :]
        cls = np.where(own < TOP, own // MEMBERS, FREQUENT + own - TOP)
        out[at : at + BATCH] = np.log10(np.maximum(_softmax(_summed(model.outer, rows))[np.arange(len(own)), cls], 1e-30))
        known = own < TOP
        if known.any():
            q = _softmax(_summed(model.inner, inner_rows(rows[known], cls[known])))
            out[at : at + BATCH][known] += np.log10(np.maximum(q[np.arange(len(q)), own[known] % MEMBERS], 1e-30))
        rest = ~known
        out[at : at + BATCH][rest] += np.log10((counts[at : at + BATCH][rest] + 1) / model.totals[own[rest] - TOP])
    return out


def _tokens(part: pa.RecordBatch | pa.Table) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the rows, an end (the empty token) after each text; and the tokens of each row.

    Arrow's white space of ASCII is the six characters between words, and its ASCII lower case that of A-Z alone.
    """
    text = part.column("text")
    text = pc.fill_null(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text, "")
    text = pc.ascii_trim_whitespace(pc.ascii_lower(text))
    # white space at the end gives an empty token there, and so does a text without words
    own = pc.ascii_split_whitespace(pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(text, "", " ")))
    return own.flatten(), np.asarray(pc.list_value_length(own)).astype(np.int64)


def _ready(texts: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, held_out, bundle: as many bundles as the bytes ask for; and their number."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bundles = max(1, -(-size // BUNDLE_BYTES))
    left = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0))
    return texts.select("doc_id", "text", (left == 2).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(bundles)).cast("int").alias("bundle")), bundles


class _Sums:
    """Words with their class and count, gathered in arrays and added up from time to time."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, w: np.ndarray, other: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((w, other, n))
        self.size += len(w)

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, other, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        keys, first, inverse = np.unique(w, return_index=True, return_inverse=True)
        return keys, other[first], np.bincount(inverse, n, len(keys)).astype(np.int64)


def _vocabulary(ready: DataFrame) -> DataFrame:
    """w, n, other: the words of training texts with their counts. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def flushed() -> pa.RecordBatch:
            w, other, n = sums.taken()
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(other), pa.array(n)], ["w", "other", "n"])

        for part in slices(batches):
            h, other, at = hashed(_tokens(part)[0])
            sums.add(h, other, np.bincount(at, minlength=len(h)))
            if sums.size > HELD_WORDS:
                yield flushed()
        if sums.size:
            yield flushed()

    rows = ready.where("NOT held_out").select("text").mapInArrow(run, "w long, other byte, n long")
    return settled(rows.groupBy("w").agg(F.sum("n").alias("n"), F.min("other").alias("other")), "vocabulary")


def _bundle_words(dealt: DataFrame) -> DataFrame:
    """bundle, w: a bundle's distinct words, few of them twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for b, parts in held.items():
                w = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), b, np.int32)), pa.array(w)], ["bundle", "w"])
            held.clear()

        for part in slices(batches):
            flat, sizes = _tokens(part)
            _, h, at = distinct(flat)
            bundle = np.repeat(part.column("bundle").to_numpy(), sizes)
            for b in np.unique(bundle).tolist():
                seen = np.zeros(len(h), bool)
                seen[at[bundle == b]] = True
                held.setdefault(b, []).append(h[seen])
                size += int(seen.sum())
            if size > HELD_WORDS:
                yield from flushed()
                size = 0
        yield from flushed()

    return dealt.mapInArrow(run, "bundle int, w long")


def _first_model(vocabulary: DataFrame) -> tuple[Model, int, int]:
    """The model before training: what counts alone say. TOP words and OTHER sums come to the driver."""
    total = vocabulary.agg(F.sum("n"), F.count("*")).first()
    top = vocabulary.orderBy(F.desc("n"), "w").limit(TOP)
    rows = top.collect()
    sums = {r[0]: r[1] for r in vocabulary.groupBy("other").agg(F.sum(F.col("n") + 1)).collect()}
    totals = np.array([sums.get(o, 0) for o in range(OTHER)], np.float64)
    for r in rows:
        totals[r["other"]] -= r["n"] + 1
    totals += 1
    h, n = np.array([r["w"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    order = np.argsort(h)
    member = np.full(TOP, -30.0)
    member[: len(n)] = np.log(n) if len(n) else 0
    mass = np.concatenate([np.bincount(np.arange(len(n)) // MEMBERS, n, FREQUENT), totals])
    outer, inner = np.zeros((ROWS, CLASSES), np.float32), np.zeros((INNER, MEMBERS), np.float32)
    outer[0] = np.log(np.maximum(mass, 1e-6) / mass.sum())
    inner[:FREQUENT] = member.reshape(FREQUENT, MEMBERS)
    return Model(h[order], order, totals, outer, inner), int(total[0] or 0), int(total[1])


def _round(model: Model, squares: tuple[np.ndarray, np.ndarray], texts: DataFrame) -> tuple[Model, tuple[np.ndarray, np.ndarray]]:
    """One round: every task trains on its texts, each row's moves are averaged over the tasks that used it. Returns weights and squares."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((model, squares))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before = held.value
        mine = Model(start.top, start.place, start.totals, start.outer.copy(), start.inner.copy())
        squares, n = (before[0].copy(), before[1].copy()), 0
        used = (np.zeros(len(mine.outer)), np.zeros(len(mine.inner)))
        for part in slices(batches):
            flat, size = _tokens(part)
            h, other, at = hashed(flat)
            ends = np.cumsum(size)
            trained(mine, mine.coded(h, other)[at], np.repeat(ends - size, size), squares, used)
            n += len(flat)
        if n:
            moved = np.concatenate([np.hstack([mine.outer - start.outer, squares[0] - before[0]]), np.hstack([mine.inner - start.inner, squares[1] - before[1]])])
            n_used = np.concatenate(used)
            cut = range(0, len(moved), BLOCK)
            at = TaskContext.get().partitionId() // TOGETHER
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(range(len(cut)), pa.int32()),
                "salt": pa.array([at] * len(cut), pa.int32()),
                "used": pa.array([n_used[i : i + BLOCK].tobytes() for i in cut], pa.binary()),
                "moved": pa.array([moved[i : i + BLOCK].tobytes() for i in cut], pa.binary()),
            })

    def mean(table: pa.Table) -> pa.Table:
        total, sums = 0.0, 0.0
        for raw_n, raw in zip(table["used"], table["moved"], strict=True):
            n = np.frombuffer(raw_n.as_py())
            total = total + n
            sums = sums + n[:, None] * np.frombuffer(raw.as_py(), np.float32).reshape(len(n), -1)
        sums = (sums / np.maximum(total, 1)[:, None]).astype(np.float32)
        return pa.table({"block": table["block"][:1], "salt": pa.array([0], pa.int32()), "used": pa.array([total.tobytes()], pa.binary()), "moved": pa.array([sums.tobytes()], pa.binary())})

    schema = "block int, salt int, used binary, moved binary"
    moves = texts.mapInArrow(train, schema).groupBy("block", "salt").applyInArrow(mean, schema).groupBy("block").applyInArrow(mean, schema)
    rows = sorted(moves.select("block", "moved").collect())  # the model's size
    if not rows:
        return model, squares
    moved = np.concatenate([np.frombuffer(r["moved"], np.float32) for r in rows]).reshape(ROWS + INNER, 2, CLASSES)  # CLASSES is MEMBERS
    outer, inner = moved[:ROWS], moved[ROWS:]
    return Model(model.top, model.place, model.totals, model.outer + outer[:, 0], model.inner + inner[:, 0]), (squares[0] + outer[:, 1], squares[1] + inner[:, 1])


def few_tasks(texts: DataFrame, bundles: int) -> DataFrame:
    """``texts`` in at most as many partitions as they fill bundles: a task returns the whole model, however few its texts."""
    return texts.coalesce(max(TASKS, bundles))


def score_texts(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(id as text) mod 7 isn't 2; a null id trains. Tokens are words, A-Z lower-cased, and an
    end. rounds are those of up to BUNDLE_BYTES of texts. base_score: add-one unigram log10 probability, score: the model's; a null text is an empty one. Repeated
    rows and ties: each row is scored, and counted, by itself. Without training texts every token is unknown. An
    empty table gives an empty result; other columns aren't read.
    """
    ready, bundles = _ready(id_and_text(docs, id_col, text_col))
    vocabulary = _vocabulary(ready)
    model, n_train, distinct = _first_model(vocabulary)
    train = few_tasks(ready.where("NOT held_out"), bundles)
    rounds += (bundles - 1).bit_length()
    squares = (np.ones_like(model.outer), np.ones_like(model.inner))
    for i in range(rounds):
        model, squares = _round(model, squares, train.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds)) == i).select("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    dealt = ready.repartition("bundle")  # once for both: the words of each bundle, and the bundle itself
    counts = _bundle_words(dealt).join(vocabulary.select("w", "n"), "w")
    log_all = np.log10(n_train + distinct + 1)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        model = held.value
        w, n = known["w"].to_numpy(), known["n"].to_numpy()
        order = np.argsort(w)
        w, n = w[order], n[order]
        out = []
        for part in slices(iter(texts.to_batches())):
            flat, size = _tokens(part)
            h, other, at = hashed(flat)
            near = np.minimum(np.searchsorted(w, h), max(0, len(w) - 1))
            c = (np.where(w[near] == h, n[near], 0) if len(w) else np.zeros(len(h), np.int64))[at]
            start = np.cumsum(size) - size
            logs = log10_probabilities(model, model.coded(h, other)[at], np.repeat(start, size), c)
            sums = lambda x: np.add.reduceat(x, start)  # noqa: E731, B023
            out.append(
                pa.table({
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "n_tokens": pa.array(size),
                    "n_known": pa.array(sums((c > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(len(size), n_train, np.int64)),
                    "base_score": pa.array(sums(np.log10(c + 1) - log_all)),
                    "score": pa.array(sums(logs)),
                })
            )
        return pa.concat_tables(out) if out else _NOTHING.empty_table()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("bundle").cogroup(counts.groupBy("bundle")).applyInArrow(score, schema)


_NOTHING = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
