"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score): one hashed weight per feature of a text is shared by all
grades, and the ordered thresholds cut the score. Fitting takes at most ``sample``
labelled rows, those with the lowest hash of their id, so what reaches the driver is bounded;
scoring runs over all texts inside Arrow batches, with no shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import id_and_text
from lexspan.llm.units import Memory
from lexspan.session import ship_package

BUCKETS = 1 << 18
#: Labelled rows that a fit takes at most.
SAMPLE = 20_000
#: The probability of the highest grade from which a text is kept.
LEAST = 0.7


def _bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


def _of_word(word: str) -> tuple[int, ...]:
    """Buckets of a word, its first four letters, and its shape (what stands around its letters, and its case)."""
    low = word.lower()
    core = low.strip("\"'()[]{}.,;:!?#*$%&|<>-_")
    at = low.find(core) if core else 0
    case = "A" if len(core) > 1 and word[at : at + len(core)].isupper() else "a" if core else ""
    shape = f"{low[:at]}{case}{low[at + len(core) :]}"
    return _bucket(b"w" + core.encode()), _bucket(b"p" + core[:4].encode()), _bucket(b"s" + shape.encode())


@cache
def _words() -> Memory:
    return Memory(_of_word, 100_000)


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text: its words, and how long and how varied it is; a null text is an empty one."""
    tokens = text.split() if text else []
    distinct = set(tokens)
    out = set().union(*map(_words().__getitem__, distinct))
    n = len(tokens)
    out.add(_bucket(b"every text"))
    out.add(_bucket(b"length %d" % n.bit_length()))
    out.add(_bucket(b"varied %d" % (10 * len(distinct) // max(1, n)) + b" of %d" % (n.bit_length() // 2)))
    same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    out.add(_bucket(b"in a row %d" % (20 * same // max(1, n))))
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    out.add(_bucket(b"lines again %d" % (10 * (len(lines) - len(set(lines))) // max(1, len(lines)))))
    return np.array(sorted(out), np.int32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """By row: P(grade >= k) for k = 1 .. grades - 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 8, rate: float = 0.3, l1: float = 5e-4, batch: int = 128, least: int = 3) -> OrdinalModel:
    """Adagrad with an L1 step over mini-batches of hashed rows, in a fixed order.

    Buckets of fewer than ``least`` rows get no weight. Rare grades count more, by the square root of
    their rarity.
    """
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    count = np.bincount(grades, minlength=levels)
    by_grade = np.sqrt(len(grades) / (levels * np.maximum(count, 1)))
    by_row = by_grade[grades] / by_grade[grades].mean()
    share = np.cumsum((count * by_grade)[:-1] + 1) / ((count * by_grade).sum() + levels)
    cuts, cut_squares = np.log(share / (1 - share)), np.full(levels - 1, 1e-2)
    known = np.bincount(np.concatenate(rows), minlength=BUCKETS) >= least
    rows = [np.append(r[known[r]], _bucket(b"every text")) for r in rows]
    order = np.random.default_rng(0)
    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = turn[at : at + batch]
            idx, size = np.concatenate([rows[i] for i in some]), np.array([len(rows[i]) for i in some])
            s, y, own = np.add.reduceat(weights[idx], np.cumsum(size) - size), grades[some], by_row[some]
            padded = np.concatenate([[-np.inf], cuts, [np.inf]])
            sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
            hi, lo = np.where(y == levels - 1, 1.0, sigmoid(padded[y + 1] - s)), np.where(y == 0, 0.0, sigmoid(padded[y] - s))
            step = np.bincount(idx, np.repeat((1 - hi - lo) * own, size), BUCKETS) / len(some)
            squares += step * step
            pace = rate / np.sqrt(squares)
            weights -= pace * step
            weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * l1, 0)
            p = np.maximum(hi - lo, 1e-9)
            down = np.bincount(y + 1, -hi * (1 - hi) / p * own, levels + 1) + np.bincount(y, lo * (1 - lo) / p * own, levels + 1)
            down = down[1:-1] / len(some)
            cut_squares += down * down
            cuts = np.maximum.accumulate(cuts - rate * down / np.sqrt(cut_squares))
    return OrdinalModel(weights.astype(np.float32), cuts)


def train(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on ``ratings`` (doc_id, grade from 0 to levels - 1) joined to their texts.

    At most ``sample`` ratings, those with the lowest hash of the id, are used. Null ids, null grades
    and grades outside the range are left out; an id rated twice has its lowest grade. Without
    any usable row the model gives every text the same, even probabilities.
    """
    usable = ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id IS NOT NULL").where(F.col("grade").between(0, levels - 1))
    chosen = usable.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<int>")
    def hashed(text: pd.Series) -> pd.Series:
        return text.map(features)

    texts = id_and_text(docs, id_col, text_col)
    # sample rows of two numbers each: this side is small by construction
    pairs = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", hashed("text").alias("f"))
    pairs = pairs.orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(sample).toArrow()  # rows of one id count each, within the bound
    rows = [x.values.to_numpy() for x in pairs["f"]]
    if not rows:
        return OrdinalModel(np.zeros(BUCKETS, np.float32), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1)))
    return fit(rows, pairs["grade"].to_numpy().astype(np.int64), levels)


def scored(model: OrdinalModel, text: Column, spark: SparkSession) -> Column:
    """Struct of expected_grade and tail_probability, P(the highest grade)."""
    ship_package(spark)
    held = spark.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def score(texts: pd.Series) -> pd.DataFrame:
        weights, cuts = held.value
        s = np.array([weights[features(t)].sum(dtype=np.float64) for t in texts])
        p = OrdinalModel(weights, cuts).probabilities(s)
        return pd.DataFrame({"expected_grade": p.sum(axis=1), "tail_probability": p[:, -1]})

    return score(text)


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 for low quality, 1 for toxic, 2 for neither; a null counts as 0 quality, not toxic."""
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.select("doc_id", F.when(~good, 0).when(toxic, 1).otherwise(2).alias("grade"))


def classify(docs: DataFrame, model: OrdinalModel, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability, kept (tail_probability >= least).

    A null text is scored as an empty one. Null ids, repeated rows and ties: each row by itself. An
    empty table gives an empty result; other columns aren't read.
    """
    texts = id_and_text(docs, id_col, text_col)
    out = texts.select("doc_id", scored(model, F.col("text"), docs.sparkSession).alias("s"))
    return out.select("doc_id", "s.expected_grade", "s.tail_probability", (F.col("s.tail_probability") >= least).alias("kept"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return classify(docs, model)
