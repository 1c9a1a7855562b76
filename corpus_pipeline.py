"""Corpus preparation: each stage takes the documents that the one before kept.

quality    documents that the ordinal classifier rejects go
lines      lines that repeat an earlier line go, and documents of which nothing is left
near       of each group of near-duplicates the document with the least id stays
benchmark  documents that hold a benchmark item go
bpe        ids of what is left, and the text decoded from them

All stages but the last return the columns of documents; n_chars is the length of the text as
it now is. Rows with a null text pass the filters as empty texts do. Where ids are null or shared, rows
are told apart by their texts. Other columns, whatever their names, come along as they are. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import apart, row_key, settled
from lexspan.llm.decontamination import contaminated
from lexspan.llm.line_dedup import dedup_lines
from lexspan.llm.lsh_forest import kept_rows
from lexspan.llm.ordinal import LEAST, graded, scored, train
from lexspan.llm.transducer import encode_decode


def keyed(docs: DataFrame) -> DataFrame:
    """whole, a struct of all columns, so that none of them can clash with what a stage adds; row, the row's key; doc_id and text."""
    return docs.select(F.struct("*").alias("whole"), row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of the highest grade is LEAST or more, as they are; a null text is judged as an empty one."""
    model = train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    judged = keyed(docs).withColumn("judged", scored(model, F.col("text"), spark))
    return judged.where(F.col("judged.tail_probability") >= LEAST).select("whole.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that repeat an earlier one (see dedup_lines), n_chars anew; rows left without a word go."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least id; texts without words are in no group and all stay."""
    kept = kept_rows(docs).select("row")
    # equal rows of one id are in one group, and so are equal texts without an id: one of them stays
    copies = F.when(F.col("doc_id").isNull(), apart(F.col("text"))).otherwise(0)
    return keyed(docs).join(kept, "row", "left_semi").withColumn("apart", copies).dropDuplicates(["row", "apart"]).select("whole.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, as they are."""
    found = contaminated(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return keyed(docs).join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select("whole.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, n_tokens and digests of ids and decoded text."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("bpe", bpe)]
#: The classifier and BPE can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
