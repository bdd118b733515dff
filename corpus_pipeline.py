"""A corpus pipeline: each stage works on all that its predecessor kept, is written as Parquet and read again.

Quality classifier (rejected documents go), line dedup (lines that ten documents share go), n-gram Jaccard join
(the smallest doc_id of each class of five-word shingle sets at a similarity of 0.8 stays), benchmark decontamination
(documents with a benchmark item go), piece encoding.  All stages but the last return the columns of documents; the
last returns doc_id and the piece ids.  Rows without a doc_id are no near duplicates and stay, null texts are kept or
rejected as the quality model's features of no words are, repeated rows of one doc_id and text stay together, rows of
one doc_id with different texts are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.llm import quality_model
from shardflow.llm.common import read, stored
from shardflow.llm.decontaminate import decontaminate
from shardflow.llm.line_dedup import dedup_lines
from shardflow.llm.ngram_join import near_duplicates
from shardflow.llm.pieces import encode, load_pieces
from shardflow.llm.queries import PIECE_MODEL


def _applied(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after a step, which sees columns that no stage knows under names that clash with no result."""
    known = ("doc_id", "text", "n_chars")
    names = {c: c if c in known else f"other{k}" for k, c in enumerate(docs.columns)}
    return step(docs.toDF(*names.values())).select(*[F.col(n).alias(c) for c, n in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels, doesn't reject."""
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    return _applied(docs, lambda d: quality_model.score_quality(d, model).filter("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them share; n_chars follows the text."""
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _applied(docs, lambda d: dedup_lines(d, min_docs=10, min_chars=1).withColumn("n_chars", changed))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    copies = near_duplicates(docs, n=5, percent=80).filter("component_id <> doc_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(copies, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return _applied(docs, lambda d: decontaminate(d, read(spark, sf_dir, "benchmark")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document."""
    return encode(docs.select("doc_id", "text"), load_pieces(PIECE_MODEL), keep_text=False)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("pieces", pieces)]

#: No stage but line dedup can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
