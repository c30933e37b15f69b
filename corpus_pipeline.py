"""From raw documents to token ids: five stages, each written as Parquet and read again before the next.

1. language: documents without a recognisable language go.
2. line_dedup: lines that five or more documents hold stay in one of them.
3. near_dups: one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays.
4. decontaminate: what a text shares with benchmark items leaves it; a document that is mostly such text goes.
5. bpe: the texts that are left, as token ids and decoded again.

Stages before the last return the columns of documents. Where a stage changes a text, n_chars follows it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import bpe_chunks, decontaminate, encoders, language, line_dedup, near_dups, queries
from lodeseam.llm.common import sha, shared_dir, table


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, n_chars brought in line with the text."""
    return docs.select(*(F.when(F.col("text").isNull(), F.col(c)).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(c) for c in columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs), min_score=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.dedup_lines(docs, min_chars=40, min_docs=5), docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.drop_near_duplicates(docs, shingle=5, threshold=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5), docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe_chunks.encode_chunked(docs, encoders.WordEncoder.opened(queries.tokenizer_path("word_bpe_49k.json")))
    return coded.select("doc_id", "n_tokens", sha(F.col("ids")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dups", near_dup_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", bpe_stage),
]

#: Neither a trained classifier nor byte-pair encoding can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
