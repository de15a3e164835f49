"""From raw documents to token ids: quality rules, exact and near duplicates, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import exact_dedup, jaccard_join, mixing, quality_rules, scratch, sentence_piece


def stage(function):
    """Each stage's input is written, so what earlier stages kept aside has served and goes."""

    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, __name__)
        with scratch.owned(__name__):
            return function(docs)

    run_.__doc__ = function.__doc__
    return run_


@stage
def quality(docs: DataFrame) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@stage
def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    return exact_dedup.drop_duplicates(docs)


@stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id."""
    return jaccard_join.keep_first(docs)


@stage
def mixture(docs: DataFrame) -> DataFrame:
    """Documents by the budgets of domains, languages and sources; a document chosen in two epochs comes twice."""
    return mixing.mix(docs).select(*docs.columns)


@stage
def encoding(docs: DataFrame) -> DataFrame:
    """Token ids of each document, with their checksum and the checks of decoding and parity."""
    return sentence_piece.encode_texts(docs.select("doc_id", "lang", "source", "text"), sentence_piece.model_path())


STAGES = [("quality rules", quality), ("exact dedup", exact_duplicates), ("n-gram Jaccard join", near_duplicates), ("mixing", mixture), ("SentencePiece encoding", encoding)]

#: The near-duplicate join and the encoding have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; every stage's result is written to the shared folder and read again. What came before the last result is deleted."""
    folder = f"{scratch.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            scratch.delete(spark, f"{folder}/{i - 1}")
    scratch.release(spark, __name__)
    return docs
