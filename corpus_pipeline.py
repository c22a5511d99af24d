"""Corpus preparation in stages; each one works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import Scratch
from foliomill.llm.language_id import keep_identified
from foliomill.llm.ngram_join import keep_one
from foliomill.llm.packing import pack, tokenizer_path
from foliomill.llm.secret_scan import redact
from foliomill.llm.suffix_dedup import without_repeats

#: Bytes of a repeated string: about 50 short words.
WIDTH = 250


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language learned, go."""
    return keep_identified(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: five words a shingle, similarity 0.8 or more."""
    return keep_one(docs, 5, 80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of WIDTH that stand elsewhere go, all copies of them."""
    return _counted(without_repeats(docs, WIDTH))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mark takes the place of each secret."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences."""
    return pack(docs, tokenizer_path(), 2048)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("suffix_dedup", suffix_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents table; each stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for i, (name, stage) in enumerate(STAGES[:-1]):
            after = scratch.written(stage(spark, docs, sf_dir), name)
            if i:
                scratch.drop(docs)
            docs = after
        return STAGES[-1][1](spark, docs, sf_dir)  # has written its pieces
