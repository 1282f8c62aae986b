"""A corpus cleaned in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollweave.llm import decontam, language, lines, ngrams, pieces, queries
from pollweave.llm.texts import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the rejected ones go."""
    judged = language.predict(docs, language.learn(docs), keep=tuple(docs.columns))
    return judged.where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; documents of which nothing is left go."""
    kept = lines.dedup_lines(docs)
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(lines.WORD))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near copies."""
    return ngrams.first_of_class(docs, ngrams.similar(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.without_contaminated(docs, decontam.matches(docs, benchmark))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what the other stages left, and what they decode to."""
    return pieces.encode_decode(docs, public_tokenizers.path(queries.PIECE_MODEL)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
# MinHash, compression and piece segmentation have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
