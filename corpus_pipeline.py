"""A corpus pipeline of five operators; each stage's rows are written as Parquet and read as the next one's documents.

In every stage null texts are texts without words; rows that repeat are separate documents unless the stage says
otherwise; empty tables give empty tables; columns beyond those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import decontam, idplanes, jaccard, mixing, quality
from quernel.llm.queries import tokenizer
from quernel.llm.store import stash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels of both kinds all get one score, and without any label all stay."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the row of least (doc_id, text hash), ids before none; rows without words all stay."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; items without an id count too, an empty benchmark drops nothing."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source of its own, documents without words are taken never."""
    return mixing.mixed_documents(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from byte planes; a document without text is the end id alone."""
    return idplanes.write_and_read(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mix", mix_sources),
    ("token_id_planes", write_ids),
]

#: Boosted trees and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
