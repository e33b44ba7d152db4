"""Cleaning, deduplicating, mixing and packing a corpus, stage by stage.

Each stage reads what the one before it kept, from Parquet. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinframe.llm import _common, exact, minhash, mixing, packing, toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, learned from the labelled ones, doesn't reject.

    Each row by its own text: null and empty texts stay unless texts without terms are toxic; null and repeated ids are like
    others; an empty table, or one without labels, loses nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.drop_toxic(docs, toxic.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest id; null texts are empty ones, so one of these stays in all.

    A null id is the smallest; of a repeated row one stays; an empty table gives no rows."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, one with the smallest id; texts without a word, null ones among them, all stay.

    Rows without an id stay if no other of their class is there; of a repeated row one stays; an empty table gives no rows."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; null sources are one source, null texts have no words.

    Rows with a null or repeated id are documents each for itself; an empty table gives no rows."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids; null and empty texts have the end id alone.

    Null ids stay null; rows with equal ids, copies of the mix among them, are packed each for itself; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_windows", pack_windows)]

#: Learned scores, sampled near duplicates and tokens can't be had from SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _common.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
