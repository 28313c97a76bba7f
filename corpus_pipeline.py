"""The corpus pipeline: quality, exact copies, near copies, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.llm import bpe, classifier, common, exact_dedup, mixing, near_dedup
from stormglass.llm.queries import vocabulary

#: Near copies: Jaccard similarity of five-word shingles, in percent.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3; the classifier learns from labels outside its held-out fold.

    Null and empty texts are judged like any other, rows that repeat stay or go alike; an empty table stays empty.
    """
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, the one with the smallest id; a null text equals an empty one."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; wordless texts and null ids stay."""
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets; wordless texts stay once, null sources are one source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with their digests; a null text has none."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), ids=True).drop("decoded")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: No SQL: the classifier, the similarity join, the solver and the encoder are not expressible; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, and deleted once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        written: list[str] = []
        docs = common.cut(stage(spark, docs, sf_dir), written)
        common.drop(spark, last)
        last = written
    return STAGES[-1][1](spark, docs, sf_dir)


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run(), with the ids as one string a row so that results compare as text."""
    return run(spark, sf_dir).withColumn("token_ids", F.concat_ws(" ", F.col("token_ids").cast("array<string>")))
