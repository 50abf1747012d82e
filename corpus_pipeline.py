"""A training corpus from `documents`: classify, deduplicate, decontaminate, mix, shard.

Every stage takes whole texts of any length, rows with nulls in any column, rows that repeat or share an id, tables with more
columns (which stay, but for `shard` and `slot` in the last stage) and empty tables, which stay empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, neardup, quality, shard
from tessera.llm.common import cut


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    Null and empty texts are scored alike, as texts without words; labels with null ids or qualities teach nothing; without
    labels every document scores 0.5 and stays; repeated rows score alike.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out="__score").filter("__score >= 0.5").drop("__score")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, 0.8).

    Rows that share an id stay or go together, with the ids of which one row is kept; null ids are one id, after all others.
    Null texts and texts without words are in no group and stay.  Ties cannot be: an id is the smallest of its group or not.
    """
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.  Null and empty texts and items match nothing; repeated rows fare alike."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes of each document, repeats included.

    Documents of which nothing is taken go, and so do null and empty texts; a null source is a source; rows of equal id and
    text each have their own share.
    """
    return mixing.mixed_texts(docs, mixing.mix(docs))


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot; repeated rows are placed one by one, nulls are values like any other."""
    return shard.shard(docs, 24)


STAGES = [("quality_classifier", classify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", deal)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
