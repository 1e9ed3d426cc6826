"""From raw documents to packed sequences: quality, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return
the columns of documents, as they are and whatever further ones there are. run() writes each stage's result as
Parquet in the shared folder and reads it again, so a lost executor costs one stage's tasks at most.

Defined results: a null text counts as empty; the first stage scores it, the second drops it, as it has no letter.
Rows with a null id are held out of training where the operators say so, and come last where the smallest id stays.
Repeated rows count as copies. An empty table passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import exact_dedup, langid, near_dedup, packing, quality
from lodestrata.llm.base import documents, written
from lodestrata.session import ship

#: Documents below this score go.
QUALITY_AT_LEAST = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted to the labels, calls good."""
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, QUALITY_AT_LEAST)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the rank-order profiles know; texts without letters go."""
    ship(spark)
    return langid.identified(docs, langid.language_profiles(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, the one with the smallest id."""
    ship(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near copies, the one with the smallest id."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("language", keep_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]
#: No stage but the third can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
