"""A training corpus from documents in five stages, each written as Parquet and read by the next.

All stages but the last return the columns of documents. Rows with null ids pass through; a null text has no letter, so
the first stage drops it. Empty tables give empty results of the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestow.llm import decontaminate, langid, mixing, nearcopies, substrings
from lodestow.llm.base import shared_folder

#: Bytes of a repeat that is cut: some fifty short words.
REPEAT = 240
#: Bits within which fingerprints make a pair of texts candidates; those in reach only of the bands are found by these.
RADIUS = 7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a known language (operator 3)."""
    return langid.recognised(docs, langid.fit(docs)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, which share 0.8 of their 5-word shingles (operator 9, verified): that with the smallest id."""
    named = docs.withColumn("_lodestow_node", F.xxhash64("text"))
    one = nearcopies.kept(docs, RADIUS).select(F.col("doc_id").alias("_lodestow_id"), F.col("node").alias("_lodestow_kept"))
    rest = named.where("doc_id is not null").join(one, (F.col("doc_id") == F.col("_lodestow_id")) & (F.col("_lodestow_node") == F.col("_lodestow_kept")), "left_semi")
    # rows that repeat both id and text are copies; another text under the same id is not
    return named.where("doc_id is null").unionByName(rest.dropDuplicates(["doc_id", "_lodestow_node"])).select(*docs.columns)


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that repeat anywhere (operator 5); a text that is nothing else goes."""
    return substrings.cleaned(docs, REPEAT).where("trim(text) != ''")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item (operator 8)."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document (operator 10)."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substring_duplicates", substring_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
]

#: No stage but the last can be stated in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
