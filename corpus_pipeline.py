"""The training-data pipeline: documents in, packed sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``. Null texts are empty, null ids are kept, and an empty table
passes through every stage; see the operators for ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runforge.llm import exact_dedup, packing, quality, simhash, substring_dedup
from runforge.llm.common import table
from runforge.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.drop_near_copies(docs, shingle=4, max_distance=4)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that come first elsewhere; ``n_chars`` follows the text."""
    done = substring_dedup.remove_repeats(docs).drop("_spans")
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, a row a piece."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact dedup", one_of_equal), ("near dedup", one_of_near),
          ("substring dedup", no_repeated_passages), ("packing", packed)]

#: SQL cannot express the classifier, the tokenizer or the packing; tests/llm has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
