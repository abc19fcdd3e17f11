"""Corpus sources and sinks (IO4-IO7): catalog selection, parquet corpora,
compressed payload decoding and sorted CSV export."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_corpora(catalog: DataFrame, prefix: str, exclude: str = "-eval-",
                   col: str = "dataset_id") -> DataFrame:
    """IO4: dataset ids starting with ``prefix`` and not containing ``exclude``."""
    return catalog.where(F.col(col).startswith(prefix) & ~F.col(col).contains(exclude)).select(col)


def write_corpus(df: DataFrame, path: str, by: str = "dataset") -> None:
    """Store a corpus partitioned by dataset, so dataset selection prunes files."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_selected(spark: SparkSession, path: str, selection: DataFrame, by: str = "dataset",
                  key: str = "dataset_id") -> DataFrame:
    """Read only the selected datasets of a partitioned corpus: a semi join on
    the partition column with the (small) catalog selection, which dynamic
    partition pruning turns into a partition filter on the scan."""
    corpus = spark.read.parquet(path)
    return corpus.join(selection.select(F.col(key).alias(by)), by, "left_semi")


def read_corpus(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """IO5: read one or more parquet corpora (train split) into one frame by column name, in one scan.

    Corpora written partitioned by ``dataset`` get partition pruning for free
    when the caller filters on it.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    return reader.parquet(*paths)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _inflate(payload: pd.Series) -> pd.DataFrame:
    texts, errors = [], []
    for b in payload:
        if b is None:
            texts.append(None)
            errors.append("null payload")
            continue
        try:
            texts.append(zlib.decompress(bytes(b)).decode("utf-8"))
            errors.append(None)
        except Exception as e:  # noqa: BLE001 - a bad row is reported, not fatal
            texts.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return pd.DataFrame({"text": texts, "error": errors})


def decode_content(df: DataFrame, col: str = "content", out: str = "text") -> DataFrame:
    """IO6: base64 -> zlib inflate -> UTF-8. Bad rows get ``decode_error`` instead of failing.

    ``unbase64`` is a JVM built-in; Spark has no inflate function, so only the
    inflate runs in an Arrow-batched pandas UDF.
    """
    raw = F.try_to_binary(F.col(col), F.lit("base64"))
    dec = _inflate(raw)
    return (df.withColumn("_rf_dec", dec)
            .withColumn(out, F.col("_rf_dec.text"))
            .withColumn("decode_error", F.when(raw.isNull() & F.col(col).isNotNull(), F.lit("bad base64"))
                        .otherwise(F.col("_rf_dec.error")))
            .drop("_rf_dec"))


@F.pandas_udf(T.BinaryType())
def _deflate(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else zlib.compress(t.encode("utf-8")))


def encode_content(df: DataFrame, col: str = "text", out: str = "content") -> DataFrame:
    """Inverse of :func:`decode_content` (UTF-8 -> zlib -> base64), for round trips."""
    return df.withColumn(out, F.base64(_deflate(F.col(col))))


def sorted_results(df: DataFrame) -> DataFrame:
    """IO7 ordering: by task_name then score, ascending."""
    return df.orderBy("task_name", "score", "model_name")


def write_results(df: DataFrame, path: str) -> None:
    """IO7: export the result table sorted by (task_name, score) as CSV with a header.

    The sort is a range-partitioned global sort; files come out in order
    (part-00000 first), never coalesced to one task.
    """
    sorted_results(df).write.mode("overwrite").option("header", True).csv(path)
