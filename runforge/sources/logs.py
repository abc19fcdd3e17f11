"""Run-log sources and sinks (IO1-IO3, IO8, IO9).

Logs are JSON lines. Schemas are always explicit: inference would turn the
per-dataset counters into structs with one field per dataset. Torn lines (a
killed run) are read through ``_corrupt_record``, dropped and counted.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.session import ensure_checkpoint_dir

CORRUPT = "_corrupt_record"

STEP_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("reduced_dim", T.IntegerType()),
    T.StructField("task", T.StringType()),
    T.StructField("num_samples", T.LongType()),
    T.StructField("num_identifiers", T.LongType()),
    T.StructField("num_tokens", T.LongType()),
    T.StructField("samples_by_dataset", T.MapType(T.StringType(), T.LongType())),
    T.StructField("tokens_by_dataset", T.MapType(T.StringType(), T.LongType())),
    T.StructField("loss", T.DoubleType()),
    T.StructField("clip_threshold", T.DoubleType()),
    T.StructField("sample_time", T.DoubleType()),
    T.StructField("forward_time", T.DoubleType()),
    T.StructField("backward_time", T.DoubleType()),
    T.StructField("optimizer_time", T.DoubleType()),
    T.StructField("step_time", T.DoubleType()),
    T.StructField("total_time", T.DoubleType()),
    T.StructField("token_rate", T.DoubleType()),
    T.StructField("time", T.TimestampType()),
])

EVAL_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("mean", "median", "std", "min", "p5", "p95", "max")],
    T.StructField("num_samples", T.LongType()),
    T.StructField("svd_mean_ratio_1", T.DoubleType()),
    T.StructField("svd_median_ratio_1", T.DoubleType()),
])

OBJECTS_SCHEMA = T.StructType([T.StructField("step", T.LongType()),
                               T.StructField("objects", T.ArrayType(T.StringType()))])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def _read_json(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(with_corrupt)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("allowNonNumericNumbers", True)
            .json(paths if isinstance(paths, (list, str)) else list(paths)))


def read_step_log(spark: SparkSession, paths, schema: T.StructType = STEP_SCHEMA) -> DataFrame:
    """IO1: step log rows; missing ``task`` -> 'unknown'; torn lines dropped.

    Read a folder of ``run_id=<id>`` sub-folders to get ``run_id`` by partition
    discovery, or add it from ``_metadata.file_path``. The per-dataset
    counters stay map columns (see ``dataset_proportions``).
    """
    return (_good_lines(_read_json(spark, paths, schema), schema)
            .withColumn("task", F.coalesce(F.col("task"), F.lit("unknown"))))


def _good_lines(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Parsed lines that carry the first schema field (``step``). Testing that
    field also keeps it in every scan: Spark refuses raw-JSON queries that
    would read only the corrupt-record column (e.g. a count by partition)."""
    first = schema.fields[0].name
    return raw.where(F.col(CORRUPT).isNull() & F.col(first).isNotNull()).drop(CORRUPT)


def read_run_logs(spark: SparkSession, paths, schema: T.StructType = STEP_SCHEMA,
                  pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """IO1 for logs laid out as ``<run>/log.jsonl``: like :func:`read_step_log`,
    with ``run_id`` taken from each file's path (first group of ``pattern``,
    by default the parent folder name)."""
    log = read_step_log(spark, paths, schema)
    return log.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def bad_line_counts(spark: SparkSession, paths, schema: T.StructType = STEP_SCHEMA) -> DataFrame:
    """IO1: bad lines per file: unparsable (e.g. torn) lines, and lines without
    the first schema field (``step``), which cannot be placed in a run.

    Spark refuses raw-JSON queries that need only the corrupt-record column;
    testing the first field as well keeps it in the scan.
    """
    raw = _read_json(spark, paths, schema)
    first = schema.fields[0].name
    return (raw.where(F.col(CORRUPT).isNotNull() | F.col(first).isNull())
            .groupBy(F.col("_metadata.file_path").alias("file_path"))
            .agg(F.count(F.lit(1)).alias("bad_lines")))


def read_eval_log(spark: SparkSession, paths, schema: T.StructType = EVAL_SCHEMA) -> DataFrame:
    """IO2: eval log rows with ``line_key`` = (file_path, file_block_start, row id),
    which orders rows in file line order (a restart writes a step-0 eval after
    later ones, so step order is not line order). Compare the whole key: row ids
    follow Spark's packing of files into tasks, not the order of the files."""
    raw = _read_json(spark, paths, schema)
    return (_good_lines(raw, schema)
            .withColumn("line_key", F.struct(F.col("_metadata.file_path").alias("file"),
                                             F.col("_metadata.file_block_start").alias("block"),
                                             F.monotonically_increasing_id().alias("row"))))


def read_run_evals(spark: SparkSession, paths, schema: T.StructType = EVAL_SCHEMA,
                   pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """IO2 with ``run_id`` taken from each file's path, like :func:`read_run_logs`."""
    ev = read_eval_log(spark, paths, schema)
    return ev.withColumn("run_id", F.regexp_extract("line_key.file", pattern, 1))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def split_objects(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO3: move the per-step ``objects`` list to a sidecar (step, objects);
    empty lists are not written."""
    side = log.where(F.size("objects") > 0).select("step", "objects")
    return log.drop("objects"), side


def write_objects(side: DataFrame, path: str, mode: str = "append") -> None:
    """IO3: sidecar as gzip JSON lines (many part files: a gz file is one task)."""
    side.write.mode(mode).option("compression", "gzip").json(path)


def read_objects(spark: SparkSession, paths) -> DataFrame:
    """IO3: read the gz sidecar back as (step, identifier) rows."""
    raw = spark.read.schema(OBJECTS_SCHEMA).json(paths)
    return raw.select("step", F.explode("objects").alias("identifier"))


def write_stats(stats: DataFrame, path: str) -> None:
    """IO8: statistics report as JSON lines."""
    stats.write.mode("overwrite").json(path)


def write_eval_samples(samples: DataFrame, path: str) -> None:
    """IO9: eval sample set (nested int arrays) as JSON lines, for restarts."""
    samples.write.mode("overwrite").json(path)


EVAL_SAMPLE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("chunk_idx", T.IntegerType()),
    *[T.StructField(c, T.ArrayType(T.ArrayType(T.IntegerType())))
      for c in ("input_ids", "attention_mask", "labels")]])


def read_eval_samples(spark: SparkSession, path: str, schema: T.StructType = EVAL_SAMPLE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
