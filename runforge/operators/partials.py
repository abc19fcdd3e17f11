"""Run reports that follow a log: stored partial results of each part file, merged on demand.

A report over a run's whole log need not read what it has read before. :func:`update`
finds the part files that the store does not know, reads only those, and appends a row
a (run, file): number, mean and sum of squared differences of the losses, extremes, sums of
the timings, tokens, the last rows and a histogram of fixed bin width. The reports merge
such rows: means and variances pairwise (never by subtracting sums of squares), extremes,
sums and bins as they are, and the last rows of a run from the last rows of its files.

A file that has changed in size is read again and its newest row counts. Files are listed
by Spark, so any store that it reads will do; only the paths of new files pass the
driver. One writer a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runforge.operators.runlog import TIMING_COLS, _last_k
from runforge.sources.logs import STEP_SCHEMA, exists, read_step_log

TAIL = 100
BIN_WIDTH = 0.25
#: What ``bin`` says of losses that have no bin.
NO_BIN = "not finite"


def _run_of(path: Column, pattern: str) -> Column:
    return F.regexp_extract(path, pattern, 1)


def partials(log: DataFrame, tail: int = TAIL, bin_width: float = BIN_WIDTH) -> DataFrame:
    """A row for each (run_id, file) of a step log."""
    by = ["run_id", "file"]
    loss = F.nanvl("loss", F.lit(None).cast("double"))
    timings = [c for c in TIMING_COLS if c in log.columns]
    main = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("loss").alias("n_loss"), F.avg("loss").alias("mean"),
        (F.var_pop("loss") * F.count("loss")).alias("m2"), F.min(loss).alias("min_loss"), F.max(loss).alias("max_loss"),
        F.max("step").alias("last_step"), F.max_by("loss", "step").alias("final_loss"), F.sum("num_tokens").cast("long").alias("tokens"),
        F.struct(*[F.sum(c).alias(c) for c in timings]).alias("time_sums"), F.struct(*[F.count(c).alias(c) for c in timings]).alias("time_counts"))
    last = (_last_k(log.select(*by, "step", "loss"), by, "step", tail).groupBy(*by)
            .agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("last")))
    finite = F.abs(F.col("loss")) < float("inf")
    place = F.when(F.col("loss").isNotNull(), F.when(finite & ~F.isnan("loss"), F.floor(F.col("loss") / bin_width).cast("string")).otherwise(NO_BIN))
    bins = (log.where("loss is not null").groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("k")).groupBy(*by)
            .agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("bins")))
    return main.join(last, by, "left").join(bins, by, "left")


def update(spark: SparkSession, root: str, store: str, pattern: str = r"run_id=([^/]+)", tail: int = TAIL, bin_width: float = BIN_WIDTH,
           schema=STEP_SCHEMA) -> list[str]:
    """Read the part files under ``root`` that ``store`` does not know, add their partial results, and return their paths.

    ``run_id`` is the first group of ``pattern`` in a file's path.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")))
    if exists(spark, store):
        found = found.join(spark.read.parquet(store).select("file", "bytes"), ["file", "bytes"], "left_anti")
    new = [(r.file, r.bytes) for r in found.collect()]
    if not new:
        return []
    paths = [p for p, _ in new]
    log = read_step_log(spark, [_plain(p) for p in paths], schema).withColumn("file", F.col("_metadata.file_path"))
    own = partials(log.withColumn("run_id", _run_of(F.col("file"), pattern)), tail, bin_width)
    # a file without a whole line has a row too: it need not be read again
    sizes = spark.createDataFrame(new, "file string, bytes long").withColumn("run_id", _run_of(F.col("file"), pattern))
    sizes.join(own, ["run_id", "file"], "left").write.mode("append").parquet(store)
    return paths


def _plain(path: str) -> str:
    """A file path as the readers take it (metadata paths are URL-encoded)."""
    from urllib.parse import unquote
    return unquote(path)


def read(spark: SparkSession, store: str) -> DataFrame:
    """The partial rows that count: of a file that was read more than once, the largest."""
    w = Window.partitionBy("run_id", "file").orderBy(F.desc("bytes"))
    return spark.read.parquet(store).withColumn("_rf_r", F.row_number().over(w)).where("_rf_r = 1 and n > 0").drop("_rf_r")


def statistics(rows: DataFrame, tail: int = TAIL) -> DataFrame:
    """The columns of ``runlog.log_statistics`` from partial rows with at least ``tail`` last rows each."""
    timings = rows.schema["time_sums"].dataType.names
    known = F.col("n_loss") > 0
    whole = rows.groupBy("run_id").agg(
        F.max("last_step").alias("total_steps"), F.max_by("final_loss", "last_step").alias("final_loss"),
        F.sum("n_loss").alias("_rf_n"), F.try_divide(F.sum(F.when(known, F.col("n_loss") * F.col("mean"))), F.sum("n_loss")).alias("mean_loss"),
        F.min("min_loss").alias("min_loss"), F.max("max_loss").alias("max_loss"),
        *[F.try_divide(F.sum(f"time_sums.{c}"), F.sum(f"time_counts.{c}")).alias(f"mean_{c}") for c in timings],
        (F.sum("tokens") / F.lit(1e9)).alias("total_tokens_b"))
    apart = F.col("mean") - F.col("mean_loss")
    spread = (rows.where(known).join(whole.select("run_id", "mean_loss"), "run_id").groupBy("run_id")
              .agg(F.sum(F.col("m2") + F.col("n_loss") * apart * apart).alias("_rf_m2")))
    ends = rows.select("run_id", F.explode("last").alias("_rf_l")).select("run_id", "_rf_l.*")
    ends = _last_k(ends, ["run_id"], "step", tail).groupBy("run_id").agg(F.avg("loss").alias(f"last_{tail}_loss_mean"))
    std = F.when(F.col("_rf_n") > 1, F.sqrt(F.col("_rf_m2") / (F.col("_rf_n") - 1)))
    return (whole.join(spread, "run_id", "left").join(ends, "run_id", "left")
            .select("run_id", "total_steps", "final_loss", "mean_loss", std.alias("std_loss"), "min_loss", "max_loss",
                    *[f"mean_{c}" for c in timings], "total_tokens_b", f"last_{tail}_loss_mean"))


def loss_bins(rows: DataFrame) -> DataFrame:
    """(run_id, bin, count) of losses in [bin, bin + 1) times the bin width; ``bin`` is null for losses that are not finite."""
    each = rows.select("run_id", F.explode("bins").alias("_rf_b", "_rf_k"))
    return (each.groupBy("run_id", F.when(F.col("_rf_b") != NO_BIN, F.col("_rf_b").cast("long")).alias("bin"))
            .agg(F.sum("_rf_k").alias("count")))
