"""Live monitoring of training logs with Structured Streaming.

Contract (T1): a run writes its log as rotated, immutable part files under
``<root>/run_id=<id>/``. The file source lists new files per micro-batch; a
file appended to after it was ingested is not read again. For one file a run that
grows, take ``sources.growing.stream_growing_log``; all operators here work on either.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from runforge.sources.logs import CORRUPT, EVAL_SCHEMA, STEP_SCHEMA


def stream_step_log(spark: SparkSession, root: str, schema: T.StructType = STEP_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming step log from a folder of rotated part files.

    Torn lines are dropped, a missing task becomes 'unknown', ``run_id`` comes
    from the ``run_id=<id>`` folder of each file.
    """
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.readStream.schema(with_corrupt).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("allowNonNumericNumbers", True))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(root + "/*")
    task = F.coalesce(F.col("task"), F.lit("unknown")) if "task" in schema.names else F.lit("eval")
    return (raw.where(F.col(CORRUPT).isNull() & F.col(schema.fields[0].name).isNotNull()).drop(CORRUPT)
            .withColumn("task", task)
            .withColumn("run_id", F.regexp_extract(F.input_file_name(), "run_id=([^/]+)", 1)))


def stream_totals(sdf: DataFrame) -> DataFrame:
    """Running totals per (run, task): steps and tokens (complete/update mode)."""
    return sdf.groupBy("run_id", "task").agg(F.count(F.lit(1)).alias("steps"),
                                             F.sum("num_tokens").cast("bigint").alias("total_tokens"))


def stream_dataset_totals(sdf: DataFrame) -> DataFrame:
    """Running token totals per (run, dataset) from the per-step map."""
    ex = sdf.select("run_id", F.explode("tokens_by_dataset").alias("dataset", "n"))
    return ex.groupBy("run_id", "dataset").agg(F.sum("n").cast("bigint").alias("total_tokens"))


def stream_dedup(sdf: DataFrame, watermark: str | None = None) -> DataFrame:
    """T4: one row per (run, step) across a resume that rewrites steps.

    Unbounded key state by default; with ``watermark`` (e.g. '1 hour' on
    ``time``) the state is bounded by ``dropDuplicatesWithinWatermark``.
    """
    if watermark:
        return sdf.withWatermark("time", watermark).dropDuplicatesWithinWatermark(["run_id", "step"])
    return sdf.dropDuplicates(["run_id", "step"])


TRAILING_OUT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("step", T.LongType()),
    T.StructField("loss_100", T.DoubleType()), T.StructField("loss_1000", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()), T.StructField("steps_seen", T.LongType()),
    T.StructField("token_rate", T.DoubleType()), T.StructField("last_eval", T.DoubleType())])
TRAILING_STATE = T.StructType([
    T.StructField("steps", T.ArrayType(T.LongType())), T.StructField("losses", T.ArrayType(T.DoubleType())),
    T.StructField("tokens", T.LongType()), T.StructField("seen", T.LongType()),
    T.StructField("session_step", T.LongType()), T.StructField("session_tokens", T.LongType()),
    T.StructField("last_step", T.LongType()), T.StructField("last_time", T.DoubleType()),
    T.StructField("eval_step", T.LongType()), T.StructField("eval_mean", T.DoubleType())])


def _trailing(ks):
    window = max(ks)

    def fn(key, pdfs, state):
        if state.exists:
            steps, losses, tokens, seen, s_step, s_tokens, last, clock, e_step, e_mean = state.get
            held = list(zip(steps, losses))
        else:
            held, tokens, seen, s_step, s_tokens, last, clock, e_step, e_mean = [], 0, 0, 0, 0, -1, None, None, None
        # of a micro-batch four numbers a line are kept, and of its losses the newest ``window``
        lines = []
        for p in pdfs:
            evals = p[p["is_eval"]].sort_values("step")
            if len(evals) and (e_step is None or evals["step"].iloc[-1] >= e_step):
                e_step, e_mean = int(evals["step"].iloc[-1]), float(evals["loss"].iloc[-1])
            own = p[~p["is_eval"]]
            held += [(int(s), None if pd.isna(x) else float(x)) for s, x in zip(own["step"], own["loss"])]
            held = sorted(held, key=lambda x: x[0])[-window:]
            lines.append(own[["step", "num_tokens", "total_time"]])
        batch = pd.concat(lines).sort_values("step", kind="stable") if lines else pd.DataFrame()
        for step, n, t in batch.itertuples(index=False):
            n = 0 if pd.isna(n) else int(n)
            tokens, seen = tokens + n, seen + 1
            if step < last:  # a late line: it counts, but is not the newest
                s_tokens += n if step >= s_step else 0
                continue
            t = None if pd.isna(t) else float(t)
            if t is not None and clock is not None and t < clock:  # the clock starts anew with a session
                s_step, s_tokens = int(step), 0
            last, clock, s_tokens = int(step), clock if t is None else t, s_tokens + n
        state.update(([s for s, _ in held], [x for _, x in held], tokens, seen, s_step, s_tokens, last, clock, e_step, e_mean))
        row = {"run_id": key[0], "step": last, "total_tokens": tokens, "steps_seen": seen,
               "token_rate": None if clock is None else s_tokens / max(clock, 1.0), "last_eval": 0.0 if e_mean is None else e_mean}
        for k in ks:
            vals = [x for _, x in held[-k:] if x is not None]
            row[f"loss_{k}"] = sum(vals) / len(vals) if vals else None
        yield pd.DataFrame([row])[[f.name for f in TRAILING_OUT.fields]]

    return fn


def stream_trailing(sdf: DataFrame, evals: DataFrame | None = None, ks=(100, 1000)) -> DataFrame:
    """Live trailing loss means, token total and rate, and last eval mean per run.

    Keyed state per run holds the last max(ks) losses with their steps and a few
    numbers, so state size is bounded whatever the run length, and late part files
    fall into place (a late line counts in the totals, and in the losses if it is among
    the newest). ``token_rate`` is the tokens since the session started over its clock
    (null without ``total_time``). ``evals`` is a stream of (run_id, step, mean); the
    eval of the highest step counts, start-up evals at step 0 do not. A micro-batch's
    lines of one run meet in one group: bound them with ``max_files_per_trigger``.
    """
    if tuple(ks) != (100, 1000):
        raise ValueError("output schema is fixed to loss_100 and loss_1000")
    clock = F.col("total_time") if "total_time" in sdf.columns else F.lit(None)
    rows = sdf.select("run_id", "step", F.col("loss").cast("double").alias("loss"), F.col("num_tokens").cast("double").alias("num_tokens"),
                      clock.cast("double").alias("total_time"), F.lit(False).alias("is_eval"))
    if evals is not None:
        none = F.lit(None).cast("double")
        rows = rows.unionByName(evals.where("step > 0").select(
            "run_id", "step", F.col("mean").cast("double").alias("loss"), none.alias("num_tokens"), none.alias("total_time"),
            F.lit(True).alias("is_eval")))
    return (rows.groupBy("run_id")
            .applyInPandasWithState(_trailing(ks), TRAILING_OUT, TRAILING_STATE, "update",
                                    GroupStateTimeout.NoTimeout))


def stream_eval_log(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming eval log (run_id, step, mean, ...) from a folder of rotated part files."""
    return stream_step_log(spark, root, EVAL_SCHEMA, max_files_per_trigger).drop("task")


def run_available(sdf: DataFrame, sink: str, checkpoint: str, mode: str = "append", one_batch: bool = False) -> None:
    """Process everything available now, then stop (restartable from ``checkpoint``); ``one_batch``: in a single batch.

    Each micro-batch is written to its own ``batch_id=<id>`` folder of ``sink``
    with overwrite, so a retried batch replaces its own output instead of
    adding a second copy (foreachBatch is at-least-once); complete/update
    outputs are resolved by :func:`latest`.
    """
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(**({"once": True} if one_batch else {"availableNow": True})).start())
    q.awaitTermination()


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Latest row per key across the appended micro-batch outputs."""
    out = spark.read.parquet(sink)
    cols = [c for c in out.columns if c not in keys and c != "batch_id"]
    return out.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in cols])
