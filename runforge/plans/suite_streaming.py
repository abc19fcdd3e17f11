"""Checked queries for the streaming operators.

Each query writes the stand-in step log as rotated part files (two rotations,
steps < 1200 first), drives the stream with ``availableNow`` after each
rotation from the same checkpoint (a restart), and returns the sink contents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runforge.plans.oracle_views import with_views
from runforge.plans.registry import register, rounded
from runforge.plans.suite_runlog import rsel
from runforge.sources import fixtures as X
from runforge.sources import growing as G
from runforge.sources.logs import scratch_dir
from runforge.streaming import steplog as T
from runforge.streaming import timed as TS

ROTATE_AT = 1200


def _lines(spark, sf):
    s = X.steps(spark, sf).withColumn("total_time", (F.pmod(F.col("step"), F.lit(700)) + 1) * F.lit(0.25))
    line = F.to_json(F.struct("step", "task", "loss", "num_tokens", "total_time",
                              F.create_map("dataset", "num_tokens").alias("tokens_by_dataset"), "time"))
    return s.select("run_id", "step", line.alias("value"))


def _rotation(lines, root, first: bool):
    part = lines.where(F.col("step") < ROTATE_AT) if first else lines.where(F.col("step") >= ROTATE_AT)
    part.select("run_id", "value").write.mode("append").partitionBy("run_id").text(root)


def _drive(spark, sf, name, build, mode, duplicate_first=False, between=None, run=T.run_available):
    root, sink, ckpt = (scratch_dir(spark, f"{name}-in"), scratch_dir(spark, f"{name}-out"),
                        scratch_dir(spark, f"{name}-ckpt"))
    lines = _lines(spark, sf)
    _rotation(lines, root, True)
    run(build(T.stream_step_log(spark, root)), sink, ckpt, mode)
    if duplicate_first:       # a resumed run rewrites steps it had already logged
        _rotation(lines, root, True)
    _rotation(lines, root, False)
    if between:
        between()
    run(build(T.stream_step_log(spark, root)), sink, ckpt, mode)
    return sink


@register("T1_stream_step_log", with_views("steps") + rsel("""
SELECT run_id, step, task, loss, num_tokens FROM steps""", "loss"))
def t1(spark, sf):
    sink = _drive(spark, sf, "t1", lambda s: s, "append")
    out = spark.read.parquet(sink)
    return rounded(out.select(F.col("run_id").cast("bigint").alias("run_id"), "step", "task", "loss", "num_tokens"))


def _append(lines, root, until=None):
    """One ``log.jsonl`` a run, up to the middle of the line of step ``until``; what is there stays and grows."""
    whole = F.concat("value", F.lit("\n"))
    if until is None:
        pieces = lines.withColumn("piece", whole)
    else:
        half = F.expr("substring(value, 1, length(value) div 2)")
        pieces = lines.where(F.col("step") <= until).withColumn("piece", F.when(F.col("step") == until, half).otherwise(whole))

    def write(batches):
        run = file = None
        for rows in batches:
            for own, piece in zip(rows["run_id"], rows["piece"]):
                if own != run:
                    if file:
                        file.close()
                    store, folder = G.open_store(f"{root}/{own}")
                    store.create_dir(folder)
                    run, file = own, store.open_output_stream(f"{folder}/log.jsonl")
                file.write(piece.encode())
        if file:
            file.close()
        yield from ()

    ordered = pieces.select("run_id", "step", "piece").repartition("run_id").sortWithinPartitions("run_id", "step")
    ordered.mapInPandas(write, "run_id long").write.format("noop").mode("overwrite").save()


@register("T1b_stream_growing_log", with_views("steps") + rsel("""
SELECT run_id, step, task, loss, num_tokens FROM steps""", "loss"))
def t1b(spark, sf):
    """One log a run, read while it ends in mid-line, and from the same checkpoint once it has grown."""
    root, sink, ckpt = (scratch_dir(spark, f"t1b-{x}") for x in ("in", "out", "ckpt"))
    lines = _lines(spark, sf)
    for until in (ROTATE_AT, None):
        _append(lines, root, until)
        T.run_available(G.stream_growing_log(spark, root, partition_bytes=1 << 17), sink, ckpt)
    out = spark.read.parquet(sink)
    return rounded(out.select(F.col("run_id").cast("bigint").alias("run_id"), "step", "task", "loss", "num_tokens"))


@register("T2_stream_totals", with_views("steps") + rsel("""
SELECT run_id, task, count(*) AS steps, CAST(sum(num_tokens) AS BIGINT) AS total_tokens
FROM steps GROUP BY run_id, task"""))
def t2(spark, sf):
    sink = _drive(spark, sf, "t2", T.stream_totals, "update")
    out = T.latest(spark, sink, ["run_id", "task"])
    return out.select(F.col("run_id").cast("bigint").alias("run_id"), "task", "steps", "total_tokens")


@register("T2b_stream_dataset_totals", with_views("steps") + rsel("""
SELECT run_id, dataset, CAST(sum(num_tokens) AS BIGINT) AS total_tokens FROM steps GROUP BY run_id, dataset"""))
def t2b(spark, sf):
    sink = _drive(spark, sf, "t2b", T.stream_dataset_totals, "update")
    out = T.latest(spark, sink, ["run_id", "dataset"])
    return out.select(F.col("run_id").cast("bigint").alias("run_id"), "dataset", "total_tokens")


_T3 = with_views("steps", "evals") + """, w AS (
SELECT run_id, step, step // 700 AS session,
       avg(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS loss_100,
       avg(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS loss_1000,
       CAST(sum(num_tokens) OVER (PARTITION BY run_id) AS BIGINT) AS total_tokens,
       sum(num_tokens) OVER (PARTITION BY run_id, step // 700 ORDER BY step) / greatest((step % 700 + 1) * 0.25, 1.0) AS token_rate,
       count(*) OVER (PARTITION BY run_id) AS steps_seen, max(step) OVER (PARTITION BY run_id) AS last_step FROM steps)
""" + rsel("""
SELECT run_id, step, loss_100, loss_1000, total_tokens, steps_seen, token_rate, e.last_eval
FROM w JOIN (SELECT run_id, arg_max(mean, step) AS last_eval FROM evals WHERE step > 0 GROUP BY run_id) AS e USING (run_id)
WHERE step = last_step""", "loss_100", "loss_1000", "token_rate", "last_eval")


def _trailing(spark, sf, name, live, run):
    """Losses, tokens and evals of each run after two rotations of both logs."""
    evals, root = X.evals(spark, sf), scratch_dir(spark, f"{name}-evals")
    lines = evals.select("run_id", "step", F.to_json(F.struct("step", "mean")).alias("value"))

    def build(steps):
        return live(steps, T.stream_eval_log(spark, root))

    _rotation(lines, root, True)
    sink = _drive(spark, sf, name, build, "update", between=lambda: _rotation(lines, root, False), run=run)
    out = T.latest(spark, sink, ["run_id"])
    return rounded(out.select(F.col("run_id").cast("bigint").alias("run_id"), "step", "loss_100", "loss_1000",
                              "total_tokens", "steps_seen", "token_rate", "last_eval"))


@register("T3_stream_trailing", _T3)
def t3(spark, sf):
    return _trailing(spark, sf, "t3", T.stream_trailing, T.run_available)


@register("T3b_stream_trailing_timed", _T3)
def t3b(spark, sf):
    """The same from blocks in map state, which a timer would end after a day without lines."""
    return _trailing(spark, sf, "t3b", TS.stream_trailing_timed, TS.run_timed)


@register("T4_stream_dedup", with_views("steps") + rsel("""
SELECT run_id, count(*) AS steps, CAST(sum(num_tokens) AS BIGINT) AS total_tokens FROM steps GROUP BY run_id"""))
def t4(spark, sf):
    sink = _drive(spark, sf, "t4", T.stream_dedup, "append", duplicate_first=True)
    out = spark.read.parquet(sink)
    return out.groupBy(F.col("run_id").cast("bigint").alias("run_id")).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("num_tokens").cast("bigint").alias("total_tokens"))
