"""Checked queries for sources and sinks (IO1-IO3, IO6-IO9).

Each query writes data Spark derives from the driver tables into a fresh
folder under the shared checkpoint folder, reads it back through the source
under test and returns what was read.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.functions.indexing import sorted_positions
from runforge.operators import corpus as C
from runforge.operators import runlog as R
from runforge.operators import sampling as S
from runforge.plans.oracle_views import with_views
from runforge.plans.registry import ORACLE, register, rounded
from runforge.plans.suite_corpus import TOK_CTES, tokenized
from runforge.plans.suite_runlog import rsel
from runforge.sources import corpus_io as CIO
from runforge.sources import fixtures as X
from runforge.sources import logs as L


def _step_lines(spark, sf):
    """Step-log JSON lines per run: every 101st step (≡ 7) lacks ``task``; every
    997th (≡ 5) is torn after 20 characters."""
    s = X.steps(spark, sf)
    common = [F.col("step"), F.lit(0).alias("epoch"), F.col("loss"), F.col("num_tokens"),
              F.create_map(F.col("dataset"), F.col("num_tokens")).alias("tokens_by_dataset"),
              F.col("sample_time"), F.col("forward_time"), F.col("backward_time"), F.col("optimizer_time"),
              F.col("time")]
    full = F.to_json(F.struct(*common[:2], F.col("task"), *common[2:]))
    no_task = F.to_json(F.struct(*common))
    line = F.when(F.col("step") % 101 == 7, no_task).otherwise(full)
    line = F.when(F.col("step") % 997 == 5, F.substring(line, 1, 20)).otherwise(line)
    return s.select("run_id", line.alias("value"))


def _write_step_log(spark, sf) -> str:
    path = L.scratch_dir(spark, "steplog")
    _step_lines(spark, sf).write.partitionBy("run_id").text(path)
    return path


@register("IO1_read_step_log", with_views("steps") + rsel("""
SELECT run_id, step, CASE WHEN step % 101 = 7 THEN 'unknown' ELSE task END AS task, loss, num_tokens
FROM steps WHERE step % 997 <> 5""", "loss"))
def io1(spark, sf):
    log = L.read_step_log(spark, _write_step_log(spark, sf))
    return rounded(log.select(F.col("run_id").cast("bigint").alias("run_id"), "step", "task", "loss", "num_tokens"))


@register("IO1b_bad_line_counts", with_views("steps") + rsel("""
SELECT run_id, count(*) AS bad_lines FROM steps WHERE step % 997 = 5 GROUP BY run_id"""))
def io1b(spark, sf):
    bad = L.bad_line_counts(spark, _write_step_log(spark, sf))
    run = F.regexp_extract("file_path", "run_id=([0-9]+)", 1).cast("bigint")
    return bad.groupBy(run.alias("run_id")).agg(F.sum("bad_lines").alias("bad_lines"))


@register("IO2_read_eval_log", with_views("evals") + rsel("""
SELECT run_id, step, mean, median, p5, p95, num_samples FROM evals""", "mean", "median", "p5", "p95"))
def io2(spark, sf):
    ev = X.evals(spark, sf)
    path = L.scratch_dir(spark, "evallog")
    cols = [c.name for c in L.EVAL_SCHEMA.fields]
    ev.select("run_id", F.to_json(F.struct(*cols)).alias("value")).write.partitionBy("run_id").text(path)
    back = L.read_eval_log(spark, path)
    return rounded(back.select(F.col("run_id").cast("bigint").alias("run_id"), "step", "mean", "median", "p5",
                               "p95", "num_samples"))


@register("IO3_objects_sidecar", with_views("batches") + rsel("""
SELECT batch_id AS step, count(DISTINCT identifier[1]) AS n_objects FROM batches GROUP BY batch_id"""))
def io3(spark, sf):
    meta = S.batch_metadata(X.batches(spark, sf)).withColumnRenamed("batch_id", "step")
    _, side = L.split_objects(meta)
    path = L.scratch_dir(spark, "objects")
    L.write_objects(side.where(F.col("step") % 2 == 0), path)      # first session
    L.write_objects(side.where(F.col("step") % 2 == 1), path)      # appended after a restart
    back = L.read_objects(spark, path)
    return back.groupBy("step").agg(F.count(F.lit(1)).alias("n_objects"))


@register("IO6_decode_content", rsel("""
SELECT doc_id, true AS ok, CAST(NULL AS VARCHAR) AS decode_error, CAST(length(text) AS INTEGER) AS n_chars FROM documents"""))
def io6(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", F.col("text").alias("original"))
    enc = CIO.encode_content(docs, "original", "content")
    dec = CIO.decode_content(enc, "content", "text")
    return dec.select("doc_id", (F.col("text") == F.col("original")).alias("ok"), "decode_error",
                      F.length("text").alias("n_chars"))


RESULT_SCHEMA = T.StructType([T.StructField("model_name", T.StringType()), T.StructField("task_name", T.StringType()),
                              T.StructField("score", T.DoubleType())])


@register("IO7_write_results", with_views("results") + rsel("""
SELECT model_name, task_name, score, row_number() OVER (ORDER BY task_name, score, model_name) - 1 AS pos
FROM results""", "score"))
def io7(spark, sf):
    """The exported lines with their place in the files, which shows the order they were written in."""
    path = L.scratch_dir(spark, "results")
    CIO.write_results(X.results(spark, sf), path)
    lines = spark.read.schema(RESULT_SCHEMA).option("header", True).csv(path).withColumns(
        {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()})
    return rounded(sorted_positions(lines, [], ["file", "block", "line"], out="pos").drop("file", "block", "line"))


@register("IO8_write_stats", ORACLE.get("A3_log_statistics"))
def io8(spark, sf):
    stats = R.log_statistics(X.steps(spark, sf))
    path = L.scratch_dir(spark, "stats")
    L.write_stats(stats, path)
    return rounded(spark.read.schema(stats.schema).json(path))


@register("IO9_write_eval_samples", with_views("corpus") + TOK_CTES + """, ch AS (
SELECT doc_id, CAST(s // 126 AS INTEGER) AS chunk_idx, tokens[s + 1: s + 126] AS chunk
FROM (SELECT doc_id, tokens, unnest(range(0, len(tokens), 126)) AS s FROM tok))
""" + rsel("""
SELECT doc_id, chunk_idx, 128 AS n_ids, CAST(len(chunk) + 2 AS INTEGER) AS mask_sum,
       CAST(len(list_filter(chunk, lambda x: x > 5)) AS INTEGER) AS n_labels FROM ch"""))
def io9(spark, sf):
    ch = C.pad_chunks(C.chunk_tokens(tokenized(spark, sf), 126), 128)
    samples = ch.select(
        "doc_id", "chunk_idx", F.array("input_ids").alias("input_ids"), F.array("attention_mask").alias("attention_mask"),
        F.array(F.transform("input_ids", lambda x: F.when(x > 5, x).otherwise(F.lit(-100)))).alias("labels"))
    path = L.scratch_dir(spark, "eval_samples")
    L.write_eval_samples(samples, path)
    back = L.read_eval_samples(spark, path)
    return back.select("doc_id", "chunk_idx", F.size(F.col("input_ids")[0]).alias("n_ids"),
                       F.aggregate(F.col("attention_mask")[0], F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                       F.size(F.filter(F.col("labels")[0], lambda x: x != -100)).alias("n_labels"))
