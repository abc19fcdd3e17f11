"""Describe a run (L1): every statistic and chart-data table of one or many
step/eval logs, written as Parquet/JSON artifacts under one output folder.

The log is read once and stored (reliable checkpoint); each report is an
independent lazy query over it, so Catalyst plans them separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runforge.functions.indexing import sorted_positions
from runforge.operators import runlog as R
from runforge.operators import windows as W
from runforge.session import materialize
from runforge.sources import logs as L


def describe_tables(log: DataFrame, ev: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables of the describe command, keyed by artifact name."""
    out = {
        "task_proportions": R.task_proportions(log, by="run_id"),
        "tokens_by_task": R.tokens_by_task(log, by="run_id"),
        "tokens_per_step": R.tokens_per_step(log),
        "cumulative_tokens": W.cumulative_tokens(log),
        "tokens_per_step_hist": R.histogram(R.tokens_per_step(log), "num_tokens", 50, by="run_id"),
        "loss_hist_by_task": R.loss_hist_by_task(log, 50, by="run_id"),
        "step_time_components": R.step_time_components(log),
        "loss_by_step": W.rolling_mean(log, 1000).join(W.rolling_band(log, 1000, 10), ["run_id", "step"]),
        "loss_annotations": R.loss_annotations(log),
        "log_statistics": R.log_statistics(log),
        "chart_series": R.chart_series(log, ev),
        "loss_diff": W.loss_diff(log),
    }
    if "tokens_by_dataset" in log.columns:
        out["dataset_proportions"] = R.dataset_proportions(log, by="run_id")
    if ev is not None:
        out["eval_statistics"] = R.eval_statistics(ev)
        out["eval_by_step"] = R.eval_by_step(ev)
    return out


def describe_run(spark: SparkSession, log_path: str, eval_path: str | None = None, out_dir: str | None = None) -> list[str]:
    """Read the logs, store them once, write every report table; returns the paths.

    ``log_path`` is one run's ``log.jsonl`` or a folder of ``run_id=<id>`` folders.
    For a single file the run is named by its folder, and ``eval.jsonl`` beside it is
    read when it exists; reports go to ``reports`` beside it unless ``out_dir`` is given.
    """
    parent = log_path.rstrip("/").rpartition("/")[0]
    if eval_path is None and log_path.endswith("log.jsonl") and L.exists(spark, f"{parent}/eval.jsonl"):
        eval_path = f"{parent}/eval.jsonl"
    log = L.read_step_log(spark, log_path)
    if "run_id" not in log.columns:
        log = L.read_run_logs(spark, log_path)
    log = materialize(log, "log")
    ev = None
    if eval_path:
        raw = L.read_eval_log(spark, eval_path)
        if "run_id" not in raw.columns:
            raw = L.read_run_evals(spark, eval_path)
        # parts of a log in order of their paths, whatever their sizes
        ev = sorted_positions(raw, ["run_id"], ["line_key"], out="line_no").drop("line_key")
    written = []
    for name, df in describe_tables(log, ev).items():
        path = f"{out_dir or f'{parent}/reports'}/{name}"
        if name in ("log_statistics", "eval_statistics"):
            L.write_stats(df, path)
        else:
            order = [c for c in ("run_id", "task", "dataset", "step", "bin") if c in df.columns]
            df.orderBy(*order).write.mode("overwrite").parquet(path)
        written.append(path)
    return written
