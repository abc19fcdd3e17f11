"""Aggregations over training step logs and eval logs.

A step log is one row per logged step: ``run_id``, ``step``, ``task``,
``loss``, ``num_tokens``, timing columns, optionally ``tokens_by_dataset``.
All operators group by ``run_id`` (many runs in one job, A13) and return lazy
DataFrames. Min/max skip NaN (``nanvl(x, null)``); mean and std propagate it,
as the reference's frame library does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.functions.indexing import exclusive_cut, exclusive_cut_ranks, pick_order_stats

TIMING_COLS = ("sample_time", "forward_time", "backward_time", "optimizer_time", "step_time")


def _cols(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def _nan_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def _with_total(grouped: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Divide ``value`` by its total (per ``by``) taken from a small aggregate.

    The totals side has one row per ``by`` group (one row overall when ``by``
    is empty), so the join is a broadcast of a bounded table, not an
    unpartitioned window.
    """
    totals = grouped.groupBy(*by).agg(F.sum(value).alias("_rf_total"))
    joined = grouped.join(totals, by, "inner") if by else \
        grouped.crossJoin(totals)
    return joined.withColumn("proportion", F.col(value) / F.col("_rf_total")).drop("_rf_total")


# ---------------------------------------------------------------- A1, A2, A6, A7
def task_proportions(log: DataFrame, by=None) -> DataFrame:
    """A1: rows per task and their share, ascending by share."""
    by = _cols(by)
    counts = log.groupBy(*by, "task").agg(F.count(F.lit(1)).alias("count"))
    return _with_total(counts, "count", by).orderBy(*by, "proportion", "task")


def dataset_proportions(log: DataFrame, map_col: str = "tokens_by_dataset", by=None) -> DataFrame:
    """A2: token count per dataset from the per-step map column, and its share."""
    by = _cols(by)
    exploded = log.select(*by, F.explode(map_col).alias("dataset", "_rf_n"))
    counts = exploded.groupBy(*by, "dataset").agg(F.sum("_rf_n").cast("bigint").alias("count"))
    return _with_total(counts, "count", by).orderBy(*by, "proportion", "dataset")


def tokens_by_task(log: DataFrame, by=None) -> DataFrame:
    """Total tokens per task, sorted ascending."""
    by = _cols(by)
    return (log.groupBy(*by, "task").agg(F.sum("num_tokens").cast("bigint").alias("total_tokens"))
            .orderBy(*by, "total_tokens", "task"))


def tokens_per_step(log: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Tokens per (run, step)."""
    return log.groupBy(run_id, "step").agg(F.sum("num_tokens").cast("bigint").alias("num_tokens"))


# ---------------------------------------------------------------- A3, A13
LAST_K_SLICE = 1 << 16


def _last_k(df: DataFrame, group: list[str], order_col: str, k: int, width: int = LAST_K_SLICE) -> DataFrame:
    """The last ``k`` rows by ``order_col`` (integer-valued) within ``group``.

    Rows are counted per fixed-width slice of the order key; slices lying
    wholly within the last k are kept as they are, and only the one boundary
    slice per group is ordered (a window over at most ``width`` key values).
    Everything else is an aggregation over the small slice table, so no full
    sort of the log and no per-group task.
    """
    sl = F.floor(F.col(order_col) / F.lit(float(width))).cast("bigint")
    d = df.withColumn("_rf_sl", sl)
    cnt = d.groupBy(*group, "_rf_sl").agg(F.count(F.lit(1)).alias("_rf_n"))
    above = (Window.partitionBy(*group) if group else Window).orderBy(F.desc("_rf_sl")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    need = (cnt.withColumn("_rf_above", F.coalesce(F.sum("_rf_n").over(above), F.lit(0)))
            .where(F.col("_rf_above") < k)
            .select(*group, "_rf_sl", (F.lit(k) - F.col("_rf_above")).alias("_rf_need"), "_rf_n"))
    rows = d.join(need, [*group, "_rf_sl"], "inner")
    whole = rows.where(F.col("_rf_n") <= F.col("_rf_need"))
    edge = rows.where(F.col("_rf_n") > F.col("_rf_need"))
    ew = Window.partitionBy(*group, "_rf_sl").orderBy(F.desc(order_col))
    edge = edge.withColumn("_rf_rn", F.row_number().over(ew)).where(F.col("_rf_rn") <= F.col("_rf_need")) \
        .drop("_rf_rn")
    return whole.unionByName(edge).drop("_rf_sl", "_rf_need", "_rf_n")


def _maybe_exclude(log: DataFrame, steps_per_eval: int | None) -> DataFrame:
    return exclude_eval_steps(log, steps_per_eval) if steps_per_eval else log


def log_statistics(log: DataFrame, run_id: str = "run_id", tail: int = 100,
                   exclude_eval_steps: int | None = None) -> DataFrame:
    """One row of run statistics per run.

    ``total_steps`` is the last step value (not a count); ``final_loss`` the
    loss on the last line; ``last_100_loss_mean`` the mean of the last 100
    losses (NaN propagates); mean/std (ddof 1) of loss propagate NaN, min/max
    skip it; ``total_tokens_b`` = Σ num_tokens / 1e9.
    """
    log = _maybe_exclude(log, exclude_eval_steps)
    timings = [c for c in TIMING_COLS if c in log.columns]
    main = log.groupBy(run_id).agg(
        F.max("step").alias("total_steps"),
        F.max_by("loss", "step").alias("final_loss"),
        F.avg("loss").alias("mean_loss"),
        F.stddev_samp("loss").alias("std_loss"),
        F.min(_nan_null("loss")).alias("min_loss"),
        F.max(_nan_null("loss")).alias("max_loss"),
        *[F.avg(c).alias(f"mean_{c}") for c in timings],
        (F.sum("num_tokens") / F.lit(1e9)).alias("total_tokens_b"),
    )
    tail_df = (_last_k(log.select(run_id, "step", "loss"), [run_id], "step", tail)
               .groupBy(run_id).agg(F.avg("loss").alias(f"last_{tail}_loss_mean")))
    return main.join(tail_df, run_id, "left")


def compare_runs(log: DataFrame, run_id: str = "run_id") -> DataFrame:
    """:func:`log_statistics` for every run of one table, in one job."""
    return log_statistics(log, run_id)


# ---------------------------------------------------------------- A4, A5
def eval_statistics(ev: DataFrame, run_id: str = "run_id", order_col: str = "line_no",
                    tail: int = 10) -> DataFrame:
    """A4: eval-log statistics per run, "last" following line order.

    ``last_10_median_diff_mean`` is the mean first difference of the last 10
    medians, i.e. (last - first) / (n - 1); null when only one eval exists.
    """
    stats = []
    for c in ("mean", "median", "p5", "p95"):
        name = "loss" if c == "mean" else c
        stats += [F.avg(c).alias(f"mean_{name}"), F.stddev_samp(c).alias(f"std_{name}"),
                  F.min(_nan_null(c)).alias(f"min_{name}"), F.max(_nan_null(c)).alias(f"max_{name}")]
    main = ev.groupBy(run_id).agg(
        F.max_by("step", order_col).alias("total_steps"),
        F.max_by("svd_mean_ratio_1", order_col).alias("last_svd_mean_ratio_1"),
        *stats)
    last = _last_k(ev.select(run_id, order_col, "mean", "median"), [run_id], order_col, tail)
    tail_df = last.groupBy(run_id).agg(
        F.avg("mean").alias(f"last_{tail}_mean"),
        F.avg("median").alias(f"last_{tail}_median"),
        F.try_divide(F.max_by("median", order_col) - F.min_by("median", order_col),
                     (F.count(F.lit(1)) - 1).cast("double")).alias(f"last_{tail}_median_diff_mean"))
    return main.join(tail_df, run_id, "left")


def eval_by_step(ev: DataFrame, run_id: str = "run_id") -> DataFrame:
    """A5: mean of p5, mean and p95 per eval step (several evals per step allowed)."""
    return ev.groupBy(run_id, "step").agg(F.avg("p5").alias("p5"), F.avg("mean").alias("mean"),
                                          F.avg("p95").alias("p95"))


# ---------------------------------------------------------------- A8, A9
def histogram(df: DataFrame, col: str, bins: int = 50, by=None) -> DataFrame:
    """Equal-width histogram with ``bins`` bins over each group's own range of finite values.

    bin = least(floor((x - lo) / w), bins - 1); lo = hi puts every value in
    bin 0. Only non-empty bins are returned, with their edges. Null/NaN skipped. Infinite
    values have bins of their own, -1 below the range and ``bins`` above it.
    """
    by = _cols(by)
    vals = df.select(*by, _nan_null(col).alias("_rf_x")).where(F.col("_rf_x").isNotNull())
    finite = _finite("_rf_x")
    rng = vals.groupBy(*by).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    joined = vals.join(rng, by, "inner") if by else vals.crossJoin(rng)
    w = (F.col("hi") - F.col("lo")) / F.lit(bins)
    inf = F.lit(float("inf"))
    b = (F.when(F.col("_rf_x") == inf, F.lit(bins)).when(F.col("_rf_x") == -inf, F.lit(-1)).when(F.col("hi") == F.col("lo"), F.lit(0))
         .otherwise(F.least(F.floor((F.col("_rf_x") - F.col("lo")) / w), F.lit(bins - 1)))).cast("int")
    counted = joined.withColumn("bin", b).groupBy(*by, "bin", "lo", "hi").agg(
        F.count(F.lit(1)).alias("count"))
    return counted.select(
        *by, "bin",
        F.when(F.col("bin") < 0, -inf).when(F.col("bin") == bins, F.col("hi")).otherwise(F.col("lo") + F.col("bin") * w).alias("bin_lo"),
        F.when(F.col("bin") < 0, F.col("lo")).when(F.col("bin") == bins, inf).otherwise(F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        "count")


def _finite(col: str) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(F.abs(_nan_null(col)) < float("inf"), F.col(col))


def loss_hist_by_task(log: DataFrame, bins: int = 50, by=None,
                      exclude_eval_steps: int | None = None) -> DataFrame:
    """Per-task loss histogram on the task's own range, with the shared axis
    (global min and max finite loss over all tasks) on every row."""
    by = _cols(by)
    log = _maybe_exclude(log, exclude_eval_steps)
    h = histogram(log, "loss", bins, by=by + ["task"])
    axis = log.groupBy(*by).agg(F.min(_finite("loss")).alias("axis_min"), F.max(_finite("loss")).alias("axis_max"))
    return h.join(axis, by, "inner") if by else h.crossJoin(axis)


# ---------------------------------------------------------------- A10, A11
def linear_percentile(df: DataFrame, group_cols, value_col: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles (numpy/pandas default) by rank-and-pick."""
    def ranks(n):
        out = []
        for q in qs.values():
            pos = (n - 1) * F.lit(q)
            out += [F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint")]
        return out

    def finish(n, at):
        cols = []
        for name, q in qs.items():
            pos = (n - 1) * F.lit(q)
            lo = F.floor(pos).cast("bigint")
            hi = F.ceil(pos).cast("bigint")
            xlo, xhi = at(lo + 1), at(hi + 1)
            cols.append((xlo + (pos - lo) * (xhi - xlo)).alias(name))
        return cols

    return pick_order_stats(df, group_cols, value_col, ranks, finish)


def step_time_components(log: DataFrame, run_id: str = "run_id", q: float = 0.99,
                         headroom: float = 1.25) -> DataFrame:
    """A10: per-step sum of the four timing components (null counts as 0), its
    ``q`` quantile (linear) per run and the chart limit ``headroom * q``."""
    parts = [c for c in ("sample_time", "forward_time", "backward_time", "optimizer_time")
             if c in log.columns]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0))
    per_step = log.select(run_id, "step", total.alias("total_time_parts"))
    qv = linear_percentile(per_step, [run_id], "total_time_parts", {"q99": q})
    return qv.select(run_id, "q99", (F.col("q99") * F.lit(headroom)).alias("y_max"))


def eval_summary(samples: DataFrame, by, value: str = "sample_loss") -> DataFrame:
    """Eval summary of per-sample losses per group.

    mean, median, std (sample; 0.0 with one value), min, max, num_samples, and
    "p5"/"p95" = cut points 5 and 95 of the 99 exclusive cut points, i.e. the
    6th and 96th percentiles (Python ``statistics.quantiles(n=100)``).
    """
    by = _cols(by)
    plain = samples.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("num_samples"))

    def ranks(n):
        med = (n - 1) / 2
        return [F.floor(med).cast("bigint"), F.ceil(med).cast("bigint"),
                *exclusive_cut_ranks(5, n), *exclusive_cut_ranks(95, n)]

    def finish(n, at):
        med = (n - 1) / 2
        median = (at(F.floor(med).cast("bigint") + 1) + at(F.ceil(med).cast("bigint") + 1)) / 2
        return [median.alias("median"), exclusive_cut(5, n, at).alias("p5"),
                exclusive_cut(95, n, at).alias("p95")]

    picked = pick_order_stats(samples, by, value, ranks, finish)
    return plain.join(picked, by, "inner").select(
        *by, "mean", "median", "std", "min", "p5", "p95", "max", "num_samples")


# ---------------------------------------------------------------- A12, A14-A17
def loss_annotations(log: DataFrame, run_id: str = "run_id", x_min: int = 1000,
                     window: int = 1000, exclude_eval_steps: int | None = None) -> DataFrame:
    """Chart annotations per run: min loss, max loss after ``x_min`` (the
    overall max when the run does not pass ``x_min``), y limit 1.1 × that, and
    the last value of the ``window``-row moving average (null when shorter)."""
    log = _maybe_exclude(log, exclude_eval_steps)
    agg = log.groupBy(run_id).agg(
        F.min(_nan_null("loss")).alias("min_loss"),
        F.max("step").alias("last_step"),
        F.max(F.when(F.col("step") > x_min, _nan_null("loss"))).alias("_rf_max_after"),
        F.max(_nan_null("loss")).alias("_rf_max_all"))
    tail = (_last_k(log.select(run_id, "step", "loss"), [run_id], "step", window)
            .groupBy(run_id).agg(F.count(F.lit(1)).alias("_rf_n"), F.avg("loss").alias("_rf_avg")))
    out = agg.join(tail, run_id, "left")
    max_loss = F.when(F.col("last_step") > x_min, F.col("_rf_max_after")).otherwise(F.col("_rf_max_all"))
    return out.select(
        run_id, "min_loss", max_loss.alias("max_loss"), (max_loss * 1.1).alias("y_limit"),
        F.when(F.col("_rf_n") == window, F.col("_rf_avg")).alias("final_moving_avg"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Benchmark scores sorted by (task_name, score)."""
    return results.select("model_name", "task_name", "score").orderBy("task_name", "score", "model_name")


def chart_series(log: DataFrame, ev: DataFrame | None = None, run_id: str = "run_id",
                 bucket: int | None = None) -> DataFrame:
    """(run, step, lr, loss) points and, when an eval log is given, its svd
    ratios at the same step. ``bucket`` downsamples long runs to one averaged
    point per ``bucket`` steps."""
    pts = log.select(run_id, "step", *[c for c in ("lr", "loss") if c in log.columns])
    if ev is not None:
        svd = ev.groupBy(run_id, "step").agg(F.avg("svd_mean_ratio_1").alias("svd_mean_ratio_1"),
                                             F.avg("svd_median_ratio_1").alias("svd_median_ratio_1"))
        pts = pts.join(svd, [run_id, "step"], "full")
    if bucket:
        val_cols = [c for c in pts.columns if c not in (run_id, "step")]
        pts = pts.groupBy(run_id, (F.floor(F.col("step") / bucket) * bucket).cast("bigint").alias("step")).agg(
            *[F.avg(c).alias(c) for c in val_cols])
    return pts


def nan_steps(log: DataFrame, run_id: str = "run_id", after: int = 100) -> DataFrame:
    """Steps skipped for a NaN loss (only after step ``after``), counted per run."""
    bad = log.where(F.isnan("loss") & (F.col("step") > after))
    return bad.groupBy(run_id).agg(F.count(F.lit(1)).alias("skipped_steps"),
                                   F.min("step").alias("first_skipped"))


def flag_eval_steps(log: DataFrame, steps_per_eval: int) -> DataFrame:
    """``is_eval_step`` = step > 0 and step % steps_per_eval = 0 (those rows
    carry an eval sample's loss and forward time)."""
    return log.withColumn("is_eval_step",
                          (F.col("step") > 0) & (F.pmod(F.col("step"), F.lit(steps_per_eval)) == 0))


def exclude_eval_steps(log: DataFrame, steps_per_eval: int) -> DataFrame:
    """Drop the rows that carry an eval sample's loss (see :func:`flag_eval_steps`).
    Window operators rank the rows that are left themselves."""
    return flag_eval_steps(log, steps_per_eval).where(~F.col("is_eval_step")).drop("is_eval_step")
