"""Checked queries for the run-log aggregations (A1-A17) on the ``steps``/``evals`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from runforge.functions.indexing import sorted_positions
from runforge.operators import partials as P
from runforge.operators import runlog as R
from runforge.plans.oracle_views import with_views
from runforge.plans.registry import register, rounded
from runforge.sources import fixtures as X
from runforge.sources.logs import scratch_dir


def rsel(body: str, *cols: str) -> str:
    """``SELECT *`` over ``body`` with the named double columns rounded to 6 places."""
    if not cols:
        return f"SELECT * FROM ({body}) AS q"
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) AS q"


@register("A1_task_proportions", with_views("steps") + rsel("""
SELECT run_id, task, count, count / sum(count) OVER (PARTITION BY run_id) AS proportion
FROM (SELECT run_id, task, count(*) AS count FROM steps GROUP BY run_id, task)""", "proportion"))
def a1(spark, sf):
    return rounded(R.task_proportions(X.steps(spark, sf), by="run_id"))


@register("A2_dataset_proportions", with_views("steps") + rsel("""
SELECT run_id, dataset, count, count / sum(count) OVER (PARTITION BY run_id) AS proportion
FROM (SELECT run_id, dataset, CAST(sum(num_tokens) AS BIGINT) AS count FROM steps GROUP BY run_id, dataset)""",
                                                              "proportion"))
def a2(spark, sf):
    log = X.steps(spark, sf).withColumn("tokens_by_dataset", F.create_map("dataset", "num_tokens"))
    return rounded(R.dataset_proportions(log, by="run_id"))


_A3_COLS = ("final_loss mean_loss std_loss min_loss max_loss mean_sample_time mean_forward_time "
            "mean_backward_time mean_optimizer_time mean_step_time total_tokens_b last_100_loss_mean").split()


@register("A3_log_statistics", with_views("steps") + rsel("""
SELECT run_id, max(step) AS total_steps, arg_max(loss, step) AS final_loss, avg(loss) AS mean_loss,
       stddev_samp(loss) AS std_loss, min(loss) AS min_loss, max(loss) AS max_loss,
       avg(sample_time) AS mean_sample_time, avg(forward_time) AS mean_forward_time,
       avg(backward_time) AS mean_backward_time, avg(optimizer_time) AS mean_optimizer_time, avg(step_time) AS mean_step_time,
       sum(num_tokens) / 1e9 AS total_tokens_b,
       avg(loss) FILTER (WHERE rn <= 100) AS last_100_loss_mean
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn FROM steps)
GROUP BY run_id""", *_A3_COLS))
def a3(spark, sf):
    return rounded(R.log_statistics(X.steps(spark, sf)))


def _appended(spark, sf):
    """The step log as part files that arrive in three appends, and its partial results after each."""
    root, store = scratch_dir(spark, "appended"), scratch_dir(spark, "partials")
    cols = ["step", "loss", "num_tokens", "sample_time", "forward_time", "backward_time", "optimizer_time", "step_time"]
    lines = X.steps(spark, sf).select("run_id", "step", F.to_json(F.struct(*cols)).alias("value"))
    for k in range(3):
        low, high = F.col("step") >= 800 * k, F.col("step") < 800 * (k + 1)
        lines.where(low & high if k < 2 else low).select("run_id", "value").write.mode("append").partitionBy("run_id").text(root)
        P.update(spark, root, store)
    return P.read(spark, store)


@register("A3c_log_statistics_followed", with_views("steps") + rsel("""
SELECT run_id, max(step) AS total_steps, arg_max(loss, step) AS final_loss, avg(loss) AS mean_loss,
       stddev_samp(loss) AS std_loss, min(loss) AS min_loss, max(loss) AS max_loss,
       avg(sample_time) AS mean_sample_time, avg(forward_time) AS mean_forward_time,
       avg(backward_time) AS mean_backward_time, avg(optimizer_time) AS mean_optimizer_time, avg(step_time) AS mean_step_time,
       sum(num_tokens) / 1e9 AS total_tokens_b,
       avg(loss) FILTER (WHERE rn <= 100) AS last_100_loss_mean
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn FROM steps)
GROUP BY run_id""", *_A3_COLS))
def a3b(spark, sf):
    """A3 merged from the partial results of part files; each is read once."""
    return rounded(P.statistics(_appended(spark, sf)).withColumn("run_id", F.col("run_id").cast("bigint")))


@register("A8b_loss_bins_followed", with_views("steps") + """
SELECT run_id, CAST(floor(loss / 0.25) AS BIGINT) AS bin, count(*) AS count FROM steps WHERE loss IS NOT NULL GROUP BY ALL""")
def a8b(spark, sf):
    return P.loss_bins(_appended(spark, sf)).select(F.col("run_id").cast("bigint").alias("run_id"), "bin", "count")


@register("A13_compare_runs", with_views("steps") + rsel("""
SELECT run_id, max(step) AS total_steps, arg_max(loss, step) AS final_loss, avg(loss) AS mean_loss,
       stddev_samp(loss) AS std_loss, min(loss) AS min_loss, max(loss) AS max_loss,
       avg(sample_time) AS mean_sample_time, avg(forward_time) AS mean_forward_time,
       avg(backward_time) AS mean_backward_time, avg(optimizer_time) AS mean_optimizer_time, avg(step_time) AS mean_step_time,
       sum(num_tokens) / 1e9 AS total_tokens_b,
       avg(loss) FILTER (WHERE rn <= 100) AS last_100_loss_mean
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn FROM steps)
GROUP BY run_id""", *_A3_COLS))
def a13(spark, sf):
    return rounded(R.compare_runs(X.steps(spark, sf)))


_A4_STATS = []
for _c, _n in (("mean", "loss"), ("median", "median"), ("p5", "p5"), ("p95", "p95")):
    _A4_STATS += [f"avg({_c}) AS mean_{_n}", f"stddev_samp({_c}) AS std_{_n}",
                  f"min({_c}) AS min_{_n}", f"max({_c}) AS max_{_n}"]
_A4_DOUBLES = [s.split(" AS ")[1] for s in _A4_STATS] + [
    "last_svd_mean_ratio_1", "last_10_mean", "last_10_median", "last_10_median_diff_mean"]


@register("A4_eval_statistics", with_views("evals") + rsel(f"""
SELECT run_id, arg_max(step, line_no) AS total_steps,
       arg_max(svd_mean_ratio_1, line_no) AS last_svd_mean_ratio_1,
       {", ".join(_A4_STATS)},
       avg(mean) FILTER (WHERE rn <= 10) AS last_10_mean,
       avg(median) FILTER (WHERE rn <= 10) AS last_10_median,
       (arg_max(median, line_no) FILTER (WHERE rn <= 10) - arg_min(median, line_no) FILTER (WHERE rn <= 10))
         / CAST(nullif(count(*) FILTER (WHERE rn <= 10) - 1, 0) AS DOUBLE) AS last_10_median_diff_mean
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS rn FROM evals)
GROUP BY run_id""", *_A4_DOUBLES))
def a4(spark, sf):
    return rounded(R.eval_statistics(X.evals(spark, sf)))


@register("A5_eval_by_step", with_views("evals") + rsel("""
SELECT run_id, step, avg(p5) AS p5, avg(mean) AS mean, avg(p95) AS p95 FROM evals GROUP BY run_id, step""",
                                                      "p5", "mean", "p95"))
def a5(spark, sf):
    return rounded(R.eval_by_step(X.evals(spark, sf)))


@register("A6_tokens_by_task", with_views("steps") + rsel("""
SELECT run_id, task, CAST(sum(num_tokens) AS BIGINT) AS total_tokens FROM steps GROUP BY run_id, task"""))
def a6(spark, sf):
    return R.tokens_by_task(X.steps(spark, sf), by="run_id")


@register("A7_tokens_per_step", with_views("steps") + rsel("""
SELECT run_id, step, CAST(sum(num_tokens) AS BIGINT) AS num_tokens FROM steps GROUP BY run_id, step"""))
def a7(spark, sf):
    return R.tokens_per_step(X.steps(spark, sf))


def _hist_sql(src: str, by: str, x: str, bins: int = 50) -> str:
    return f"""
SELECT {by}, bin, lo + bin * ((hi - lo) / {bins}.0) AS bin_lo, lo + (bin + 1) * ((hi - lo) / {bins}.0) AS bin_hi,
       count(*) AS count
FROM (SELECT {by}, lo, hi,
             CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({x} - lo) / ((hi - lo) / {bins}.0)), {bins - 1}) END
                  AS INTEGER) AS bin
      FROM {src} AS s JOIN (SELECT {by}, min({x}) AS lo, max({x}) AS hi FROM {src} WHERE {x} IS NOT NULL
                            GROUP BY {by}) AS r USING ({by})
      WHERE {x} IS NOT NULL)
GROUP BY {by}, bin, lo, hi"""


@register("A8_histogram_tokens_per_step",
          with_views("steps") + ", tps AS (SELECT run_id, step, CAST(sum(num_tokens) AS BIGINT) AS x FROM steps "
          "GROUP BY run_id, step)\n" + rsel(_hist_sql("tps", "run_id", "x"), "bin_lo", "bin_hi"))
def a8(spark, sf):
    tps = R.tokens_per_step(X.steps(spark, sf))
    return rounded(R.histogram(tps, "num_tokens", 50, by="run_id"))


@register("A9_loss_hist_by_task", with_views("steps") + rsel(f"""
SELECT h.*, a.axis_min, a.axis_max
FROM ({_hist_sql("steps", "run_id, task", "loss")}) AS h
JOIN (SELECT run_id, min(loss) AS axis_min, max(loss) AS axis_max FROM steps GROUP BY run_id) AS a
USING (run_id)""", "bin_lo", "bin_hi", "axis_min", "axis_max"))
def a9(spark, sf):
    return rounded(R.loss_hist_by_task(X.steps(spark, sf), 50, by="run_id"))


@register("A10_step_time_components", with_views("steps") + rsel("""
SELECT run_id, q99, q99 * 1.25 AS y_max
FROM (SELECT run_id, quantile_cont(coalesce(sample_time, 0) + coalesce(forward_time, 0)
                                   + coalesce(backward_time, 0) + coalesce(optimizer_time, 0), 0.99) AS q99
      FROM steps GROUP BY run_id)""", "q99", "y_max"))
def a10(spark, sf):
    return rounded(R.step_time_components(X.steps(spark, sf)))


@register("A11_eval_summary", with_views("evals") + rsel("""
SELECT run_id, step, mean, median, std, min, p5, p95, max, num_samples FROM evals""",
                                                       "mean", "median", "std", "min", "p5", "p95", "max"))
def a11(spark, sf):
    return rounded(R.eval_summary(X.eval_losses(spark, sf), ["run_id", "step"], "sample_loss"))


@register("A12_loss_annotations", with_views("steps") + rsel("""
SELECT run_id, min_loss, max_loss, max_loss * 1.1 AS y_limit, final_moving_avg
FROM (SELECT run_id, min(loss) AS min_loss,
             CASE WHEN max(step) > 1000 THEN max(loss) FILTER (WHERE step > 1000) ELSE max(loss) END AS max_loss,
             CASE WHEN count(*) FILTER (WHERE rn <= 1000) = 1000 THEN avg(loss) FILTER (WHERE rn <= 1000) END
               AS final_moving_avg
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn FROM steps)
      GROUP BY run_id)""", "min_loss", "max_loss", "y_limit", "final_moving_avg"))
def a12(spark, sf):
    return rounded(R.loss_annotations(X.steps(spark, sf)))


@register("A14_leaderboard", with_views("results") + rsel("""
SELECT model_name, task_name, score, row_number() OVER (ORDER BY task_name, score, model_name) - 1 AS pos
FROM results""", "score"))
def a14(spark, sf):
    """The board with each row's place in it."""
    return rounded(sorted_positions(R.leaderboard(X.results(spark, sf)), [], ["task_name", "score", "model_name"], out="pos"))


@register("A15_chart_series", with_views("steps", "evals") + rsel("""
SELECT coalesce(s.run_id, e.run_id) AS run_id, coalesce(s.step, e.step) AS step, s.lr, s.loss,
       e.svd_mean_ratio_1, e.svd_median_ratio_1
FROM steps AS s FULL OUTER JOIN
     (SELECT run_id, step, avg(svd_mean_ratio_1) AS svd_mean_ratio_1, avg(svd_median_ratio_1) AS svd_median_ratio_1
      FROM evals GROUP BY run_id, step) AS e
ON s.run_id = e.run_id AND s.step = e.step""", "lr", "loss", "svd_mean_ratio_1", "svd_median_ratio_1"))
def a15(spark, sf):
    return rounded(R.chart_series(X.steps(spark, sf), X.evals(spark, sf)))


def _nan_log(spark, sf):
    """Steps with a NaN loss wherever num_tokens % 37 = 0 (a NaN-carrying stand-in)."""
    s = X.steps(spark, sf)
    return s.withColumn("loss", F.when(F.col("num_tokens") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("loss")))


@register("A16_nan_steps", with_views("steps") + rsel("""
SELECT run_id, count(*) AS skipped_steps, min(step) AS first_skipped
FROM steps WHERE num_tokens % 37 = 0 AND step > 100 GROUP BY run_id"""))
def a16(spark, sf):
    return R.nan_steps(_nan_log(spark, sf))


@register("A16b_nan_log_statistics", with_views("steps") + rsel("""
SELECT run_id, avg(l) AS mean_loss, min(CASE WHEN isnan(l) THEN NULL ELSE l END) AS min_loss,
       max(CASE WHEN isnan(l) THEN NULL ELSE l END) AS max_loss
FROM (SELECT run_id, CASE WHEN num_tokens % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE loss END AS l FROM steps)
GROUP BY run_id""", "mean_loss", "min_loss", "max_loss"))
def a16b(spark, sf):
    st = R.log_statistics(_nan_log(spark, sf))
    return rounded(st.select("run_id", "mean_loss", "min_loss", "max_loss"))


@register("A17_flag_eval_steps", with_views("steps") + rsel("""
SELECT run_id, step, step > 0 AND step % 1000 = 0 AS is_eval_step FROM steps"""))
def a17(spark, sf):
    return R.flag_eval_steps(X.steps(spark, sf), 1000).select("run_id", "step", "is_eval_step")


@register("A3b_log_statistics_no_eval_steps", with_views("steps") + rsel("""
SELECT run_id, max(step) AS total_steps, arg_max(loss, step) AS final_loss, avg(loss) AS mean_loss,
       stddev_samp(loss) AS std_loss, min(loss) AS min_loss, max(loss) AS max_loss,
       avg(sample_time) AS mean_sample_time, avg(forward_time) AS mean_forward_time,
       avg(backward_time) AS mean_backward_time, avg(optimizer_time) AS mean_optimizer_time, avg(step_time) AS mean_step_time,
       sum(num_tokens) / 1e9 AS total_tokens_b,
       avg(loss) FILTER (WHERE rn <= 100) AS last_100_loss_mean
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn
      FROM steps WHERE NOT (step > 0 AND step % 100 = 0))
GROUP BY run_id""", *_A3_COLS))
def a3b(spark, sf):
    """A3 with the eval-step rows (every 100th step here) excluded."""
    return rounded(R.log_statistics(X.steps(spark, sf), exclude_eval_steps=100))
