"""Checked queries for the window operators (W1-W11) on the ``steps``/``evals`` views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from runforge.operators import windows as W
from runforge.plans.oracle_views import exclusive_cut_sql, with_views
from runforge.plans.registry import register, rounded
from runforge.plans.suite_runlog import rsel
from runforge.session import materialize
from runforge.sources import fixtures as X

_NN = "CASE WHEN isnan(loss) THEN NULL ELSE loss END"


@register("W1_trailing_loss", with_views("steps") + rsel(f"""
SELECT run_id, step, loss,
       avg({_NN}) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS loss_100,
       avg({_NN}) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS loss_1000
FROM steps""", "loss", "loss_100", "loss_1000"))
def w1(spark, sf):
    return rounded(W.trailing_loss(X.steps(spark, sf)))


@register("W2_rolling_mean", with_views("steps") + rsel(f"""
SELECT run_id, step, loss,
       CASE WHEN count({_NN}) OVER w = 1000 THEN avg({_NN}) OVER w END AS rolling_mean
FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
                                                     "loss", "rolling_mean"))
def w2(spark, sf):
    return rounded(W.rolling_mean(X.steps(spark, sf), 1000))


@register("W3_rolling_band", with_views("steps") + """, q AS (
SELECT run_id, step,
       CASE WHEN count(loss) OVER w = 1000 THEN quantile_cont(loss, 0.05) OVER w END AS q05,
       CASE WHEN count(loss) OVER w = 1000 THEN quantile_cont(loss, 0.95) OVER w END AS q95
FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
""" + rsel("""
SELECT run_id, step,
       CASE WHEN count(q05) OVER v = 10 THEN avg(q05) OVER v END AS band_q05,
       CASE WHEN count(q95) OVER v = 10 THEN avg(q95) OVER v END AS band_q95
FROM q WINDOW v AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
           "band_q05", "band_q95"))
def w3(spark, sf):
    return rounded(W.rolling_band(X.steps(spark, sf), 1000, 10))


@register("W4_loss_diff", with_views("steps") + rsel("""
SELECT run_id, step, loss, loss - lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS loss_diff FROM steps""",
                                                  "loss", "loss_diff"))
def w4(spark, sf):
    return rounded(W.loss_diff(X.steps(spark, sf)))


@register("W5_cumulative_tokens", with_views("steps") + rsel("""
SELECT run_id, step, num_tokens,
       CAST(sum(num_tokens) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT)
         AS cumulative_tokens
FROM steps"""))
def w5(spark, sf):
    return W.cumulative_tokens(X.steps(spark, sf))


# The same operators on a log with gaps, in chunks of 256 rows: every run crosses many seams.
@register("W1b_trailing_loss_gaps", with_views("gapped") + f"""
SELECT run_id, step, CASE WHEN l50 = 'inf' THEN 1e300 ELSE round(l50, 6) END AS loss_50,
       CASE WHEN l200 = 'inf' THEN 1e300 ELSE round(l200, 6) END AS loss_200
FROM (SELECT run_id, step, list_avg(list_filter(list(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 49 PRECEDING
               AND CURRENT ROW), lambda x: NOT isnan(x))) AS l50,
             list_avg(list_filter(list(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 199 PRECEDING
               AND CURRENT ROW), lambda x: NOT isnan(x))) AS l200 FROM gapped)""")
def w1b(spark, sf):
    t = W.trailing_loss(X.gapped(spark, sf), (50, 200), chunk_rows=256)
    shown = lambda c: F.when(F.col(c) == float("inf"), F.lit(1e300)).otherwise(F.round(c, 6)).alias(c)
    return t.select("run_id", "step", shown("loss_50"), shown("loss_200"))


@register("W2b_rolling_mean_gaps", with_views("gapped") + """
SELECT run_id, step, CASE WHEN len(xs) = 30 THEN round(list_avg(xs), 6) END AS rolling_mean
FROM (SELECT run_id, step, list_filter(list(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 29 PRECEDING
               AND CURRENT ROW), lambda x: isfinite(x)) AS xs FROM gapped)""")
def w2b(spark, sf):
    return rounded(W.rolling_mean(X.gapped(spark, sf), 30, chunk_rows=256).select("run_id", "step", "rolling_mean"))


@register("W3b_rolling_band_gaps", with_views("gapped") + """, f AS (
SELECT run_id, step, CASE WHEN isfinite(loss) THEN loss END AS loss FROM gapped),
q AS (SELECT run_id, step,
       CASE WHEN count(loss) OVER w = 20 THEN quantile_cont(loss, 0.05) OVER w END AS q05,
       CASE WHEN count(loss) OVER w = 20 THEN quantile_cont(loss, 0.95) OVER w END AS q95
FROM f WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
""" + rsel("""
SELECT run_id, step, CASE WHEN count(q05) OVER v = 4 THEN avg(q05) OVER v END AS band_q05,
       CASE WHEN count(q95) OVER v = 4 THEN avg(q95) OVER v END AS band_q95
FROM q WINDOW v AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", "band_q05", "band_q95"))
def w3b(spark, sf):
    """All rows: a frame that holds a NaN or an infinity has no value, one that holds the huge loss has."""
    return rounded(W.rolling_band(X.gapped(spark, sf), 20, 4, chunk_rows=256))


@register("W4b_loss_diff_gaps", with_views("gapped") + """, d AS (
SELECT run_id, step, loss, loss - lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS loss_diff FROM gapped)
SELECT run_id, step, """ + ", ".join(f"""CASE WHEN isnan({c}) THEN -1e299 WHEN {c} = 'inf' THEN 1e300 WHEN {c} = '-inf' THEN -1e300
       ELSE round({c}, 6) END AS {c}""" for c in ("loss", "loss_diff")) + " FROM d")
def w4b(spark, sf):
    """All rows; NaN and infinities are shown as numbers of their own."""
    t, inf = W.loss_diff(X.gapped(spark, sf), chunk_rows=256), float("inf")
    shown = lambda c: (F.when(F.isnan(c), F.lit(-1e299)).when(F.col(c) == inf, F.lit(1e300))
                       .when(F.col(c) == -inf, F.lit(-1e300)).otherwise(F.round(c, 6)).alias(c))
    return t.select("run_id", "step", shown("loss"), shown("loss_diff"))


@register("W6b_token_rate_gaps", with_views("gapped") + """, t AS (
SELECT run_id, step, CASE WHEN step % 700 > 1 THEN num_tokens END AS num_tokens, total_time FROM gapped),
f AS (SELECT *, CASE WHEN total_time < lag(total_time) OVER (PARTITION BY run_id ORDER BY step) THEN 1 ELSE 0 END
                  AS nf FROM t),
s AS (SELECT *, sum(nf) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS session FROM f),
r AS (SELECT run_id, step, CAST(session AS BIGINT) AS session, total_time,
             CAST(coalesce(sum(num_tokens) OVER (PARTITION BY run_id, session ORDER BY step ROWS UNBOUNDED PRECEDING), 0)
                  AS BIGINT) AS session_tokens FROM s)
""" + rsel("""
SELECT run_id, step, session, session_tokens, session_tokens / greatest(total_time, 1.0) AS token_rate FROM r""",
           "token_rate"))
def w6b(spark, sf):
    """The first rows of a session have no token count: they count as 0."""
    s = X.gapped(spark, sf).withColumn("num_tokens", F.when(F.col("step") % 700 > 1, F.col("num_tokens")))
    return rounded(W.token_rate(s, chunk_rows=256))


def _timed_log(spark, sf):
    """Steps with a stand-in session clock: total_time restarts every 700 steps."""
    s = X.steps(spark, sf)
    return s.withColumn("total_time", (F.pmod(F.col("step"), F.lit(700)) + 1) * F.lit(0.25))


@register("W6_token_rate", with_views("steps") + """, t AS (
SELECT run_id, step, num_tokens, CAST((step % 700 + 1) AS DOUBLE) * 0.25::DOUBLE AS total_time FROM steps),
f AS (SELECT *, CASE WHEN total_time < lag(total_time) OVER (PARTITION BY run_id ORDER BY step) THEN 1 ELSE 0 END
                  AS nf FROM t),
s AS (SELECT *, sum(nf) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS session FROM f),
r AS (SELECT run_id, step, CAST(session AS BIGINT) AS session, total_time,
             CAST(sum(num_tokens) OVER (PARTITION BY run_id, session ORDER BY step ROWS UNBOUNDED PRECEDING)
                  AS BIGINT) AS session_tokens FROM s)
""" + rsel("""
SELECT run_id, step, session, session_tokens, session_tokens / greatest(total_time, 1.0) AS token_rate FROM r""",
           "token_rate"))
def w6(spark, sf):
    return rounded(W.token_rate(_timed_log(spark, sf)))


@register("W7_clip_threshold", with_views("steps") + """, h AS (
SELECT run_id, step, grad_norm,
       list_sort((list(grad_norm) OVER (PARTITION BY run_id ORDER BY step
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))[2:]) AS xs
FROM steps)
""" + rsel(f"""
SELECT run_id, step, grad_norm, thr AS clip_threshold, grad_norm > thr AS clipped
FROM (SELECT run_id, step, grad_norm,
             CASE WHEN step = 0 THEN NULL WHEN len(xs) < 100 THEN 1.0
                  ELSE {exclusive_cut_sql(90, 'xs', 'len(xs)')} END AS thr
      FROM h)""", "grad_norm", "clip_threshold"))
def w7(spark, sf):
    return rounded(W.clip_threshold(X.steps(spark, sf), max_norm=1.0, pct=90))


@register("W8_derive_epoch", with_views("steps") + rsel("""
SELECT run_id, step, CAST(ceil(step / 1000) AS BIGINT) AS epoch FROM steps"""))
def w8(spark, sf):
    return W.derive_epoch(X.steps(spark, sf), 1000).select("run_id", "step", "epoch")


@register("W9_resume_state", with_views("steps") + rsel("""
SELECT run_id, CAST(max(step) + 1 AS BIGINT) AS resume_step,
       CAST(arg_max(ceil(step / 1000), step) AS BIGINT) AS resume_epoch
FROM steps GROUP BY run_id"""))
def w9(spark, sf):
    return W.resume_state(W.derive_epoch(X.steps(spark, sf), 1000))


@register("W10_last_eval_asof", with_views("steps", "evals") + rsel("""
SELECT s.run_id, s.step, coalesce(e.mean, 0.0) AS last_eval
FROM steps AS s ASOF LEFT JOIN
     (SELECT run_id, step, arg_max(mean, line_no) AS mean FROM evals WHERE step > 0 GROUP BY run_id, step) AS e
ON s.run_id = e.run_id AND s.step >= e.step""", "last_eval"))
def w10(spark, sf):
    return rounded(W.last_eval_asof(X.steps(spark, sf), X.evals(spark, sf)))


# Schedule settings for the stand-in runs (2,400-2,600 steps each), so
# that every phase of each schedule is reached.
LINEAR = dict(peak_lr=2e-4, warmup_steps=500, peak_steps=1000, total_steps=3000, start_lr=1e-5, end_lr=1e-4)
EXPONENTIAL = dict(start_lr=1e-5, end_lr=1e-7, warmup_factor=2.0, warmup_steps_per_period=100,
                   warmup_periods=8, constant_steps=100, cooldown_factor=2.0, cooldown_steps_per_period=100)
SINUSOID = dict(start_lr=1e-5, plateau_lr=2e-4, end_lr=1e-6, warmup_steps=500, plateau_steps=1500,
                cooldown_steps=1000, period=100, magnitude=0.1)


def _f(x: float) -> str:
    return repr(float(x))


def _linear_sql(s: str, p: dict) -> str:
    start, peak, end = p["start_lr"], p["peak_lr"], p["end_lr"]
    wu, pk = p["warmup_steps"], p["peak_steps"]
    cd = p["total_steps"] - wu - pk
    return (f"CASE WHEN {s} < {wu} THEN {_f(start)} + ({s} / {_f(wu)}) * {_f(peak - start)} "
            f"WHEN {s} < {wu + pk} THEN {_f(peak)} "
            f"ELSE greatest({_f(peak)} - (({s} - {_f(wu + pk)}) / {_f(cd)}) * {_f(peak - end)}, {_f(end)}) END")


def _exponential_changes(p: dict, last: int) -> tuple[list[int], list[int]]:
    """Steps after which the rate has doubled, and halved once more, walking period by period."""
    K, M, C, Kc = (p["warmup_steps_per_period"], p["warmup_periods"], p["constant_steps"], p["cooldown_steps_per_period"])
    ups = [j * (K + 1) - 1 for j in range(1, K * M + 2) if j * (K + 1) <= K * M + 1]
    left = (K * M + 1) - len(ups) * (K + 1)
    left = (C - 1) % (C + 1) if left > C else (left + C) % (C + 1)
    downs, at = [], K * M + C + max(Kc + 1 - left, 1)
    while at <= last:
        downs.append(at)
        at += Kc + 1
    return ups, downs


def _exp_sql(n: str, p: dict) -> str:
    ups, downs = _exponential_changes(p, 1_000_000)
    up = f"len(list_filter({ups}, lambda x: x <= {n}))"
    down = f"(CASE WHEN {n} < {downs[0]} THEN 0 ELSE ({n} - {downs[0]}) // {downs[1] - downs[0]} + 1 END)"
    top = f"({_f(p['start_lr'])} * pow({_f(p['warmup_factor'])}, {up}))"
    return (f"CASE WHEN {down} > 0 THEN greatest({top} / pow({_f(p['cooldown_factor'])}, {down}), "
            f"{_f(p['end_lr'])}) ELSE {top} END")


def _sin_sql(s: str, p: dict) -> str:
    st, pl, en = p["start_lr"], p["plateau_lr"], p["end_lr"]
    wu, ps, cd = p["warmup_steps"], p["plateau_steps"], p["cooldown_steps"]
    return (f"CASE WHEN {s} < {wu} THEN {_f(st)} + {_f(pl - st)} * {s} / {_f(wu)} "
            f"WHEN {s} < {wu + ps} THEN {_f(pl)} + {_f(pl * p['magnitude'])} * "
            f"sin({_f(math.pi)} * ({s} - {_f(wu)}) / {_f(p['period'])}) "
            f"ELSE {_f(pl)} - {_f(pl - en)} * sqrt(({s} - {_f(wu + ps)}) / {_f(cd)}) END")


def _audit_sql(expr_of_s, lag: int) -> str:
    s = f"CAST(greatest(step - {lag}, 0) AS DOUBLE)" if lag else "CAST(step AS DOUBLE)"
    n = f"greatest(step - {lag}, 0)"
    e = expr_of_s(s, n)
    return with_views("steps") + f""", a AS (
SELECT run_id, step, {e} AS expected_lr FROM steps),
b AS (SELECT a.run_id, a.step, a.expected_lr,
             a.expected_lr * (CASE WHEN s.num_tokens % 17 = 0 THEN 1.01 ELSE 1.0 END) AS lr
      FROM a JOIN steps AS s ON a.run_id = s.run_id AND a.step = s.step)
SELECT run_id, step, round(lr * 1e6, 6) AS lr_micro, round(expected_lr * 1e6, 6) AS expected_lr_micro,
       abs(lr - expected_lr) > 1e-6 * greatest(abs(expected_lr), 1e-30) AS drift
FROM b"""


def _audit(spark, sf, kind, params, lag):
    s = X.steps(spark, sf)
    logged = s.withColumn("lr", W.expected_lr(F.col("step"), kind, params, lag) *
                          F.when(F.col("num_tokens") % 17 == 0, F.lit(1.01)).otherwise(F.lit(1.0)))
    a = W.lr_audit(logged, kind, params, lag)
    return a.select("run_id", "step", F.round(F.col("lr") * 1e6, 6).alias("lr_micro"),
                    F.round(F.col("expected_lr") * 1e6, 6).alias("expected_lr_micro"), "drift")


@register("W11_lr_audit_linear", _audit_sql(lambda s, n: _linear_sql(s, LINEAR), 1))
def w11a(spark, sf):
    return _audit(spark, sf, "linear", LINEAR, 1)


@register("W11_lr_audit_exponential", _audit_sql(lambda s, n: _exp_sql("step", EXPONENTIAL), 1))
def w11b(spark, sf):
    return _audit(spark, sf, "exponential", EXPONENTIAL, 1)


@register("W11_lr_audit_sinusoid", _audit_sql(lambda s, n: _sin_sql(s, SINUSOID), 0))
def w11c(spark, sf):
    return _audit(spark, sf, "sinusoid", SINUSOID, 0)


@register("W10b_last_eval_asof_sessions", with_views("steps", "evals") + rsel("""
SELECT s.run_id, s.step, coalesce(e.mean, 0.0) AS last_eval
FROM (SELECT run_id, step, CAST(floor(step / 700) AS BIGINT) AS session FROM steps) AS s ASOF LEFT JOIN
     (SELECT run_id, step, CAST(floor(step / 700) AS BIGINT) AS session, arg_max(mean, line_no) AS mean
      FROM evals WHERE step > 0 GROUP BY run_id, step) AS e
ON s.run_id = e.run_id AND s.session = e.session AND s.step >= e.step""", "last_eval"))
def w10b(spark, sf):
    """W10 with the eval lookup restarting at each session (clock restarts every 700 steps)."""
    sess = materialize(W.token_rate(_timed_log(spark, sf)).select("run_id", "step", "session"), "sessions")
    log = X.steps(spark, sf).join(sess, ["run_id", "step"])
    return rounded(W.last_eval_asof(log, X.evals(spark, sf), session="session"))


def _shipped_linear():
    from runforge.functions.schedules import schedule_from_config
    return schedule_from_config(X.TRAINING_CONFIG)[1]


# One configuration a run; nulls take the trainer's defaults.
CONFIGS = [(0, "linear", 1e-5, 2e-4, 1e-4, 500, 1000, 3000, 1), (1, None, None, 1e-3, None, 300, 900, 2000, 4),
           (2, "exponential", 1e-5, None, None, None, None, None, 1)]
CONFIG_SCHEMA = ("run_id long, scheduler_type string, start_lr double, peak_lr double, end_lr double, warmup_steps long, "
                 "peak_steps long, total_steps long, gradient_accumulation_steps long")
_EXP_SHIPPED = dict(start_lr=1e-5, end_lr=1e-7, warmup_factor=2.0, warmup_steps_per_period=100, warmup_periods=8,
                    constant_steps=100, cooldown_factor=2.0, cooldown_steps_per_period=100)


def _moved(g: int, session: str) -> str:
    """The last step that moved the scheduler before ``step``, listing the steps of the last accumulation."""
    return f"coalesce(list_max(list_filter(range(greatest(step - {g}, {session}), step), lambda k: (k + 1) % {g} = 0)), 0)"


def _resumed_rates(p: dict, start: int, last: int) -> str:
    """SQL list of (steps since ``start``, rate) at which a session's rate is new, walking its scheduler call by call."""
    K, C, Kc = p["warmup_steps_per_period"], p["constant_steps"], p["cooldown_steps_per_period"]
    warm = K * p["warmup_periods"]
    rate, counter, rates = p["start_lr"], 1, [(0, p["start_lr"])]  # one call before any step
    for call in range(start, start + last):
        if call < warm:
            change, new = counter >= K, rate * p["warmup_factor"]
        elif call < warm + C:
            change, new = counter >= C, rate
        else:
            change, new = counter >= Kc, max(rate / p["cooldown_factor"], p["end_lr"])
        rate, counter = (new, 0) if change else (rate, counter + 1)
        if rate != rates[-1][1]:
            rates.append((call + 1 - start, rate))
    return "[" + ", ".join(f"{{'at': {n}, 'lr': {_f(x)}}}" for n, x in rates) + "]"


@register("W11e_lr_audit_runs", with_views("steps") + f""", r AS (
SELECT run_id, step, num_tokens, (step // 700) * 700 AS s0 FROM steps),
e AS (SELECT run_id, step, num_tokens, CASE run_id
  WHEN 0 THEN {_linear_sql("CAST(" + _moved(1, "s0") + " AS DOUBLE)", dict(start_lr=1e-5, peak_lr=2e-4, end_lr=1e-4, warmup_steps=500, peak_steps=1000, total_steps=3000))}
  WHEN 1 THEN {_linear_sql("CAST(" + _moved(4, "s0") + " AS DOUBLE)", dict(start_lr=1e-5, peak_lr=1e-3, end_lr=1e-6, warmup_steps=300, peak_steps=900, total_steps=2000))}
  END AS x FROM r WHERE run_id IN (0, 1)
  UNION ALL SELECT run_id, step, num_tokens, list_filter(CASE s0 WHEN 0 THEN {_resumed_rates(_EXP_SHIPPED, 0, 700)}
    WHEN 700 THEN {_resumed_rates(_EXP_SHIPPED, 700, 700)} ELSE {_resumed_rates(_EXP_SHIPPED, 1400, 700)} END,
    lambda c: c.at <= step - s0)[-1].lr AS x FROM r WHERE run_id = 2
  UNION ALL SELECT run_id, step, num_tokens, NULL AS x FROM r WHERE run_id = 3)
SELECT run_id, step, round(x * 1e6, 6) AS expected_lr_micro,
       abs(x * (CASE WHEN num_tokens % 17 = 0 THEN 1.01 ELSE 1.0 END) - x) > 1e-6 * greatest(abs(x), 1e-30) AS drift
FROM e""")
def w11e(spark, sf):
    """A configuration for each run, accumulation of four steps in one, and a resume every 700 steps. (Run 3 has
    no configuration.)"""
    log = X.steps(spark, sf).withColumn("s0", (F.floor(F.col("step") / 700) * 700).cast("long"))
    configs = spark.createDataFrame(CONFIGS, CONFIG_SCHEMA)
    expected = W.lr_audit_runs(log.withColumn("lr", F.lit(0.0)), configs, resumed="s0").select("run_id", "step", "expected_lr")
    noise = F.when(F.col("num_tokens") % 17 == 0, F.lit(1.01)).otherwise(F.lit(1.0))
    logged = log.drop("lr").join(expected, ["run_id", "step"]).withColumn("lr", F.col("expected_lr") * noise).drop("expected_lr")
    a = W.lr_audit_runs(logged, configs, resumed="s0")
    return a.select("run_id", "step", F.round(F.col("expected_lr") * 1e6, 6).alias("expected_lr_micro"), "drift")


@register("W7b_clip_threshold_sessions", with_views("steps") + """, r AS (
SELECT run_id, step, grad_norm, step // 700 AS session, step > 0 AND (step + 1) % 3 = 0 AS rec FROM steps),
h AS (SELECT run_id, step, list_sort(list(grad_norm) OVER (PARTITION BY run_id, session ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS xs FROM r WHERE rec)
""" + rsel(f"""
SELECT r.run_id, r.step, r.grad_norm, thr AS clip_threshold, r.grad_norm > thr AS clipped
FROM r LEFT JOIN (SELECT run_id, step, CASE WHEN len(xs) < 100 THEN 1.0 ELSE {exclusive_cut_sql(90, 'xs', 'len(xs)')} END AS thr
                  FROM h) AS t ON r.run_id = t.run_id AND r.step = t.step""", "grad_norm", "clip_threshold"))
def w7b(spark, sf):
    """Gradients accumulated over three steps; every 700 steps a resume empties the history."""
    log = X.steps(spark, sf).withColumn("session", F.floor(F.col("step") / 700))
    return rounded(W.clip_threshold(log, 1.0, 90, chunk_rows=256, every=3, session="session"))


@register("W7c_clip_threshold_each_step", with_views("steps") + """, h AS (
SELECT run_id, step, list_sort(list(grad_norm) OVER (PARTITION BY run_id ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS xs FROM steps WHERE step > 0 AND step % 2 = 0),
t AS (SELECT run_id, step, CASE WHEN len(xs) < 100 THEN 1.0 ELSE """ + exclusive_cut_sql(90, 'xs', 'len(xs)') + """ END AS thr FROM h)
""" + rsel("""
SELECT s.run_id, s.step, s.grad_norm, coalesce(t.thr, 1.0) AS clip_threshold, s.grad_norm > coalesce(t.thr, 1.0) AS clipped
FROM steps AS s ASOF LEFT JOIN t ON s.run_id = t.run_id AND s.step >= t.step""", "grad_norm", "clip_threshold"))
def w7c(spark, sf):
    return rounded(W.clip_threshold(X.steps(spark, sf), 1.0, 90, chunk_rows=256, every=2, each_step=True))


@register("W11d_lr_audit_shipped_config", _audit_sql(lambda s, n: _linear_sql(s, _shipped_linear()), 1))
def w11d(spark, sf):
    """Audit against the shipped training configuration (linear trapezoid)."""
    s = X.steps(spark, sf)
    kind, params = "linear", _shipped_linear()
    logged = s.withColumn("lr", W.expected_lr(F.col("step"), kind, params, 1) *
                          F.when(F.col("num_tokens") % 17 == 0, F.lit(1.01)).otherwise(F.lit(1.0)))
    a = W.lr_audit_config(logged, X.TRAINING_CONFIG)
    return a.select("run_id", "step", F.round(F.col("lr") * 1e6, 6).alias("lr_micro"),
                    F.round(F.col("expected_lr") * 1e6, 6).alias("expected_lr_micro"), "drift")
