"""Chunked (halo) windows equal the plain per-run windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runforge.operators import windows as W
from runforge.sources import fixtures as X

from conftest import SF01


def _steps(spark):
    return X.steps(spark, SF01)


def test_trailing_halo_equals_plain(spark):
    s = _steps(spark)
    small = W.trailing_loss(s, (100, 1000), chunk_rows=1000)
    w = Window.partitionBy("run_id").orderBy("step")
    plain = s.select("run_id", "step",
                     F.avg("loss").over(w.rowsBetween(-99, 0)).alias("p100"),
                     F.avg("loss").over(w.rowsBetween(-999, 0)).alias("p1000"))
    j = small.join(plain, ["run_id", "step"])
    assert j.count() == s.count()
    bad = j.where((F.abs(F.col("loss_100") - F.col("p100")) > 1e-9) |
                  (F.abs(F.col("loss_1000") - F.col("p1000")) > 1e-9)).count()
    assert bad == 0


def test_running_sum_and_asof_chunked(spark):
    s = _steps(spark)
    a = W.cumulative_tokens(s, chunk_rows=300).withColumnRenamed("cumulative_tokens", "a")
    b = W.cumulative_tokens(s).withColumnRenamed("cumulative_tokens", "b")
    assert a.join(b, ["run_id", "step", "num_tokens"]).where("a <> b").count() == 0
    ev = X.evals(spark, SF01)
    c = W.last_eval_asof(s, ev, chunk_rows=250).withColumnRenamed("last_eval", "c")
    d = W.last_eval_asof(s, ev).withColumnRenamed("last_eval", "d")
    assert c.join(d, ["run_id", "step"]).where(F.abs(F.col("c") - F.col("d")) > 1e-12).count() == 0


def test_band_chunked_equals_unchunked(spark):
    s = _steps(spark)
    a = W.rolling_band(s, 1000, 10, chunk_rows=1100)
    b = W.rolling_band(s, 1000, 10)
    j = a.join(b.withColumnRenamed("band_q05", "b05").withColumnRenamed("band_q95", "b95"), ["run_id", "step"])
    assert j.count() == s.count()
    assert j.where(F.abs(F.col("band_q05") - F.col("b05")) > 1e-9).count() == 0


def test_rolling_rules_at_infinities(spark):
    """W2 and W3 on one gapped log against pandas; W1 keeps the infinity."""
    import numpy as np
    rng = np.random.default_rng(7)
    x = rng.normal(size=900)
    x[[100, 101, 400]], x[[250, 600]], x[700] = np.nan, [np.inf, -np.inf], 1e9
    df = spark.createDataFrame([(1, int(3 * i), float(v)) for i, v in enumerate(x)], "run_id long, step long, loss double")
    import pandas as pd
    s = pd.Series(x)
    mean = {r.step: r.rolling_mean for r in W.rolling_mean(df, 30, chunk_rows=64).collect()}
    want = s.rolling(30).mean()
    clean = s.replace([np.inf, -np.inf], np.nan).rolling(30).apply(np.mean, raw=True)  # without the drift of a running sum
    assert all((mean[3 * i] is None) == bool(np.isnan(w)) for i, w in enumerate(want))
    assert all(mean[3 * i] is None or abs(mean[3 * i] - c) <= 1e-9 * max(1, abs(c)) for i, c in enumerate(clean))
    band = {r.step: r.band_q95 for r in W.rolling_band(df, 30, 5, qs=(0.95,), chunk_rows=64).collect()}
    exact = s.replace([np.inf, -np.inf], np.nan).rolling(30).apply(lambda a: np.quantile(a, 0.95), raw=True).rolling(5).apply(np.mean, raw=True)
    assert all((band[3 * i] is None or np.isnan(band[3 * i])) == bool(np.isnan(w)) for i, w in enumerate(exact))
    last = {r.step: r.loss_30 for r in W.trailing_loss(df, (30,), chunk_rows=64).collect()}
    assert last[3 * 260] == np.inf and last[3 * 610] == -np.inf and last[3 * 110] is not None


def test_trailing_time_does_not_grow_with_the_window(spark):
    import time
    df = spark.range(600_000).selectExpr("id % 2 as run_id", "id div 2 as step", "rand(3) as loss").persist()
    df.count()
    took = {}
    for k in (100, 100, 4000):  # the first run compiles
        t = time.time()
        W.trailing_loss(df, (k,)).write.format("noop").mode("overwrite").save()
        took[k] = time.time() - t
    df.unpersist()
    assert took[4000] < 3 * took[100] + 1
