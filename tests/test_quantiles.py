"""Exclusive quantiles (A11, W7), rank-and-pick and sliced positions."""

import random
import statistics

import duckdb
from pyspark.sql import functions as F

from runforge.functions.indexing import position_within
from runforge.operators import runlog as R
from runforge.operators import windows as W


def test_a11_p5_hand_case(spark):
    vals = [float((i * 7919) % 1000) for i in range(537)]
    df = spark.createDataFrame([(0, v) for v in vals], "g int, x double")
    row = R.eval_summary(df, "g", "x").collect()[0]
    q = statistics.quantiles(vals, n=100)
    assert abs(row.p5 - 58.28) < 1e-9 and abs(row.p5 - q[5]) < 1e-9
    assert abs(row.p95 - q[95]) < 1e-9
    assert abs(row.median - statistics.median(vals)) < 1e-9
    assert abs(row.std - statistics.stdev(vals)) < 1e-9


def test_a11_random_groups(spark):
    rng = random.Random(1)
    rows = [(g, rng.random() * 10) for g in range(6) for _ in range(rng.randint(2, 300))]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r for r in R.eval_summary(df, "g", "x").collect()}
    for g in range(6):
        xs = [x for gg, x in rows if gg == g]
        q = statistics.quantiles(xs, n=100)
        assert abs(got[g].p5 - q[5]) < 1e-9 and abs(got[g].p95 - q[95]) < 1e-9


def test_w7_against_model(spark):
    rng = random.Random(2)
    norms = [rng.random() * 3 for _ in range(400)]
    df = spark.createDataFrame([(0, s, v) for s, v in enumerate(norms)], "run_id int, step long, grad_norm double")
    got = {r.step: r for r in W.clip_threshold(df, 1.0, 90).collect()}
    assert got[0].clip_threshold is None
    for s in range(1, 400):
        hist = norms[1:s + 1]
        want = 1.0 if len(hist) < 100 else statistics.quantiles(hist, n=100)[90]
        assert abs(got[s].clip_threshold - want) < 1e-9
        assert got[s].clipped == (norms[s] > want)


def test_w3_rolling_quantile_hand_case(spark):
    vals = [float((i * 7919) % 1000) for i in range(3000)]
    con = duckdb.connect()
    duck = con.execute(
        "SELECT quantile_cont(x, 0.95) OVER (ORDER BY i ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) "
        "FROM (SELECT unnest(range(3000)) AS i, unnest(?) AS x) QUALIFY i = 1500", [vals]).fetchall()[0][0]
    assert abs(duck - 949.05) < 1e-9
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vals)], "run_id int, step long, loss double")
    band = W.rolling_band(df, 1000, 1, qs=(0.95,), chunk_rows=700)
    got = band.where(F.col("step") == 1500).collect()[0].band_q95
    assert abs(got - 949.05) < 1e-9


def test_position_within_skewed(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randint(1, 50), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = position_within(df, ["g"], ["x"], out="p", rows_per_slice=64).collect()
    by_g = {}
    for r in got:
        by_g.setdefault(r.g, []).append((r.x, r.p))
    for g, lst in by_g.items():
        lst.sort()
        assert [p for _, p in lst] == list(range(len(lst)))


def test_position_within_fixed_width(spark):
    df = spark.range(0, 5000, 3).withColumn("g", F.col("id") % 2)
    got = position_within(df, ["g"], ["id"], out="p", slice_width=97).collect()
    for g in (0, 1):
        ids = sorted(r.id for r in got if r.g == g)
        pos = {r.id: r.p for r in got if r.g == g}
        assert [pos[i] for i in ids] == list(range(len(ids)))


def test_w7_chunked_against_model(spark):
    rng = random.Random(4)
    norms = [round(rng.random() * 3, 3) for _ in range(700)]  # rounding makes ties
    rows = [(r, s, v) for r in (0, 1) for s, v in enumerate(norms if r == 0 else norms[::-1])]
    df = spark.createDataFrame(rows, "run_id int, step long, grad_norm double")
    for chunk in (64, 150):
        got = {(r.run_id, r.step): r.clip_threshold for r in W.clip_threshold(df, 1.0, 90, chunk_rows=chunk).collect()}
        for run in (0, 1):
            xs = norms if run == 0 else norms[::-1]
            assert got[(run, 0)] is None
            for s in range(1, 700):
                hist = xs[1:s + 1]
                want = 1.0 if len(hist) < 100 else statistics.quantiles(hist, n=100)[90]
                assert abs(got[(run, s)] - want) < 1e-9, (chunk, run, s)


def test_position_within_two_level_prefix(spark, monkeypatch):
    import runforge.functions.indexing as I
    monkeypatch.setattr(I, "SUPER", 3)
    df = spark.range(0, 3000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    got = I.position_within(df, ["g"], ["id"], out="p", slice_width=7).collect()
    for g in (0, 1):
        ids = sorted(r.id for r in got if r.g == g)
        pos = {r.id: r.p for r in got if r.g == g}
        assert [pos[i] for i in ids] == list(range(len(ids)))
    got0 = I.position_within(df, [], ["id"], out="p", slice_width=5).collect()
    assert sorted((r.id, r.p) for r in got0) == [(i, i) for i in range(3000)]


def test_prefix_order_statistics():
    import numpy as np

    from runforge.operators.windows import prefix_kth
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 300):
        ranks = rng.permutation(n)
        upto = rng.integers(1, n + 1, size=200)
        k = (rng.random(200) * upto).astype(np.int64)
        want = [sorted(ranks[:u].tolist())[i] for u, i in zip(upto, k)]
        assert prefix_kth(ranks, upto, k).tolist() == want
