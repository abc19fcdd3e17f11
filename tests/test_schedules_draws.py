"""Schedules (W11), draws, cosine, epochs and the readable size format."""

import random

import duckdb
from pyspark.sql import functions as F

from runforge.functions import schedules as S
from runforge.functions.draws import draw_int
from runforge.functions.text import human_size
from runforge.operators import vectors as V
from runforge.operators import windows as W
from runforge.sources.fixtures import TRAINING_CONFIG


def test_linear_logged_lr_hand_case(spark):
    o = TRAINING_CONFIG["optimizer"]
    params = dict(peak_lr=o["peak_lr"], warmup_steps=o["warmup_steps"], peak_steps=o["peak_steps"],
                  total_steps=o["total_steps"], start_lr=o["start_lr"], end_lr=o["end_lr"])
    df = spark.createDataFrame([(426,)], "step long")
    got = df.select(W.expected_lr(F.col("step"), "linear", params, lag=1).alias("lr")).collect()[0].lr
    assert abs(got - 9.075e-05) < 1e-15


def change_points(K, M, C, Kc, last):
    """The steps at which the exponential schedule doubles, and those at which it halves.

    The first K*M + 1 calls (one before any step) count periods of K + 1 calls, each
    ending in a doubling. What is left of the last period is carried through C calls
    of constant rate, where a period is C + 1 calls, or nothing if more than C was
    left; and what is left then shortens the first cooling period of Kc + 1 calls.
    """
    doublings = [j * (K + 1) - 1 for j in range(1, last) if j * (K + 1) <= K * M + 1]
    left = (K * M + 1) % (K + 1)
    left = (C - 1) % (C + 1) if left > C else (left + C) % (C + 1)
    first = K * M + C + (1 if left > Kc else Kc + 1 - left)
    return doublings, list(range(first, last, Kc + 1))


def test_exponential_closed_form_matches_change_points(spark):
    rng = random.Random(5)
    steps = spark.range(0, 160).withColumnRenamed("id", "n")
    for _ in range(12):
        K, M, C, Kc = rng.randint(1, 5), rng.randint(1, 4), rng.randint(1, 6), rng.randint(1, 5)
        params = dict(start_lr=1.0, end_lr=0.1, warmup_factor=2.0, warmup_steps_per_period=K, warmup_periods=M,
                      constant_steps=C, cooldown_factor=2.0, cooldown_steps_per_period=Kc)
        got = {r.n: r.lr for r in steps.select("n", S.exponential_warmup_cooldown(F.col("n"), **params)
                                               .alias("lr")).collect()}
        up, down = change_points(K, M, C, Kc, 160)
        for n in range(160):
            want = 2.0 ** sum(x <= n for x in up)
            if halved := sum(x <= n for x in down):
                want = max(want / 2.0 ** halved, 0.1)
            assert abs(got[n] - want) < 1e-12, (K, M, C, Kc, n)


def test_exponential_hand_case():
    # K=4, M=3, constant 6, Kc=4: doubles at steps 4 and 9, halves at 21, 26, ...
    assert change_points(4, 3, 6, 4, 50) == ([4, 9], [21, 26, 31, 36, 41, 46])


def test_md5_draw_matches_duckdb(spark):
    got = spark.range(1).select(draw_int("a", F.lit(1)).alias("d")).collect()[0].d
    duck = duckdb.connect().execute("SELECT ('0x' || substr(md5('a|1'), 1, 8))::BIGINT").fetchall()[0][0]
    assert got == duck == 225584429


def test_cosine_hand_case(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 3.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()[0].c
    assert abs(got - 0.9922778767) < 1e-10


def test_epoch_rule(spark):
    E = 1000
    df = spark.createDataFrame([(s,) for s in (0, 1, E, E + 1)], "step long")
    got = [r.epoch for r in W.derive_epoch(df, E).orderBy("step").collect()]
    assert got == [0, 1, 1, 2]


def test_eval_step_flag(spark):
    from runforge.operators.runlog import flag_eval_steps
    df = spark.createDataFrame([(s,) for s in (0, 999, 1000, 2000)], "step long")
    got = [r.is_eval_step for r in flag_eval_steps(df, 1000).orderBy("step").collect()]
    assert got == [False, False, True, True]


def test_human_size(spark):
    df = spark.createDataFrame([(1000,), (1001,), (1_000_001,), (1_000_000_001,)], "n long")
    got = [r.s for r in df.orderBy("n").select(human_size(F.col("n")).alias("s")).collect()]
    assert got == ["1000B", "1.0K", "1.0M", "1.00B"]


def test_truncate_idempotent(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0, 0.0, 3.0])], "vec_id int, vec array<float>")
    once = V.truncate_dims(df, 2, binarize=True)
    twice = V.truncate_dims(once, 2, binarize=True)
    assert once.collect() == twice.collect()
    assert list(once.collect()[0].vec) == [1.0, -1.0, 0.0, 0.0]
