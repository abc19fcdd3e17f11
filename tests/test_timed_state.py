"""T3 on timed state: the same rows as the array state, state that ends, restarts."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from runforge.streaming import steplog as T
from runforge.streaming import timed as TS


def part(root, run, name, rows):
    folder = root / f"run_id={run}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def state_rows(spark, sdf, checkpoint):
    """Rows in the state store after one more batch of ``sdf``."""
    spark.conf.set(TS.STORE, TS.ROCKSDB)
    try:
        q = sdf.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(once=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(TS.STORE)
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]


def test_same_rows_as_the_array_state(spark, tmp_path):
    """Gapped steps, late and rewritten part files, missing and infinite losses, over four restarts."""
    rng = random.Random(4)
    root = tmp_path / "in"
    steps = sorted(rng.sample(range(6000), 2600))
    lines = [{"step": s, "loss": rng.choice([None, float("nan"), s / 3, 1.5]) if s != 700 else float("inf"), "num_tokens": s % 50, "total_time": float(s % 900 + 1)}
             for s in steps]
    cuts = [lines[:150], lines[1500:2300], lines[150:1500], lines[2300:] + lines[2200:2230]]
    for k, rows in enumerate(cuts):
        part(root, "a", f"p{k}.json", rows)
        if k != 1:
            part(root, "b", f"p{k}.json", rows[::7])
        for name, run, live in (("old", T.run_available, T.stream_trailing), ("new", TS.run_timed, TS.stream_trailing_timed)):
            run(live(T.stream_step_log(spark, str(root))), str(tmp_path / name), str(tmp_path / f"{name}-c"), "update")
        old, new = ({r.run_id: r for r in T.latest(spark, str(tmp_path / n), ["run_id"]).collect()} for n in ("old", "new"))
        assert set(old) == set(new)
        for run, r in old.items():
            for c in T.TRAILING_OUT.names:
                assert new[run][c] == (pytest.approx(r[c], rel=1e-12) if isinstance(r[c], float) else r[c]), (k, run, c)


def test_idle_runs_leave_by_the_clock(spark, tmp_path):
    root, ckpt = tmp_path / "in", str(tmp_path / "c")
    live = lambda: TS.stream_trailing_timed(T.stream_step_log(spark, str(root)), idle_seconds=3)
    for run in "abc":
        part(root, run, "p0.json", [{"step": s, "loss": 1.0, "num_tokens": 1} for s in range(300)])
    first = state_rows(spark, live(), ckpt)
    assert first >= 3 * 4  # totals and blocks of each run
    time.sleep(3.5)
    part(root, "d", "p1.json", [{"step": 1, "loss": 2.0, "num_tokens": 1}])
    later = state_rows(spark, live(), ckpt)
    assert 0 < later <= first / 3
    time.sleep(3.5)
    part(root, "e", "p2.json", [{"step": "no step"}])  # a batch without a line: the timer of the last run ends too
    assert state_rows(spark, live(), ckpt) == 0


def test_idle_runs_leave_by_event_time(spark, tmp_path):
    root, sink, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    live = lambda: TS.stream_trailing_timed(T.stream_step_log(spark, str(root)), idle_seconds=600, watermark="1 minute")
    at = lambda minute: f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00"
    part(root, "a", "p0.json", [{"step": s, "loss": 1.0, "num_tokens": 1, "time": at(0)} for s in range(200)])
    TS.run_timed(live(), sink, ckpt, by_clock=False)
    part(root, "a", "p1.json", [{"step": s, "loss": 3.0, "num_tokens": 1, "time": at(5)} for s in range(200, 300)])
    TS.run_timed(live(), sink, ckpt, by_clock=False)
    row = T.latest(spark, sink, ["run_id"]).first()
    assert (row.loss_100, row.steps_seen) == (3.0, 300)  # five minutes are not idle
    part(root, "b", "p2.json", [{"step": 1, "loss": 2.0, "num_tokens": 1, "time": at(90)}])
    TS.run_timed(live(), sink, ckpt, by_clock=False)
    part(root, "a", "p3.json", [{"step": 300, "loss": 5.0, "num_tokens": 1, "time": at(95)}])
    TS.run_timed(live(), sink, ckpt, by_clock=False)
    row = T.latest(spark, sink, ["run_id"]).where("run_id = 'a'").first()
    assert (row.loss_100, row.steps_seen) == (5.0, 1)  # it had left and starts anew
    with pytest.raises(ValueError):
        TS.stream_trailing_timed(T.stream_step_log(spark, str(root)), evals=T.stream_eval_log(spark, str(root)), watermark="1 minute")


def test_the_setting_stays(spark):
    before = spark.conf.get(TS.STORE)
    q = spark.readStream.format("rate").load().select(F.lit("a").alias("run_id"), F.col("value").alias("step"), F.lit(1.0).alias("loss"),
                                                      F.lit(1).alias("num_tokens"))
    with pytest.raises(Exception):
        TS.run_timed(q.select("run_id"), "/dev/null/x", "/dev/null/y")
    assert spark.conf.get(TS.STORE) == before
