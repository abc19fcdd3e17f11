"""Reports from stored partial results equal reports over the whole log, and only new files are read."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from runforge.operators import partials as P
from runforge.operators import runlog as R
from runforge.sources import logs as L


def lines(rng, steps, odd=True):
    for s in steps:
        loss = rng.choice([rng.gauss(1e6, 1), s / 7, None, float("nan") if odd and s % 97 == 5 else 3.0])
        yield json.dumps({"step": s, "loss": loss, "num_tokens": s % 40, "sample_time": rng.random(), "step_time": rng.choice([None, 0.5])}) + "\n"


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    return a == b


def test_three_appends(spark, tmp_path):
    rng = random.Random(9)
    root, store = tmp_path / "logs", str(tmp_path / "store")
    parts = {"p 0.json": range(0, 300), "p1.json": range(300, 340), "p2.json": range(250, 420)}  # a resume rewrites steps
    for k, (name, steps) in enumerate(parts.items()):
        for run in ("a", "b", "calm"):
            if (run, k) != ("b", 1):
                (root / f"run_id={run}").mkdir(parents=True, exist_ok=True)
                own = [s for s in steps if k != 2 or s >= 340] if run != "a" else steps
                (root / f"run_id={run}" / name).write_text("".join(lines(rng, own, run != "calm")))
        new = P.update(spark, str(root), store)
        assert len(new) == (2 if k == 1 else 3) and all(name.replace(" ", "%20") in p for p in new)
        log = L.read_step_log(spark, str(root))
        want = {str(r.run_id): r for r in R.log_statistics(log.where("run_id <> 'a'")).collect()}
        got = {r.run_id: r for r in P.statistics(P.read(spark, store)).where("run_id <> 'a'").collect()}
        assert set(got) == set(want)
        for run, r in want.items():
            for c in r.asDict():
                if c != "run_id":
                    assert c not in got[run] or same(got[run][c], r[c]), (run, c, got[run][c], r[c])
        counts = log.where("loss is not null").groupBy("run_id", F.when(~F.isnan("loss"), F.floor(F.col("loss") / P.BIN_WIDTH)).alias("bin")).count()
        assert {(str(r.run_id), r.bin, r["count"]) for r in counts.collect()} == {tuple(r) for r in P.loss_bins(P.read(spark, store)).collect()}
    assert P.update(spark, str(root), store) == []


def test_variance_keeps_its_digits(spark, tmp_path):
    """Losses around 1e9 with a spread of 1: sums of squares would lose it."""
    rng = random.Random(1)
    values = [1e9 + rng.gauss(0, 1) for _ in range(900)]
    (tmp_path / "l" / "run_id=1").mkdir(parents=True)
    for k in range(3):
        text = "".join(json.dumps({"step": 300 * k + i, "loss": x}) + "\n" for i, x in enumerate(values[300 * k:300 * k + 300]))
        (tmp_path / "l" / "run_id=1" / f"p{k}.json").write_text(text)
    P.update(spark, str(tmp_path / "l"), str(tmp_path / "s"))
    got = P.statistics(P.read(spark, str(tmp_path / "s"))).first()
    mean = sum(x - 1e9 for x in values) / 900
    assert got.std_loss == pytest.approx(math.sqrt(sum((x - 1e9 - mean) ** 2 for x in values) / 899), rel=1e-6)


def test_changed_and_empty_files(spark, tmp_path):
    folder = tmp_path / "l" / "run_id=x"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"step": 1, "loss": 2.0}\n')
    (folder / "b.json").write_text('{"step": 3, "lo')
    root, store = str(tmp_path / "l"), str(tmp_path / "s")
    assert len(P.update(spark, root, store)) == 2 and P.update(spark, root, store) == []
    (folder / "a.json").write_text('{"step": 1, "loss": 2.0}\n{"step": 2, "loss": 4.0}\n')
    assert len(P.update(spark, root, store)) == 1
    got = P.statistics(P.read(spark, store)).collect()
    assert [(r.run_id, r.total_steps, r.mean_loss, r.std_loss) for r in got] == [("x", 2, 3.0, pytest.approx(math.sqrt(2)))]
