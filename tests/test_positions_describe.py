"""Stored positions on heavy tails, gapped windows by default chunks, describing a run from files, task draws."""

import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from runforge.functions.indexing import sorted_positions
from runforge.operators import runlog as R
from runforge.operators import sampling as S
from runforge.operators import windows as W
from runforge.plans.describe import describe_run
from runforge.sources import fixtures as X
from runforge.sources import logs as L

from conftest import SF01


def test_positions_of_heavy_tailed_values_fill_all_slices(spark):
    rng = np.random.default_rng(3)
    values = [(0, float(x)) for x in rng.lognormal(0, 2, 200_000)]
    df = spark.createDataFrame(values, "g int, v double").repartition(8)
    out = sorted_positions(df, ["g"], ["v"], out="pos")
    rows = out.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(values)))
    assert [r.v for r in rows] == sorted(v for _, v in values)
    # the ranges that the stored rows were cut into
    stored = spark.read.parquet(out.inputFiles()[0].rpartition("/")[0])
    sizes = [r["count"] for r in stored.groupBy("_rf_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * len(values) / 8


def test_positions_of_strings_groups_and_nulls(spark):
    rows = [("b", "x", 1), ("a", None, 2), ("a", "z", 3), ("b", "w", 4), ("a", "y", 5)]
    out = sorted_positions(spark.createDataFrame(rows, "g string, k string, n int"), ["g"], ["k"]).collect()
    assert {r.n: r.pos for r in out} == {2: 0, 5: 1, 3: 2, 4: 0, 1: 1}
    assert sorted_positions(spark.createDataFrame([], "k string"), [], ["k"]).count() == 0


def test_exclusive_quantiles_of_heavy_tails(spark):
    rng = np.random.default_rng(4)
    values = [float(x) for x in rng.lognormal(0, 3, 5000)] + [7.0] * 2000
    df = spark.createDataFrame([(1, v) for v in values], "run_id int, sample_loss double")
    got = R.eval_summary(df, ["run_id"], "sample_loss").first()
    cuts = statistics.quantiles(values, n=100)
    assert got.p5 == pytest.approx(cuts[5]) and got.p95 == pytest.approx(cuts[95])


@pytest.mark.parametrize("chunk", [256, W.CHUNK_ROWS])
def test_gapped_windows_do_not_depend_on_chunks(spark, chunk):
    log = X.gapped(spark, SF01)
    want = {}
    for run in range(4):
        rows = sorted((r.step, r.loss) for r in log.where(F.col("run_id") == run).collect())
        for i, (step, _) in enumerate(rows):
            held = [x for _, x in rows[max(i - 49, 0):i + 1] if x == x]
            want[run, step] = sum(held) / len(held)
    got = W.trailing_loss(log, (50,), chunk_rows=chunk).collect()
    assert len(got) == len(want)
    assert all(r.loss_50 == pytest.approx(want[r.run_id, r.step], rel=1e-12) for r in got)


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def ev(step):
    return {"step": step, **dict.fromkeys(("mean", "median", "std", "min", "p5", "p95", "max"), float(step)), "num_samples": 3,
            "svd_mean_ratio_1": float(step), "svd_median_ratio_1": 1.0}


def test_describe_one_run_by_its_log_file(spark, tmp_path):
    run = tmp_path / "run-7"
    write_lines(run / "log.jsonl", [{"step": i, "loss": 1.0 + i, "num_tokens": 10, "lr": 0.1, "sample_time": 0.1} for i in range(30)])
    write_lines(run / "eval.jsonl", [ev(i) for i in (5, 10, 20)] + [ev(0)])
    written = describe_run(spark, str(run / "log.jsonl"))
    assert all(str(run) in p for p in written) and any(p.endswith("eval_statistics") for p in written)
    stats = spark.read.json(f"{run}/reports/log_statistics").first()
    assert (stats.run_id, stats.total_steps, stats.final_loss) == ("run-7", 29, 30.0)
    evals = spark.read.json(f"{run}/reports/eval_statistics").first()
    assert (evals.run_id, evals.total_steps, evals.last_svd_mean_ratio_1) == ("run-7", 0, 0.0)  # the last line is a restart's


def test_describe_keeps_the_order_of_part_files(spark, tmp_path):
    """Spark reads the largest file first; lines follow the paths all the same."""
    parts = tmp_path / "evals" / "run_id=1"
    write_lines(parts / "part-0.json", [ev(i) for i in range(1, 6)])
    write_lines(parts / "part-1.json", [ev(i) for i in range(6, 26)])
    write_lines(tmp_path / "logs" / "run_id=1" / "part-0.json", [{"step": i, "loss": 1.0, "num_tokens": 1} for i in range(30)])
    describe_run(spark, str(tmp_path / "logs"), str(tmp_path / "evals"), str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out" / "eval_statistics")).first()
    assert (got.total_steps, got.last_svd_mean_ratio_1, got.last_10_mean) == (25, 25.0, 20.5)


def test_missing_eval_log_is_left_out(spark, tmp_path):
    write_lines(tmp_path / "r" / "log.jsonl", [{"step": 0, "loss": 1.0, "num_tokens": 1}])
    assert not L.exists(spark, str(tmp_path / "r" / "eval.jsonl"))
    assert not any("eval" in p.rpartition("/")[2] for p in describe_run(spark, str(tmp_path / "r" / "log.jsonl")))


def test_task_ranges_have_no_holes_and_no_weights_fail(spark):
    w = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.7)], "task string, weight double")
    ranges = sorted((r.lo, r.hi) for r in S.weight_ranges(w).collect())
    assert ranges[0][0] == 0.0 and ranges[-1][1] == 1.0
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    df = spark.range(20)
    assert S.assign_task(df, w, 1, "id").where("task is null").count() == 0
    with pytest.raises(Exception, match="no task has a weight"):
        S.assign_task(df, w.limit(0), 1, "id").collect()


def test_quads_of_string_ids(spark):
    docs = spark.createDataFrame([(f"set-{d}", f"doc-{d}-{i}") for d in "abc" for i in range(4)], "dataset string, doc_id string")
    chunks = docs.select("doc_id").crossJoin(spark.range(2).withColumnRenamed("id", "chunk_idx"))
    got = S.contrastive_quads(docs, chunks, num_per_pair=2).collect()
    assert len(got) == 3 * 2 and all(r.dataset_j < r.dataset_i and r.doc_j.startswith("doc-" + r.dataset_j[-1]) for r in got)


def test_no_checkpoint_folder_on_a_cluster_is_an_error():
    from runforge.session import _scratch_for
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            _scratch_for(master)
    assert _scratch_for("local[4]")


def test_stages_can_be_removed(spark, tmp_path, monkeypatch):
    import os

    from runforge import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(X, "_STORED", {"x": 1})
    assert session.materialize(spark.range(3), "three").count() == 3
    folder = session._stages(spark)
    assert os.listdir(folder)
    session.remove_stages(spark)
    assert not os.path.exists(folder) and not X._STORED
