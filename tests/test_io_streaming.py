"""Source edge cases (IO1, IO3, IO6) and streaming restarts."""

import gzip
import json
import os
import tempfile

from pyspark.sql import functions as F

from runforge.sources import corpus_io as CIO
from runforge.sources import logs as L
from runforge.streaming import steplog as T


def test_step_log_nan_unknown_torn(spark):
    d = tempfile.mkdtemp(prefix="rf-io1-")
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        f.write('{"step": 1, "task": "mlm", "loss": NaN, "tokens_by_dataset": {"a": 5, "b": 7}}\n')
        f.write('{"step": 2, "loss": 2.5}\n')
        f.write('{"step": 3, "task": "ml')
    log = L.read_step_log(spark, d).orderBy("step").collect()
    assert len(log) == 2
    assert log[0].loss != log[0].loss  # NaN kept
    assert dict(log[0].tokens_by_dataset) == {"a": 5, "b": 7}
    assert log[1].task == "unknown"
    assert L.bad_line_counts(spark, d).collect()[0].bad_lines == 1


def test_gzip_two_members(spark):
    d = tempfile.mkdtemp(prefix="rf-io3-")
    p = os.path.join(d, "objects.jsonl.gz")
    with gzip.open(p, "at") as f:
        f.write(json.dumps({"step": 1, "objects": ["x", "y"]}) + "\n")
    with gzip.open(p, "at") as f:
        f.write(json.dumps({"step": 2, "objects": ["z"]}) + "\n")
    got = sorted((r.step, r.identifier) for r in L.read_objects(spark, d).collect())
    assert got == [(1, "x"), (1, "y"), (2, "z")]


def test_decode_bad_payload(spark):
    df = spark.createDataFrame([(1, "not base64 !!"), (2, "aGVsbG8=")], "id int, content string")
    out = {r.id: r for r in CIO.decode_content(df).collect()}
    assert out[1].text is None and out[1].decode_error
    assert out[2].text is None and out[2].decode_error  # valid base64, not zlib


def test_stream_restart_trailing(spark):
    root = tempfile.mkdtemp(prefix="rf-t3-")
    ckpt, sink = tempfile.mkdtemp(prefix="rf-t3c-"), tempfile.mkdtemp(prefix="rf-t3s-")
    os.makedirs(os.path.join(root, "run_id=r1"))

    def part(name, steps):
        with open(os.path.join(root, "run_id=r1", name), "w") as f:
            for s in steps:
                f.write(json.dumps({"step": s, "loss": float(s), "num_tokens": 1}) + "\n")

    part("p0.json", range(0, 150))
    T.run_available(T.stream_trailing(T.stream_step_log(spark, root)), sink + "/out", ckpt, "update")
    first = T.latest(spark, sink + "/out", ["run_id"]).collect()[0]
    assert first.loss_100 == 99.5
    part("p1.json", range(150, 200))
    T.run_available(T.stream_trailing(T.stream_step_log(spark, root)), sink + "/out", ckpt, "update")
    second = T.latest(spark, sink + "/out", ["run_id"]).collect()[0]
    assert second.loss_100 == 149.5 and second.total_tokens == 200


def test_stream_ingested_file_not_reread(spark):
    root = tempfile.mkdtemp(prefix="rf-t1-")
    ckpt, sink = tempfile.mkdtemp(prefix="rf-t1c-"), tempfile.mkdtemp(prefix="rf-t1s-")
    os.makedirs(os.path.join(root, "run_id=r1"))
    p = os.path.join(root, "run_id=r1", "p0.json")
    with open(p, "w") as f:
        f.write(json.dumps({"step": 0, "loss": 1.0}) + "\n")
    T.run_available(T.stream_step_log(spark, root), sink + "/out", ckpt)
    with open(p, "a") as f:
        f.write(json.dumps({"step": 1, "loss": 1.0}) + "\n")
    T.run_available(T.stream_step_log(spark, root), sink + "/out", ckpt)
    assert spark.read.parquet(sink + "/out").where(F.col("step") == 1).count() == 0


def test_describe_run_writes_reports(spark):
    from runforge.plans import describe as D
    from runforge.plans.suite_io import _write_step_log
    from runforge.operators import runlog as R

    from conftest import SF01
    log_dir = _write_step_log(spark, SF01)
    out = tempfile.mkdtemp(prefix="rf-describe-")
    paths = D.describe_run(spark, log_dir, None, out)
    assert len(paths) >= 12 and all(os.path.isdir(p) for p in paths)
    stats = spark.read.json(os.path.join(out, "log_statistics"))
    want = R.log_statistics(L.read_step_log(spark, log_dir))
    assert stats.count() == want.count() == 4


def test_stream_dedup_within_watermark(spark):
    root = tempfile.mkdtemp(prefix="rf-t4w-")
    ckpt, sink = tempfile.mkdtemp(prefix="rf-t4wc-"), tempfile.mkdtemp(prefix="rf-t4ws-")
    os.makedirs(os.path.join(root, "run_id=r1"))
    lines = [json.dumps({"step": s, "loss": 1.0, "time": f"2024-01-01T00:00:{s:02d}"}) + "\n" for s in range(10)]
    for name in ("p0.json", "p1.json"):  # a resumed run rewrites the same steps
        with open(os.path.join(root, "run_id=r1", name), "w") as f:
            f.writelines(lines)
    T.run_available(T.stream_dedup(T.stream_step_log(spark, root), watermark="1 hour"), sink + "/out", ckpt)
    assert spark.read.parquet(sink + "/out").count() == 10


def test_run_id_from_parent_folder(spark):
    root = tempfile.mkdtemp(prefix="rf-runs-")
    for run, n in (("alpha", 3), ("beta", 2)):
        os.makedirs(os.path.join(root, run))
        with open(os.path.join(root, run, "log.jsonl"), "w") as f:
            for s in range(n):
                f.write(json.dumps({"step": s, "loss": 1.0}) + "\n")
    log = L.read_run_logs(spark, [os.path.join(root, "alpha"), os.path.join(root, "beta")])
    got = {r.run_id: r["count"] for r in log.groupBy("run_id").count().collect()}
    assert got == {"alpha": 3, "beta": 2}


def test_stream_trailing_puts_late_lines_in_place(spark, tmp_path):
    """A part file of older steps arrives last: totals grow, the newest step and its losses stay."""
    import json
    root, sink = str(tmp_path / "in"), str(tmp_path / "out")
    part = tmp_path / "in" / "run_id=1"
    part.mkdir(parents=True)
    lines = [json.dumps({"step": i, "loss": float(i), "num_tokens": 10, "total_time": float(i % 200 + 1)}) for i in range(400)]
    (part / "part-1.json").write_text("\n".join(lines[150:]))
    T.run_available(T.stream_trailing(T.stream_step_log(spark, root)), sink, str(tmp_path / "ckpt"), "update")
    (part / "part-0.json").write_text("\n".join(lines[:150]))
    T.run_available(T.stream_trailing(T.stream_step_log(spark, root)), sink, str(tmp_path / "ckpt"), "update")
    row = T.latest(spark, sink, ["run_id"]).first()
    assert (row.step, row.total_tokens, row.steps_seen) == (399, 4000, 400)
    assert row.loss_100 == sum(range(300, 400)) / 100 and row.loss_1000 == sum(range(400)) / 400
    assert row.token_rate == 2000 / 200 and row.last_eval == 0.0
