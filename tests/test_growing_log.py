"""The source of growing logs: byte ranges, torn lines, restarts."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from runforge.sources import growing as G
from runforge.sources import logs as L
from runforge.streaming import steplog as T


def line(i, text="x"):
    return json.dumps({"step": i, "loss": i / 7, "num_tokens": i, "task": text, "tokens_by_dataset": {"a": i}}) + "\n"


def read_all(spark, root, work, **options):
    T.run_available(G.stream_growing_log(spark, str(root), **options), f"{work}/out", f"{work}/ckpt")
    return spark.read.parquet(f"{work}/out")


def test_ranges_give_every_line_once(monkeypatch):
    rng = random.Random(2)
    for block in (3, 16, 1 << 20):
        monkeypatch.setattr(G, "BLOCK", block)
        for _ in range(40):
            data = b"".join(b"x" * rng.choice([0, 1, 5, 40]) + b"\n" for _ in range(rng.randrange(1, 30)))
            torn = data + b"torn" * rng.randrange(3)
            last = G.whole_bytes(io.BytesIO(torn), len(torn), 0)
            assert last == len(data)
            first = rng.choice([0, data.index(b"\n") + 1])
            step = rng.randrange(1, 50)
            got = []
            for at in range(first, last, step):
                got += list(G.lines_of(io.BytesIO(torn), G.Range("f", first, at, min(at + step, last), last)))
            want, at = [], first
            for x in data[first:].split(b"\n")[:-1]:
                want.append((at, x))
                at += len(x) + 1
            assert got == want


@pytest.mark.parametrize("partition_bytes", [64 << 20, 100])
def test_appended_twice_and_torn(spark, tmp_path, partition_bytes):
    """Appended to once in mid-line, with a restart between; equal to reading the finished file."""
    runs = {"alpha": [line(i) for i in range(120)], "beta": [line(i, "é🙂") for i in range(40)]}
    root = tmp_path / "runs"
    for run, rows in runs.items():
        (root / run).mkdir(parents=True)
        text = "".join(rows[:30]).encode() + rows[30].encode()[:17]
        (root / run / "log.jsonl").write_bytes(text)
    (root / "alpha" / "_notes.jsonl").write_text(line(9))
    options = {"partition_bytes": partition_bytes}
    assert read_all(spark, root, tmp_path, **options).groupBy("run_id").count().collect()[0]["count"] == 30
    for run, rows in runs.items():
        with open(root / run / "log.jsonl", "ab") as f:
            f.write(rows[30].encode()[17:] + "".join(rows[31:]).encode())
    (root / "gamma").mkdir()
    (root / "gamma" / "log.jsonl").write_text('{"step": 1, "loss": NaN}\n\n{"step": 2, "lo{"step": 3}\n{"loss": 1}\n{"step": 4}')
    got = read_all(spark, root, tmp_path, **options)
    paths = [str(root / r / "log.jsonl") for r in ("alpha", "beta", "gamma")]
    want = L.read_run_logs(spark, paths).where("run_id <> 'gamma' or step = 1")
    columns = ["run_id", "step", "task", "num_tokens", F.col("loss").cast("string").alias("loss"), F.col("tokens_by_dataset").cast("string").alias("m")]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() == 161
    assert read_all(spark, root, tmp_path, **options).count() == 161  # nothing new
    (root / "gamma" / "log.jsonl").write_text("{}\n")  # shorter than what was read
    with open(root / "alpha" / "log.jsonl", "a") as f:
        f.write(line(500))
    with pytest.raises(Exception, match="gamma/log.jsonl.*appended"):
        read_all(spark, root, tmp_path, **options)


def test_live_totals_and_a_lost_file(spark, tmp_path):
    """Feeds the live operators; a finished log may be removed, a folder may not be there yet."""
    root = tmp_path / "runs"
    live = lambda: T.stream_totals(G.stream_growing_log(spark, str(root)))
    work = str(tmp_path)
    for run in ("a", "b"):
        (root / run).mkdir(parents=True)
        (root / run / "log.jsonl").write_text("".join(line(i) for i in range(10)))
    T.run_available(live(), f"{work}/t", f"{work}/c", "update")
    (root / "a" / "log.jsonl").unlink()
    with open(root / "b" / "log.jsonl", "a") as f:
        f.write(line(10))
    T.run_available(live(), f"{work}/t", f"{work}/c", "update")
    got = {(r.run_id, r.steps, r.total_tokens) for r in T.latest(spark, f"{work}/t", ["run_id", "task"]).collect()}
    assert got == {("a", 10, 45), ("b", 11, 55)}


def test_no_folder_yet(spark, tmp_path):
    q = G.stream_growing_log(spark, str(tmp_path / "none")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_evals(spark, tmp_path):
    (tmp_path / "r" / "x").mkdir(parents=True)
    (tmp_path / "r" / "x" / "eval.jsonl").write_text('{"step": 5, "mean": 2.5}\n{"step": 6, "mea')
    T.run_available(G.stream_growing_evals(spark, str(tmp_path / "r")), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [(r.run_id, r.step, r["mean"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("x", 5, 2.5)]


def test_a_range_reads_little_more_than_itself():
    """Every line once from ranges of any size, and of the bytes behind a range only the end of its last line."""

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            self.taken += len(got)
            return got

    rng = random.Random(3)
    text = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 5, 200, 9000]))) + b"\n" for _ in range(700))
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    for size in (700, 100_000, len(text)):
        got, taken = [], 0
        for start in range(0, len(text), size):
            file = Counted(text)
            got += G.lines_of(file, G.Range("f", 0, start, min(start + size, len(text)), len(text)))
            taken = max(taken, file.taken)
        assert got == want
        assert taken <= size + 2 * (9001 + 3 * G.TAIL) + 2
