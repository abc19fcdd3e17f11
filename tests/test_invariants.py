"""Invariants and edge cases from the test strategy."""

import math

from pyspark.sql import functions as F

from runforge.operators import corpus as C
from runforge.operators import runlog as R
from runforge.operators import windows as W
from runforge.sources import fixtures as X

from conftest import SF01


def test_proportions_sum_to_one(spark):
    p = R.task_proportions(X.steps(spark, SF01), by="run_id")
    sums = p.groupBy("run_id").agg(F.sum("proportion").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in sums)


def test_chunks_concatenate_to_input(spark):
    df = spark.createDataFrame([(1, list(range(10, 23))), (2, []), (3, [7])], "doc_id int, tokens array<int>")
    ch = C.chunk_tokens(df, 5).groupBy("doc_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk"))), lambda s: s["chunk"]))
        .alias("joined"), F.count(F.lit(1)).alias("n"))
    got = {r.doc_id: (list(r.joined), r.n) for r in ch.collect()}
    assert got[1] == (list(range(10, 23)), 3)
    assert got[3] == ([7], 1)
    assert 2 not in got  # empty document: no chunk


def test_all_nan_losses_and_one_row_run(spark):
    rows = [(0, s, float("nan"), 1) for s in range(5)] + [(1, 0, 2.5, 3)]
    log = spark.createDataFrame(rows, "run_id int, step long, loss double, num_tokens long")
    tr = {(r.run_id, r.step): r for r in W.trailing_loss(log, (2, 3)).collect()}
    assert tr[(0, 4)].loss_2 is None and tr[(1, 0)].loss_3 == 2.5
    st = {r.run_id: r for r in R.log_statistics(log).collect()}
    assert math.isnan(st[0].mean_loss) and st[0].min_loss is None and st[0].max_loss is None
    assert st[1].total_steps == 0 and st[1].final_loss == 2.5 and st[1].std_loss is None


def test_single_sample_eval_has_zero_std(spark):
    df = spark.createDataFrame([(0, 4.0), (0, 5.0), (1, 3.0)], "g int, x double")
    got = {r.g: r for r in R.eval_summary(df, "g", "x").collect()}
    assert got[1].std == 0.0 and got[1].num_samples == 1
    assert got[0].median == 4.5


def test_density_gate_drops_empty(spark):
    df = spark.createDataFrame([("a b", [6, 7]), ("", []), ("abcdefgh", [6])], "text string, tokens array<int>")
    kept = [r.text for r in C.density_gate(df).collect()]
    assert kept == ["abcdefgh"]


def test_record_length_check_fails_on_overflow(spark):
    df = spark.createDataFrame([([1] * 11,)], "input_ids array<int>")
    try:
        C.record_length_hist(df, 10).collect()
        raise AssertionError("expected failure")
    except Exception as e:  # noqa: BLE001
        assert "more ids than fit" in str(e)


def test_balanced_prefix_against_loop(spark):
    """The shortest qualifying prefix equals the reference's stopping loop."""
    import random
    from runforge.operators import sampling as S
    rng = random.Random(8)
    rows = [(f"d{rng.choice('aabbbcde')}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "dataset string, doc_id long")
    got = S.balanced_prefix(df, "dataset", 3, 3, seed=5, key="doc_id").orderBy("sample_pos").collect()
    # replay: walk rows in the seeded order until the stop condition holds
    from runforge.functions.draws import draw_int
    ordered = [(r.dataset, r.doc_id) for r in
               df.withColumn("d", draw_int(5, F.concat_ws(":", F.col("doc_id").cast("string")), "prefix"))
               .orderBy("d", "doc_id").collect()]
    seen = {}
    stop = None
    for t, (ds, _) in enumerate(ordered):
        seen[ds] = seen.get(ds, 0) + 1
        if len(seen) >= 3 and all(v >= 3 for v in seen.values()):
            stop = t
            break
    assert stop is not None and len(got) == stop + 1
    assert [(r.dataset, r.doc_id) for r in got] == ordered[:stop + 1]


def test_last_k_slices(spark):
    import random
    from runforge.operators.runlog import _last_k
    rng = random.Random(11)
    rows = [(g, s) for g in range(3) for s in rng.sample(range(500), 120 + 30 * g)]
    df = spark.createDataFrame(rows, "g int, s long")
    for k, width in ((10, 7), (50, 3), (200, 64)):
        got = sorted((r.g, r.s) for r in _last_k(df, ["g"], "s", k, width=width).collect())
        want = sorted((g, s) for g in range(3) for s in sorted([s for gg, s in rows if gg == g])[-k:])
        assert got == want, (k, width)


def test_histogram_at_infinities(spark):
    """Infinite losses have bins of their own and leave the range alone."""
    from runforge.operators import runlog as R
    inf = float("inf")
    rows = [("a", "t", x) for x in (0.0, 1.0, 2.0, 4.0, inf, inf, -inf, float("nan"), None)] + [("b", "t", inf), ("b", "u", 3.0)]
    df = spark.createDataFrame(rows, "run_id string, task string, loss double")
    got = {tuple(r) for r in R.histogram(df, "loss", 4, by="run_id").collect()}
    assert got == {("a", -1, -inf, 0.0, 1), ("a", 0, 0.0, 1.0, 1), ("a", 1, 1.0, 2.0, 1), ("a", 2, 2.0, 3.0, 1), ("a", 3, 3.0, 4.0, 1),
                   ("a", 4, 4.0, inf, 2), ("b", 0, 3.0, 3.0, 1), ("b", 4, 3.0, inf, 1)}
    by_task = R.loss_hist_by_task(df, 4, by="run_id").where("run_id = 'b'").collect()
    assert {(r.task, r.bin, r.bin_lo, r.axis_min, r.axis_max) for r in by_task} == {("t", 4, None, 3.0, 3.0), ("u", 0, 3.0, 3.0, 3.0)}
