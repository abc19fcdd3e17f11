"""P1 packing: hand cases from FIXTURES.md and a step-by-step model of the rule."""

import random

from pyspark.sql import functions as F

from runforge.functions.text import CLS_ID, EOS_ID, SEP_ID
from runforge.operators import packing as P


def model_pack(docs, record_size):
    """Records of one batch from where ids are placed.

    Documents lie one after the other on a line of record bodies. One id of space
    after each holds the end mark, unless the document stops where a body does. A body
    is a record when a document stops exactly at its end, or when an id of a document
    lies beyond it (it is then closed with a separator).
    """
    body = record_size - 2
    line, exact, at, reach = {}, set(), 0, -1
    for doc in filter(None, docs):
        line.update(zip(range(at, at + len(doc)), doc))
        at += len(doc)
        reach = at - 1
        if at % body == 0:
            exact.add(at // body - 1)
        else:
            line[at] = EOS_ID
            at += 1
    records = []
    for k in range(at // body + 1):
        ids = [line[p] for p in range(k * body, (k + 1) * body) if p in line]
        if k in exact:
            records.append([CLS_ID, *ids])
        elif reach >= (k + 1) * body:
            records.append([CLS_ID, *ids, SEP_ID])
    return records


def run_pack(spark, docs, record_size, batch_rows=1000):
    rows = [(i, [100 + 10 * i + k for k in range(n)] if isinstance(n, int) else n) for i, n in enumerate(docs)]
    df = spark.createDataFrame(rows, "position long, tokens array<int>")
    recs = P.pack_records(df, record_size, order="position", batch_rows=batch_rows)
    return [list(r.input_ids) for r in recs.orderBy("batch", "record_idx").collect()]


def test_offsets_example(spark):
    lens = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 3, 2, 6, 4])], "batch long, pos long, len long")
    row = P.pack_offsets(lens, 10).collect()[0]
    assert list(row.offs) == [0, 6, 10, 13, 20]
    assert row.tmax == 20 + 4 - 1


def test_exact_fill(spark):
    recs = run_pack(spark, [8], 10)
    assert len(recs) == 1 and len(recs[0]) == 9 and SEP_ID not in recs[0][1:] and EOS_ID not in recs[0]


def test_tail_dropped(spark):
    assert run_pack(spark, [3], 10) == []


def test_spill(spark):
    recs = run_pack(spark, [9], 10)
    assert len(recs) == 1 and len(recs[0]) == 10 and recs[0][-1] == SEP_ID


def test_random_against_model(spark):
    rng = random.Random(7)
    for _ in range(6):
        R = rng.choice([6, 10, 17])
        docs = [[rng.randint(10, 99) for _ in range(rng.choice([0, 1, 2, 5, 8, 9, 16, 30]))] for _ in range(25)]
        got = run_pack(spark, docs, R, batch_rows=1000)
        want = model_pack(docs, R)
        assert got == want


def test_batches_do_not_share_state(spark):
    docs = [[11, 12, 13, 14, 15, 16, 17]] * 6
    got = run_pack(spark, docs, 6, batch_rows=3)
    want = model_pack(docs[:3], 6) + model_pack(docs[3:], 6)
    assert got == want
    assert all(len(r) in (5, 6) for r in got)


def test_interleave_all_exhausted(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "dataset string, row_idx long")
    out = P.interleave(df).orderBy("position").collect()
    assert [(r.dataset, r.row_idx) for r in out] == [("a", 0), ("b", 0), ("a", 1), ("b", 0), ("a", 2), ("b", 0)]
    assert [r.position for r in out] == list(range(6))


def test_shuffle_is_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    out = P.shuffle(df, 3, "k")
    assert sorted(r.shuffle_pos for r in out.collect()) == list(range(500))
    assert out.agg(F.countDistinct("k")).collect()[0][0] == 500


def test_interleave_block_split_equals_plain(spark):
    rows = [("big", i) for i in range(40)] + [("small", 0), ("small", 1), ("tiny", 0)]
    df = spark.createDataFrame(rows, "dataset string, row_idx long")
    plain = sorted((r.dataset, r.row_idx, r.position) for r in P.interleave(df).collect())
    split = sorted((r.dataset, r.row_idx, r.position) for r in P.interleave(df, round_block=3).collect())
    assert plain == split
    assert [p for _, _, p in sorted(plain, key=lambda t: t[2])] == list(range(40 * 3))


def test_documents_are_dealt_once(spark):
    """Random documents with duplicates and unkept ones against the model, however few rows come at a time; one exchange."""
    rng = random.Random(11)
    docs = [[rng.randint(10, 99) for _ in range(rng.choice([0, 1, 3, 8, 9, 40, 200]))] for _ in range(90)]
    rows = [(i if i != 5 else None, d if i != 9 else None, i % 7 != 3) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "position long, tokens array<int>, keep boolean").repartition(5)
    recs = P.pack_records(df, 10, batch_rows=30, keep="keep")
    used = [d if i not in (5, 9) and i % 7 != 3 else [] for i, d in enumerate(docs)]
    want = [(b, k, ids) for b in range(3) for k, ids in enumerate(model_pack(used[30 * b:30 * b + 30], 10))]
    for at_once in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
        try:
            assert [(r.batch, r.record_idx, list(r.input_ids)) for r in recs.orderBy("batch", "record_idx").collect()] == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = P.pack_records(spark.createDataFrame(rows, "position long, tokens array<int>, keep boolean"), 10, keep="keep")
    assert plan._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_eval_set_moves_keys(spark):
    """The same rows in the same order as a shuffle of whole records; ids are not in what is ranked."""
    from runforge.plans import training_set as TS
    recs = spark.createDataFrame([(b, k, [b, k, 7], 3) for b in range(6) for k in range(9)], "batch long, record_idx long, input_ids array<int>, n_ids int")
    got = TS.build_eval_set(recs, 10, seed=3)
    want = P.sample_k(P.shuffle(recs, 3, ["batch", "record_idx"]), 10, 3, ["batch", "record_idx"])
    rows = [(r.batch, r.record_idx, list(r.input_ids), r.shuffle_pos) for r in got.collect()]
    assert rows == [(r.batch, r.record_idx, list(r.input_ids), r.shuffle_pos) for r in want.collect()] and len(rows) == 10
    ranked = got._jdf.queryExecution().optimizedPlan().toString().split("GlobalLimit")[1]
    assert not [x for x in ranked.splitlines() if "input_ids" in x and "LogicalRDD" not in x]


def test_summary_needs_no_ids(spark):
    from runforge.plans import training_set as TS
    recs = spark.createDataFrame([(0, 0, [1, 2], 128), (0, 1, [1], 127)], "batch long, record_idx long, input_ids array<int>, n_ids int")
    assert [tuple(r) for r in TS.summarize(recs, 128).collect()] == [(0, 2, 1, 1, 255)]
