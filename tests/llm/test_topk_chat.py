"""Top-k search and chat formatting against plain versions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from runforge.llm import chat, topk


def best(rows, k, scale=64):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(scale * x) for x in v]
            kept[i] = min(kept.get(i, w), w)
    out = []
    for q, a in kept.items():
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in kept.items() if c != q and len(b) == len(a))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return sorted(out)


def make(n, dim=5):
    import random
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.3, 0.5]) for _ in range(dim)]) for i in range(n)]
    rows += [(n, None), (n + 1, [None] * dim), (n + 2, [float("nan")] * dim), (n + 3, [float("inf")] * dim), (None, [1.0] * dim),
             (0, [0.5] * dim), (1, rows[1][1]), (40, [2.0] * (dim - 1)), (n + 4, []), (n + 5, [1.0] * (dim - 1))]
    return rows + [(1000 + i, [0.5] * dim) for i in range(60)]


@pytest.mark.parametrize("k,qb,cb", [(20, 512, 2048), (3, 4, 7), (500, 3, 50), (1, 100, 1)])
def test_topk(spark, k, qb, cb):
    rows = make(150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = topk.search(df, F.col("id") % 20 == 0, k, 64, qb, cb).collect()
    assert sorted(map(tuple, got)) == best(rows, k)


def test_topk_extremes(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.search(spark.createDataFrame([], schema), F.col("id") % 20 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(0, [1.0])], schema), F.col("id") % 20 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0])], schema), F.col("id") % 20 == 0).count() == 0
    large = [(i, [float(i * 1000), -float(i) * 999.5]) for i in range(50)]
    got = topk.search(spark.createDataFrame(large, schema), F.col("id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == best(large, 20)
    same = [(i, [0.0, 0.0]) for i in range(100)]
    got = topk.search(spark.createDataFrame(same, schema), F.col("id") % 20 == 0, candidate_block=10).collect()
    assert sorted(map(tuple, got)) == best(same, 20)


def shuffled(plan):
    """Bytes that the exchanges of an executed plan have written."""
    own = plan.metrics().get("dataSize") if plan.nodeName() == "Exchange" else None
    below = "plan" if plan.nodeName().endswith("QueryStage") else {"AdaptiveSparkPlan": "executedPlan"}.get(plan.nodeName())
    parts = [getattr(plan, below)()] if below else [plan.children().apply(i) for i in range(plan.children().size())]
    return (own.get().value() if own is not None and own.isDefined() else 0) + sum(map(shuffled, parts))


def test_topk_of_many_blocks(spark, monkeypatch):
    """25 query blocks against 40 candidate blocks: their histograms meet as sums, not one by one."""
    moved, write = [], topk.materialize

    def spy(df, name):
        if df.columns[-2:] == ["prefix", "wanted"]:
            df.collect()
            moved.append(shuffled(df._jdf.queryExecution().executedPlan()))
        return write(df, name)

    monkeypatch.setattr(topk, "materialize", spy)
    rows = [(i, [math.sin(i * d + d) for d in range(1, 9)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for held in (1 << 21, 500):
        monkeypatch.setattr(topk, "HELD", held, raising=False)
        got = topk.search(df, F.col("id") % 20 == 0, 20, 64, 2, 25).collect()
        assert sorted(map(tuple, got)) == best(rows, 20)
    print("bytes", moved)  # dense histograms, at 8 bytes a bin, are 8 MB
    assert len(moved) > 2 and max(moved) < 2e6


def broadcasts(plan):
    """Names of an executed plan's nodes that send rows through the driver."""
    own = [plan.nodeName()] if plan.nodeName().startswith("Broadcast") else []
    below = "plan" if plan.nodeName().endswith("QueryStage") else {"AdaptiveSparkPlan": "executedPlan"}.get(plan.nodeName())
    parts = [getattr(plan, below)()] if below else [plan.children().apply(i) for i in range(plan.children().size())]
    return own + [x for p in parts for x in broadcasts(p)]


def test_topk_sends_no_blocks_through_the_driver(spark, monkeypatch):
    """A query state is copied to many candidate blocks: the copies are shuffled, in tiles of several blocks, not broadcast."""
    plans, write = [], topk.materialize

    def spy(df, name):
        if df.columns[-2:] == ["prefix", "wanted"]:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan())
        return write(df, name)

    monkeypatch.setattr(topk, "materialize", spy)
    monkeypatch.setattr(topk, "PAIRS", 160, raising=False)  # else one tile holds all of so small a table
    rows = make(120)  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for held in (1 << 21, 30):  # the second holds fewer winners than k for two queries
        monkeypatch.setattr(topk, "HELD", held, raising=False)
        done = topk.search(df, F.col("id") % 20 == 0, 20, 64, 2, 5)
        got = done.collect()
        assert sorted(map(tuple, got)) == best(rows, 20)
        plans.append(done._jdf.queryExecution().executedPlan())
    found = [broadcasts(p) for p in plans]
    assert len(found) > 4 and not any(found)


NASTY = ["", "plain", "</turn>", "</turn>\n", r"<\/turn>", r"<\\/turn>", "### ", r"#\## x", "#### ", "### ### user\n", "<</turn>>", "\n### user\nhi</turn>\n",
         "\\", "\\\\", "a\n\nb", "é🙂 ### Assistant: ", r"\### Assistant: </turn> ok", "##", "# ", "</turn", ">"]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "assistant", "system", "### ", "a\nb", "a\\nb", "\\b", None, "</turn>", "assistant"]
    rows = [(c, t, roles[(c * 3 + t * (1 + c % 3)) % len(roles)], NASTY[(c + t * 5) % len(NASTY)] if (c + t) % 7 else None)
            for c in range(30) for t in range(c % 9 + 1)]
    rows += [(50, 0, "assistant", "x"), (50, 0, "assistant", "x"), (50, None, "user", "first"), (None, 1, "user", "lost"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2)).repartition(4)
    done = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(done).collect()}
    read = {r.conv_id: r for r in done.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        assert [(t.role, t.text) for t in read[c].turns] == [(r, x) for _, _, r, x in own]
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        g = got[c]
        assert g.n_turns == len(own) and g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert g.formatted_chars == len(read[c].formatted)
        heads = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:]))
        assert read[c].formatted.count("### ") == heads and read[c].formatted.count("</turn>") == len(own)


def test_chat_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(df)).count() == 0
