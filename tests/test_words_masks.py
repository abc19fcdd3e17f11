"""Words split in Arrow batches, masking and the training set's inputs against plain Python."""

import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runforge.functions.text import arrow_words, non_ws_chars, word_tokens
from runforge.operators import corpus as C
from runforge.plans import training_set as TS
from runforge.sources import fixtures as X

SPACES = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                           0x205F, 0x3000)]
NOT_SPACES = [chr(c) for c in (0x08, 0x0E, 0x1B, 0x84, 0xA1, 0x1681, 0x180E, 0x200B, 0x2030, 0x2060, 0x3001, 0xFEFF, 0x1F642, 0xE9)]
TEXTS = ["one two", None, "", "  ", "end", "start　x \t y ", "é 🙂 ñ", "x", "x ", " x", "Â", *[f"a{c}b{c}{c}" for c in SPACES],
         *[f"a{c}b {c}" for c in NOT_SPACES], "".join(SPACES), "w " * 3000]


def test_words_of_a_batch(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    want = [list(r.w or []) for r in df.select("i", word_tokens("t").alias("w")).orderBy("i").collect()]
    for texts, words in ((pa.array(TEXTS), want), (pa.array(TEXTS)[3:9], want[3:9]), (pa.array(TEXTS, pa.large_string()), want),
                         (pa.array([], pa.string()), []), (pa.array([None, ""], pa.string()), [[], []])):
        flat, at = arrow_words(texts)
        got = flat.to_pylist()
        assert [got[i:j] for i, j in zip(at, at[1:])] == words
        assert at[0] == 0 and at[-1] == len(got)


def test_characters_beside_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc long, t string").repartition(3)
    got = C.tokenize(df, C.build_vocab(df, "t"), "doc", text="t", keep_text=False, chars="n")
    assert got.columns == ["doc", "n", "tokens"]
    want = {r.doc: r.n for r in df.select("doc", non_ws_chars("t").alias("n")).collect()}
    assert {r.doc: r.n for r in got.collect()} == want and want[1] is None and want[2] == 0


def test_vocabulary_of_few_words(spark):
    df = spark.createDataFrame([("a b",), (None,), ("b",)], "text string")
    vocab = C.build_vocab(df, "text")
    assert [(r.token, r["count"], r.id) for r in vocab.orderBy("id").collect()] == [("b", 2, 6), ("a", 1, 7)]


def plain_mask(seed, key, ids, p, vocab, special):
    out, labels = [], []
    for i, x in enumerate(ids):
        h = hashlib.md5("|".join([str(seed), key, str(i), "mask"]).encode()).hexdigest()
        u = [int(h[j:j + 8], 16) / 2 ** 32 for j in (0, 8, 16)]
        chosen = u[0] < p and x not in special
        labels.append(x if chosen else -100)
        out.append(x if not chosen or u[1] >= 0.9 else 4 if u[1] < 0.8 else 6 + int(u[2] * vocab))
    return out, labels


@pytest.mark.parametrize("p", [0.0, 0.15, 0.5, 1.0])
def test_masks(spark, p):
    rows = [(1, "a", list(range(400))), (2, None, [7] * 300), (3, "b", []), (4, "b", None)]
    df = spark.createDataFrame(rows, "k long, part string, input_ids array<int>")
    m = C.mask_tokens(df, ["k", "part"], 7, p, vocab_size=1000)
    assert m.columns == ["k", "part", "input_ids", "labels"]
    got = {r.k: (r.input_ids, r.labels) for r in m.collect()}
    for k, part, ids in rows[:3]:
        assert got[k] == plain_mask(7, ":".join([str(k), *([part] if part else [])]), ids, p, 1000, range(6))
    assert got[4] == (None, None)


def documents(spark, folder, n=400):
    """One source holds most rows and its ids lie in many slices."""
    rows = spark.range(n).select((F.col("id") * 1001).alias("doc_id"), F.when(F.col("id") % 10 == 0, "src1").otherwise("src0").alias("source"),
                                 F.concat(F.lit("words of text "), F.col("id").cast("string")).alias("text"))
    rows.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_selected_sources_deal_no_text(spark, tmp_path, monkeypatch):
    sf, plans = documents(spark, tmp_path), []

    def keep_plan(df, name="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    kept = C.materialize
    monkeypatch.setattr(C, "materialize", keep_plan)
    recs = TS.pack_training_set(spark, sf, prefix="src", min_ratio=0.0)
    assert recs.count() > 0
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_one_source_is_cut_into_slices(spark, tmp_path):
    sf = documents(spark, tmp_path)
    rows = X.corpus_plan(spark, sf)
    for source in ("src0", "src1"):
        got = [(r.doc_id, r.row_idx) for r in rows.where(F.col("dataset") == source).orderBy("doc_id").collect()]
        assert [i for _, i in got] == list(range(len(got)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert f"/ {float(X.DOC_SLICE)}" in plan and 400_000 // X.DOC_SLICE > 50
