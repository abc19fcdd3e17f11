"""The block lookup against plain Python: odd texts, unknown words, several keys, many and few blocks."""

import re

import pytest

from runforge.functions.text import FIRST_WORD_ID, UNK_ID
from runforge.operators import corpus as C

ROWS = [(1, "a", "the cat the dog"), (2, "a", ""), (3, "b", None), (4, "b", " \t\n "), (5, "b", "only once here"), (1, "b", "the　cat sat"),
        (7, "c", "x " * 5000), (8, "c", "é 🙂 é ñ"), (None, "c", "the end")]


@pytest.mark.parametrize("block_bytes", [4 << 20, 100])
@pytest.mark.parametrize("size", [None, 3, 0])
def test_against_plain(spark, block_bytes, size):
    df = spark.createDataFrame(ROWS, "doc long, part string, text string").repartition(4)
    vocab = C.build_vocab(df, "text", size)
    ids = {r.token: r.id for r in vocab.collect()}
    assert all(i >= FIRST_WORD_ID for i in ids.values())
    split = lambda t: [w for w in re.split(r"\s+", t or "") if w]
    want = sorted(((d, p, t, [ids.get(w, UNK_ID) for w in split(t)]) for d, p, t in ROWS), key=str)
    got = C.tokenize(df, vocab, ["doc", "part"], block_bytes=block_bytes)
    assert got.columns == ["doc", "part", "text", "tokens"]
    assert sorted(((r.doc, r.part, r.text, list(r.tokens)) for r in got.collect()), key=str) == want
    lean = C.tokenize(df, vocab, ["doc", "part"], keep_text=False, block_bytes=block_bytes)
    assert lean.columns == ["doc", "part", "tokens"] and lean.count() == len(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, text string")
    assert C.tokenize(df, C.build_vocab(df, "text"), "doc").count() == 0


@pytest.mark.parametrize("told", [0, 2, 1 << 17])
def test_words_do_not_shuffle(spark, monkeypatch, told):
    """Few, some or all words are told to every task; what is dealt to blocks holds ids only."""
    monkeypatch.setattr(C, "TOLD_WORDS", told)
    rows = [(i, " ".join(["the", f"w{i % 7}", f"only{i}", "the", f"only{i}"])) for i in range(300)] + [(None, "the w1"), (5, "the w1")]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    vocab = C.build_vocab(df, "text")
    ids = {r.token: r.id for r in vocab.collect()}
    got = C.tokenize(df, vocab, "doc", keep_text=False, block_bytes=500)
    want = sorted(((d, [ids[w] for w in t.split()]) for d, t in rows), key=str)
    assert sorted(((r.doc, list(r.tokens)) for r in got.collect()), key=str) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_rf_words" not in plan and "split(" not in plan
