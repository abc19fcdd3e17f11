"""The pipeline against plain versions of its stages, each on what the one before it kept."""

import pytest
from brute import ROWS, groups, remove_repeats, simhash
from pyspark.sql import functions as F
from test_text_operators import check_packing

import corpus_pipeline
from runforge.llm import quality

SF001 = "/root/testdata/sf0.001"


def stored(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("name", ["small", "odd", "none"])
def test_stages(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    if name != "small":
        docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in ROWS], docs.schema)
    if name == "none":
        docs = docs.limit(0)
    docs = stored(spark, docs, tmp_path / "documents")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    score = {(r.doc_id, r.predicted) for r in quality.score_quality(docs, labels).collect()}
    rows, n = docs, {}
    for k, (stage, fn) in enumerate(corpus_pipeline.STAGES):
        before = rows.collect()
        rows = stored(spark, fn(spark, rows, SF001), tmp_path / str(k))
        after = n[stage] = rows.collect()
        if stage != "packing":
            assert rows.columns == docs.columns
        if stage == "quality":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if (r.doc_id, 1) in score)
        elif stage == "exact dedup":
            best = {}
            for r in before:
                t = "".join(c for c in r.text or "" if c not in " \t\n\x0b\f\r")
                place = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0, str(r))
                best[t] = min(best.get(t, place), place)
            assert sorted(str(r) for r in after) == sorted(x[3] for x in best.values())
        elif stage == "near dedup":
            label = groups([simhash(r.text) for r in before], 4)
            first = {}
            for r, g in zip(before, label):
                if r.doc_id is not None:
                    first[g] = min(first.get(g, r.doc_id), r.doc_id)
            assert sorted(str(r) for r in after) == sorted(str(r) for r, g in zip(before, label) if first.get(g) == r.doc_id)
        elif stage == "substring dedup":
            known = [r for r in before if r.doc_id is not None]
            want = dict(zip((r.doc_id for r in known), remove_repeats([(r.doc_id, r.text) for r in known])))
            assert len(after) == len(before)
            assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in after if r.doc_id is not None)
        else:
            check_packing(after, [(r.doc_id, r.text) for r in before])


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF001)
    assert got.agg(F.sum("length")).first()[0] > 0
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)


def test_planted_cases_at_scale(spark):
    """Clean documents stay, and copies go, on the larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, "/root/testdata/sf0.01")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    assert kept.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 0.1 * labels.where("quality = 0").count()
