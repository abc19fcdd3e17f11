"""Checked queries for embedding measurements (E1-E6) on the ``embeddings`` table.

Quads come from S5 over the vectors: three consecutive vectors are the chunks of one
document, and documents form ten datasets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runforge.operators import sampling as S
from runforge.operators import vectors as V
from runforge.plans.registry import register, rounded
from runforge.plans.suite_runlog import rsel
from runforge.plans.suite_sampling import quads_sql
from runforge.sources import fixtures as X

SLOTS = {"i1a": ("doc_i1", "chunk_i1a"), "i1b": ("doc_i1", "chunk_i1b"), "i2": ("doc_i2", "chunk_i2"),
         "j": ("doc_j", "chunk_j")}
KEY = ("doc_id", "chunk_idx")


def vectors(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def chunk_vectors(spark, sf):
    """Three consecutive vectors are the chunks of one document; ten datasets of documents."""
    doc = F.floor(F.col("vec_id") / 3).cast("bigint")
    return vectors(spark, sf).select((doc % 10).alias("dataset"), doc.alias("doc_id"), (F.col("vec_id") % 3).alias("chunk_idx"), "vec")


def vector_quads(spark, sf):
    v = chunk_vectors(spark, sf)
    return S.contrastive_quads(v.select("dataset", "doc_id").distinct(), v.select("doc_id", "chunk_idx"), "dataset", "doc_id", 3,
                               seed=13)


def _cos_sql(a: str, b: str) -> str:
    return (f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
            f"(greatest(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))), 1e-8) * "
            f"greatest(sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 1e-8))")


_QUADS = ("""WITH ch AS (SELECT vec_id // 3 AS doc_id, vec_id % 3 AS chunk_idx, embedding FROM embeddings),
vpool AS (SELECT doc_id % 10 AS dataset, doc_id, count(*) AS nch FROM ch GROUP BY doc_id)
""" + quads_sql("vpool", "dataset", "'13'"))
_JOINED = """quads JOIN ch AS a ON a.doc_id = quads.doc_i1 AND a.chunk_idx = quads.chunk_i1a
           JOIN ch AS z ON z.doc_id = quads.doc_i1 AND z.chunk_idx = quads.chunk_i1b
           JOIN ch AS b ON b.doc_id = quads.doc_i2 AND b.chunk_idx = quads.chunk_i2
           JOIN ch AS c ON c.doc_id = quads.doc_j AND c.chunk_idx = quads.chunk_j"""
_SIMS = f""", sims AS (
SELECT quads.*, {_cos_sql('a.embedding', 'z.embedding')} AS sim_same,
       {_cos_sql('a.embedding', 'b.embedding')} AS sim_similar_a, {_cos_sql('z.embedding', 'b.embedding')} AS sim_similar_b,
       {_cos_sql('a.embedding', 'c.embedding')} AS sim_diff_a, {_cos_sql('z.embedding', 'c.embedding')} AS sim_diff_b,
       {_cos_sql('b.embedding', 'c.embedding')} AS sim_diff_c
FROM {_JOINED}),
terms AS (SELECT *, 1.0 * (1.0 - sim_same) AS t1, 0.5 * (0.0 - sim_similar_a) AS t2, 0.5 * (0.0 - sim_similar_b) AS t3,
                 0.33 * (sim_diff_a + 1.0) AS t4, 0.33 * (sim_diff_b + 1.0) AS t5, 0.33 * (sim_diff_c + 1.0) AS t6
          FROM sims),
scored AS (SELECT *, m + ln(exp(t1 - m) + exp(t2 - m) + exp(t3 - m) + exp(t4 - m) + exp(t5 - m) + exp(t6 - m)) AS loss
           FROM (SELECT *, greatest(t1, t2, t3, t4, t5, t6) AS m FROM terms))
"""
_SIM_COLS = ("sim_same", "sim_similar_a", "sim_similar_b", "sim_diff_a", "sim_diff_b", "sim_diff_c")


@register("E1_masked_mean_pool", rsel("""
SELECT CAST(vec_id % 50 AS BIGINT) AS seq_id, CAST(d - 1 AS INTEGER) AS dim,
       sum(CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END * CAST(embedding[d] AS DOUBLE)) / count(*) AS value
FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS d FROM embeddings)
GROUP BY vec_id % 50, d""", "value"))
def e1(spark, sf):
    v = vectors(spark, sf).select((F.col("vec_id") % 50).alias("seq_id"),
                                  F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1).alias("mask"), "vec")
    pooled = V.masked_mean_pool(v, "seq_id", "mask", "vec")
    return rounded(pooled.select("seq_id", F.posexplode("pooled").alias("dim", "value")))


@register("E2_cosine_pairs", _QUADS + _SIMS + rsel(
    "SELECT dataset_i, dataset_j, q, doc_i1, doc_i2, doc_j, " + ", ".join(_SIM_COLS) + " FROM scored", *_SIM_COLS))
def e2(spark, sf):
    q = V.cosine_pairs(vector_quads(spark, sf), chunk_vectors(spark, sf), SLOTS, KEY)
    return rounded(q.select("dataset_i", "dataset_j", "q", "doc_i1", "doc_i2", "doc_j", *_SIM_COLS))


@register("E3_contrastive_loss", _QUADS + _SIMS + rsel(
    "SELECT dataset_i, dataset_j, q, loss FROM scored", "loss"))
def e3(spark, sf):
    q = V.contrastive_loss(V.cosine_pairs(vector_quads(spark, sf), chunk_vectors(spark, sf), SLOTS, KEY))
    return rounded(q.select("dataset_i", "dataset_j", "q", "loss"))


@register("E4_contrastive_report", _QUADS + _SIMS + rsel("""
SELECT dataset_i, avg(loss) AS mean_loss, avg(sim_same) AS mean_sim_same,
       (sum(sim_similar_a) + sum(sim_similar_b)) / (2 * count(*)) AS mean_sim_similar,
       (sum(sim_diff_a) + sum(sim_diff_b) + sum(sim_diff_c)) / (3 * count(*)) AS mean_sim_diff,
       count(*) AS num_quads
FROM scored GROUP BY dataset_i""", "mean_loss", "mean_sim_same", "mean_sim_similar", "mean_sim_diff"))
def e4(spark, sf):
    q = V.contrastive_loss(V.cosine_pairs(vector_quads(spark, sf), chunk_vectors(spark, sf), SLOTS, KEY))
    return rounded(V.contrastive_report(q, "dataset_i"))


@register("E5_truncate_dims_sign", rsel("""
SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, CASE WHEN d - 1 < 16 THEN sign(embedding[d]) ELSE 0.0 END AS value
FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS d FROM embeddings)""", "value"))
def e5(spark, sf):
    t = V.truncate_dims(vectors(spark, sf), 16, "vec", binarize=True)
    return rounded(t.select("vec_id", F.posexplode("vec").alias("dim", "value")))


@register("E5b_truncate_dims", rsel("""
SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, CASE WHEN d - 1 < 16 THEN embedding[d] ELSE 0.0 END AS value
FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS d FROM embeddings)""", "value"))
def e5b(spark, sf):
    t = V.truncate_dims(vectors(spark, sf), 16, "vec", binarize=False, hidden=64)
    return rounded(t.select("vec_id", F.posexplode("vec").alias("dim", "value")))


def _trunc_sql(col: str, k: str) -> str:
    return f"list_transform(CAST({col} AS DOUBLE[]), lambda x, i: CASE WHEN i - 1 < {k} THEN x ELSE 0.0 END)"


@register("E6_separation_by_dim", _QUADS + f""", kq AS (SELECT quads.*, k FROM quads, (VALUES (8), (16), (32)) AS t(k)),
tv AS (SELECT k, {_trunc_sql('a.embedding', 'k')} AS va, {_trunc_sql('z.embedding', 'k')} AS vz,
              {_trunc_sql('b.embedding', 'k')} AS vb, {_trunc_sql('c.embedding', 'k')} AS vc
       FROM {_JOINED.replace("quads", "kq")}),
sims AS (SELECT k, {_cos_sql('va', 'vz')} AS sim_same, {_cos_sql('va', 'vb')} AS sim_similar_a,
                {_cos_sql('vz', 'vb')} AS sim_similar_b, {_cos_sql('va', 'vc')} AS sim_diff_a,
                {_cos_sql('vz', 'vc')} AS sim_diff_b, {_cos_sql('vb', 'vc')} AS sim_diff_c FROM tv),
terms AS (SELECT *, 1.0 * (1.0 - sim_same) AS t1, 0.5 * (0.0 - sim_similar_a) AS t2, 0.5 * (0.0 - sim_similar_b) AS t3,
                 0.33 * (sim_diff_a + 1.0) AS t4, 0.33 * (sim_diff_b + 1.0) AS t5, 0.33 * (sim_diff_c + 1.0) AS t6
          FROM sims),
scored AS (SELECT *, m + ln(exp(t1 - m) + exp(t2 - m) + exp(t3 - m) + exp(t4 - m) + exp(t5 - m) + exp(t6 - m)) AS loss
           FROM (SELECT *, greatest(t1, t2, t3, t4, t5, t6) AS m FROM terms))
""" + rsel("""
SELECT CAST(k AS INTEGER) AS k, avg(loss) AS mean_loss, avg(sim_same) AS mean_sim_same,
       (sum(sim_similar_a) + sum(sim_similar_b)) / (2 * count(*)) AS mean_sim_similar,
       (sum(sim_diff_a) + sum(sim_diff_b) + sum(sim_diff_c)) / (3 * count(*)) AS mean_sim_diff,
       count(*) AS num_quads
FROM scored GROUP BY k""", "mean_loss", "mean_sim_same", "mean_sim_similar", "mean_sim_diff"))
def e6(spark, sf):
    return rounded(V.separation_by_dim(chunk_vectors(spark, sf), vector_quads(spark, sf), SLOTS, (8, 16, 32), KEY))
