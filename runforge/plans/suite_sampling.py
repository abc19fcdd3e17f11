"""Checked queries for sampling, draws and batch accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from runforge.operators import corpus as C
from runforge.operators import sampling as S
from runforge.plans.oracle_views import with_views
from runforge.plans.registry import register, rounded
from runforge.plans.suite_corpus import TOK_CTES, tokenized
from runforge.plans.suite_runlog import rsel
from runforge.sources import fixtures as X

TWO32 = "4294967296.0"


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


_STEP_KEY = "concat_ws(':', CAST(run_id AS VARCHAR), CAST(step AS VARCHAR))"
_CFG = """, w AS (SELECT task, CAST(weight AS DOUBLE) AS weight
           FROM (VALUES ('mlm', 0.75), ('nsp', 0.1), ('nlp', 0.1), ('mhm', 0.05)) AS t(task, weight)),
h AS (SELECT task, CASE WHEN lead(task) OVER (ORDER BY task) IS NULL THEN 1.0 ELSE
             sum(weight) OVER (ORDER BY task ROWS UNBOUNDED PRECEDING) / sum(weight) OVER () END AS hi FROM w),
r AS (SELECT task, coalesce(lag(hi) OVER (ORDER BY task), 0.0) AS lo, hi FROM h),
assigned AS (SELECT s.run_id, s.step, r.task
             FROM (SELECT run_id, step, """ + _draw("'11'", _STEP_KEY, "'task'") + f""" / {TWO32} AS u FROM steps) AS s
             LEFT JOIN r ON s.u >= r.lo AND s.u < r.hi)
"""


def _assigned(spark, sf):
    s = X.steps(spark, sf).select("run_id", "step")
    return S.assign_task(s, X.task_weights(spark), 11, ["run_id", "step"])


@register("S1_assign_task", with_views("steps") + _CFG + rsel("SELECT run_id, step, task FROM assigned"))
def s1(spark, sf):
    return _assigned(spark, sf)


@register("S2_task_mix_audit", with_views("steps") + _CFG + rsel("""
SELECT coalesce(o.task, c.task) AS task, o.observed_count, o.observed_share, c.configured_share,
       o.observed_share - c.configured_share AS share_diff
FROM (SELECT task, count(*) AS observed_count, count(*) / sum(count(*)) OVER () AS observed_share
      FROM assigned GROUP BY task) AS o
FULL OUTER JOIN (SELECT task, weight / sum(weight) OVER () AS configured_share FROM w) AS c ON o.task = c.task""",
                                                                   "observed_share", "configured_share", "share_diff"))
def s2(spark, sf):
    return rounded(S.task_mix_audit(_assigned(spark, sf), X.task_weights(spark)))


def _dim_sql(b: int) -> str:
    d = _draw("'5'", _STEP_KEY, f"'dim{b}'")
    p = _draw("'5'", _STEP_KEY, f"'pow{b}'")
    return f"CASE WHEN {d} / {TWO32} < 0.5 THEN CAST(pow(2, 3 + floor({p} / {TWO32} * 5)) AS INTEGER) END"


@register("S3_assign_reduced_dim", with_views("steps") + rsel(f"""
SELECT run_id, step, coalesce({_dim_sql(2)}, {_dim_sql(1)}) AS reduced_dim FROM steps"""))
def s3(spark, sf):
    s = X.steps(spark, sf).select("run_id", "step")
    return S.assign_reduced_dim(s, 0.5, 3, 256, 5, ["run_id", "step"])


@register("S4_balanced_prefix", with_views("corpus") + f""", o AS (
SELECT dataset, doc_id, {_draw("'3'", "CAST(doc_id AS VARCHAR)", "'prefix'")} AS dr FROM corpus),
p AS (SELECT *, row_number() OVER (ORDER BY dr, doc_id) - 1 AS sample_pos,
             row_number() OVER (PARTITION BY dataset ORDER BY dr, doc_id) - 1 AS occ FROM o),
g AS (SELECT dataset, min(sample_pos) AS first, min(CASE WHEN occ = 2 THEN sample_pos END) AS reach
      FROM p GROUP BY dataset),
gg AS (SELECT first, row_number() OVER (ORDER BY first) AS k,
              max(coalesce(reach, 4611686018427387904)) OVER (ORDER BY first ROWS UNBOUNDED PRECEDING) AS t,
              lead(first) OVER (ORDER BY first) AS nxt FROM g),
stop AS (SELECT min(t) AS st FROM gg WHERE k >= 3 AND t < 4611686018427387904 AND (nxt IS NULL OR t < nxt))
""" + rsel("SELECT dataset, doc_id, sample_pos FROM p, stop WHERE sample_pos <= st"))
def s4(spark, sf):
    pre = S.balanced_prefix(X.corpus(spark, sf), "dataset", 3, 3, seed=3, key="doc_id")
    return pre.select("dataset", "doc_id", "sample_pos")


def quads_sql(pool: str, by: str, seed: str, num_per_pair: int = 3) -> str:
    """CTEs building ``quads`` from ``pool`` (by, doc_id, nch) exactly as S5 does."""
    qk = "concat_ws(':', CAST(ds_i AS VARCHAR), CAST(ds_j AS VARCHAR), CAST(q AS VARCHAR))"

    def di(n: str, purpose: str) -> str:
        return f"CAST(floor({_draw(seed, qk, purpose)} / {TWO32} * {n}) AS BIGINT)"

    return f""", pl AS (SELECT {by} AS ds, doc_id, nch,
                   row_number() OVER (PARTITION BY {by} ORDER BY doc_id) - 1 AS di FROM {pool}),
sz AS (SELECT ds, count(*) AS nd, dense_rank() OVER (ORDER BY ds) AS ord FROM pl GROUP BY ds),
pr AS (SELECT a.ds AS ds_i, b.ds AS ds_j, a.nd AS n_i, b.nd AS n_j, q
       FROM sz AS a JOIN sz AS b ON b.ord < a.ord, range(0, {num_per_pair}) AS t(q)),
dr AS (SELECT ds_i, ds_j, q, {di('n_i', "'i1'")} AS i1, {di('n_i', "'i2'")} AS i2, {di('n_j', "'j'")} AS j FROM pr),
quads AS (
SELECT dr.ds_i AS dataset_i, dr.ds_j AS dataset_j, CAST(dr.q AS BIGINT) AS q,
       p1.doc_id AS doc_i1, {di('p1.nch', "'c_i1a'")} AS chunk_i1a, {di('p1.nch', "'c_i1b'")} AS chunk_i1b,
       p2.doc_id AS doc_i2, {di('p2.nch', "'c_i2'")} AS chunk_i2,
       p3.doc_id AS doc_j, {di('p3.nch', "'c_j'")} AS chunk_j
FROM dr JOIN pl AS p1 ON p1.ds = dr.ds_i AND p1.di = dr.i1
        JOIN pl AS p2 ON p2.ds = dr.ds_i AND p2.di = dr.i2
        JOIN pl AS p3 ON p3.ds = dr.ds_j AND p3.di = dr.j)
"""


_S5_POOL = ", cpool AS (SELECT dataset, doc_id, CAST(ceil(len(tokens) / 126.0) AS BIGINT) AS nch FROM tok WHERE len(tokens) > 0)\n"


@register("S5_contrastive_quads", with_views("corpus") + TOK_CTES + _S5_POOL + quads_sql("cpool", "dataset", "'9'")
          + rsel("SELECT * FROM quads"))
def s5(spark, sf):
    t = tokenized(spark, sf)
    chunks = C.chunk_tokens(t.select("doc_id", "tokens"), 126).select("doc_id", "chunk_idx")
    return S.contrastive_quads(t.select("dataset", "doc_id"), chunks, "dataset", "doc_id", 3, seed=9)


@register("S6_batch_metadata", with_views("batches") + rsel("""
SELECT batch_id, count(*) AS num_samples, CAST(count(DISTINCT ident) AS BIGINT) AS num_identifiers,
       CAST(sum(n_words) AS BIGINT) AS num_tokens, array_to_string(list_sort(list(DISTINCT ident)), ',') AS objects
FROM (SELECT batch_id, n_words, identifier[1] AS ident FROM batches) GROUP BY batch_id"""))
def s6(spark, sf):
    m = S.batch_metadata(X.batches(spark, sf))
    return m.select("batch_id", "num_samples", "num_identifiers", "num_tokens",
                    F.array_join("objects", ",").alias("objects"))


@register("S6b_batch_dataset_counts", with_views("batches") + rsel("""
SELECT batch_id, dataset, count(*) AS samples, CAST(sum(n_words) AS BIGINT) AS tokens
FROM (SELECT batch_id, n_words, unnest(dataset_id) AS dataset FROM batches) GROUP BY batch_id, dataset"""))
def s6b(spark, sf):
    return S.batch_dataset_counts(X.batches(spark, sf))


@register("S6c_batch_maps", with_views("batches") + rsel("""
SELECT batch_id, string_agg(dataset || '=' || samples || '/' || tokens, ',' ORDER BY dataset) AS maps
FROM (SELECT batch_id, dataset, count(*) AS samples, CAST(sum(n_words) AS BIGINT) AS tokens
      FROM (SELECT batch_id, n_words, unnest(dataset_id) AS dataset FROM batches) GROUP BY batch_id, dataset)
GROUP BY batch_id"""))
def s6c(spark, sf):
    m = S.batch_maps(S.batch_dataset_counts(X.batches(spark, sf)))
    keys = F.array_sort(F.map_keys("samples_by_dataset"))
    shown = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.col("samples_by_dataset")[k].cast("string"), F.lit("/"),
                                                 F.col("tokens_by_dataset")[k].cast("string")))
    return m.select("batch_id", F.array_join(shown, ",").alias("maps"))
