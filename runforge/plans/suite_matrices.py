"""Checked queries for keyed-matrix and manifest operators (K1-K9).

K2-K4 need a decomposition, which SQL cannot express: on full matrices they are registered
without oracle SQL and checked against NumPy in ``tests/test_matrices.py``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runforge.operators import matrices as K
from runforge.plans.oracle_views import with_views
from runforge.plans.registry import register, rounded
from runforge.plans.suite_runlog import rsel
from runforge.sources import fixtures as X
from runforge.sources import tensor_files as TF
from runforge.sources.logs import scratch_dir


def _model(spark, sf, name):
    return X.model_matrices(spark, sf).where(F.col("model") == name).drop("model")


@register("K1_matrix_stats", with_views("matrices") + rsel("""
SELECT matrix_id, count(*) AS parameters, sqrt(sum(x * x)) AS norm, avg(x) AS mean, min(x) AS min, max(x) AS max
FROM (SELECT matrix_id, CAST(unnest(vec) AS DOUBLE) AS x FROM matrices) GROUP BY matrix_id""",
                                                           "norm", "mean", "min", "max"))
def k1(spark, sf):
    return rounded(K.matrix_stats(X.matrices(spark, sf)))


@register("K2_spectral_stats")
def k2(spark, sf):
    s = K.spectral_stats(X.matrices(spark, sf))
    return rounded(s.select("matrix_id", F.size("svd_values").alias("n_singular"), "scree_1", "scree_2",
                            "mean_ratio_1", "median_ratio_1"))


@register("K3_aggregate_spectral")
def k3(spark, sf):
    mm = X.model_matrices(spark, sf)
    return rounded(K.aggregate_spectral(K.layer_stats(mm, ["model", "matrix_id"]), by="model"))


@register("K4_spectral_wide")
def k4(spark, sf):
    return rounded(K.spectral_wide(K.spectral_stats(X.matrices(spark, sf))))


# Two columns a row (every value kept) have singular values in closed form.
_TWO = """, two AS (SELECT matrix_id, CAST(vec[2 * i + 1] AS DOUBLE) AS x, CAST(vec[2 * i + 2] AS DOUBLE) AS y
FROM (SELECT matrix_id, vec, unnest(range(len(vec) // 2)) AS i FROM matrices)),
g AS (SELECT matrix_id, sum(x * x) AS a, sum(y * y) AS c, sum(x * y) AS b, count(*) AS n FROM two GROUP BY matrix_id),
sv AS (SELECT matrix_id, n, sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s1,
              sqrt((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s2 FROM g)
"""


def _two_columns(spark, sf):
    m = X.matrices(spark, sf)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("vec") / 2).cast("int") - 1), lambda i: F.slice("vec", i * 2 + 1, 2))
    return m.select("matrix_id", F.explode(pairs).alias("vec"))


@register("K2b_spectral_stats_two_columns", with_views("matrices") + _TWO + rsel("""
SELECT matrix_id, s1, s2, s1 / (s1 + s2) AS scree_1, 1.0 AS scree_2, s1 / ((s1 + s2) / 2) AS mean_ratio_1,
       s1 / ((s1 + s2) / 2) AS median_ratio_1 FROM sv""", "s1", "s2", "scree_1", "scree_2", "mean_ratio_1", "median_ratio_1"))
def k2b(spark, sf):
    s = K.spectral_stats(_two_columns(spark, sf))
    return rounded(s.select("matrix_id", F.col("svd_values")[0].alias("s1"), F.col("svd_values")[1].alias("s2"), "scree_1",
                            "scree_2", "mean_ratio_1", "median_ratio_1"))


@register("K2c_singular_values_norm", with_views("matrices") + rsel("""
SELECT matrix_id, sum(x * x) AS squares FROM (SELECT matrix_id, CAST(unnest(vec) AS DOUBLE) AS x FROM matrices)
GROUP BY matrix_id""", "squares"))
def k2c(spark, sf):
    """The squared singular values of the full matrices add up to the squared norm."""
    s = K.spectral_stats(X.matrices(spark, sf))
    return rounded(s.select("matrix_id", F.aggregate("svd_values", F.lit(0.0), lambda a, x: a + x * x).alias("squares")))


# Pairs of rows as matrices of two rows and many columns.
_PAIRS = """, pairs AS (SELECT matrix_id, (row_number() OVER (PARTITION BY matrix_id ORDER BY row_id) - 1) // 2 AS pair, row_id, vec FROM matrices),
g AS (SELECT p.matrix_id, p.pair, list_inner_product(CAST(p.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[])) AS a,
             list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(q.vec AS DOUBLE[])) AS c,
             list_inner_product(CAST(p.vec AS DOUBLE[]), CAST(q.vec AS DOUBLE[])) AS b
      FROM pairs p JOIN pairs q ON p.matrix_id = q.matrix_id AND p.pair = q.pair AND p.row_id < q.row_id),
sv AS (SELECT matrix_id, pair, sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s1,
              sqrt((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s2 FROM g)
"""


@register("K2d_spectral_stats_two_rows", with_views("matrices") + _PAIRS + rsel("""
SELECT matrix_id, pair, s1, s2, s1 / (s1 + s2) AS scree_1, s1 / ((s1 + s2) / 2) AS mean_ratio_1 FROM sv""",
                                                                             "s1", "s2", "scree_1", "mean_ratio_1"))
def k2d(spark, sf):
    """The short side of matrices with more columns than rows."""
    place = F.row_number().over(Window.partitionBy("matrix_id").orderBy("row_id")) - 1
    m = X.matrices(spark, sf).withColumn("pair", F.floor(place / 2).cast("bigint"))
    s = K.spectral_stats(m, ["matrix_id", "pair"])
    return rounded(s.select("matrix_id", "pair", F.col("svd_values")[0].alias("s1"), F.col("svd_values")[1].alias("s2"), "scree_1", "mean_ratio_1"))


_K3 = ["scree_1", "scree_2", "mean_ratio_1", "median_ratio_1"]
_K3_OUT = _K3 + [f"{r}_weighted" for r in _K3] + [f"{r}_param_mean" for r in _K3]


@register("K3b_aggregate_spectral_two_columns", with_views("matrices") + _TWO + """, r AS (
SELECT 2 * n AS p, s1 / (s1 + s2) AS scree_1, 1.0 AS scree_2, s1 / ((s1 + s2) / 2) AS mean_ratio_1,
       s1 / ((s1 + s2) / 2) AS median_ratio_1 FROM sv)
""" + rsel("SELECT CAST(sum(p) AS BIGINT) AS total_params, " + ", ".join(
    [f"avg({r}) AS {r}" for r in _K3] + [f"avg({r} * p) / sum(p) AS {r}_weighted" for r in _K3]
    + [f"sum({r} * p) / sum(p) AS {r}_param_mean" for r in _K3]) + " FROM r", *_K3_OUT))
def k3b(spark, sf):
    return rounded(K.aggregate_spectral(K.layer_stats(_two_columns(spark, sf))))


@register("K4b_spectral_wide_two_columns", with_views("matrices") + _TWO + rsel("""
SELECT matrix_id, s1 / ((s1 + s2) / 2) AS mean_ratio_1 FROM sv""", "mean_ratio_1"))
def k4b(spark, sf):
    return rounded(K.spectral_wide(K.spectral_stats(_two_columns(spark, sf))))


@register("K5_select_matrices", with_views("manifests") + rsel("""
SELECT model, name FROM manifests WHERE ends_with(name, 'intermediate.dense.weight') AND len(shape) = 2"""))
def k5(spark, sf):
    return K.select_matrices(X.manifests(spark, sf)).select("model", "name")


@register("K6_manifest_listing", with_views("manifests") + rsel("""
SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY name) - 1 AS INTEGER) AS ordinal, name,
       array_to_string(shape, ',') AS shape, dtype FROM manifests"""))
def k6(spark, sf):
    m = K.manifest_listing(X.manifests(spark, sf))
    return m.select("model", "ordinal", "name", F.array_join("shape", ",").alias("shape"), "dtype")


def _diff_sql(m1: str, m2: str) -> str:
    return f""", a AS (SELECT name, shape, dtype FROM {m1}), b AS (SELECT name, shape, dtype FROM {m2}),
d AS (SELECT 'only_in_1' AS kind, name, shape AS shape_1, NULL AS shape_2, dtype AS dtype_1, NULL AS dtype_2
      FROM a WHERE name NOT IN (SELECT name FROM b)
      UNION ALL
      SELECT 'only_in_2', name, NULL, shape, NULL, dtype FROM b WHERE name NOT IN (SELECT name FROM a)),
mm AS (SELECT 'mismatch' AS kind, a.name, a.shape AS shape_1, b.shape AS shape_2, a.dtype AS dtype_1,
              b.dtype AS dtype_2
       FROM a JOIN b ON a.name = b.name WHERE a.shape <> b.shape OR a.dtype <> b.dtype)
""" + rsel("""
SELECT kind, name, array_to_string(shape_1, ',') AS shape_1, array_to_string(shape_2, ',') AS shape_2, dtype_1, dtype_2
FROM (SELECT * FROM d UNION ALL SELECT * FROM mm WHERE NOT EXISTS (SELECT 1 FROM d))""")


def _diff_out(df):
    return df.select("kind", "name", F.array_join("shape_1", ",").alias("shape_1"),
                     F.array_join("shape_2", ",").alias("shape_2"), "dtype_1", "dtype_2")


_MODEL_D = """, md AS (SELECT * FROM manifests WHERE model = 'c'
                UNION ALL SELECT * FROM manifests WHERE model = 'a' AND name LIKE 'layer.9.%'),
ma AS (SELECT * FROM manifests WHERE model = 'a'), mc AS (SELECT * FROM manifests WHERE model = 'c')
"""


@register("K7_diff_manifests_names", with_views("manifests") + _MODEL_D + _diff_sql("ma", "mc"))
def k7(spark, sf):
    m = X.manifests(spark, sf)
    return _diff_out(K.diff_manifests(m.where(F.col("model") == "a"), m.where(F.col("model") == "c")))


@register("K7b_diff_manifests_shapes", with_views("manifests") + _MODEL_D + _diff_sql("ma", "md"))
def k7b(spark, sf):
    m = X.manifests(spark, sf)
    d = m.where(F.col("model") == "c").unionByName(
        m.where((F.col("model") == "a") & F.col("name").startswith("layer.9.")))
    return _diff_out(K.diff_manifests(m.where(F.col("model") == "a"), d))


@register("K8_average_matrices", with_views("model_matrices") + rsel("""
SELECT a.matrix_id, a.row_id, CAST(i - 1 AS INTEGER) AS dim,
       CAST(CAST(a.vec[i] AS DOUBLE) * 0.3 + 0.5 * CAST(b.vec[i] AS DOUBLE) AS FLOAT) AS value
FROM (SELECT *, generate_subscripts(vec, 1) AS i FROM model_matrices WHERE model = 'a') AS a
JOIN (SELECT * FROM model_matrices WHERE model = 'b') AS b ON a.matrix_id = b.matrix_id AND a.row_id = b.row_id""",
                                                                   "value"))
def k8(spark, sf):
    w = spark.createDataFrame(K.parse_weights(["a:30", "b"]), "model string, weight double, ord int")
    avg = K.average_matrices(X.model_matrices(spark, sf).where(F.col("model").isin("a", "b")), w)
    return rounded(avg.select("matrix_id", "row_id", F.posexplode("vec").alias("dim", "value")))


@register("K9_model_size", with_views("manifests") + rsel("""
SELECT model, parameters,
       CASE WHEN parameters > 1000000000 THEN printf('%.2fB', parameters / 1e9)
            WHEN parameters > 1000000 THEN printf('%.1fM', parameters / 1e6)
            WHEN parameters > 1000 THEN printf('%.1fK', parameters / 1e3)
            ELSE CAST(parameters AS VARCHAR) || 'B' END AS size
FROM (SELECT model, CAST(sum(numel) AS BIGINT) AS parameters FROM manifests WHERE trainable GROUP BY model)"""))
def k9(spark, sf):
    return K.model_size(X.manifests(spark, sf))


# ---------------------------------------------------------------- stored models
def _stored_models(spark, sf):
    """The models as tensor files: matrices, and per matrix a flat bias (its last row); model c stores layer.3 as float16."""
    mm = X.model_matrices(spark, sf).withColumn("flat", F.lit(False))
    biases = mm.groupBy("model", "matrix_id").agg(F.max_by("vec", "row_id").alias("vec")).select(
        "model", F.regexp_replace("matrix_id", "weight$", "bias").alias("matrix_id"), F.lit(0).cast("long").alias("row_id"), "vec",
        F.lit(True).alias("flat"))
    half = (F.col("model") == "c") & (F.col("matrix_id") == "layer.3.intermediate.dense.weight")
    root = scratch_dir(spark, "models")
    TF.write_tensors(mm.unionByName(biases).withColumn("dtype", F.when(half, "float16").otherwise("float32")), root, shard_bytes=1 << 20)
    return root


@register("K6b_manifest_of_files", with_views("manifests") + rsel("""
SELECT model, name, array_to_string(shape, ',') AS shape, dtype, numel FROM manifests"""))
def k6b(spark, sf):
    """Names, shapes and types from the files' headers alone."""
    m = TF.read_manifest(spark, _stored_models(spark, sf))
    return m.select("model", "name", F.array_join("shape", ",").alias("shape"), "dtype", "numel")


@register("K7c_diff_stored_models", with_views("manifests") + _MODEL_D + _diff_sql("ma", "md"))
def k7c(spark, sf):
    """Two stored models compared by name, shape and type (the second is given the tensors it lacks)."""
    m = TF.read_manifest(spark, _stored_models(spark, sf))
    a = m.where(F.col("model") == "a")
    return _diff_out(K.diff_manifests(a, m.where(F.col("model") == "c").unionByName(a.where(F.col("name").startswith("layer.9.")))))


_DENSE = """, dense AS (SELECT model, matrix_id, row_number() OVER (PARTITION BY model, matrix_id ORDER BY row_id) - 1 AS row_id, vec
FROM model_matrices)"""


@register("K8b_average_stored_models", with_views("model_matrices") + _DENSE + rsel("""
SELECT a.matrix_id, a.row_id, CAST(i - 1 AS INTEGER) AS dim,
       CAST(CAST(a.vec[i] AS DOUBLE) * 0.3 + 0.5 * CAST(b.vec[i] AS DOUBLE) AS FLOAT) AS value
FROM (SELECT *, generate_subscripts(vec, 1) AS i FROM dense WHERE model = 'a') AS a
JOIN (SELECT * FROM dense WHERE model = 'b') AS b ON a.matrix_id = b.matrix_id AND a.row_id = b.row_id""", "value"))
def k8b(spark, sf):
    """Averaged from files, stored as a model again and read back; only the weights of two models are read."""
    weights = spark.createDataFrame(K.parse_weights(["a:30", "b"]), "model string, weight double, ord int")
    averaged = K.average_matrices(TF.read_tensors(spark, _stored_models(spark, sf), ["a", "b"], ["*weight"], partition_bytes=1 << 15), weights)
    root = scratch_dir(spark, "averaged")
    TF.write_tensors(averaged.withColumn("model", F.lit("average")), root)
    return rounded(TF.read_tensors(spark, root).select("matrix_id", "row_id", F.posexplode("vec").alias("dim", "value")))


@register("K9b_stored_model_size", with_views("manifests") + rsel("""
SELECT model, parameters,
       CASE WHEN parameters > 1000000000 THEN printf('%.2fB', parameters / 1e9)
            WHEN parameters > 1000000 THEN printf('%.1fM', parameters / 1e6)
            WHEN parameters > 1000 THEN printf('%.1fK', parameters / 1e3)
            ELSE CAST(parameters AS VARCHAR) || 'B' END AS size
FROM (SELECT model, CAST(sum(numel) AS BIGINT) AS parameters FROM manifests GROUP BY model)"""))
def k9b(spark, sf):
    return K.model_size(TF.read_manifest(spark, _stored_models(spark, sf)))


@register("K1b_matrix_stats_of_files", with_views("model_matrices") + rsel("""
SELECT model, matrix_id, count(*) AS parameters, sqrt(sum(x * x)) AS norm, avg(x) AS mean, min(x) AS min, max(x) AS max
FROM (SELECT model, matrix_id, CAST(unnest(vec) AS DOUBLE) AS x FROM model_matrices WHERE model <> 'c') GROUP BY model, matrix_id""",
                                                               "norm", "mean", "min", "max"))
def k1b(spark, sf):
    rows = TF.read_tensors(spark, _stored_models(spark, sf), ["a", "b"], ["*weight"])
    return rounded(K.matrix_stats(rows, ["model", "matrix_id"]))
