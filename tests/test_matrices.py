"""K2-K4 against NumPy (SQL cannot express them); K8 completeness rule; K7 gate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runforge.operators import matrices as K
from runforge.sources import fixtures as X

from conftest import SF01


def _numpy_stats(spark):
    rows = X.matrices(spark, SF01).collect()
    mats = {}
    for r in rows:
        mats.setdefault(r.matrix_id, []).append((r.row_id, np.asarray(r.vec, dtype=np.float64)))
    out = {}
    for k, lst in mats.items():
        m = np.stack([v for _, v in sorted(lst, key=lambda t: t[0])])
        sv = np.linalg.svd(m, compute_uv=False)
        out[k] = dict(sv=sv, scree_1=sv[0] / sv.sum(), scree_2=(sv[0] + sv[1]) / sv.sum(),
                      mean_ratio_1=sv[0] / sv.mean(), median_ratio_1=sv[0] / np.nanmedian(sv),
                      params=m.size, norm=np.linalg.norm(m))
    return out


def test_spectral_matches_numpy(spark):
    want = _numpy_stats(spark)
    got = {r.matrix_id: r for r in K.spectral_stats(X.matrices(spark, SF01)).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert np.allclose(np.asarray(g.svd_values), w["sv"], rtol=1e-6, atol=1e-6)
        for c in ("scree_1", "scree_2", "mean_ratio_1", "median_ratio_1"):
            assert abs(getattr(g, c) - w[c]) <= 1e-6 * abs(w[c])


def test_aggregate_spectral_definitions(spark):
    want = _numpy_stats(spark)
    stats = K.layer_stats(X.matrices(spark, SF01))
    row = K.aggregate_spectral(stats).collect()[0]
    ratios = np.array([w["mean_ratio_1"] for w in want.values()])
    params = np.array([w["params"] for w in want.values()], dtype=float)
    assert abs(row.mean_ratio_1 - ratios.mean()) < 1e-6
    assert abs(row.mean_ratio_1_weighted - np.nanmean(ratios * params) / params.sum()) < 1e-9
    assert abs(row.mean_ratio_1_param_mean - (ratios * params).sum() / params.sum()) < 1e-6


def test_spectral_wide_pivot(spark):
    stats = K.spectral_stats(X.matrices(spark, SF01))
    names = ["layer.0.intermediate.dense.weight", "layer.1.intermediate.dense.weight"]
    wide = K.spectral_wide(stats, names=names).collect()[0]
    long = {r.matrix_id: r.mean_ratio_1 for r in K.spectral_wide(stats).collect()}
    assert abs(wide[f"{names[0]}_mean_ratio_1"] - long[names[0]]) < 1e-12


def test_average_missing_key_fails(spark):
    mm = X.model_matrices(spark, SF01).where(F.col("model").isin("a", "c"))
    w = spark.createDataFrame(K.parse_weights(["a", "c"]), "model string, weight double, ord int")
    with pytest.raises(Exception):
        K.average_matrices(mm, w).collect()


def test_average_extra_keys_ignored(spark):
    mm = X.model_matrices(spark, SF01).where(F.col("model").isin("a", "c"))
    w = spark.createDataFrame(K.parse_weights(["c:50", "a:50"]), "model string, weight double, ord int")
    out = K.average_matrices(mm, w)
    assert out.count() == X.model_matrices(spark, SF01).where(F.col("model") == "c").count()


def test_parse_weights_repeated_path():
    assert K.parse_weights(["a:30", "b", "a:10"]) == [("a", 0.1, 0), ("b", 1 / 3, 1)]


def test_diff_gate_same_sets_no_mismatch(spark):
    m = X.manifests(spark, SF01)
    a = m.where(F.col("model") == "a")
    assert K.diff_manifests(a, a).count() == 0


def _rows(name, m, parts=None):
    return [(name, i, [float(x) for x in row]) for i, row in enumerate(m)]


def test_small_singular_values(spark, monkeypatch):
    """Values down to 1e-10 of the largest, tall and wide, over many tasks and rounds of the reduction."""
    rng = np.random.default_rng(5)
    want, rows = {}, []
    for name, (n, d) in {"tall": (700, 12), "wide": (9, 500), "square": (20, 20), None: (40, 6)}.items():
        k = min(n, d)
        u, v = (np.linalg.qr(rng.normal(size=(x, k)))[0] for x in (n, d))
        m = u @ np.diag(np.logspace(0, -10, k)) @ v.T
        want[name], rows = np.linalg.svd(m, compute_uv=False), rows + _rows(name, m)
    df = spark.createDataFrame(rows, "matrix_id string, row_id long, vec array<double>").repartition(40, "row_id")
    for held in (K.HELD, 300):
        monkeypatch.setattr(K, "HELD", held)
        got = {r.matrix_id: np.array(r.svd_values) for r in K.spectral_stats(df).collect()}
        assert set(got) == set(want)
        for name, sv in want.items():
            assert len(got[name]) == len(sv)
            assert np.all(np.abs(got[name] - sv) <= 1e-6 * sv + 2e-16), name


def test_factors_are_bounded_by_the_short_side(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(_rows("w", rng.normal(size=(4, 30_000))), "matrix_id string, row_id long, vec array<double>")
    turned = K._transposed(df.withColumn("_rf_rows", F.lit(4)), ["matrix_id"], "vec")
    sizes = K._factors(turned, ["matrix_id"], "vec").select("side", F.size("r").alias("n")).collect()
    assert all(r.side == 4 and r.n <= 16 for r in sizes)


def test_spectra_of_few_rows(spark):
    schema = "matrix_id string, row_id long, vec array<double>"
    one = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 0, [3.0, 0.0]), ("b", 1, [0.0, 4.0]), ("c", 0, [1.0])], schema)
    assert [(r.matrix_id, [round(x, 9) for x in r.svd_values]) for r in K.spectral_stats(one).collect()] == [("b", [4.0, 3.0])]
    assert K.spectral_stats(one.limit(0)).count() == 0


def test_whole_matrices_need_no_meeting(spark, monkeypatch):
    """Many small matrices in one task, some of one row, with a null key: as NumPy has them, also when factors leave early."""
    import numpy as np

    from runforge.operators import matrices as K
    rng = np.random.default_rng(5)
    data = {k: rng.normal(size=(1 if k == 3 else 4 + (k or 0) % 3, 3)) for k in [None, *range(40)]}
    rows = [(k, [float(x) for x in v]) for k, m in data.items() for v in m]
    df = spark.createDataFrame(rows, "m long, vec array<double>").coalesce(1)
    want = {k: np.linalg.svd(m, compute_uv=False) for k, m in data.items() if k != 3}
    for held in (1 << 22, 20):
        monkeypatch.setattr(K, "HELD", held)
        stats = K.spectral_stats(df, "m")
        got = {r.m: r.svd_values for r in stats.collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)
        assert "FlatMapGroupsInPandas" not in stats._jdf.queryExecution().optimizedPlan().toString()
