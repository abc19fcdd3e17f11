"""Keyed-matrix and manifest operators.

A model is a long table (model, matrix_id, row_id, vec array<float>); a
manifest is (model, name, shape array<int>, dtype, numel[, trainable]).
Matrices are never gathered on the driver: statistics are aggregations,
spectra come from triangular factors that meet in a tree, and the weighted average combines at most one row per model for each (matrix, row).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runforge.functions.text import human_size
from runforge.session import materialize


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- K1
def matrix_stats(df: DataFrame, by="matrix_id", vec: str = "vec") -> DataFrame:
    """K1: element count, Frobenius norm, mean, min and max per matrix."""
    by = _cols(by)
    x = F.transform(vec, lambda e: e.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e)
    rows = df.select(*by, F.size(vec).cast("bigint").alias("_rf_n"), total(x).alias("_rf_s"),
                     total(F.transform(x, lambda e: e * e)).alias("_rf_q"), F.array_min(x).alias("_rf_lo"), F.array_max(x).alias("_rf_hi"))
    return rows.groupBy(*by).agg(
        F.sum("_rf_n").alias("parameters"), F.sqrt(F.sum("_rf_q")).alias("norm"),
        (F.sum("_rf_s") / F.sum("_rf_n")).alias("mean"), F.min("_rf_lo").alias("min"), F.max("_rf_hi").alias("max"))


# ---------------------------------------------------------------- K2
#: Values of triangular factors that a task holds before it emits them, and of one block of a transposed matrix.
HELD = 1 << 22
#: Factors that meet in one step of the reduction.
FAN_IN = 8


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The R of a QR decomposition: a small matrix with the singular values of the rows."""
    return np.linalg.qr(rows, mode="r") if rows.shape[0] > 1 else rows


def _factors(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """(by..., side, part, r): for each task and matrix the R of its rows, flat, ``side`` columns wide."""
    keys = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes)

    def key_of(values) -> tuple:
        return tuple(None if pd.isna(k) else k for k in values)

    def fn(batches):
        held: dict[tuple, np.ndarray] = {}
        values = 0
        number = TaskContext.get().partitionId() << 32

        def made() -> pd.DataFrame:
            nonlocal number, values
            out = pd.DataFrame([{**dict(zip(by, key)), "side": r.shape[1], "part": number + k, "r": r.ravel()}
                                for k, (key, r) in enumerate(held.items())])
            number += len(held)
            held.clear()
            values = 0
            return out

        for pdf in batches:
            for key, rows in pdf.groupby(by, sort=False, dropna=False)[vec]:
                key = key_of(key if isinstance(key, tuple) else (key,))
                block = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
                values -= held[key].size if key in held else 0
                held[key] = _triangle(np.vstack([held[key], block]) if key in held else block)
                values += held[key].size
                if values > HELD:
                    yield made()
        if held:
            yield made()

    return df.select(*by, vec).mapInPandas(fn, f"{keys}, side int, part long, r array<double>")


def _transposed(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """(by..., vec): the columns of matrices with fewer rows (``_rf_rows``) than columns, as rows, block by block."""
    keys = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes)
    width = F.greatest(F.lit(1), F.floor(F.lit(HELD) / F.col("_rf_rows"))).cast("int")
    starts = F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / width).cast("int"))
    pieces = (df.select(*by, vec, width.alias("_rf_w"), F.explode(starts).alias("_rf_block"))
              .select(*by, "_rf_block", F.slice(vec, F.col("_rf_block") * F.col("_rf_w") + 1, F.col("_rf_w")).alias(vec)))

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]]).T  # the order of rows does not matter
        out = pd.DataFrame({vec: list(_triangle(columns) if columns.shape[0] > columns.shape[1] else columns)})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, vec]]

    return pieces.groupBy(*by, "_rf_block").applyInPandas(turn, f"{keys}, {vec} array<double>")


def spectral_stats(df: DataFrame, by="matrix_id", vec: str = "vec") -> DataFrame:
    """K2: singular values per matrix and scree_1, scree_2, mean_ratio_1, median_ratio_1.

    A tall-skinny QR by tree reduction: each task keeps, for each matrix it holds, the
    triangular factor R of the rows seen so far; the factors of a matrix meet ``FAN_IN`` at a time,
    stacked and factored again, until one is left, whose singular values are the
    matrix's (min(n, d) of them, descending). Nothing is squared, so small
    singular values are as exact as those of a decomposition in memory. A matrix of fewer
    rows than columns is transposed first, column block by column block, so a factor
    has at most min(n, d)^2 values. The first factors are written once when this is called.

    Matrices with fewer than two singular values are left out; a null key is a matrix like
    any other.
    """
    by = _cols(by)
    keys = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes)
    shapes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rf_rows"), F.max(F.size(vec)).alias("_rf_columns")) \
        .select(*[F.col(c).alias(f"_rf_{c}") for c in by], "_rf_rows", "_rf_columns")
    shapes = materialize(shapes, "shapes")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_rf_{c}")) for c in by])
    wide = shapes.where("_rf_rows < _rf_columns")
    tall_rows = df.select(*by, vec).join(wide, same, "left_anti")
    wide_rows = df.select(*by, vec).join(wide, same).select(*by, vec, "_rf_rows")
    stored = rs = materialize(_factors(tall_rows, by, vec).unionByName(_factors(_transposed(wide_rows, by, vec), by, vec)), "factors")
    most = rs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    numbered = Window.partitionBy(*by).orderBy("part")
    rs = rs.withColumn("part", F.row_number().over(numbered) - 1)  # one row a task that holds the matrix

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        side = int(pdf["side"].iloc[0])
        r = _triangle(np.vstack([np.asarray(x).reshape(-1, side) for x in pdf["r"]]))
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "side": side, "part": int(pdf["part"].iloc[0]) // FAN_IN, "r": r.ravel()}])

    while most > FAN_IN:
        rs = rs.groupBy(*by, F.floor(F.col("part") / FAN_IN)).applyInPandas(meet, f"{keys}, side int, part long, r array<double>")
        most = -(-most // FAN_IN)

    schema = f"{keys}, svd_values array<double>, scree_1 double, scree_2 double, mean_ratio_1 double, median_ratio_1 double"
    names = [*by, "svd_values", "scree_1", "scree_2", "mean_ratio_1", "median_ratio_1"]

    def stats_of(factors, side: int) -> list | None:
        sv = np.linalg.svd(_triangle(np.vstack([np.asarray(x).reshape(-1, side) for x in factors])), compute_uv=False)
        if len(sv) < 2:
            return None
        total, mean, med = sv.sum(), sv.mean(), np.nanmedian(sv)
        return [[float(x) for x in sv], sv[0] / total, (sv[0] + sv[1]) / total, sv[0] / mean, sv[0] / med]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        stats = stats_of(pdf["r"], int(pdf["side"].iloc[0]))
        return pd.DataFrame([] if stats is None else [[*(pdf[c].iloc[0] for c in by), *stats]], columns=names)

    def solve_rows(batches):
        for pdf in batches:
            rows = [(i, stats_of([r], side)) for i, (r, side) in enumerate(zip(pdf["r"], pdf["side"]))]
            kept = [i for i, stats in rows if stats is not None]
            out = pd.DataFrame([stats for _, stats in rows if stats is not None], columns=names[len(by):])
            yield pd.concat([pdf[by].iloc[kept].reset_index(drop=True), out], axis=1)

    if most <= 1:  # each matrix lies in one task: nothing is left to meet
        return stored.mapInPandas(solve_rows, schema)
    return rs.groupBy(*by).applyInPandas(solve, schema)


def layer_stats(df: DataFrame, by="matrix_id", vec: str = "vec") -> DataFrame:
    """K1 + K2 joined: one row of statistics per 2-D matrix."""
    by = _cols(by)
    return matrix_stats(df, by, vec).join(spectral_stats(df, by, vec), by, "inner")


# ---------------------------------------------------------------- K3, K4
RATIOS = ("scree_1", "scree_2", "mean_ratio_1", "median_ratio_1")


def aggregate_spectral(stats: DataFrame, by=None) -> DataFrame:
    """K3: model-level aggregate of per-matrix statistics.

    ``<r>`` = nanmean of the ratio; ``<r>_weighted`` = nanmean(ratio·params) /
    Σ params, kept as defined although it is 1/L of a weighted mean; and
    ``<r>_param_mean`` = Σ(ratio·params) / Σ params, the true weighted mean.
    """
    by = _cols(by)
    nn = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    aggs = [F.sum("parameters").alias("total_params")]
    for r in RATIOS:
        aggs += [F.avg(nn(r)).alias(r),
                 F.avg(nn(r) * F.col("parameters")).alias(f"_rf_{r}_w"),
                 F.sum(nn(r) * F.col("parameters")).alias(f"_rf_{r}_s")]
    g = stats.groupBy(*by).agg(*aggs)
    out = [*by, "total_params", *RATIOS]
    cols = [F.col(c) for c in out]
    for r in RATIOS:
        cols += [(F.col(f"_rf_{r}_w") / F.col("total_params")).alias(f"{r}_weighted"),
                 (F.col(f"_rf_{r}_s") / F.col("total_params")).alias(f"{r}_param_mean")]
    return g.select(*cols)


def spectral_wide(stats: DataFrame, by=None, names: list[str] | None = None, value: str = "mean_ratio_1",
                  key: str = "matrix_id") -> DataFrame:
    """K4: per-matrix ``mean_ratio_1`` report. Long form (by, matrix_id,
    value) by default; with an explicit bounded ``names`` list, one column per
    matrix (``<name>_mean_ratio_1``) via pivot."""
    by = _cols(by)
    if names is None:
        return stats.select(*by, key, F.col(value).alias(f"{value}"))
    wide = stats.groupBy(*by).pivot(key, names).agg(F.first(value))
    return wide.select(*by, *[F.col(f"`{n}`").alias(f"{n}_{value}") for n in names])


# ---------------------------------------------------------------- K5, K6, K7
def manifest(df: DataFrame) -> DataFrame:
    """K6 (survey name): see :func:`manifest_listing`."""
    return manifest_listing(df)


def select_matrices(manifest: DataFrame, suffix: str = "intermediate.dense.weight", name: str = "name") -> DataFrame:
    """K5: 2-D entries whose name ends with ``suffix`` (the eval roll-up set)."""
    return manifest.where(F.col(name).endswith(suffix) & (F.size("shape") == 2))


def manifest_listing(manifest: DataFrame) -> DataFrame:
    """K6: ordinal, name, shape and dtype per model, in the model's own order when
    the manifest has it (``position``), else by name."""
    w = Window.partitionBy("model").orderBy("position" if "position" in manifest.columns else "name")
    return manifest.select("model", (F.row_number().over(w) - 1).alias("ordinal"), "name", "shape", "dtype")


def diff_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """K7: if the name sets differ, the names only in one side (kind
    ``only_in_1`` / ``only_in_2``) and nothing else; otherwise the entries whose
    shape or dtype differ (kind ``mismatch``). Set difference is a left-anti
    join both ways; the gate is a one-row count."""
    a1 = a.select("name", F.col("shape").alias("shape_1"), F.col("dtype").alias("dtype_1"))
    b1 = b.select("name", F.col("shape").alias("shape_2"), F.col("dtype").alias("dtype_2"))
    only1 = a1.join(b1.select("name"), "name", "left_anti").select(
        F.lit("only_in_1").alias("kind"), "name", "shape_1", F.lit(None).cast("array<int>").alias("shape_2"),
        "dtype_1", F.lit(None).cast("string").alias("dtype_2"))
    only2 = b1.join(a1.select("name"), "name", "left_anti").select(
        F.lit("only_in_2").alias("kind"), "name", F.lit(None).cast("array<int>").alias("shape_1"), "shape_2",
        F.lit(None).cast("string").alias("dtype_1"), "dtype_2")
    diff = only1.unionByName(only2)
    mism = a1.join(b1, "name", "inner").where(
        (F.col("shape_1") != F.col("shape_2")) | (F.col("dtype_1") != F.col("dtype_2"))).select(
        F.lit("mismatch").alias("kind"), "name", "shape_1", "shape_2", "dtype_1", "dtype_2")
    gate = diff.agg((F.count(F.lit(1)) > 0).alias("_rf_sets_differ"))
    both = diff.withColumn("_rf_is_diff", F.lit(True)).unionByName(mism.withColumn("_rf_is_diff", F.lit(False)))
    return (both.crossJoin(F.broadcast(gate)).where(F.col("_rf_is_diff") == F.col("_rf_sets_differ"))
            .drop("_rf_is_diff", "_rf_sets_differ"))


# ---------------------------------------------------------------- K8
def parse_weights(specs: list[str]) -> list[tuple[str, float, int]]:
    """``path:NN`` -> NN/100; bare path -> 1/num_models (num_models = number of
    arguments). A repeated path keeps its first position and last weight."""
    n = len(specs)
    out: dict[str, float] = {}
    for s in specs:
        if ":" in s:
            p, w = s.split(":")
            out[p] = float(w) / 100
        else:
            out[s] = 1.0 / n
    return [(p, w, i) for i, (p, w) in enumerate(out.items())]


def average_matrices(df: DataFrame, weights: DataFrame, vec: str = "vec") -> DataFrame:
    """K8: Σ weight·value per (matrix, row), weights not normalised.

    ``weights``: (model, weight, ord); the key set is the first model's (ord
    0): keys missing from another model fail the job, extra keys elsewhere are
    ignored. Each key gathers at most one row per model, so the group size is
    bounded by the number of models; the sum runs in double and is stored as
    float.
    """
    nmodels = weights.agg(F.count(F.lit(1)).alias("_rf_nm"))
    j = df.join(F.broadcast(weights), "model", "inner")
    base = j.where(F.col("ord") == 0).select("matrix_id", "row_id")
    grouped = j.groupBy("matrix_id", "row_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", F.col("weight").cast("double").alias("w"), F.col(vec))))
        .alias("_rf_parts"))
    g = base.join(grouped, ["matrix_id", "row_id"], "inner").crossJoin(F.broadcast(nmodels))
    first = F.col("_rf_parts")[0]
    init = F.transform(first[vec], lambda x: x.cast("double") * first["w"])
    rest = F.slice(F.col("_rf_parts"), F.lit(2), F.size("_rf_parts"))
    summed = F.aggregate(rest, init, lambda acc, p: F.zip_with(acc, p[vec], lambda a, x: a + p["w"] * x.cast("double")))
    ok = F.size("_rf_parts") == F.col("_rf_nm")
    out = F.when(ok, F.transform(summed, lambda x: x.cast("float"))).otherwise(
        F.raise_error(F.concat(F.lit("key missing in a model: "), F.col("matrix_id"), F.lit("/"),
                               F.col("row_id").cast("string"))))
    return g.select("matrix_id", "row_id", out.alias(vec))


# ---------------------------------------------------------------- K9
def model_size(manifest: DataFrame, trainable_only: bool = True, by="model") -> DataFrame:
    """K9: parameter total per model and its readable size (strict '>'
    thresholds: 1e9 -> '.2fB', 1e6 -> '.1fM', 1e3 -> '.1fK', else '<n>B')."""
    by = _cols(by)
    m = manifest.where(F.col("trainable")) if trainable_only and "trainable" in manifest.columns else manifest
    g = m.groupBy(*by).agg(F.sum("numel").cast("bigint").alias("parameters"))
    return g.withColumn("size", human_size(F.col("parameters")))
