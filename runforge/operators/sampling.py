"""Deterministic sampling, draws and batch accounting.

All randomness is an md5 draw of (seed, key, purpose), so every result is
reproducible and checkable in SQL. Dataset-level tables (weights, dataset
lists) are one row per task or dataset; row-level work stays partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runforge.functions.draws import draw_index, draw_int, draw_uniform
from runforge.functions.indexing import sorted_positions
from runforge.session import materialize


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def _key(cols) -> F.Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in _cols(cols)])


# ---------------------------------------------------------------- S1, S2
def weight_ranges(weights: DataFrame, order: str = "task") -> DataFrame:
    """Cumulative [lo, hi) share of each task in ``order`` (weights are relative).

    One row per configured task; the running sum is a window over that table. Each
    range starts where the one before ends, and the last one ends at 1.
    """
    w = Window.orderBy(order)
    c = (weights.withColumn("weight", F.col("weight").cast("double"))
         .withColumn("_rf_sum", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_rf_tot", F.sum("weight").over(Window.partitionBy()))
         .withColumn("_rf_last", F.lead(order).over(w).isNull()))
    c = c.withColumn("hi", F.when(F.col("_rf_last"), F.lit(1.0)).otherwise(F.col("_rf_sum") / F.col("_rf_tot")))
    return c.select("task", F.coalesce(F.lag("hi").over(w), F.lit(0.0)).alias("lo"), "hi")


def assign_task(df: DataFrame, weights: DataFrame, seed, key, out: str = "task") -> DataFrame:
    """Weighted task draw per row: u = md5 draw in [0, 1), task whose
    cumulative share range holds u. A broadcast range join against the (one
    row per task) weights table. The job fails when there are no weights."""
    ranges = weight_ranges(weights)
    u = draw_uniform(seed, _key(key), "task")
    d = df.withColumn("_rf_u", u)
    j = d.join(F.broadcast(ranges.withColumnRenamed("task", "_rf_task")),
               (F.col("_rf_u") >= F.col("lo")) & (F.col("_rf_u") < F.col("hi")), "left")
    none = F.raise_error(F.lit("no task has a weight"))
    return j.withColumn(out, F.when(F.col("lo").isNull(), none).otherwise(F.col("_rf_task"))) \
        .drop("_rf_u", "_rf_task", "lo", "hi")


def task_mix_audit(log: DataFrame, config_weights: DataFrame, task: str = "task") -> DataFrame:
    """Observed share of each task vs its configured share (full outer join;
    a task on one side only shows null on the other)."""
    obs = log.groupBy(F.col(task).alias("task")).agg(F.count(F.lit(1)).alias("observed_count"))
    obs_tot = obs.agg(F.sum("observed_count").alias("_rf_n"))
    obs = obs.crossJoin(F.broadcast(obs_tot)).select(
        "task", "observed_count", (F.col("observed_count") / F.col("_rf_n")).alias("observed_share"))
    cfg_tot = config_weights.agg(F.sum("weight").alias("_rf_w"))
    cfg = config_weights.crossJoin(F.broadcast(cfg_tot)).select(
        "task", (F.col("weight") / F.col("_rf_w")).alias("configured_share"))
    j = obs.join(cfg, "task", "full")
    return j.withColumn("share_diff", F.col("observed_share") - F.col("configured_share"))


# ---------------------------------------------------------------- S3
def assign_reduced_dim(df: DataFrame, p: float, lo: int, hidden: int, seed, key,
                       out: str = "reduced_dim") -> DataFrame:
    """S3: nested-prefix dimension ``2**randint(lo, log2(hidden) - 1)`` drawn in
    two successive blocks of probability ``p`` (the second overwrites), so a
    row gets a dimension with probability 1 - (1 - p)^2."""
    import math
    hi = int(math.log2(hidden)) - 1
    k = _key(key)

    def block(b: int) -> F.Column:
        take = draw_uniform(seed, k, f"dim{b}") < F.lit(p)
        exp = F.lit(lo) + draw_index(F.lit(hi - lo + 1), seed, k, f"pow{b}")
        return F.when(take, F.pow(F.lit(2), exp).cast("int"))

    return df.withColumn(out, F.coalesce(block(2), block(1)))


# ---------------------------------------------------------------- S4
def balanced_prefix(df: DataFrame, by: str, min_groups: int = 3, min_per_group: int = 3, seed=0,
                    key=None) -> DataFrame:
    """Shortest prefix of a seeded order holding ≥ ``min_groups`` groups
    with every seen group at ≥ ``min_per_group`` rows.

    With groups ordered by first appearance, the prefix that stops inside the
    first K groups must reach max_{i≤K} reach_i (the place of each group's
    ``min_per_group``-th row) before group K+1 appears. A group's first and
    ``min_per_group``-th place are its smallest draws: each task keeps that many rows
    of a group before the shuffle, and only rows up to the stop are ranked (the rank
    is stored when this is called). Returns the prefix rows with ``sample_pos``; empty
    when no prefix qualifies.
    """
    keys = _cols(key) or [by]
    draw = draw_int(seed, _key(keys), "prefix")
    place = F.struct(draw.alias("draw"), *[F.col(k) for k in keys]).alias("_rf_at")
    own = Window.partitionBy(by).orderBy("_rf_at")
    low = (df.select(by, place).withColumn("_rf_nth", F.row_number().over(own))
           .where(F.col("_rf_nth") <= min_per_group))
    groups = low.groupBy(by).agg(F.min("_rf_at").alias("_rf_first"),
                                 F.min(F.when(F.col("_rf_nth") == min_per_group, F.col("_rf_at"))).alias("_rf_reach"))
    # one row a group; a group that never has enough rows blocks every prefix that holds it
    ow = Window.orderBy("_rf_first")
    upto = ow.rowsBetween(Window.unboundedPreceding, 0)
    g = groups.select(
        F.row_number().over(ow).alias("_rf_k"), F.max("_rf_reach").over(upto).alias("_rf_t"),
        F.max(F.col("_rf_reach").isNull()).over(upto).alias("_rf_short"), F.lead("_rf_first").over(ow).alias("_rf_next"))
    stop = g.where((F.col("_rf_k") >= min_groups) & ~F.col("_rf_short")
                   & (F.col("_rf_next").isNull() | (F.col("_rf_t") < F.col("_rf_next")))) \
        .agg(F.min("_rf_t").alias("_rf_stop"))
    chosen = (df.select(F.struct("*").alias("_rf_row"), place).crossJoin(F.broadcast(stop))
              .where(F.col("_rf_at") <= F.col("_rf_stop")))
    ranked = sorted_positions(chosen.select("_rf_row", "_rf_at"), [], ["_rf_at"], out="sample_pos")
    return ranked.select("_rf_row.*", "sample_pos")


# ---------------------------------------------------------------- S5
def contrastive_quads(docs: DataFrame, chunks: DataFrame, by: str = "dataset", doc: str = "doc_id",
                      num_per_pair: int = 3, seed=0) -> DataFrame:
    """Contrastive quads. For every dataset pair (i, j) with j before i,
    ``num_per_pair`` times: documents i1, i2 from i and j from j (independent
    draws, may coincide), then chunks i1a, i1b of i1 (may coincide), i2 of i2,
    j of j.

    ``docs``: (by, doc) pool rows; ``chunks``: (doc, chunk_idx). Documents
    without chunks are left out of the pool. Datasets and their documents may have
    ids of any type. The dataset pairs (d·(d-1)/2 of them, which is the result's own
    size) come from listing, for each dataset, the ranks before its own and an
    equi-join on rank; document and chunk picks are equi-joins on drawn indexes. The
    indexed pool is stored when this is called.
    """
    nchunks = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("_rf_nch"))
    pool = docs.select(by, doc).join(nchunks, doc, "inner")
    # the indexed pool (one row per document) feeds four branches below: store it once
    pool = materialize(sorted_positions(pool, [by], [doc], out="_rf_di"), "quad_pool")
    sizes = pool.groupBy(by).agg(F.count(F.lit(1)).alias("_rf_nd"))
    ranked = sorted_positions(sizes, [], [by], out="_rf_ord")
    a = ranked.where("_rf_ord > 0").select(
        F.col(by).alias("ds_i"), F.col("_rf_nd").alias("n_i"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rf_ord") - 1)).alias("_rf_ord"))
    b = ranked.select(F.col(by).alias("ds_j"), F.col("_rf_nd").alias("n_j"), "_rf_ord")
    pairs = a.join(b, "_rf_ord")
    q = pairs.select("ds_i", "ds_j", "n_i", "n_j",
                     F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(num_per_pair - 1).cast("bigint"))).alias("q"))
    qk = F.concat_ws(":", F.col("ds_i").cast("string"), F.col("ds_j").cast("string"), F.col("q").cast("string"))
    q = q.select("ds_i", "ds_j", "q",
                 draw_index(F.col("n_i"), seed, qk, "i1").alias("_rf_i1"),
                 draw_index(F.col("n_i"), seed, qk, "i2").alias("_rf_i2"),
                 draw_index(F.col("n_j"), seed, qk, "j").alias("_rf_j"))
    p = pool.select(by, "_rf_di", doc, "_rf_nch")

    def pick(frame, ds_col, idx_col, name):
        pp = p.select(F.col(by).alias(ds_col), F.col("_rf_di").alias(idx_col),
                      F.col(doc).alias(f"doc_{name}"), F.col("_rf_nch").alias(f"_rf_n_{name}"))
        return frame.join(pp, [ds_col, idx_col], "inner")

    q = pick(q, "ds_i", "_rf_i1", "i1")
    q = pick(q, "ds_i", "_rf_i2", "i2")
    q = pick(q, "ds_j", "_rf_j", "j")
    return q.select(
        F.col("ds_i").alias("dataset_i"), F.col("ds_j").alias("dataset_j"), "q",
        "doc_i1", draw_index(F.col("_rf_n_i1"), seed, qk, "c_i1a").alias("chunk_i1a"),
        draw_index(F.col("_rf_n_i1"), seed, qk, "c_i1b").alias("chunk_i1b"),
        "doc_i2", draw_index(F.col("_rf_n_i2"), seed, qk, "c_i2").alias("chunk_i2"),
        "doc_j", draw_index(F.col("_rf_n_j"), seed, qk, "c_j").alias("chunk_j"))


# ---------------------------------------------------------------- S6
def batch_metadata(df: DataFrame, by: str = "batch_id", mask: str = "attention_mask",
                   identifier: str = "identifier", dataset: str = "dataset_id") -> DataFrame:
    """Per batch: num_samples, distinct identifiers, Σ attention mask, and
    the distinct object list; see :func:`batch_dataset_counts` for the
    per-dataset counters."""
    tokens = F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = df.select(by, F.col(identifier), tokens.alias("_rf_tok"))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.size(F.array_distinct(F.flatten(F.collect_list(identifier)))).cast("bigint").alias("num_identifiers"),
        F.sum("_rf_tok").cast("bigint").alias("num_tokens"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(identifier)))).alias("objects"))


def batch_dataset_counts(df: DataFrame, by: str = "batch_id", mask: str = "attention_mask",
                         dataset: str = "dataset_id") -> DataFrame:
    """samples_by_dataset and tokens_by_dataset in exploded form: a row that
    lists two datasets counts once for each and adds its *full* token count to
    both. ``batch_maps`` folds them into the two map columns."""
    tokens = F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x)
    ex = df.select(by, tokens.alias("_rf_tok"), F.explode(dataset).alias("dataset"))
    return ex.groupBy(by, "dataset").agg(F.count(F.lit(1)).alias("samples"),
                                         F.sum("_rf_tok").cast("bigint").alias("tokens"))


def batch_maps(counts: DataFrame, by: str = "batch_id") -> DataFrame:
    """Fold :func:`batch_dataset_counts` into ``samples_by_dataset`` and
    ``tokens_by_dataset`` maps, one row per batch (the step-log shape)."""
    return counts.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("dataset", "samples"))).alias("samples_by_dataset"),
        F.map_from_entries(F.collect_list(F.struct("dataset", "tokens"))).alias("tokens_by_dataset"))
