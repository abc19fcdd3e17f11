"""Row positions and order statistics without one-task-per-group windows.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends each group to one
task; a run or dataset holding a third of all rows then becomes one straggler.
:func:`position_within` gets the same numbers in slices:

1. exact per-group ``min``, ``max`` and ``count`` of the (numeric) first order
   key give each group ``S = ceil(count / rows_per_slice)`` equal-width key
   slices; the slice of a row is a pure function of its key, so every branch
   of the plan that recomputes it agrees (no sampling, no partition ids);
2. a local row number per (group, slice): a window over bounded partitions;
3. per-(group, slice) counts, prefix-summed over slice order (a table with one
   row per slice, i.e. ``rows / rows_per_slice`` plus the number of groups);
4. join the offset back and add it.

Slices are balanced when keys are spread over their range (steps, ids); a key
range concentrated in one slice is still exact, just a larger task.

:func:`pick_order_stats` builds exact quantiles on top (rank-and-pick), never
collecting a group's values into one array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.session import materialize

ROWS_PER_SLICE = 1 << 20


def _cols(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def position_within(df: DataFrame, group_cols, order_cols, out: str = "pos",
                    descending: bool = False, rows_per_slice: int = ROWS_PER_SLICE,
                    slice_width: float | None = None) -> DataFrame:
    """Add a 0-based bigint ``out`` = row number within ``group_cols`` ordered by ``order_cols``.

    The first order column must be numeric; ``descending`` reverses the whole
    order. Ties are broken arbitrarily (make the order total for reproducible
    positions). Exact for any data.

    ``slice_width`` (for integer ids, steps and hashes, whose values are
    spread evenly) cuts fixed-width key slices directly, skipping the
    per-group min/max pass; the input is then read twice instead of four
    times, which keeps nested plans small.
    """
    groups = _cols(group_cols)
    orders = [c for c in _cols(order_cols)]
    key = F.col(orders[0]) if isinstance(orders[0], str) else orders[0]
    if descending:
        key = -key
        sort_cols = [(F.col(c) if isinstance(c, str) else c).desc() for c in orders]
    else:
        sort_cols = [F.col(c) if isinstance(c, str) else c for c in orders]
    if slice_width:
        sliced = df.withColumn("_rf_slice", F.floor(key / F.lit(float(slice_width))).cast("bigint"))
    else:
        keyed = df.withColumn("_rf_k", key.cast("double"))
        stats = keyed.groupBy(*groups).agg(F.min("_rf_k").alias("_rf_lo"), F.max("_rf_k").alias("_rf_hi"),
                                           F.count(F.lit(1)).alias("_rf_cnt"))
        nslices = F.greatest(F.ceil(F.col("_rf_cnt") / F.lit(float(rows_per_slice))), F.lit(1))
        span = F.col("_rf_hi") - F.col("_rf_lo")
        slice_expr = F.when(span <= 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("_rf_k") - F.col("_rf_lo")) / span * nslices), nslices - 1)).cast("bigint")
        joined = keyed.join(stats, groups, "inner") if groups else keyed.crossJoin(F.broadcast(stats))
        sliced = joined.withColumn("_rf_slice", slice_expr).drop("_rf_lo", "_rf_hi", "_rf_cnt", "_rf_k")
    local_w = Window.partitionBy(*groups, "_rf_slice").orderBy(*sort_cols)
    local = sliced.withColumn("_rf_local", F.row_number().over(local_w) - 1)
    # counted from the windowed rows so both branches share one shuffle of the input
    counts = local.groupBy(*groups, "_rf_slice").agg(F.count(F.lit(1)).alias("_rf_n"))
    offsets = _prefix_offsets(counts, groups)
    return (local.join(offsets, groups + ["_rf_slice"], "inner")
            .withColumn(out, (F.col("_rf_off") + F.col("_rf_local")).cast("bigint"))
            .drop("_rf_slice", "_rf_local", "_rf_off"))


def sorted_positions(df: DataFrame, group_cols, order_cols, out: str = "pos") -> DataFrame:
    """Add a 0-based bigint ``out`` = row number within ``group_cols`` ordered by ``order_cols``, of any types.

    The rows are sorted by group and order over all tasks, in ranges that Spark cuts
    from the data, so that a hot group or a heavy tail of values fills many tasks
    alike (make the order total: equal rows share a range). The sorted rows are
    written once to the shared folder when this is called, each with its number in
    its task; what a task's rows add is the total of the tasks before it.
    """
    groups, orders = _cols(group_cols), _cols(order_cols)
    keys = [F.col(c) if isinstance(c, str) else c for c in [*groups, *orders]]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    rows = materialize(ranged.withColumn("_rf_part", F.shiftright(number, 33))
                       .withColumn("_rf_local", number.bitwiseAND(F.lit((1 << 33) - 1))), "sorted")
    # one row a task, whatever the data
    before = Window.orderBy("_rf_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_rf_part").agg(F.count(F.lit(1)).alias("_rf_n"))
    offsets = counts.select("_rf_part", F.coalesce(F.sum("_rf_n").over(before), F.lit(0)).alias("_rf_off"))
    placed = rows.join(F.broadcast(offsets), "_rf_part").withColumn(out, F.col("_rf_off") + F.col("_rf_local"))
    placed = placed.drop("_rf_part", "_rf_local", "_rf_off")
    if not groups:
        return placed.withColumn(out, F.col(out).cast("bigint"))
    first = placed.groupBy(*groups).agg(F.min(out).alias("_rf_first"))
    return (placed.join(first, groups).withColumn(out, (F.col(out) - F.col("_rf_first")).cast("bigint"))
            .drop("_rf_first"))


SUPER = 4096


def _prefix_offsets(counts: DataFrame, groups: list) -> DataFrame:
    """Rows before each slice of its group: a two-level prefix sum.

    Slices are summed within super-slices of ``SUPER`` slices, and
    super-slice totals are summed per group, so no window partition holds more
    than ``SUPER`` slice rows or one row per super-slice (rows / 2^28 with
    65,536-wide slices) — bounded even for a group holding most of the data.
    """
    c = counts.withColumn("_rf_sup", F.floor(F.col("_rf_slice") / SUPER).cast("bigint"))
    w1 = Window.partitionBy(*groups, "_rf_sup").orderBy("_rf_slice").rowsBetween(Window.unboundedPreceding, -1)
    inner = c.select(*groups, "_rf_sup", "_rf_slice", F.coalesce(F.sum("_rf_n").over(w1), F.lit(0)).alias("_rf_o1"))
    sup = c.groupBy(*groups, "_rf_sup").agg(F.sum("_rf_n").alias("_rf_t"))
    w2 = (Window.partitionBy(*groups) if groups else Window).orderBy("_rf_sup") \
        .rowsBetween(Window.unboundedPreceding, -1)
    outer = sup.select(*groups, "_rf_sup", F.coalesce(F.sum("_rf_t").over(w2), F.lit(0)).alias("_rf_o2"))
    return (inner.join(outer, [*groups, "_rf_sup"], "inner")
            .select(*groups, "_rf_slice", (F.col("_rf_o1") + F.col("_rf_o2")).alias("_rf_off")))


def exclusive_cut(c: int, n: Column, at: Callable[[Column], Column]) -> Column:
    """Cut point ``c`` (0-based) of Python ``statistics.quantiles(n=100)``.

    Exclusive method, N = ``n`` sorted values, ``at(k)`` returns the k-th
    smallest (1-based). i = c+1; j = clamp(i*(N+1) div 100, 1, N-1);
    delta = i*(N+1) - 100*j; q = (x[j]*(100-delta) + x[j+1]*delta) / 100.
    """
    i = c + 1
    m = F.lit(i) * (n + 1)
    j = F.least(F.greatest(F.floor(m / 100), F.lit(1)), n - 1).cast("bigint")
    delta = m - F.lit(100) * j
    return (at(j) * (F.lit(100) - delta) + at(j + 1) * delta) / F.lit(100.0)


def exclusive_cut_ranks(c: int, n: Column) -> tuple[Column, Column]:
    """0-based ranks read by :func:`exclusive_cut` (j-1 and j)."""
    m = F.lit(c + 1) * (n + 1)
    j = F.least(F.greatest(F.floor(m / 100), F.lit(1)), n - 1).cast("bigint")
    return j - 1, j


def pick_order_stats(df: DataFrame, group_cols, value_col: str,
                     ranks: Callable[[Column], Sequence[Column]],
                     finish: Callable[[Column, Callable[[Column], Column]], Sequence[Column]]) -> DataFrame:
    """Exact order statistics per group by rank-and-pick.

    The ranking is stored when this is called (see :func:`sorted_positions`), in
    ranges cut from the data, so heavy-tailed values fill all tasks alike.
    ``ranks(n)`` lists the 0-based ranks needed given the group size ``n``;
    only those rows survive the filter, so the final aggregate is tiny.
    ``finish(n, at)`` maps ``at(k1)`` (k1 = 1-based rank -> value) to the
    output columns. Rows with a null value are ignored.
    """
    groups = _cols(group_cols)
    vals = df.select(*groups, F.col(value_col).alias("_rf_v")).where(F.col("_rf_v").isNotNull())
    ranked = sorted_positions(vals, groups, ["_rf_v"], out="_rf_r")
    sizes = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rf_cnt"))
    joined = ranked.join(sizes, groups, "inner") if groups else ranked.crossJoin(sizes)
    needed = ranks(F.col("_rf_cnt"))
    picked = joined.where(_any_eq(F.col("_rf_r"), needed))
    # one row per (group, rank): keep them as a map so finish() can look up any rank
    per_group = picked.groupBy(*groups).agg(
        F.first("_rf_cnt").alias("_rf_cnt"),
        F.map_from_entries(F.collect_set(F.struct(F.col("_rf_r"), F.col("_rf_v")))).alias("_rf_m"))

    def at(k1: Column) -> Column:
        return F.try_element_at(F.col("_rf_m"), (k1 - 1).cast("bigint"))

    return per_group.select(*groups, *finish(F.col("_rf_cnt"), at))


def _any_eq(c: Column, options: Sequence[Column]) -> Column:
    cond = None
    for o in options:
        e = c == o
        cond = e if cond is None else (cond | e)
    return cond
