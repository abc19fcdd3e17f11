"""Window operators over step logs.

Ordered windows are never unpartitioned and never one task per run. Rows get a
dense 0-based position per run (``dense``; logs have gaps), are cut into chunks of
``chunk_rows`` consecutive positions, and the last ``w-1`` rows of each chunk are
copied into the next chunk as a halo, so a ``w``-row frame is complete inside
every chunk (requires ``chunk_rows >= w-1``). Running sums use per-chunk totals
plus a prefix over the (small) chunk table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.functions import schedules as S
from runforge.functions.indexing import _prefix_offsets, position_within, sorted_positions
from runforge.session import materialize

CHUNK_ROWS = 1 << 16


def _nan_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def dense(df: DataFrame, run_id: str, pos: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_rf_pos``: the row's 0-based rank along ``pos`` within its run."""
    return position_within(df, [run_id], [pos], out="_rf_pos", slice_width=max(chunk_rows, 1))


def with_halo(df: DataFrame, run_id: str, pos: str, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Assign ``_rf_chunk`` = pos div R and append halo copies of each chunk's
    last ``halo`` rows to the next chunk (``_rf_halo`` true on copies)."""
    R = max(chunk_rows, halo, 1)
    chunk = F.floor(F.col(pos) / R).cast("bigint")
    own = df.withColumn("_rf_chunk", chunk).withColumn("_rf_halo", F.lit(False))
    if halo <= 0:
        return own
    copies = (df.where(F.pmod(F.col(pos), F.lit(R)) >= R - halo)
              .withColumn("_rf_chunk", chunk + 1).withColumn("_rf_halo", F.lit(True)))
    return own.unionByName(copies)


def _chunk_window(run_id: str) -> Window:
    return Window.partitionBy(run_id, "_rf_chunk").orderBy("_rf_pos")


def _chunked(log: DataFrame, run_id: str, pos: str, halo: int, chunk_rows: int) -> DataFrame:
    return with_halo(dense(log, run_id, pos, chunk_rows), run_id, "_rf_pos", halo, chunk_rows)


def _drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_rf_halo")).drop("_rf_halo", "_rf_chunk", "_rf_pos")


# ---------------------------------------------------------------- W1, W2, W4
def _trailing_sums(log: DataFrame, ks, run_id: str, pos: str, chunk_rows: int, x: Column) -> DataFrame:
    """Per row and k: sum and count of the values ``x`` that are not null among the last k rows.

    Positions are cut into segments of k rows. The last k rows of any row are the
    end of one segment and the beginning of the next, so their sum is a sum from
    the segment's end plus one from its beginning, and nothing is subtracted: an infinite
    or huge loss reaches just the k rows that hold it. Either sum is a running one, the
    one from the end along descending positions (a frame from the current row to the
    segment's end would be added up anew for every row), so k costs nothing.
    """
    c = _chunked(log.select(run_id, pos, "loss"), run_id, pos, max(ks), chunk_rows)
    cols = []
    for k in ks:
        segment = Window.partitionBy(run_id, "_rf_chunk", F.floor(F.col("_rf_pos") / k))
        first = segment.orderBy("_rf_pos").rowsBetween(Window.unboundedPreceding, 0)
        rest = segment.orderBy(F.col("_rf_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
        c = (c.withColumn(f"_rf_a{k}", F.coalesce(F.sum(x).over(first), F.lit(0.0)))
             .withColumn(f"_rf_b{k}", F.coalesce(F.sum(x).over(rest), F.lit(0.0)))
             .withColumn(f"_rf_c{k}", F.count(x).over(first)).withColumn(f"_rf_d{k}", F.count(x).over(rest)))
    w = _chunk_window(run_id)
    for k in ks:
        whole = F.pmod(F.col("_rf_pos"), F.lit(k)) == k - 1  # the segment itself

        def before(name, zero):
            return F.when(whole, zero).otherwise(F.coalesce(F.lag(name, k - 1).over(w), zero))  # noqa: B023

        cols += [(F.col(f"_rf_a{k}") + before(f"_rf_b{k}", F.lit(0.0))).alias(f"_rf_s{k}"),
                 (F.col(f"_rf_c{k}") + before(f"_rf_d{k}", F.lit(0))).alias(f"_rf_n{k}")]
    return c.select(run_id, pos, "loss", *cols, "_rf_halo", "_rf_chunk", "_rf_pos")


def trailing_loss(log: DataFrame, ks=(100, 1000), run_id: str = "run_id", pos: str = "step",
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean of the last k losses with NaN/null dropped after taking the k
    rows; null when none is left. One column ``loss_<k>`` per k."""
    t = _trailing_sums(log, ks, run_id, pos, chunk_rows, _nan_null("loss"))
    cols = [F.when(F.col(f"_rf_n{k}") > 0, F.col(f"_rf_s{k}") / F.col(f"_rf_n{k}")).alias(f"loss_{k}")
            for k in ks]
    return _drop_halo(t.select(run_id, pos, "loss", *cols, "_rf_halo", "_rf_chunk"))


def rolling_mean(log: DataFrame, window: int = 1000, run_id: str = "run_id", pos: str = "step",
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``window``-row rolling mean, null unless all ``window`` losses of the frame are finite numbers.

    An infinite loss counts as missing, as NaN does, here and in W3 (the rule of
    dataframe rolling windows); W1 drops only NaN.
    """
    finite = F.when(F.abs(_nan_null("loss")) < float("inf"), F.col("loss"))
    t = _trailing_sums(log, (window,), run_id, pos, chunk_rows, finite)
    out = F.when(F.col(f"_rf_n{window}") == window, F.col(f"_rf_s{window}") / F.lit(float(window)))
    return _drop_halo(t.select(run_id, pos, "loss", out.alias("rolling_mean"), "_rf_halo", "_rf_chunk"))


def loss_diff(log: DataFrame, run_id: str = "run_id", pos: str = "step",
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First difference of loss along the run."""
    c = _chunked(log.select(run_id, pos, "loss"), run_id, pos, 1, chunk_rows)
    d = (F.col("loss") - F.lag("loss").over(_chunk_window(run_id))).alias("loss_diff")
    return _drop_halo(c.select(run_id, pos, "loss", d, "_rf_halo", "_rf_chunk"))


# ---------------------------------------------------------------- W3
def rolling_band(log: DataFrame, window: int = 1000, smooth: int = 10, qs=(0.05, 0.95),
                 run_id: str = "run_id", pos: str = "step", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``window``-row rolling linear quantiles of loss, then a ``smooth``-row
    mean of each (both need full frames of finite values, see W2).

    A quantile per row over a 1000-row frame is O(n·w) as a SQL frame
    aggregate; here each halo chunk is one pandas frame whose rolling quantile
    keeps a sorted window (O(n log w)), shipped through Arrow.
    """
    halo = window + smooth - 2
    c = _chunked(log.select(run_id, pos, "loss"), run_id, pos, halo, chunk_rows)
    names = [f"band_q{int(round(q * 100)):02d}" for q in qs]
    schema = f"{run_id} {dict(log.dtypes)[run_id]}, {pos} {dict(log.dtypes)[pos]}, " + \
        ", ".join(f"{n} double" for n in names)

    def per_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rf_pos")
        out = pdf[[run_id, pos]].copy()
        x = pdf["loss"].astype("float64")
        for n, q in zip(names, qs):
            out[n] = x.rolling(window).quantile(q).rolling(smooth).mean().to_numpy()
        return out[~pdf["_rf_halo"].to_numpy()]

    return c.groupBy(run_id, "_rf_chunk").applyInPandas(per_chunk, schema)


# ---------------------------------------------------------------- W5, W6
def running_sum(df: DataFrame, value: str, out: str, group: list[str], pos: str,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact running sum of ``value`` per ``group`` along dense ``pos``:
    chunk totals, a prefix over the chunk table, then a local running sum."""
    R = max(chunk_rows, 1)
    c = df.withColumn("_rf_chunk", F.floor(F.col(pos) / R).cast("bigint"))
    tot = c.groupBy(*group, F.col("_rf_chunk").alias("_rf_slice")).agg(F.sum(value).alias("_rf_n"))
    offs = _prefix_offsets(tot, list(group)).withColumnRenamed("_rf_slice", "_rf_chunk")
    lw = Window.partitionBy(*group, "_rf_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = c.withColumn("_rf_run", F.sum(value).over(lw))
    return (local.join(offs, group + ["_rf_chunk"], "inner")
            .withColumn(out, F.col("_rf_off") + F.col("_rf_run"))
            .drop("_rf_chunk", "_rf_off", "_rf_run"))


def cumulative_tokens(log: DataFrame, run_id: str = "run_id", pos: str = "step",
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running token total per run (the step axis itself is not accumulated)."""
    base = log.select(run_id, pos, "num_tokens")
    return running_sum(base, "num_tokens", "cumulative_tokens", [run_id], pos, chunk_rows) \
        .withColumn("cumulative_tokens", F.col("cumulative_tokens").cast("bigint"))


def token_rate(log: DataFrame, run_id: str = "run_id", pos: str = "step",
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cumulative token rate = tokens since the session start / max(total_time, 1).

    A session starts where ``total_time`` decreases (a resumed run restarts its
    clock and its counter). Session ids are a running sum of restart flags; the
    session's token base is the run total just before its first row. A null
    ``num_tokens`` counts as 0.
    """
    base = log.select(run_id, pos, F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"), "total_time")
    c = _chunked(base, run_id, pos, 1, chunk_rows)
    prev = F.lag("total_time").over(_chunk_window(run_id))
    flagged = _drop_halo(c.withColumn("_rf_new", F.when(F.col("total_time") < prev, 1).otherwise(0)))
    with_sess = running_sum(flagged, "_rf_new", "session", [run_id], pos, chunk_rows)
    with_cum = running_sum(with_sess, "num_tokens", "_rf_cum", [run_id], pos, chunk_rows)
    starts = with_cum.groupBy(run_id, "session").agg(
        F.min_by(F.col("_rf_cum") - F.col("num_tokens"), pos).alias("_rf_base"))
    j = with_cum.join(starts, [run_id, "session"], "inner")
    tokens = (F.col("_rf_cum") - F.col("_rf_base")).cast("bigint")
    return j.select(run_id, pos, F.col("session").cast("bigint").alias("session"),
                    tokens.alias("session_tokens"),
                    (tokens / F.greatest(F.col("total_time"), F.lit(1.0))).alias("token_rate"))


# ---------------------------------------------------------------- W7
def _cut_index(n: np.ndarray | int, i: int):
    """1-based rank of the lower element of exclusive cut point i-1 over n values."""
    m = i * (np.asarray(n) + 1)
    return np.clip(m // 100, 1, np.asarray(n) - 1), m


def prefix_kth(ranks: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the k-th smallest (from 0) of the first ``upto`` of ``ranks``, distinct numbers from 0.

    A wavelet matrix, bit by bit from the highest: all queries step together, counting
    the zeros of their range, in O((n + queries) log n).
    """
    row, lo, hi, k = ranks, np.zeros(len(k), dtype=np.int64), upto.copy(), k.copy()
    found = np.zeros(len(k), dtype=np.int64)
    for bit in range(max(int(len(ranks) - 1).bit_length(), 1) - 1, -1, -1):
        one = (row >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        zlo, zhi = zeros[lo], zeros[hi]
        up = k >= zhi - zlo
        found = found * 2 + up
        k = np.where(up, k - (zhi - zlo), k)
        lo, hi = np.where(up, zeros[-1] + lo - zlo, zlo), np.where(up, zeros[-1] + hi - zhi, zhi)
        row = np.concatenate([row[~one], row[one]])
    return found


def clip_threshold(log: DataFrame, max_norm: float = 1.0, pct: int = 90, run_id: str = "run_id",
                   pos: str = "step", norm: str = "grad_norm", min_history: int = 100,
                   chunk_rows: int = CHUNK_ROWS, every: int = 1, session: str | None = None,
                   each_step: bool = False) -> DataFrame:
    """Expanding-percentile clip threshold per logged step.

    Norms are recorded from step 1 on (step 0 records none and logs no
    threshold), with gradient accumulation at the last step of ``every`` only;
    other steps record and clip nothing. ``session`` names a column that numbers
    a run's sessions: a resumed run starts with an empty history. ``each_step`` is
    the other trainer's rule: steps that are multiples of ``every`` record, and all
    steps clip by the history so far. Writes stages when called. At step s the history holds the norms of steps 1..s, current
    one included; with fewer than ``min_history`` the threshold is
    ``max_norm``, else exclusive cut point ``pct`` of the history. Falsy
    ``max_norm``: no clipping (null); falsy ``pct``: constant ``max_norm``.
    ``clipped`` = norm > threshold.

    Exact and chunked, never one run per task. With histories cut into chunks
    of C rows, the k-th smallest of prefix P_a ∪ Q_t (P_a = rows before the
    chunk, |Q_t| ≤ C) has P_a-rank in [k - C, k]; so each chunk needs only the
    window of P_a between ranks k_min - C and k_max (about 1.9·C values). That
    window is found through a (chunk × value-block) count table: prefix counts
    over chunks, cumulative over blocks, then an equi-join on the covering
    blocks. Each chunk is finished in one pandas group holding its window and
    its own rows (a wavelet matrix over their ranks, see :func:`prefix_kth`).
    """
    if session or every > 1 or each_step:
        return _clip_gated(log, max_norm, pct, run_id, pos, norm, min_history, chunk_rows, every, session, each_step)
    C = max(int(chunk_rows), 2)
    base = log.select(run_id, pos, F.col(norm).cast("double").alias(norm))
    out_schema = f"{run_id} {dict(log.dtypes)[run_id]}, {pos} {dict(log.dtypes)[pos]}, " \
                 f"{norm} double, clip_threshold double, clipped boolean"
    if not max_norm or not pct:
        thr = F.when(F.col(pos) > 0, F.lit(float(max_norm)) if max_norm else F.lit(None).cast("double"))
        return base.select(run_id, pos, norm, thr.alias("clip_threshold"),
                           (F.col(norm) > thr).alias("clipped"))
    i = pct + 1
    rec = base.where(F.col(pos) > 0)
    # p: 0-based history position; g: 0-based global value rank within the run
    rec = position_within(rec, [run_id], [pos], out="_rf_p", slice_width=C)
    rec = sorted_positions(rec, [run_id], [norm, "_rf_p"], out="_rf_g")
    rec = rec.withColumn("_rf_c", F.floor(F.col("_rf_p") / C).cast("bigint")) \
             .withColumn("_rf_b", F.floor(F.col("_rf_g") / C).cast("bigint"))
    # the ranked history feeds four branches below: store it once
    rec = materialize(rec)
    cnt = rec.groupBy(run_id, "_rf_c", "_rf_b").agg(F.count(F.lit(1)).alias("_rf_n"))
    nchunks = rec.groupBy(run_id).agg((F.max("_rf_c") + 1).alias("_rf_nc"))
    grid = (nchunks.select(run_id, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rf_nc") - 1)).alias("_rf_c"),
                           "_rf_nc")
            .select(run_id, "_rf_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rf_nc") - 1)).alias("_rf_b")))
    grid = grid.join(cnt, [run_id, "_rf_c", "_rf_b"], "left").fillna(0, ["_rf_n"])
    w_prev = Window.partitionBy(run_id, "_rf_b").orderBy("_rf_c").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_rf_pre", F.coalesce(F.sum("_rf_n").over(w_prev), F.lit(0)))
    w_cum = Window.partitionBy(run_id, "_rf_c").orderBy("_rf_b").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_rf_cum", F.sum("_rf_pre").over(w_cum))
    # needed P_a ranks of chunk c (a = c*C rows before it; history sizes n in [a+1, a+C])
    a = F.col("_rf_c") * C
    n_lo = F.greatest(a + 1, F.lit(min_history))
    n_hi = a + C

    def jcol(n):
        return F.least(F.greatest(F.floor(F.lit(i) * (n + 1) / 100), F.lit(1)), n - 1).cast("bigint")

    lo = F.greatest(jcol(n_lo) - C, F.lit(1))
    hi = F.least(jcol(n_hi) + 1, a)
    win = (grid.withColumn("_rf_lo", lo).withColumn("_rf_hi", hi)
           .groupBy(run_id, "_rf_c", "_rf_lo", "_rf_hi").agg(
               F.min(F.when(F.col("_rf_cum") >= F.col("_rf_lo"), F.col("_rf_b"))).alias("_rf_b_lo"),
               F.min(F.when(F.col("_rf_cum") >= F.col("_rf_hi"), F.col("_rf_b"))).alias("_rf_b_hi"),
               F.coalesce(F.max(F.when(F.col("_rf_cum") < F.col("_rf_lo"), F.col("_rf_cum"))), F.lit(0))
               .alias("_rf_base"))
           .where((F.col("_rf_c") * C >= 1) & (F.col("_rf_hi") >= F.col("_rf_lo"))
                  & ((F.col("_rf_c") + 1) * C >= min_history)))
    blocks = win.select(run_id, "_rf_c", "_rf_lo", "_rf_hi", "_rf_base",
                        F.explode(F.sequence("_rf_b_lo", "_rf_b_hi")).alias("_rf_b"))
    cand = (blocks.join(rec.select(run_id, "_rf_b", F.col("_rf_p").alias("_rf_q"), "_rf_g", norm),
                        [run_id, "_rf_b"], "inner")
            .where(F.col("_rf_q") < F.col("_rf_c") * C))
    rw = Window.partitionBy(run_id, "_rf_c").orderBy("_rf_g")
    cand = cand.withColumn("_rf_r", F.col("_rf_base") + F.row_number().over(rw))
    window_rows = cand.where((F.col("_rf_r") >= F.col("_rf_lo")) & (F.col("_rf_r") <= F.col("_rf_hi"))).select(
        run_id, "_rf_c", F.lit(None).cast(dict(log.dtypes)[pos]).alias(pos), F.lit(-1).cast("bigint").alias("_rf_p"),
        "_rf_g", norm, (F.col("_rf_lo") - 1).alias("_rf_below"))
    own = rec.select(run_id, "_rf_c", pos, "_rf_p", "_rf_g", norm, F.lit(None).cast("bigint").alias("_rf_below"))
    both = window_rows.unionByName(own)

    def per_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["_rf_p"] >= 0].sort_values("_rf_p")
        earlier = pdf[pdf["_rf_p"] < 0]
        below = int(earlier["_rf_below"].iloc[0]) if len(earlier) else 0
        g = np.concatenate([earlier["_rf_g"].to_numpy(), mine["_rf_g"].to_numpy()])
        order = np.argsort(g)
        ranks = np.empty(len(g), dtype=np.int64)
        ranks[order] = np.arange(len(g))
        x = mine[norm].to_numpy()
        vals = np.concatenate([earlier[norm].to_numpy(), x])[order]
        n = mine["_rf_p"].to_numpy().astype(np.int64) + 1
        thr = np.full(len(mine), float(max_norm))
        full = np.flatnonzero(n >= min_history)
        j, m = _cut_index(n[full], i)
        upto = len(earlier) + full + 1
        lo_v = vals[prefix_kth(ranks, upto, j - below - 1)]
        hi_v = vals[prefix_kth(ranks, upto, j - below)]
        d = m - 100 * j
        thr[full] = (lo_v * (100 - d) + hi_v * d) / 100.0
        return pd.DataFrame({run_id: mine[run_id].to_numpy(), pos: mine[pos].to_numpy(), norm: x,
                             "clip_threshold": thr, "clipped": x > thr})

    done = both.groupBy(run_id, "_rf_c").applyInPandas(per_chunk, out_schema)
    first = base.where(F.col(pos) <= 0).select(run_id, pos, norm, F.lit(None).cast("double").alias("clip_threshold"),
                                                 F.lit(None).cast("boolean").alias("clipped"))
    return done.unionByName(first)


def _clip_gated(log: DataFrame, max_norm: float, pct: int, run_id: str, pos: str, norm: str, min_history: int,
                chunk_rows: int, every: int, session: str | None, each_step: bool) -> DataFrame:
    """:func:`clip_threshold` of the recorded steps, each session a history of its own, given back to all steps."""
    own = F.struct(F.col(run_id).alias("run"), (F.col(session) if session else F.lit(0)).alias("session"))
    base = log.select(F.to_json(own).alias("_rf_h"), run_id, pos, F.col(norm).cast("double").alias(norm))
    step = F.col(pos)
    recorded = (step > 0) & (F.pmod(step if each_step else step + 1, F.lit(every)) == 0)
    made = materialize(clip_threshold(base.where(recorded).select("_rf_h", pos, norm), max_norm, pct, "_rf_h", pos, norm,
                                      min_history, chunk_rows).select("_rf_h", pos, "clip_threshold"), "thresholds")
    if each_step:
        lines = base.select("_rf_h", F.col(pos).alias("step"))
        known = made.select("_rf_h", F.col(pos).alias("step"), F.col("clip_threshold").alias("mean"), F.col(pos).alias("line_no"))
        held = last_eval_asof(lines, known, "_rf_h", chunk_rows=chunk_rows)
        start = F.lit(float(max_norm)) if max_norm else F.lit(None).cast("double")
        made = held.select("_rf_h", F.col("step").alias(pos), F.when(F.col("last_eval") > 0, F.col("last_eval")).otherwise(start)
                           .alias("clip_threshold"))
    out = base.join(made, ["_rf_h", pos], "left")
    return out.select(run_id, pos, norm, "clip_threshold", (F.col(norm) > F.col("clip_threshold")).alias("clipped"))


# ---------------------------------------------------------------- W8, W9
def derive_epoch(log: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Epoch 0 at step 0, +1 after every step with step % E == 0 (= ceil(step / E))."""
    return log.withColumn("epoch", F.ceil(F.col("step") / F.lit(steps_per_epoch)).cast("bigint"))


def resume_state(log: DataFrame, run_id: str = "run_id", order_col: str = "step") -> DataFrame:
    """Where a run resumes: last line's step + 1 and its epoch (0, 0 for an
    empty run). Lines that failed to parse are skipped (see IO1)."""
    g = log.groupBy(run_id).agg(F.max_by(F.struct("step", "epoch"), order_col).alias("_rf_last"))
    return g.select(run_id,
                    F.coalesce(F.col("_rf_last.step") + 1, F.lit(0)).cast("bigint").alias("resume_step"),
                    F.coalesce(F.col("_rf_last.epoch"), F.lit(0)).cast("bigint").alias("resume_epoch"))


# ---------------------------------------------------------------- W10
def last_eval_asof(log: DataFrame, ev: DataFrame, run_id: str = "run_id", value: str = "mean",
                   order_col: str = "line_no", chunk_rows: int = CHUNK_ROWS,
                   session: str | None = None) -> DataFrame:
    """As-of join — the last eval ``value`` known at each logged step, the
    eval of the same step included; 0.0 before the first one. Step-0 evals are
    start-up evals and do not count; several evals at one step: the last line.
    With ``session`` (a column of ``log``, e.g. from :func:`token_rate`), the
    lookup restarts at every session, as the in-memory eval series does after a
    resume; evals take the session of the logged step they belong to.

    Union of both sides on the step axis, then a forward fill: within a chunk
    by ``last(ignorenulls)``, across chunks from a prefix over chunk tails.
    """
    if session:
        sess = log.select(run_id, "step", session)
        ev = ev.join(sess, [run_id, "step"], "inner")
        key = F.concat_ws("#", F.col(run_id).cast("string"), F.col(session).cast("string"))
        out = last_eval_asof(log.withColumn("_rf_rs", key), ev.withColumn("_rf_rs", key), "_rf_rs", value,
                             order_col, chunk_rows)
        keys = log.select(run_id, "step", key.alias("_rf_rs"))
        return out.join(keys, ["_rf_rs", "step"], "inner").select(run_id, "step", "last_eval")
    e = (ev.where(F.col("step") > 0).groupBy(run_id, "step")
         .agg(F.max_by(value, order_col).alias("_rf_v"))
         .select(run_id, "step", "_rf_v", F.lit(0).alias("_rf_kind")))
    s = log.select(run_id, "step", F.lit(None).cast("double").alias("_rf_v"), F.lit(1).alias("_rf_kind"))
    u = e.unionByName(s).withColumn("_rf_chunk", F.floor(F.col("step") / max(chunk_rows, 1)).cast("bigint"))
    w = (Window.partitionBy(run_id, "_rf_chunk").orderBy("step", "_rf_kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    local = u.withColumn("_rf_ff", F.last("_rf_v", ignorenulls=True).over(w))
    tails = (u.where(F.col("_rf_v").isNotNull()).groupBy(run_id, "_rf_chunk")
             .agg(F.max_by("_rf_v", "step").alias("_rf_tail")))
    # carry into chunk k = the last tail among chunks < k (chunk table: rows / chunk_rows)
    pw = Window.partitionBy(run_id).orderBy("_rf_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry2 = (u.select(run_id, "_rf_chunk").distinct().join(tails, [run_id, "_rf_chunk"], "left")
              .select(run_id, "_rf_chunk", F.last("_rf_tail", ignorenulls=True).over(pw).alias("_rf_carry")))
    out = (local.where(F.col("_rf_kind") == 1)
           .join(carry2, [run_id, "_rf_chunk"], "left")
           .select(run_id, "step",
                   F.coalesce(F.col("_rf_ff"), F.col("_rf_carry"), F.lit(0.0)).alias("last_eval")))
    return out


# ---------------------------------------------------------------- W11
def expected_lr(step: Column, kind: str, params: dict, lag: int = 1, every=1, resumed=0) -> Column:
    """Expected logged lr at ``step``.

    The trainer reads the rate at the top of a step and moves the scheduler at the end
    of every ``every``-th one (gradient accumulation), telling it the step's number. So
    a linear log shows the schedule at the last step that moved it, and at 0 until one
    has since the run started or was ``resumed``. ``lag=0``: read at the end of the step.
    """
    done = step + F.lit(1 - lag)  # training steps done when the rate is read
    if kind == "exponential":
        return S.exponential_warmup_cooldown(done, **params, every=every, resumed=resumed)
    every, resumed = S._c(every), S._c(resumed)
    moved = (F.floor(done / every) * every).cast("bigint") - 1
    s = F.when(moved >= F.greatest(resumed, F.lit(0)), moved).otherwise(F.lit(0))
    if kind == "linear":
        return S.linear_warmup_cooldown(s, **params)
    if kind == "sinusoid":
        return S.trapezoid_sinusoid(s, **params)
    raise ValueError(f"unknown schedule kind {kind!r}")


def _with_drift(log: DataFrame, rel_tol: float) -> DataFrame:
    return log.withColumn("drift", F.abs(F.col("lr") - F.col("expected_lr")) >
                          F.lit(rel_tol) * F.greatest(F.abs(F.col("expected_lr")), F.lit(1e-30)))


def lr_audit(log: DataFrame, kind: str, params: dict, lag: int = 1, rel_tol: float = 1e-6,
             run_id: str = "run_id", every=1, resumed=0) -> DataFrame:
    """Expected vs logged lr per step; ``drift`` where they differ by more
    than ``rel_tol`` relative. Filter on ``drift`` for the drift rows."""
    exp = expected_lr(F.col("step"), kind, params, lag, every, resumed)
    return _with_drift(log.select(run_id, "step", "lr", exp.alias("expected_lr")), rel_tol)


def lr_audit_config(log: DataFrame, config: dict, rel_tol: float = 1e-6, run_id: str = "run_id") -> DataFrame:
    """W11 from one training configuration (see :func:`runforge.functions.schedules.schedule_from_config`)."""
    kind, params = S.schedule_from_config(config)
    every = config.get("gradient_accumulation_steps") or 1
    return lr_audit(log, kind, params, lag=1, rel_tol=rel_tol, run_id=run_id, every=every)


def lr_audit_runs(log: DataFrame, configs: DataFrame, rel_tol: float = 1e-6, run_id: str = "run_id",
                  resumed: str | None = None) -> DataFrame:
    """W11 for many runs, each with its own settings, in one job.

    ``configs`` has a row a run: ``scheduler_type`` (null: linear), the settings of its
    schedule and ``gradient_accumulation_steps``; absent columns and nulls take the
    trainer's defaults. ``resumed`` names a log column with the step at which the row's
    session started (see :func:`token_rate`). A run without a configuration has no
    expected rate.
    """
    have = set(configs.columns)
    joined = log.join(configs.select(run_id, F.struct(*[c for c in configs.columns if c != run_id]).alias("_rf_cfg")), run_id, "left")

    def given(name, default):
        if name not in have:
            return F.lit(default)
        return F.coalesce(F.col("_rf_cfg")[name], F.lit(default)) if default is not None else F.col("_rf_cfg")[name]

    every = given("gradient_accumulation_steps", 1)
    start = F.col(resumed) if resumed else F.lit(0)
    named = given("scheduler_type", "linear")
    expected = F.lit(None).cast("double")
    for kind, defaults in (("linear", S.LINEAR_DEFAULTS), ("exponential", S.EXPONENTIAL_DEFAULTS)):
        settings = {k: given(k, v) for k, v in defaults.items()}
        names = [n for n, k in S.KINDS.items() if k == kind]
        expected = F.when(named.isin(names), expected_lr(F.col("step"), kind, settings, 1, every, start)).otherwise(expected)
    known = F.when(F.col("_rf_cfg").isNotNull(), expected)
    return _with_drift(joined.select(run_id, "step", "lr", known.alias("expected_lr")), rel_tol)
