"""Live trailing losses with state that ends (T3): ``transformWithState`` over list, map and value state, and timers.

``steplog.stream_trailing`` rewrites two arrays of a thousand numbers for each run and
batch, and keeps each run for ever. Here a run's newest losses lie in blocks of
``BLOCK`` steps, an entry of a map state each; a list state holds each block's number of
rows and sum. A batch rewrites the blocks that its lines fall into, and a mean adds up
the sums of whole blocks and reads the one block that its window cuts. A timer, moved on
by every batch of the run, removes all of a run's state once it has been idle.

This needs the RocksDB state store; :func:`run_timed` starts a query with it and leaves the
session's setting as it was. With timers by the clock it runs one batch: Spark always has
another one to run then, so a query that should stop when all is read never would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runforge.streaming.steplog import TRAILING_OUT, run_available

WINDOWS = (100, 1000)
BLOCK = 128
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrailingRuns(StatefulProcessor):
    """Means of a run's newest losses, totals, token rate and last eval; see ``steplog.stream_trailing`` for the rules."""

    def __init__(self, idle_ms: int, event_time: bool) -> None:
        self.idle_ms, self.event_time = idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "tokens long, seen long, session_step long, session_tokens long, last_step long, "
                                                     "clock double, eval_step long, eval_mean double")
        self.blocks = handle.getListState("blocks", "block long, n int, valid int, total double")
        self.losses = handle.getMapState("losses", "block long", "steps array<long>, losses array<double>")

    def _add(self, new: list[tuple[int, float | None]]) -> dict[int, tuple[int, int, float]]:
        """Put (step, loss) rows into their blocks and let go of blocks behind the longest window; the blocks' numbers."""
        blocks = {r[0]: (r[1], r[2], r[3]) for r in self.blocks.get()} if self.blocks.exists() else {}
        touched: dict[int, list] = {}
        for step, loss in new:
            touched.setdefault(step // BLOCK, []).append((step, loss))
        for block, rows in touched.items():
            held = self.losses.getValue((block,)) if block in blocks else None
            rows = sorted((list(zip(held[0], held[1])) if held else []) + rows, key=lambda x: x[0])
            valid = [x for _, x in rows if x is not None]
            self.losses.updateValue((block,), ([s for s, _ in rows], [x for _, x in rows]))
            blocks[block] = (len(rows), len(valid), float(sum(valid)))
        left = sum(n for n, _, _ in blocks.values())
        for block in sorted(blocks):
            if left - blocks[block][0] < max(WINDOWS):
                break
            left -= blocks.pop(block)[0]
            if self.losses.containsKey((block,)):
                self.losses.removeKey((block,))
        if blocks:
            self.blocks.put([(b, *blocks[b]) for b in sorted(blocks)])
        return blocks

    def _mean(self, blocks: dict[int, tuple[int, int, float]], k: int) -> float | None:
        count, total = 0, 0.0
        for block in sorted(blocks, reverse=True):
            n, valid, own = blocks[block]
            if n <= k:
                count, total, k = count + valid, total + own, k - n
            else:
                kept = [x for x in self.losses.getValue((block,))[1][n - k:] if x is not None] if k else []
                count, total, k = count + len(kept), total + sum(kept), 0
            if not k:
                break
        return total / count if count else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.totals.get()
        tokens, seen, s_step, s_tokens, last, clock, e_step, e_mean = had if had else (0, 0, 0, 0, -1, None, None, None)
        newest: list[tuple[int, float | None]] = []
        lines, moment = [], None
        for p in rows:
            if self.event_time and p["time"].notna().any():
                top = int(p["time"].max().timestamp() * 1000)
                moment = top if moment is None else max(moment, top)
            evals = p[p["is_eval"]].sort_values("step")
            if len(evals) and (e_step is None or evals["step"].iloc[-1] >= e_step):
                e_step, e_mean = int(evals["step"].iloc[-1]), float(evals["loss"].iloc[-1])
            own = p[~p["is_eval"]]
            newest += [(int(s), None if pd.isna(x) else float(x)) for s, x in zip(own["step"], own["loss"])]
            newest = sorted(newest, key=lambda x: x[0])[-max(WINDOWS):]
            lines.append(own[["step", "num_tokens", "total_time"]])
        batch = pd.concat(lines).sort_values("step", kind="stable") if lines else pd.DataFrame()
        for step, n, t in batch.itertuples(index=False):
            n = 0 if pd.isna(n) else int(n)
            tokens, seen = tokens + n, seen + 1
            if step < last:  # a late line counts, but is not the newest
                s_tokens += n if step >= s_step else 0
                continue
            t = None if pd.isna(t) else float(t)
            if t is not None and clock is not None and t < clock:  # the clock starts anew with a session
                s_step, s_tokens = int(step), 0
            last, clock, s_tokens = int(step), clock if t is None else t, s_tokens + n
        blocks = self._add(newest)
        self.totals.update((tokens, seen, s_step, s_tokens, last, clock, e_step, e_mean))
        self._wait(timerValues, moment)
        row = {"run_id": key[0], "step": last, "total_tokens": tokens, "steps_seen": seen,
               "token_rate": None if clock is None else s_tokens / max(clock, 1.0), "last_eval": 0.0 if e_mean is None else e_mean}
        row.update({f"loss_{k}": self._mean(blocks, k) for k in WINDOWS})
        yield pd.DataFrame([row])[TRAILING_OUT.names]

    def _wait(self, timerValues, moment: int | None) -> None:
        """One timer a run: after its last line by event time, or after now."""
        if self.event_time:
            at = max(moment or 0, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        else:
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        for old in list(self.handle.listTimers()):
            if self.event_time and old > at:
                return  # a late batch does not bring the end nearer
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.totals, self.blocks, self.losses):
            state.clear()
        yield from ()


def stream_trailing_timed(sdf: DataFrame, evals: DataFrame | None = None, idle_seconds: float = 86_400,
                          watermark: str | None = None) -> DataFrame:
    """T3 with timed state: the rows of ``stream_trailing``, and a run idle for ``idle_seconds`` leaves the state store.

    Idle is measured by the clock, or, with a ``watermark`` delay on the step log's ``time``,
    by event time (then without ``evals``, which have none; lines behind the watermark are
    dropped). A run that logs again after it has left starts anew. State of a run: some
    1,000 losses in blocks, one row a block, and eight numbers. Start the query with
    :func:`run_timed`, or with the RocksDB state store set.
    """
    if watermark and evals is not None:
        raise ValueError("evals have no event time: measure idle time by the clock")
    clock = F.col("total_time") if "total_time" in sdf.columns else F.lit(None)
    steps = sdf.withWatermark("time", watermark) if watermark else sdf
    rows = steps.select("run_id", "step", F.col("loss").cast("double").alias("loss"), F.col("num_tokens").cast("double").alias("num_tokens"),
                        clock.cast("double").alias("total_time"), F.lit(False).alias("is_eval"), *(["time"] if watermark else []))
    if evals is not None:
        none = F.lit(None).cast("double")
        rows = rows.unionByName(evals.where("step > 0").select(
            "run_id", "step", F.col("mean").cast("double").alias("loss"), none.alias("num_tokens"), none.alias("total_time"),
            F.lit(True).alias("is_eval")))
    return rows.groupBy("run_id").transformWithStateInPandas(
        TrailingRuns(int(idle_seconds * 1000), bool(watermark)), TRAILING_OUT, "update", "EventTime" if watermark else "ProcessingTime")


def run_timed(sdf: DataFrame, sink: str, checkpoint: str, mode: str = "update", by_clock: bool = True) -> None:
    """``steplog.run_available`` with the RocksDB state store for this query alone; in one batch if idle time is ``by_clock``."""
    conf = sdf.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        run_available(sdf, sink, checkpoint, mode, one_batch=by_clock)
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)
