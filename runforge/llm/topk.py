"""Exact top-k search by distributed histogram selection.

Every query meets every candidate, block by block, in each pass. The first passes
keep no scores, only a histogram a query: of the leading bits of the score, then of
the next bits of the scores that share the leading bits of the k-th best so far, until
all bits of each query's k-th best score are known. A last pass emits the scores over
it, and of those equal to it the smallest ids of each block, and a ranking over these
few rows breaks the ties.

A block of queries times a block of candidates is scored as a matrix product. Blocks
meet in tiles, some query blocks times some candidate blocks, each a group of its own:
a query block is copied once a column of tiles and a candidate block once a row of
tiles, by a shuffle, and never through the driver. Only counts and winners leave a tile:
of a query's histogram the non-zero bins down to the one where the tile's candidates
reach the k-th place (k at most). Scores below that bin are not looked at again. Spark
sums the rows (query, bin, count) of all tiles. All queries against all rows is the work
asked for, so time grows with the square of the table; a tile's memory does not.

Components are ``floor(scale * x)`` with x as double; scores are exact integer inner
products (components up to 2^26 or so in size).

Cases: a vector that is null or holds a null, NaN or infinity takes no part, as query
or candidate, and so does a null id; of rows with the same id the least vector stays;
vectors of different lengths have no score; a query with fewer than k candidates
returns them all; no vectors or no queries give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.llm.common import one, prepare
from runforge.session import materialize

#: Bits of the score that one pass settles.
PASS_BITS = 9
#: Bins, or winners, that a tile holds for all its queries, or for one block of them.
HELD = 1 << 21
#: Tiles wanted, so that tasks are many; pairs that a tile has at least, if the table has so many.
TILES, PAIRS = 64, 1 << 23
#: Components of a tile's candidates at most, or one block; tasks that tiles are dealt to at most.
VALUES, TASKS = 1 << 21, 1024


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, dim, norm): valid vectors as integers, one row an id."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("id"),
                               F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))
    return (rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
            .withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)))


def packed(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """One row a block: its dimension, ids and matrix."""
    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(one(group.column("id"))))
        ids = np.asarray(one(group.column("id")))[order]
        flat = np.asarray(one(group.column("v")).flatten()).reshape(len(ids), -1)[order]
        return pa.table({name: group.column("block").slice(0, 1), "dim": group.column("dim").slice(0, 1),
                         f"{name}_ids": pa.array([ids.tobytes()], pa.binary()),
                         f"{name}_m": pa.array([flat.astype(np.int32).tobytes()], pa.binary())})

    return (rows.withColumn("block", block).select("block", "dim", "id", "v").groupBy("block", "dim")
            .applyInArrow(pack, f"{name} long, dim int, {name}_ids binary, {name}_m binary"))


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, as floats while these are exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float32 if bound < 2.0 ** 24 else np.float64 if bound < 2.0 ** 53 else np.int64
    return queries.astype(kind) @ candidates.astype(kind).T


def unpacked(rows: pa.Table, name: str) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(row, ids, matrix) of each block."""
    for r in rows.to_pylist():
        ids = np.frombuffer(r[f"{name}_ids"], dtype=np.int64)
        yield r, ids, np.frombuffer(r[f"{name}_m"], dtype=np.int32).reshape(len(ids), -1)


def reaching(ids: np.ndarray, m: np.ndarray, other: np.ndarray, c_m: np.ndarray,
             least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of a pair of blocks, by query and candidate, where a score is its query's ``least`` or more."""
    s = scores(m, c_m)
    # a limit that rounds is larger in size than all exact floats here, so the comparison holds
    at = np.flatnonzero(s >= least.astype(s.dtype)[:, None])
    q, c = np.divmod(at, max(len(other), 1))
    foreign = ids[q] != other[c]
    return q[foreign], c[foreign], s.ravel()[at[foreign]].astype(np.int64)


def first_of_each(q: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the sorted ``q`` are among the first ``wanted`` of their value."""
    return np.arange(len(q)) - np.searchsorted(q, q) < wanted[q]


def leading(counts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, count) of each query's non-zero bins from the top down to where ``wanted`` scores are reached.

    Its k-th best score over all candidates is in none of the bins below.
    """
    over = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    at = np.flatnonzero((counts > 0) & (over < wanted[:, None]))
    return at, counts.ravel()[at]


def search(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, query_block: int = 512,
           candidate_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query, its own id left out.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = materialize(vectors(df, id_col, vector_col, scale), "vectors")
    n, bound, widest = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max("dim")).first()
    n_queries = rows.where(is_query).count()
    blocks = max(-(-n // candidate_block), 1)
    candidates = materialize(packed(rows, F.pmod(F.xxhash64("id"), F.lit(blocks)), "c"), "candidates")
    query_blocks = max(-(-n_queries // query_block), 1)
    queries = packed(rows.where(is_query), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)), "q")
    top = int(bound or 0)  # by Cauchy and Schwarz no score is larger
    bits = max((2 * top + 1).bit_length(), 1)

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(x.as_py()) // 8 for x in b.column("q_ids")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([np.zeros(x, dtype=np.int64).tobytes() for x in sizes], pa.binary()),
                 pa.array([np.full(x, k, dtype=np.int64).tobytes() for x in sizes], pa.binary())],
                names=[*b.schema.names, "prefix", "wanted"])

    layout = "q long, dim int, q_ids binary, q_m binary, prefix binary, wanted binary"
    state = materialize(queries.mapInArrow(fresh, layout), "queries")
    # a column of tiles costs a copy of the queries and counts of theirs, a row one of the candidates: tiles are wide
    wide = min(math.isqrt(2 * max(n * n_queries // TILES, PAIRS)), VALUES // max(widest or 1, 1))
    if k > HELD // query_block:
        wide = min(wide, HELD // query_block)
    side = max(wide // candidate_block, 1)
    q_side = max(min(wide // 2, HELD // max(min(k, max(wide, candidate_block)), 1)) // query_block, 1)
    across, down = -(-blocks // side), -(-query_blocks // q_side)
    tasks = min(across * down, TASKS)

    def tiles(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def dealt(rows: DataFrame, row: Column, column: Column):
        return (rows.withColumn("tile", row * across + column).drop("at")
                .repartition(tasks, "tile", "dim").groupBy("tile", "dim"))

    def met(state: DataFrame):
        return dealt(state.withColumn("at", tiles(across)), F.floor(F.col("q") / q_side), F.col("at")).cogroup(
            dealt(candidates.withColumn("at", tiles(down)), F.col("at"), F.floor(F.col("c") / side)))

    while bits:
        step = min(PASS_BITS, bits)
        low, bits = bits - step, bits - step
        state = materialize(_refined(state, met(state), low, step, top, layout), "queries")
    return _winners(met(state), top, k)


def _refined(state: DataFrame, met, low: int, step: int, top: int, layout: str) -> DataFrame:
    """The state after one pass: ``step`` more bits of each query's k-th best score.

    ``prefix``: its leading bits so far; ``wanted``: how many of the scores with these
    bits are among the k best.
    """
    bins = 1 << step

    def count(own: pa.Table, others: pa.Table) -> pa.Table:
        blocks, parts = [x[1:] for x in unpacked(others, "c")], []
        for r, ids, m in unpacked(own, "q"):
            prefix, wanted = (np.frombuffer(r[c], dtype=np.int64) for c in ("prefix", "wanted"))
            counts, floor = np.zeros((len(ids), bins), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            for other, c_m in blocks:
                q, _, s = reaching(ids, m, other, c_m, (((prefix << step) + floor) << low) - top)
                at = ((s + top) >> low) - (prefix[q] << step)
                within = at < bins
                counts += np.bincount(q[within] * bins + at[within], minlength=counts.size).reshape(counts.shape)
                over = np.cumsum(counts[:, ::-1], axis=1)
                floor = np.maximum(bins - 1 - (over < wanted[:, None]).sum(axis=1), 0)
            at, n = leading(counts, wanted)
            parts.append((np.full(len(at), r["q"]), np.full(len(at), r["dim"], dtype=np.int32),
                          (at // bins).astype(np.int32), (at % bins).astype(np.int32), n))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                        names=["q", "dim", "query", "bin", "n"])

    def settle(own: pa.Table, counted: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own.select([c.split()[0] for c in layout.split(", ")])
        r = own.to_pylist()[0]
        prefix, wanted = (np.frombuffer(r[c], dtype=np.int64) for c in ("prefix", "wanted"))
        counts = np.zeros((len(prefix), bins), dtype=np.int64)
        counts[np.asarray(one(counted.column("query"))), np.asarray(one(counted.column("bin")))] = one(counted.column("n"))
        above = np.cumsum(counts[:, ::-1], axis=1)  # scores in the topmost bins
        j = np.argmax(above >= wanted[:, None], axis=1)
        few = above[:, -1] < wanted  # not enough scores: the lowest bin, so that all are kept
        j[few] = bins - 1
        passed = above[np.arange(len(j)), j] - counts[np.arange(len(j)), bins - 1 - j]
        r["prefix"], r["wanted"] = ((prefix << step) | (bins - 1 - j)).tobytes(), (wanted - passed).tobytes()
        return pa.Table.from_pylist([r], schema=pa.schema(
            [("q", pa.int64()), ("dim", pa.int32())] + [(c, pa.binary()) for c in ("q_ids", "q_m", "prefix", "wanted")]))

    counted = (met.applyInArrow(count, "q long, dim int, query int, bin int, n long")
               .groupBy("q", "dim", "query", "bin").agg(F.sum("n").alias("n")))
    return state.groupBy("q", "dim").cogroup(counted.groupBy("q", "dim")).applyInArrow(settle, layout)


def _winners(met, top: int, k: int) -> DataFrame:
    def emit(own: pa.Table, others: pa.Table) -> pa.Table:
        blocks, parts = [x[1:] for x in unpacked(others, "c")], []
        for r, ids, m in unpacked(own, "q"):
            prefix, wanted = (np.frombuffer(r[c], dtype=np.int64) for c in ("prefix", "wanted"))
            least, ties = prefix - top, []
            for other, c_m in blocks:
                q, c, s = reaching(ids, m, other, c_m, least)
                tied = s == least[q]
                parts.append((ids[q[~tied]], other[c[~tied]], s[~tied]))
                q, c = q[tied], c[tied]
                # candidates are in order of id: of equal scores a block's first ones are enough
                kept = first_of_each(q, wanted)
                ties.append((q[kept], other[c[kept]]))
            if ties:
                q, c = (np.concatenate(x) for x in zip(*ties))
                order = np.lexsort((c, q))
                order = order[first_of_each(q[order], wanted)]
                parts.append((ids[q[order]], c[order], least[q[order]]))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (met.applyInArrow(emit, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
