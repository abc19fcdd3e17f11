"""Record packing, interleaving, concatenation and seeded shuffles.

Packing rule (per batch of ``batch_rows`` consecutive input rows; state never
crosses a batch). R = record_size, body B = R - 2; a record is CLS + body (+ SEP):

1. a token enters the body if there is room; otherwise SEP is appended, the
   record is emitted (length R) and the token opens the next record;
2. at a document's end, EOS is appended if there is room, otherwise the record
   is emitted without SEP and without EOS (length R - 1);
3. the partial record left at the end of the batch is dropped.

Closed form used here: with kept documents in order and lengths l > 0,
``off' = off + l + (1 if (off + l) % B != 0 else 0)``; token k of a document
sits at position off + k, EOS (when placed) at off + l; record = pos div B.
Record r is emitted when a document ends exactly at (r+1)·B (rule 2) or when
some token lies at or beyond (r+1)·B (rule 1, SEP appended).

Documents are dealt once, by batch, and sorted; a task reads them as a stream and
holds, besides an Arrow batch of them, the ids of the record that is still open.
:func:`pack_offsets` gives the places alone, from lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.functions.draws import draw_int
from runforge.functions.indexing import position_within, sorted_positions
from runforge.functions.text import CLS_ID, EOS_ID, SEP_ID


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- P1
def pack_offsets(lens: DataFrame, record_size: int, batch: str = "batch", pos: str = "pos",
                 length: str = "len") -> DataFrame:
    """Per-batch fold over document lengths (the closed form of the packing rule).

    ``lens`` has one row per kept document: (batch, pos, len) with len > 0.
    Returns one row per batch: ``docs`` (sorted (p, l) structs), ``offs``
    (start offset of each document), ``tmax`` (last token position) and
    ``rule2`` (records closed by a document ending exactly at their end).
    """
    B = record_size - 2
    per_batch = lens.groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(length).cast("bigint").alias("l"))))
        .alias("docs"))
    init = F.struct(F.lit(0).cast("bigint").alias("off"), F.array().cast("array<bigint>").alias("offs"),
                    F.lit(0).cast("bigint").alias("last_end"), F.array().cast("array<bigint>").alias("rule2"))

    def step(acc, d):
        end = acc["off"] + d["l"]
        exact = F.pmod(end, F.lit(B)) == 0
        nxt = end + F.when(exact, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
        r2 = F.when(exact, F.concat(acc["rule2"], F.array((F.floor(end / B) - 1).cast("bigint")))) \
            .otherwise(acc["rule2"])
        return F.struct(nxt.alias("off"), F.concat(acc["offs"], F.array(acc["off"])).alias("offs"),
                        end.alias("last_end"), r2.alias("rule2"))

    acc = F.aggregate("docs", init, step)
    return per_batch.select(batch, "docs", acc["offs"].alias("offs"), (acc["last_end"] - 1).alias("tmax"),
                            acc["rule2"].alias("rule2"))


def pack_records(df: DataFrame, record_size: int, order: str = "position", tokens: str = "tokens",
                 batch_rows: int = 1000, keep: str | None = None, cls: int = CLS_ID, sep: int = SEP_ID,
                 eos: int = EOS_ID) -> DataFrame:
    """Pack token lists into records of at most ``record_size`` ids.

    ``order`` is the 0-based input row position (batches are taken over input
    rows *before* filtering, as the reference filters inside the batch);
    ``keep`` is an optional boolean column marking rows that enter packing
    (MIME and density gates). Empty token lists are skipped.
    Returns (batch, record_idx, input_ids).
    """
    body = record_size - 2
    base = df.withColumn("batch", F.floor(F.col(order) / batch_rows).cast("bigint"))
    cond = (F.size(tokens) > 0) & F.col(order).isNotNull()
    if keep is not None:
        cond = cond & F.col(keep)
    kept = base.where(cond).select("batch", F.col(order).alias("pos"), F.col(tokens).alias("_rf_tok"))
    ordered = kept.repartition("batch").sortWithinPartitions("batch", "pos")

    def cut(docs: pa.RecordBatch, held: pa.Array, done: int):
        """Records of documents behind ``held`` (ids of no record yet), what is held then, and the records done."""
        lists = docs.column("_rf_tok")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).tolist()
        at, last, closed, ends = len(held), 0, [], []
        for n in lengths:
            at += n
            last = at - 1
            if at % body == 0:
                closed.append(at // body - 1)
            else:
                ends.append(at)
                at += 1
        count = max(last // body, closed[-1] + 1 if closed else 0)
        ids = pa.concat_arrays([held, lists.flatten(), pa.array([cls, sep, eos], pa.int32())])
        specials = len(ids) - 3
        line = np.full(at, specials + 2, np.int64)
        token = np.ones(at, bool)
        token[ends] = False
        line[token] = np.arange(specials)
        short = np.zeros(count, bool)
        short[closed] = True
        rows = np.empty((count, body + 2), np.int64)
        rows[:, 0], rows[:, -1] = specials, specials + 1
        rows[:, 1:-1] = line[:count * body].reshape(count, body)
        filled = np.ones(rows.shape, bool)
        filled[short, -1] = False
        offsets = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
        records = pa.RecordBatch.from_arrays(
            [pa.repeat(docs.column("batch")[0], count), pa.array(np.arange(done, done + count), pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(rows[filled])))],
            names=["batch", "record_idx", "input_ids"])
        return records, ids.take(pa.array(line[count * body:])), done + count

    def pack(tables):
        batch, held, done = None, pa.array([], pa.int32()), 0
        for table in tables:
            if not table.num_rows:
                continue
            own = table.column("batch").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            for i, j in zip(starts[:-1], starts[1:]):
                if own[i] != batch:
                    batch, held, done = own[i], pa.array([], pa.int32()), 0
                records, held, done = cut(table.slice(i, j - i), held, done)
                if records.num_rows:
                    yield records

    return ordered.mapInArrow(pack, "batch bigint, record_idx bigint, input_ids array<int>")


# ---------------------------------------------------------------- P2, P3
ROUND_BLOCK = 1 << 16


def interleave(df: DataFrame, by: str = "dataset", index: str = "row_idx",
               round_block: int = ROUND_BLOCK) -> DataFrame:
    """Round-robin interleave of datasets, oversampling until all are exhausted.

    n datasets (ordinal = rank of the name), L = longest length. Row i of
    dataset d appears at logical rows i, i + len_d, ... < L, at position
    logical_row·n + ordinal(d): L·n rows out, no global sort. ``index`` is the
    dense 0-based row index within the dataset.

    A row of a small dataset is repeated about L / len_d times. Rows needing
    more than ``round_block`` repeats are first cut into blocks of rounds and
    those (row, block) pairs are spread over tasks by a shuffle that touches
    only the small datasets, so no task generates a hot dataset's copies alone.
    The table of dataset ranks is stored when this is called.
    """
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_rf_len"))
    ranked = sorted_positions(sizes, [], [by], out="_rf_ord")
    # one row: longest length and dataset count
    totals = ranked.agg(F.max("_rf_len").alias("_rf_L"), F.count(F.lit(1)).alias("_rf_n"))
    meta = ranked.crossJoin(F.broadcast(totals))
    j = df.join(meta, by, "inner")
    # repeats of row i: ceil((L - i) / len)
    reps = F.floor((F.col("_rf_L") - F.col(index) + F.col("_rf_len") - 1) / F.col("_rf_len"))
    j = j.withColumn("_rf_reps", reps.cast("bigint"))
    few = j.where(F.col("_rf_reps") <= round_block).withColumn("_rf_b0", F.lit(0).cast("bigint")) \
        .withColumn("_rf_b1", F.col("_rf_reps") - 1)
    many = j.where(F.col("_rf_reps") > round_block)
    nblk = F.floor((F.col("_rf_reps") + round_block - 1) / round_block).cast("bigint")
    many = (many.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), nblk - 1)).alias("_rf_blk"))
            .repartition(by, index, "_rf_blk")
            .withColumn("_rf_b0", F.col("_rf_blk") * round_block)
            .withColumn("_rf_b1", F.least(F.col("_rf_b0") + round_block, F.col("_rf_reps")) - 1)
            .drop("_rf_blk"))
    both = few.unionByName(many)
    # logical row = index + m * len for m in [b0, b1]
    out = both.select("*", F.explode(F.sequence("_rf_b0", "_rf_b1")).alias("_rf_m"))
    lr = F.col(index) + F.col("_rf_m") * F.col("_rf_len")
    return (out.withColumn("position", (lr * F.col("_rf_n") + F.col("_rf_ord")).cast("bigint"))
            .withColumn("round", lr.cast("bigint"))
            .drop("_rf_len", "_rf_ord", "_rf_L", "_rf_n", "_rf_reps", "_rf_b0", "_rf_b1", "_rf_m"))


def concat_corpora(*dfs: DataFrame) -> DataFrame:
    """Concatenate corpora by column name; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- P4, P5
def shuffle_key(seed, key) -> F.Column:
    keys = [F.col(k) for k in _cols(key)]
    return draw_int(seed, *keys, "shuffle")


def shuffle(df: DataFrame, seed, key) -> DataFrame:
    """Deterministic seeded shuffle: order by md5 draw of (seed, key), ties by key.

    Adds ``shuffle_pos`` (0-based rank in the shuffled order) computed with a
    sliced row number, so the order is materialized without one global task.
    """
    keys = _cols(key)
    d = df.withColumn("_rf_draw", shuffle_key(seed, keys))
    # draws are uniform on [0, 2^32): fixed-width slices are balanced
    return position_within(d, [], ["_rf_draw", *keys], out="shuffle_pos",
                           slice_width=1 << 16).drop("_rf_draw")


def sample_k(df: DataFrame, k: int, seed, key) -> DataFrame:
    """P5: shuffle then take the first ``k`` (a distributed top-k: TakeOrderedAndProject)."""
    keys = _cols(key)
    return (df.withColumn("_rf_draw", shuffle_key(seed, keys))
            .orderBy("_rf_draw", *keys).limit(k).drop("_rf_draw"))
