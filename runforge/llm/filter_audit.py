"""Filter interaction audit: what each filter removes, alone and after others, from sorted posting lists.

Five text filters can run in any order. For every part of the corpus (a value of one
column) and every order the audit tells what each step removes, what it would have
removed but an earlier step already had, and what only it removes.

1. A pass over the texts notes which of filters A to D each row fails and a 128-bit
   digest; the smallest id of each digest, from a grouping, decides filter E.
2. :func:`postings` deals the rows by ranges of (part, id), so a part that holds a third
   of all rows fills many tasks, and sorts them. Every run of at most ``range_rows`` rows
   of a part becomes one row of a stored table: the ids of the run and, for each filter
   and each label, the sorted list of the row numbers that fail (or have) it.
3. :func:`union_sizes` merges the lists of each run: the union for every set of filters by
   a galloping k-way merge, the labelled rows outside a union by a galloping difference.
   Sizes of disjoint id ranges add up, so only sizes are summed over ranges.
4. :func:`audit` reads all orders off the 32 sums of a part.

Cases: a null text is empty, a null part is the empty string. A row with a null id fails
E never and makes no other row fail it; rows of one id are separate rows and no smaller
than each other. A row is good (toxic) if any label row of its id says so; other labels
do nothing. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm.common import blocks, one, prepare, whole_text, words_of
from runforge.session import materialize

FILTERS = "ABCDE"
LISTS = [*FILTERS, "good", "toxic"]
SETS = 1 << len(FILTERS)
#: Rows of a part in one run: a run's lists take about 150 kB at most.
RANGE_ROWS = 8192


def failing(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3: which of filters A to D each whole text fails."""
    index, bounds, distinct = words_of(texts)
    n_words = np.diff(bounds)
    n_distinct = np.zeros(len(texts), dtype=np.int64)
    last, places = np.zeros(len(distinct), dtype=np.int64), np.arange(n_words.max(initial=0))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        own, at = index[a:b], places[:b - a]
        last[own] = at  # of a word's places the last stays
        n_distinct[k] = np.count_nonzero(last[own] == at)
    upper = np.asarray(pc.subtract(pc.binary_length(texts),
                                   pc.binary_length(pc.replace_substring_regex(texts, "[A-Z]", "")))).astype(np.int64)
    points = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    marks = np.asarray(pc.match_substring_regex(texts, r"[#$%&*|]"))
    return ((n_words < 50) * 1 + (100 * n_distinct < 65 * n_words) * 2 + (100 * upper > 5 * points) * 4 + marks * 8).astype(np.int32)


def checked(df: DataFrame, labels: DataFrame, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """(part, id, row, fails, good, toxic) of every row; ``row`` tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for block in blocks(batches, 4 << 20):
            texts = one(block.column(1))
            digest = pa.array([xxh3_128_digest(x.as_buffer()) for x in texts.cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([one(block.column(0)), one(block.column(2)), digest, pa.array(failing(texts))],
                                             names=["id", "part", "digest", "fails"])

    own = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), whole_text(part_col).alias("part"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("part", T.StringType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("fails", T.IntegerType())])
    # written once: rows keep their number, and the joins below read a few bytes a row
    rows = materialize(own.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "filtered")
    firsts = materialize(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("id").alias("n"))
                         .where("n > 1").drop("n"), "first-texts")
    labelled = materialize(labels.groupBy(F.col(id_col).alias("id"))
                           .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
                           .where("good or toxic"), "labelled")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return (rows.join(firsts, "digest", "left").join(labelled, "id", "left")
            .select("part", "id", "row", (F.col("fails") + F.when(later, 16).otherwise(0)).cast("int").alias("fails"),
                    F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


def postings(df: DataFrame, labels: DataFrame, range_rows: int = RANGE_ROWS, part_col: str = "source",
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, range, ids, A, B, C, D, E, good, toxic): a stored row for each run of a part's ids.

    ``ids`` are the ids of the run in order; the other columns are sorted row numbers
    in it: the rows that fail a filter, or have a label.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = checked(df, labels, part_col, id_col, text_col)
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("range", T.LongType()),
                           T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
                           *[T.StructField(x, numbers) for x in LISTS]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, part = TaskContext.get().partitionId() << 32, [], None
        ready: list[tuple] = []

        def close() -> None:
            nonlocal number, held
            if held:
                run = pa.Table.from_batches(held)
                fails = np.asarray(run.column("fails"))
                hits = [fails >> k & 1 for k in range(len(FILTERS))] + [np.asarray(run.column(c)) for c in ("good", "toxic")]
                ready.append((part, number, run.column("id").to_pylist(), *(np.flatnonzero(h).astype(np.int32) for h in hits)))
                number, held = number + 1, []

        def made() -> pa.RecordBatch:
            nonlocal ready
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*ready), shape)]
            ready = []
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        from pyspark.sql.pandas.types import to_arrow_schema
        shape = list(to_arrow_schema(schema))
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = np.asarray(names.indices)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(edges[:-1], edges[1:]):
                name = names.dictionary[int(codes[a])].as_py() if b > a else part
                if name != part:
                    close()
                    part = name
                while a < b:
                    step = min(b - a, range_rows - sum(x.num_rows for x in held))
                    held.append(batch.slice(a, step))
                    a += step
                    if sum(x.num_rows for x in held) >= range_rows:
                        close()
                if len(ready) >= 64:
                    yield made()
        close()
        if ready:
            yield made()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, "part", "id", "row").sortWithinPartitions("part", "id", "row")
    return materialize(ordered.mapInArrow(cut, schema), "postings")


def gallop(ids: list[int], lo: int, value: int) -> int:
    """First place from ``lo`` on whose id is not below ``value``: steps that double, then a bisection."""
    step, n = 1, len(ids)
    while lo + step < n and ids[lo + step] < value:
        lo, step = lo + step, 2 * step
    return bisect_left(ids, value, lo, min(lo + step, n))


def merged(lists: list[list[int]]) -> list[int]:
    """Union of sorted lists: the list with the smallest head gives all its ids below the next head at once."""
    heads = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapify(heads)
    out: list[int] = []
    while heads:
        value, k, at = heads[0]
        ids = lists[k]
        if len(heads) == 1:
            out += ids[at + (bool(out) and out[-1] == value):]
            break
        limit = min(heads[1][0], heads[2][0]) if len(heads) > 2 else heads[1][0]
        to = at + 1 if limit <= value else gallop(ids, at, limit)
        out += ids[at + (bool(out) and out[-1] == value):to]
        if to < len(ids):
            heapreplace(heads, (ids[to], k, to))
        else:
            heappop(heads)
    return out


def outside(ids: list[int], union: list[int]) -> int:
    """How many of ``ids`` the union does not hold."""
    at, n, missing = 0, len(union), 0
    for value in ids:
        if at < n and union[at] < value:
            at = gallop(union, at, value)
        missing += at == n or union[at] != value
    return missing


def run_sizes(n_rows: int, lists: dict[str, list[int]]) -> np.ndarray:
    """(3, 32): for each set of filters the size of its union, and how many good and toxic rows are in it.

    The union of no filter is empty; its place holds the number of rows.
    """
    out = np.zeros((3, SETS), dtype=np.int64)
    out[0, 0] = n_rows
    good, toxic = lists["good"], lists["toxic"]
    for chosen in range(1, SETS):
        union = merged([lists[f] for k, f in enumerate(FILTERS) if chosen >> k & 1])
        out[:, chosen] = len(union), len(good) - outside(good, union), len(toxic) - outside(toxic, union)
    return out


def union_sizes(posted: DataFrame) -> DataFrame:
    """(part, n, good, toxic): three arrays of 32 sums a part, by the bits of the set of filters."""
    cells = [f"c{k}" for k in range(3 * SETS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def made() -> pa.RecordBatch:
            values = np.stack([x.ravel() for x in sums.values()])
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *map(pa.array, np.ascontiguousarray(values.T))],
                                              names=["part", *cells])

        for batch in batches:
            for r in batch.to_pylist():
                sizes = run_sizes(r["n"], r)
                sums[r["part"]] = sums[r["part"]] + sizes if r["part"] in sums else sizes
                if len(sums) >= 4096:
                    yield made()
                    sums.clear()
        if sums:
            yield made()

    schema = "part string, " + ", ".join(f"{c} long" for c in cells)
    rows = posted.select("part", F.size("ids").alias("n"), *LISTS).mapInArrow(run, schema)
    total = rows.groupBy("part").agg(*[F.sum(c).alias(c) for c in cells])
    return total.select("part", *[F.array(*cells[k * SETS:(k + 1) * SETS]).alias(n) for k, n in enumerate(("n", "good", "toxic"))])


def audit(posted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see the module for the counts."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    every = SETS - 1
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)"
    before = (f"aggregate(sequence(1, {len(FILTERS)}), 0, (m, i) -> "
              f"if(i < step, m | shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1), m))")
    # orders in which the filters before this one are a given set: of each size k, k! (4 - k)!
    times = "array(24L, 6L, 4L, 6L, 24L)"
    shapley = (f"aggregate(sequence(0, {every}), 0L, (t, s) -> if((s & _bit) != 0, t, "
               f"t + {times}[bit_count(s)] * (_n[s | _bit] - if(s = 0, 0L, _n[s]))))")
    rows = (union_sizes(posted).select("part", F.col("n").alias("_n"), F.col("good").alias("_good"), F.col("toxic").alias("_toxic"),
                                       F.explode(F.lit(orders)).alias("filter_order"))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
            .withColumn("_bit", F.expr(bit)).withColumn("_before", F.expr(before))
            .withColumn("_after", F.expr("_before | _bit")))
    had = "if(_before = 0, 0L, _n[_before])"
    return rows.selectExpr(
        "part", "filter_order", "step", "_n[0] - _n[_after] AS kept", f"_n[_after] - {had} AS removed",
        f"_n[_bit] - (_n[_after] - {had}) AS redundant", f"_n[{every}] - _n[{every} - _bit] AS unique_fails",
        "_good[_after] - _good[_before] AS good_lost", "_toxic[_after] - _toxic[_before] AS toxic_lost", f"{shapley} AS shapley")
