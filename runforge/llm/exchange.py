"""A join of per-chunk keys with global tables, both packed into arrays.

A chunk is a run of a task's rows with a bounded amount of text, kept as one
compressed row. It asks about each of its distinct keys once (so a key that every
document holds costs one entry a chunk), in rows of (chunk, kind, bucket) with the
keys of that hash bucket as one array. A bucket meets all entries of its keys in one
task, which aggregates them and answers each row with an array in the same order; the
answers go back to their chunk. This is the join of an exploded key table with its
aggregate, at a few bytes a distinct key instead of a row for each occurrence. There
are never more packed rows than flat ones.

Chunks shuffle once, by number; both the questions and the last step read that
shuffle. The input must be a table read from storage, or give the same rows to a task
that runs again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import blocks, one

REQUEST = "chunk long, kind int, bucket long, keys binary, extra binary"
ANSWER = "chunk long, kind int, bucket long, answer binary"


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """64-bit integers by byte planes: the high planes of small ones compress away."""
    return squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def unplane(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), dtype=np.uint8).reshape(8, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return planes(np.diff(keys, prepend=np.zeros(1, dtype=np.uint64)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplane(data, np.uint64), dtype=np.uint64)


def chunked(rows: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(chunk, rows) and a number of buckets; ``rows`` has the text, never null, as column 1.

    Both follow the bytes of text; small tables are cut finer, for as many chunks as
    shuffle partitions.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length(rows.columns[1]))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(chunk_bytes, max(total // parts, chunk_bytes // 32))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for block in blocks(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                out.write_table(block)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["chunk", "rows"])
            chunk += 1

    return rows.mapInArrow(bundle, "chunk long, rows binary"), max(total // size, 1)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in a sorted array; buckets are equal ranges of the key space."""
    width = (1 << 64) // buckets + 1
    edges = np.array([min(k * width, (1 << 64) - 1) for k in range(buckets)], dtype=np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def requests(kind: int, keys: np.ndarray, extra, buckets: int) -> list[dict]:
    """One row for each bucket that the sorted ``keys`` reach; ``extra(a, b)`` are bytes about keys a to b."""
    bounds = bucket_bounds(keys, buckets)
    return [{"kind": kind, "bucket": k, "keys": pack_keys(keys[a:b]), "extra": extra(a, b)}
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]


def answers_of(table: pa.Table, kind: int) -> list[bytes]:
    """A chunk's answers of one kind in key order."""
    got = sorted((r["bucket"], r["answer"]) for r in table.select(["kind", "bucket", "answer"]).to_pylist()
                 if r["kind"] == kind)
    return [x for _, x in got]


def ask(chunks: DataFrame, request, answer, finish, schema) -> DataFrame:
    """``request(rows) -> dicts``; ``answer(kind, [(keys, extra)]) -> [bytes]``; ``finish(rows, answers) -> table``."""
    asked_as = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()),
                          ("extra", pa.binary())])
    told_as = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("answer", pa.binary())])

    def rows_of(group: pa.Table) -> pa.Table:
        return pa.ipc.open_stream(one(group.column("rows"))[0].as_buffer()).read_all()

    def questions(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        return pa.Table.from_pylist([r | {"chunk": chunk} for r in request(rows_of(group))], schema=asked_as)

    def reply(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        told = answer(rows[0]["kind"], [(unpack_keys(r["keys"]), r["extra"]) for r in rows])
        return pa.Table.from_pylist([{k: r[k] for k in ("chunk", "kind", "bucket")} | {"answer": x}
                                     for r, x in zip(rows, told)], schema=told_as)

    asked = chunks.groupBy("chunk").applyInArrow(questions, REQUEST)
    answered = asked.groupBy("kind", "bucket").applyInArrow(reply, ANSWER)
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")) \
        .applyInArrow(lambda group, told: finish(rows_of(group), told), schema)
