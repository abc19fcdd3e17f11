"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.session import ensure_checkpoint_dir, ship_package

#: Rows in one Arrow batch sent to Python: whole texts travel, so batches stay small.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Session state that every operator here relies on."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, the text never null."""
    return df.select(F.col(id_col), whole_text(text_col).alias(text_col))


def schema_of(df: DataFrame, id_col: str, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The id with its own type, then ``fields``."""
    return T.StructType([T.StructField(id_col, df.schema[id_col].dataType)]
                        + [T.StructField(n, t) for n, t in fields])


def hash_sample(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, the ones of low hash: all rows if they are few, and else about 95 % of ``most``.

    Every task drops its other rows, so no task or driver sees more than the sample.
    """
    total = df.count()
    if total <= most:
        return df
    low = int(0.95 * most / total * (1 << 62))
    return df.where(F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1)) < low).limit(most)


def resource(name: str) -> str:
    """Place of a public vocabulary file; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def in_blocks(texts: pa.Array, max_bytes: int):
    """(first, last) row ranges of at most ``max_bytes`` text each, or one row."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def blocks(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``max_bytes`` text (column 1) each; one row at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= max_bytes:
            yield from _cut(held, max_bytes)
            held, size = [], 0
    if held:
        yield from _cut(held, max_bytes)


def _cut(held: list[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    whole = pa.Table.from_batches(held).combine_chunks()
    if whole.num_rows:
        for a, b in in_blocks(one(whole.column(1)), 2 * max_bytes):
            yield whole.slice(a, b - a)


def one(column: pa.ChunkedArray) -> pa.Array:
    """A table's column as one array."""
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def strings(texts: pa.Array) -> list[str]:
    """The strings of an array without nulls (several times faster than ``to_pylist``)."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Whitespace words (runs free of ``[\\x20\\x09-\\x0D]``) of many texts at once.

    Returns one index into the third value, the distinct words, for each word in
    order; the position of each text's first word, with the total at the end;
    and the distinct words.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = np.asarray(lists.offsets)[: len(lists) + 1].astype(np.int64)
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    index = np.asarray(coded.indices)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # the splitter leaves an empty string at a leading or trailing space
        real = index != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        index = index[real]
    return index, bounds, coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` of all i, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit XXH64 of each word's UTF-8 bytes."""
    from xxhash import xxh64_intdigest
    binary = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary())
    return np.fromiter(map(xxh64_intdigest, binary.to_pylist()), dtype=np.uint64, count=len(words))
