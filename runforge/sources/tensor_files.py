"""Stored models: a source and a sink for header-indexed tensor files (K5 to K9).

A file holds a little-endian 64-bit length, a JSON header of that many bytes with the
type, shape and byte range of each tensor, and then the tensors' bytes (the public
``safetensors`` layout). A model is a folder of such files.

Reading never loads a model. :func:`read_manifest` reads headers only.
:func:`read_tensors` plans from the headers: a task gets a range of rows of one tensor
(``partitionBytes`` at most, one row at least) and reads just its bytes, so one huge
matrix is read by many tasks. Models and tensor names are selected by arguments, while
planning, and a scan without ``vec`` reads no tensor bytes at all. (Filters are not pushed
into the source: Spark 4.1 keeps a Python source's pushed filters in the relation, where
other plans over the same DataFrame find them; probed, rows were lost.)

Writing (:func:`write_tensors`) takes rows in any order. A grouping gives each tensor's
shape, a running total of bytes deals the tensors of a model to files of about
``shard_bytes``, and one task writes a file as its sorted rows come in, after the
header that was made for it: no tensor is held in memory. A task that runs again writes
the same file anew.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from runforge.session import materialize
from runforge.sources.growing import open_store

# fixed values: type codes of the layout, their usual names, and how numpy stores them (bfloat16: the upper half of a float32)
TYPES = {"F64": ("float64", "<f8"), "F32": ("float32", "<f4"), "F16": ("float16", "<f2"), "BF16": ("bfloat16", "<u2"),
         "I64": ("int64", "<i8"), "I32": ("int32", "<i4"), "I16": ("int16", "<i2"), "I8": ("int8", "<i1"), "U8": ("uint8", "<u1"),
         "BOOL": ("bool", "<u1")}
CODES = {name: code for code, (name, _) in TYPES.items()}
SUFFIX = ".safetensors"
#: Bytes of one Arrow batch, and files of one manifest task.
BATCH_BYTES = 4 << 20
FILES = 64

MANIFEST = "model string, file string, position int, name string, shape array<int>, dtype string, numel long, start long, end long"
TENSORS = "model string, matrix_id string, row_id long, vec array<float>"


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __post_init__(self) -> None:
        super().__init__(tuple(self.paths))


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``last`` of a tensor whose rows are ``width`` numbers from byte ``start`` on."""

    path: str
    model: str
    name: str
    code: str
    start: int
    width: int
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.name, self.first))


def header(file, path: str, size: int) -> list[tuple[str, str, list[int], int, int]]:
    """(name, type code, shape, first byte, last byte) of each tensor, in the header's order; the file's name in any error."""
    try:
        n = int.from_bytes(file.read(8), "little")
        if n > size - 8:
            raise ValueError("the header is cut off")
        told = json.loads(file.read(n))
        out = []
        for name, t in told.items():
            if name == "__metadata__":
                continue
            a, b = t["data_offsets"]
            numbers = int(np.prod(t["shape"], dtype=np.int64))
            if t["dtype"] not in TYPES:
                raise ValueError(f"tensor {name} has the unknown type {t['dtype']}")
            if b - a != numbers * np.dtype(TYPES[t["dtype"]][1]).itemsize or 8 + n + b > size:
                raise ValueError(f"tensor {name} is cut off")
            out.append((name, t["dtype"], t["shape"], 8 + n + a, 8 + n + b))
        return out
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"{path} is no whole tensor file: {e}") from e


def numbers(data: bytes, code: str) -> np.ndarray:
    """Tensor bytes as float32."""
    raw = np.frombuffer(data, dtype=TYPES[code][1])
    return (raw.astype(np.uint32) << 16).view(np.float32) if code == "BF16" else raw.astype(np.float32)


def stored(values: np.ndarray, code: str) -> bytes:
    """Numbers as tensor bytes; bfloat16 rounds half to even."""
    if code == "BF16":
        bits = values.astype(np.float32).view(np.uint32)
        return ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype("<u2").tobytes()
    return values.astype(TYPES[code][1]).tobytes()


class TensorReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.root, self.manifest = options["path"], options.get("rows", "true") == "false"
        self.partition_bytes = int(options.get("partitionbytes", str(64 << 20)))
        self.columns = schema.names
        self.models, self.names = (json.loads(options.get(c, "null")) for c in ("models", "names"))

    def _named(self, name: str) -> bool:
        return self.names is None or any(fnmatchcase(name, x) for x in self.names)

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs
        store, root = open_store(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(SUFFIX)
                      and (self.models is None or model_of(f.path) in self.models))

    def partitions(self) -> list[InputPartition]:
        found = self.files()
        if self.manifest:
            return [Files([p for p, _ in found[k:k + FILES]]) for k in range(0, len(found), FILES)]
        store, _ = open_store(self.root)

        def of(place: tuple[str, int]) -> list[Rows]:
            path, size = place
            with store.open_input_file(path) as file:
                tensors = header(file, path, size)
            out = []
            for name, code, shape, a, b in tensors:
                rows = shape[0] if len(shape) > 1 else 1
                if not rows or not self._named(name):
                    continue
                step = max(self.partition_bytes // max((b - a) // rows, 1), 1)
                width = (b - a) // rows // np.dtype(TYPES[code][1]).itemsize
                out += [Rows(path, model_of(path), name, code, a, width, k, min(k + step, rows)) for k in range(0, rows, step)]
            return out

        with ThreadPoolExecutor(16) as pool:
            return [r for rows in pool.map(of, found) for r in rows]

    def read(self, partition) -> Iterator:
        import pyarrow as pa
        if partition is None:  # no file or tensor passes: Spark still asks once
            return
        store, _ = open_store(self.root)
        if isinstance(partition, Files):
            for path in partition.paths:
                size = store.get_file_info(path).size
                with store.open_input_file(path) as file:
                    for k, (name, code, shape, a, b) in enumerate(header(file, path, size)):
                        if not self._named(name):
                            continue
                        row = {"model": model_of(path), "file": path, "position": k, "name": name, "shape": shape,
                               "dtype": TYPES[code][0], "numel": int(np.prod(shape, dtype=np.int64)), "start": a, "end": b}
                        yield tuple(row[c] for c in self.columns)
            return
        item = np.dtype(TYPES[partition.code][1]).itemsize
        step = max(BATCH_BYTES // max(partition.width * 4, 1), 1)
        reads = "vec" in self.columns
        file = store.open_input_file(partition.path) if reads else None
        for k in range(partition.first, partition.last, step):
            n = min(step, partition.last - k)
            made = {"model": pa.array([partition.model] * n, pa.string()), "matrix_id": pa.array([partition.name] * n, pa.string()),
                    "row_id": pa.array(np.arange(k, k + n))}
            if reads:
                file.seek(partition.start + k * partition.width * item)
                data = file.read(n * partition.width * item)
                made["vec"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.width, pa.int32()), pa.array(numbers(data, partition.code)))
            yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], names=self.columns)
        if file:
            file.close()


def model_of(path: str) -> str:
    """The folder that a file is in names its model."""
    return path.rsplit("/", 2)[-2]


class TensorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor_files"

    def schema(self) -> str:
        return MANIFEST if self.options.get("rows") == "false" else TENSORS

    def reader(self, schema: T.StructType) -> TensorReader:
        return TensorReader({k.lower(): v for k, v in self.options.items()}, schema)


def _source(spark: SparkSession, root: str, models: Iterable[str] | None, names: Iterable[str] | None):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning runs in a Python worker of its own
    cloudpickle.register_pickle_by_value(sys.modules[open_store.__module__])
    spark.dataSource.register(TensorFiles)
    source = spark.read.format("tensor_files").option("path", root)
    for key, chosen in (("models", models), ("names", names)):
        if chosen is not None:
            source = source.option(key, json.dumps(list(chosen)))
    return source


def read_manifest(spark: SparkSession, root: str, models: Iterable[str] | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """K5, K6, K7, K9: a row a tensor, from the headers of the files under ``root``; ``position`` counts within a file.

    ``models`` are folder names, ``names`` patterns of tensor names with ``*`` and ``?``.
    """
    return _source(spark, root, models, names).option("rows", "false").load()


def read_tensors(spark: SparkSession, root: str, models: Iterable[str] | None = None, names: Iterable[str] | None = None,
                 columns: Iterable[str] = ("model", "matrix_id", "row_id", "vec"), partition_bytes: int = 64 << 20) -> DataFrame:
    """K1, K2, K8: rows (model, matrix_id, row_id, vec) of the tensors under ``root``, as float32.

    A tensor of more than two dimensions has its first one as rows; one of fewer is a
    single row. Without ``vec`` among ``columns`` no tensor byte is read.
    """
    own = T._parse_datatype_string(TENSORS)
    return (_source(spark, root, models, names).schema(T.StructType([own[c] for c in columns]))
            .option("partitionBytes", str(partition_bytes)).load())


def write_tensors(df: DataFrame, root: str, shard_bytes: int = 1 << 30) -> DataFrame:
    """Write rows (model, matrix_id, row_id, vec[, dtype][, flat]) as tensor files under ``root``; (model, file, tensors, bytes) of each.

    ``dtype`` (float32 if missing) and ``flat`` (a tensor of one dimension, a single row)
    belong to a tensor as a whole. All rows of a tensor have one length; row ids give
    their order, which is all that a file keeps of them.
    """
    rows = df.select("model", "matrix_id", "row_id", "vec",
                     (F.col("dtype") if "dtype" in df.columns else F.lit("float32")).alias("dtype"),
                     (F.col("flat") if "flat" in df.columns else F.lit(False)).alias("flat"))
    code = F.create_map(*[F.lit(x) for name, c in CODES.items() for x in (name, c)])[F.col("dtype")]
    item = F.create_map(*[F.lit(x) for name, c in CODES.items() for x in (name, np.dtype(TYPES[c][1]).itemsize)])[F.col("dtype")]
    known = (rows.groupBy("model", F.col("matrix_id").alias("name"))
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("width"), F.max(F.size("vec")).alias("widest"),
                  F.first("dtype").alias("dtype"), F.max("flat").alias("flat"))
             .withColumn("width", F.when((F.col("width") == F.col("widest")) & (~F.col("flat") | (F.col("n") == 1)), F.col("width"))
                         .otherwise(F.raise_error(F.concat(F.lit("rows of unlike length, or several of a flat tensor: "), F.col("name")))))
             .select("model", "name", code.alias("code"), "flat", "n", "width", (F.col("n") * F.col("width") * item).alias("bytes")))
    before = Window.partitionBy("model").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    dealt = materialize(known.withColumn("shard", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / shard_bytes).cast("int")), "tensors")
    none = F.lit(None)
    heads = (dealt.groupBy("model", "shard").agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "code", "flat", "n", "width", "bytes")))).alias("head"))
             .select("model", "shard", "head", none.cast("string").alias("name"), none.cast("long").alias("row_id"), none.cast("array<float>").alias("vec")))
    body = (rows.withColumnRenamed("matrix_id", "name").join(dealt.select("model", "name", "shard"), ["model", "name"])
            .select("model", "shard", none.cast("string").alias("head"), "name", F.col("row_id").cast("long").alias("row_id"),
                    F.col("vec").cast("array<float>").alias("vec")))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        place, file, left, count, codes = None, None, 0, 0, {}

        def finish() -> pa.RecordBatch:
            file.close()
            if left:
                raise ValueError(f"{place}: {left} bytes are missing")
            return pa.RecordBatch.from_arrays([pa.array([model_of(place)]), pa.array([place]), pa.array([count], pa.int32()),
                                               pa.array([size], pa.int64())], names=["model", "file", "tensors", "bytes"])

        for batch in batches:
            for model, shard, head, name, vec in zip(*[batch.column(c) for c in ("model", "shard", "head", "name", "vec")]):
                if head.is_valid:
                    if file:
                        yield finish()
                    store, folder = open_store(f"{root}/{model.as_py()}")
                    store.create_dir(folder)
                    tensors, at, told = json.loads(head.as_py()), 0, {}
                    for t in tensors:
                        shape = [t["width"]] if t["flat"] else [t["n"], t["width"]]
                        told[t["name"]] = {"dtype": t["code"], "shape": shape, "data_offsets": [at, at + t["bytes"]]}
                        at += t["bytes"]
                    text = json.dumps(told).encode()
                    text += b" " * (-len(text) % 8)
                    place = f"{folder}/model-{shard.as_py():05d}{SUFFIX}"
                    codes, count, left, size = {t["name"]: t["code"] for t in tensors}, len(tensors), at, 8 + len(text) + at
                    file = store.open_output_stream(place)
                    file.write(len(text).to_bytes(8, "little") + text)
                else:
                    data = stored(np.asarray(vec.values), codes[name.as_py()])
                    file.write(data)
                    left -= len(data)
        if file:
            yield finish()

    sorted_rows = (heads.unionByName(body).repartition("model", "shard")
                   .sortWithinPartitions("model", "shard", F.col("head").desc_nulls_last(), "name", "row_id"))
    return materialize(sorted_rows.mapInArrow(write, "model string, file string, tensors int, bytes long"), "tensor-files")
