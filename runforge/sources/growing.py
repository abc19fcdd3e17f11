"""A streaming source for logs that grow: files that a run appends to and flushes line by line.

Spark's file source reads a file once. This Python data source remembers how many bytes
of each file it has read. Its offsets are ``{path: bytes}``, always just after a line
break, so a line that is still being written waits for a later batch; what a batch reads
is the byte ranges between two offsets, cut into input partitions of ``partitionBytes``,
so a log that has grown by gigabytes is read by many tasks. A range gives the lines
that begin in it, as Spark's own text source does.

Offsets live in the query's checkpoint: a restart goes on where the last batch ended, and a
batch that runs again reads the same bytes. A file that is shorter than what was read of it
is an error that names the file (logs are appended to, also by a resumed run); a file
that is gone is let go.

Paths name any store that Arrow's file systems reach (a plain path, ``file:``, ``s3:``,
``gs:``, ``hdfs:``); offsets are planned by one listing of the folder a batch, and a look at
the end of each file that has grown.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from runforge.sources.logs import CORRUPT, EVAL_SCHEMA, STEP_SCHEMA

#: Bytes read at once from a file.
BLOCK = 1 << 20
#: Bytes read first where only the end of a line is looked for; each further read takes twice as many.
TAIL = 1 << 12
#: Lines in one Arrow batch.
LINES = 2000


@dataclass
class Range(InputPartition):
    """Lines of ``path`` that begin in bytes ``start`` to ``end``; the file was read up to ``first`` before."""

    path: str
    first: int
    start: int
    end: int
    last: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start))


def open_store(path: str):
    """(file system, path in it) of a plain path or a URI."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_bytes(file, size: int, known: int) -> int:
    """The place after the last line break of a file's first ``size`` bytes, not before ``known``."""
    end = size
    while end > known:
        start = max(end - BLOCK, known)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return known


def lines_of(file, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range; all of the file's bytes up to ``part.last`` end with a line break."""
    at = part.start
    file.seek(max(at - 1, part.first))
    held, tail = b"", TAIL
    if at > part.first:  # the line that reaches into the range belongs to the one before
        held = file.read(1)
        while not held.endswith(b"\n"):
            more, tail = file.read(min(tail, part.last - at)), min(tail * 2, BLOCK)
            if not more:
                return
            cut = more.find(b"\n")
            if cut >= 0:
                file.seek(at + cut + 1)
                at, held = at + cut + 1, b"\n"
            else:
                at += len(more)
        held, tail = b"", TAIL
    read = at
    while at < part.end:
        if read < part.end:
            more = file.read(min(BLOCK, part.end - read))
        else:  # the last line ends in a range behind this one
            more, tail = file.read(min(tail, part.last - read)), min(tail * 2, BLOCK)
        read += len(more)
        parts = (held + more).split(b"\n")
        held = parts.pop()
        for line in parts:
            if at >= part.end:
                return
            yield at, line
            at += len(line) + 1
        if not more:
            return


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".jsonl,.json").split(","))
        self.partition_bytes = int(options.get("partitionbytes", str(64 << 20)))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs
        store, root = open_store(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        sizes = {f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffixes) and not _hidden(f.path[len(root):])}
        ends = {}
        for path, size in sorted(sizes.items()):
            known = min(self.seen.get(path, 0), size)
            if size > known:
                with store.open_input_file(path) as file:
                    known = whole_bytes(file, size, known)
            if known:
                ends[path] = known
        self.seen = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, last in sorted(end.items()):
            first = start.get(path, 0)
            if last < first:
                raise ValueError(f"{path} has {last} whole bytes, but {first} were read of it: logs must only be appended to")
            out += [Range(path, first, at, min(at + self.partition_bytes, last), last) for at in range(first, last, self.partition_bytes)]
        return out

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa
        store, _ = open_store(self.root)
        with store.open_input_file(partition.path) as file:
            places: list[int] = []
            lines: list[str] = []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines), pa.string()), pa.array(places, pa.int64()),
                                                   pa.array(lines, pa.string())], names=["file", "start", "value"])

            for at, line in lines_of(file, partition):
                places.append(at)
                lines.append(line.decode("utf-8", "replace"))
                if len(lines) == LINES:
                    yield made()
                    places, lines = [], []
            if lines:
                yield made()


def _hidden(path: str) -> bool:
    return any(x[:1] in ("_", ".") for x in path.split("/") if x)


class GrowingLog(DataSource):
    """Lines (file, start, value) of the files under ``path`` that end in one of ``suffixes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "file string, start long, value string"

    def streamReader(self, schema: T.StructType) -> GrowingReader:
        return GrowingReader({k.lower(): v for k, v in self.options.items()})


def stream_growing_log(spark: SparkSession, root: str, schema: T.StructType = STEP_SCHEMA, pattern: str = r"([^/]+)/[^/]+$",
                       partition_bytes: int = 64 << 20, suffixes: str = ".jsonl,.json") -> DataFrame:
    """T1 for logs that are appended to: the columns of ``read_run_logs``, line by line as files grow.

    ``root`` holds a folder a run; ``run_id`` is the first group of ``pattern`` in the
    file's path. Python only finds the lines; Spark parses them. Lines that are no JSON
    (a run was killed in mid-line and a resumed one went on behind it) and lines without
    the first field of ``schema`` are dropped; a missing task is 'unknown'. ``file`` and
    ``line_start`` place each row in its file.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning runs in a Python worker of its own
    spark.dataSource.register(GrowingLog)
    raw = (spark.readStream.format("growing_log").option("path", root).option("partitionBytes", str(partition_bytes))
           .option("suffixes", suffixes).load())
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "true"}
    rows = raw.select("file", F.col("start").alias("line_start"), F.from_json("value", with_corrupt, options).alias("_row"))
    good = (rows.where(F.col(f"_row.{CORRUPT}").isNull() & F.col(f"_row.{schema.fields[0].name}").isNotNull())
            .select("file", "line_start", "_row.*").drop(CORRUPT).withColumn("run_id", F.regexp_extract("file", pattern, 1)))
    return good.withColumn("task", F.coalesce("task", F.lit("unknown"))) if "task" in schema.names else good


def stream_growing_evals(spark: SparkSession, root: str, **options) -> DataFrame:
    """The eval log in the same way."""
    return stream_growing_log(spark, root, EVAL_SCHEMA, **options)
