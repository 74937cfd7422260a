"""Parts of files: the first and last bytes of every file, or any stated range, without reading the rest.

``read_slices`` takes a table of files and reads in its tasks. ``FileRanges`` is the same as a data source: the
driver lists a folder, deals its files so that partitions read about equally much, and tasks read the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a prefix has by default; documents about a picture stand at its beginning.
PREFIX = 256 << 10
#: Bytes that one partition of the data source reads at most, and that a task holds before it hands them on.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
#: What listing and opening a file counts as, so that many small files are dealt too.
OPEN_BYTES = 64 << 10


def system_of(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_slice(path: str, spans: list[tuple[int, int] | None]) -> list[bytes | None]:
    """The bytes (first, last) of a file for each span, both ends included; None where there is no span, or the file can't be read."""
    try:
        system, inner = system_of(path)
        with system.open_input_file(inner) as file:
            size = file.size()
            return [None if s is None else file.read_at(max(0, min(s[1] + 1, size) - s[0]), s[0]) if s[0] < size else b"" for s in spans]
    except (OSError, pa.ArrowInvalid):
        return [None] * len(spans)


def read_slices(files: DataFrame, spans: dict[str, Column], path: str = "path") -> DataFrame:
    """files with a binary column for each span: a struct (first, last) of byte positions, as ``media.byte_range`` gives it.

    Only the named bytes are read, in the tasks that hold the rows; a null span, a null path or a file that can't be read
    gives null, a span behind the file's end nothing. Rows leave a task in batches of about BATCH_BYTES.
    """
    names = list(spans)
    asked = files.withColumn("__spans", F.array(*[spans[n].cast("struct<first:long,last:long>") for n in names]))
    kept = [c for c in files.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = held = 0
            parts: list[list[bytes | None]] = []

            def out(end: int) -> pa.RecordBatch:
                columns = [batch.column(c).slice(at, end - at) for c in kept]
                return pa.RecordBatch.from_arrays([*columns, *(pa.array([p[i] for p in parts], pa.binary()) for i in range(len(names)))], names=[*kept, *names])

            for row, (where, asks) in enumerate(zip(batch.column(path).to_pylist(), batch.column("__spans").to_pylist())):
                ranges = [(s["first"], s["last"]) if s and s["first"] is not None and s["last"] is not None else None for s in asks]
                parts.append(read_slice(where, ranges) if where is not None else [None] * len(names))
                held += sum(len(p) for p in parts[-1] if p)
                if held >= BATCH_BYTES:
                    yield out(row + 1)
                    at, held, parts = row + 1, 0, []
            if parts:
                yield out(batch.num_rows)

    schema = ", ".join([f"`{c}` {t}" for c, t in files.dtypes if c in kept] + [f"`{n}` binary" for n in names])
    return asked.select(*kept, "__spans").mapInArrow(run, schema)


def prefix_span(n: int) -> Column:
    return F.struct(F.lit(0).alias("first"), F.lit(n - 1).alias("last"))


def suffix_span(size, n: int) -> Column:
    whole = F.col(size) if isinstance(size, str) else size
    return F.struct(F.greatest(whole - n, F.lit(0)).alias("first"), (whole - 1).alias("last"))


@dataclass
class Deal(InputPartition):
    files: list[tuple[str, int]]


class FileRanges(DataSource):
    """``spark.read.format("file_ranges").option("path", folder)``: (path, size, prefix, suffix) of all files below a folder.

    Options: ``prefix`` and ``suffix``, the bytes from either end (262144 and 0), and ``partitionBytes``. Names that begin
    with a dot are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, size long, prefix binary, suffix binary"

    def reader(self, schema) -> DataSourceReader:
        return FileRangesReader(self.options)


class FileRangesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.prefix, self.suffix = int(options.get("prefix", PREFIX)), int(options.get("suffix", 0))
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = system_of(self.path)
        root = self.path.rstrip("/")
        found = [e for e in system.get_file_info(fs.FileSelector(inner, recursive=True)) if e.is_file]
        inside = lambda e: e.path[len(inner.rstrip("/")) + 1 :]
        files = sorted((f"{root}/{inside(e)}", e.size) for e in found if not any(p.startswith(".") for p in inside(e).split("/")))
        deals, load = [Deal([])], 0
        for path, size in files:
            cost = min(size, self.prefix) + min(size, self.suffix) + OPEN_BYTES
            if deals[-1].files and load + cost > self.partition_bytes:
                deals.append(Deal([]))
                load = 0
            deals[-1].files.append((path, size))
            load += cost
        return deals

    def read(self, partition: Deal) -> Iterator[tuple]:
        for path, size in partition.files:
            ends = [(0, self.prefix - 1) if self.prefix else None, (max(0, size - self.suffix), size - 1) if self.suffix else None]
            yield (path, size, *read_slice(path, ends))


def read_ranges(spark: SparkSession, folder: str, prefix: int = PREFIX, suffix: int = 0) -> DataFrame:
    """(path, size, prefix, suffix) of all files below a folder that the driver can list."""
    spark.dataSource.register(FileRanges)
    return spark.read.format("file_ranges").option("path", folder).option("prefix", prefix).option("suffix", suffix).load()
