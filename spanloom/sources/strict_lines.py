"""A data source for JSON lines: byte ranges as partitions, true line numbers, a writer that commits all or nothing.

``spark.dataSource.register(StrictLines)`` makes it known as ``strict-lines`` to read, readStream and write. Files are
reached with pyarrow's file systems from the executors, so the path is a shared mount or an object store that pyarrow knows;
for other stores there is ``records.numbered_lines``, which reads through Spark and gives the same columns.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Bytes of a range, of a read at most, of a read beyond the range, and of the short ranges that one task reads one after the other.
RANGE_BYTES, BLOCK_BYTES, TAIL_BYTES, TASK_BYTES = 64 << 20, 1 << 20, 1 << 12, 4 << 20
COLUMNS = pa.schema([("file", pa.string()), ("part", pa.int32()), ("row", pa.int64()), ("value", pa.string())])
DONE, STAGING = "_SUCCESS", "_staging"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[pafs.FileInfo]:
    """The files of a folder and of those in it, or the file itself, by name; names that start with _ or . are left out."""
    fs, inner = _place(path)
    root = fs.get_file_info(inner)
    if root.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [root] if root.is_file else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    hidden = lambda f: any(p[:1] in "_." for p in f.path[len(inner.rstrip("/")) :].split("/") if p)
    return sorted((f for f in found if f.is_file and (root.is_file or not hidden(f))), key=lambda f: f.path)


@dataclass
class ByteRange(InputPartition):
    file: str
    part: int
    low: int
    high: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads: numbers of lines stay those within their range."""

    ranges: list[ByteRange]


def _packed(ranges: list[ByteRange]) -> list[Ranges]:
    out, held = [], TASK_BYTES
    for r in ranges:
        if held + r.high - r.low > TASK_BYTES:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.high - r.low
    return out


def _ranges(files: list[pafs.FileInfo], size: int) -> list[ByteRange]:
    return [ByteRange(f.path, k, low, min(low + size, f.size)) for f in files for k, low in enumerate(range(0, f.size, size))]


def _lines(fs: pafs.FileSystem, part: ByteRange) -> Iterator[bytes]:
    """The lines that start in the byte range, without their ends; the last may reach beyond it."""
    with fs.open_input_file(part.file) as f:
        at = part.low - 1 if part.low else 0
        f.seek(at)
        skip, left, size = part.low > 0, b"", part.high - at + TAIL_BYTES
        while True:
            block = f.read(min(size, BLOCK_BYTES))
            size = min(2 * size, BLOCK_BYTES)
            pieces = (left + block).split(b"\n")
            left = pieces.pop()
            for line in pieces:
                if skip:
                    skip = False
                elif at < part.high:
                    yield line
                else:
                    return
                at += len(line) + 1
            if not block:
                if left and not skip and at < part.high:
                    yield left
                return
            if at >= part.high or (skip and at + len(left) >= part.high):
                return


class _Reading:
    def __init__(self, options: dict) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("strict-lines needs a path")
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.counting = options.get("counts", "false").lower() == "true"

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        """Lines that are not blank, numbered within their range; with ``counts`` only the number of lines of each range."""
        fs, _ = _place(self.path)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLUMNS.types, strict=True)], schema=COLUMNS)

        for r in part.ranges:
            n = 0
            for line in _lines(fs, r):
                n += 1
                if not self.counting and line.strip():
                    # bytes that are no UTF-8 show as replacement characters, inside strings or where no JSON can be
                    rows.append((r.file, r.part, n - 1, line.removesuffix(b"\r").decode("utf-8", "replace")))
                    held += len(line)
                    if held >= BLOCK_BYTES * 4 or len(rows) >= 8192:
                        yield batch()
                        rows, held = [], 0
            if self.counting:
                rows.append((r.file, r.part, n, None))
        if rows:
            yield batch()


class StrictReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return _packed(_ranges(_files(self.path), self.size))


class StrictStreamReader(_Reading, DataSourceStreamReader):
    """Files that were written since the last batch, each once; an offset is the modification time up to which files were read."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.settle = float(options.get("settleseconds", 1.0))

    def _known(self) -> list[pafs.FileInfo]:
        until = time.time_ns() - int(self.settle * 1e9)
        return [f for f in _files(self.path) if f.mtime_ns <= until]

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": max((f.mtime_ns for f in self._known()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return _packed(_ranges([f for f in _files(self.path) if start["until"] < f.mtime_ns <= end["until"]], self.size))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class StrictWriter(DataSourceArrowWriter):
    """Every task writes its own file aside; the driver moves those of the successful attempts into place, or deletes all.

    An overwrite removes the earlier files only once all new ones are there. The mark of success holds the number of rows.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, inner = _place(self.path)
        fs.create_dir(f"{inner}/{STAGING}-{self.job}", recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{inner}/{STAGING}-{self.job}/{name}") as out:
            for b in iterator:
                for value in b.column("value").to_pylist():
                    if value is None or "\n" in value:
                        raise ValueError("a line is null or holds a line break")
                    out.write(value.encode() + b"\n")
                    rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = _place(self.path)
        fs.create_dir(inner, recursive=True)
        old = [f.path for f in _files(self.path)] if self.overwrite else []
        before = 0 if self.overwrite else self._count(fs, inner)
        done = [m for m in messages if m is not None]
        for m in done:
            fs.move(f"{inner}/{STAGING}-{self.job}/{m.file}", f"{inner}/{m.file}")
        for path in old:
            fs.delete_file(path)
        with fs.open_output_stream(f"{inner}/{DONE}") as out:
            out.write(json.dumps({"rows": before + sum(m.rows for m in done)}).encode())
        self._clear(fs, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, fs: pafs.FileSystem, inner: str) -> None:
        if fs.get_file_info(f"{inner}/{STAGING}-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{inner}/{STAGING}-{self.job}")

    @staticmethod
    def _count(fs: pafs.FileSystem, inner: str) -> int:
        if fs.get_file_info(f"{inner}/{DONE}").type == pafs.FileType.NotFound:
            return 0
        with fs.open_input_stream(f"{inner}/{DONE}") as f:
            return json.loads(f.read())["rows"]


class StrictLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strict-lines"

    def schema(self) -> str:
        return "file string, part int, row bigint, value string"

    def reader(self, schema) -> StrictReader:
        return StrictReader(self.options)

    def streamReader(self, schema) -> StrictStreamReader:
        return StrictStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> StrictWriter:
        if "value" not in schema.names:
            raise ValueError("strict-lines writes a column named value")
        return StrictWriter(self.options, overwrite)


def read_strict_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, line, value) of every line that is not blank; lines are counted from 1 in their file, across its ranges.

    A second, counting pass reads bytes and parses nothing; it yields one row per range.
    """
    spark.dataSource.register(StrictLines)
    load = lambda counts: spark.read.format("strict-lines").option("rangebytes", range_bytes).option("counts", counts).load(path)
    in_file = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = load("true").select("file", "part", F.coalesce(F.sum("row").over(in_file), F.lit(0)).alias("_before"))
    return load("false").join(ranges, ["file", "part"]).select("file", (F.col("_before") + F.col("row") + 1).alias("line"), "value")


def stream_strict_lines(spark: SparkSession, path: str, settle_seconds: float = 1.0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same lines as a stream of new files, numbered within their byte range (file, part, row, value)."""
    spark.dataSource.register(StrictLines)
    return spark.readStream.format("strict-lines").option("rangebytes", range_bytes).option("settleseconds", settle_seconds).load(path)


def write_strict_lines(lines: DataFrame, path: str, mode: str = "append") -> int:
    """Write the column value, one line per row, all of it or nothing; returns the number of lines that the folder then holds."""
    lines.sparkSession.dataSource.register(StrictLines)
    lines.select("value").write.format("strict-lines").mode(mode).save(path)
    return StrictWriter._count(*_place(path))
