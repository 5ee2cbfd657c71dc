"""Result logs that are still being written: a data source over byte positions, for batches and streams.

A log is a file of lines, or a folder of such files. A line counts once its line end is written; an unterminated last line waits for the next
batch. Rows are (file, offset, line): a line's offset is an address that never changes, so (file, offset, key) of all lines is an index of the
log that grows with it, and a filter on file and offset reads only the pieces that hold them.

A stream's position is a number of bytes for each file, always behind a line end. Whatever a batch reads lies between two positions that Spark has
written down, so a batch that is repeated after a failure reads the same lines. Files may be added; a file that went, shrank or was replaced
(no line end stands before the position any more) is an error that names it. Pieces of ``piece`` bytes are read by different tasks: a line belongs
to the piece that holds its first byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

FORMAT = "corvane_log"
PIECE = 64 << 20
#: Bytes that are read at once.
BLOCK = 1 << 20
SCHEMA = "file string, offset long, line string"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Piece(InputPartition):
    """Lines of ``file`` that begin in [first, last); the log is complete up to ``end``. ``at_line``: a line begins at ``first``."""

    file: str
    first: int
    last: int
    end: int
    at_line: bool


class Log:
    """Files of a log and how far each is complete."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a log needs a path")
        self.uri, self.piece = options["path"], int(options.get("piece", PIECE))
        if self.piece < 1:
            raise ValueError(f"pieces have at least one byte, not {self.piece}")

    def sizes(self) -> dict[str, int]:
        store, path = open_folder(self.uri)
        (info,) = store.get_file_info([path])
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no log at {self.uri}")
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}

    def complete(self, since: dict[str, int]) -> dict[str, int]:
        """Position behind the last line end of each file, from the positions ``since``."""
        store, _ = open_folder(self.uri)
        sizes = self.sizes()
        if gone := sorted(set(since) - set(sizes)):
            raise ValueError(f"log file {gone[0]} is gone")
        return {f: self._behind_last_line(store, f, since.get(f, 0), n) for f, n in sizes.items()}

    @staticmethod
    def _behind_last_line(store: fs.FileSystem, file: str, since: int, size: int) -> int:
        if size < since:
            raise ValueError(f"log file {file} was replaced or truncated: {size} bytes, read up to {since}")
        with store.open_input_file(file) as f:
            if since and f.read_at(1, since - 1) != b"\n":
                raise ValueError(f"log file {file} was replaced: no line ends at {since}")
            while size > since:
                at = max(since, size - BLOCK)
                if (k := f.read_at(size - at, at).rfind(b"\n")) >= 0:
                    return at + k + 1
                size = at
        return since

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        """What lies between two positions; the first may be an earlier run's, so it is held against the files."""
        store, _ = open_folder(self.uri)
        for f, at in start.items():
            if at and end.get(f, 0) <= at:
                (info,) = store.get_file_info([f])
                if f not in end or info.type == fs.FileType.NotFound:
                    raise ValueError(f"log file {f} is gone")
                self._behind_last_line(store, f, at, info.size)
        return [Piece(f, a, min(a + self.piece, n), n, a == start.get(f, 0)) for f, n in end.items() for a in range(start.get(f, 0), n, self.piece)]

    def lines(self, p: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.uri)
        with store.open_input_file(p.file) as f:
            at = p.first if p.at_line else p.first - 1  # a line that begins at ``first`` has its line end before it
            held, skip = b"", not p.at_line
            while at < p.last or held:
                block = f.read_at(min(BLOCK, p.end - at - len(held)), at + len(held))
                *whole, held_next = (held + block).split(b"\n")
                offsets, texts = [], []
                for line in whole:
                    if skip:
                        skip = False
                    elif at < p.last:
                        offsets.append(at)
                        texts.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                held = held_next
                if offsets:
                    yield pa.RecordBatch.from_arrays([pa.array([p.file] * len(offsets)), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], ["file", "offset", "line"])
                if at >= p.last or not block:
                    return


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = Log(options)
        self.file, self.low, self.high = None, 0, None

    def partitions(self) -> list[Piece]:
        found = [p for p in self.log.pieces({}, self.log.complete({})) if self.file in (None, p.file)]
        if self.high is None and not self.low:
            return found
        # Of a piece that holds wanted offsets only their stretch is read.
        cut = [Piece(p.file, max(p.first, self.low), p.last if self.high is None else min(p.last, self.high + 1), p.end, p.at_line and p.first >= self.low) for p in found]
        return [p for p in cut if p.first < p.last]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.lines(partition)


class FilteredLogReader(LogReader):
    """The reader of sessions that push filters down to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on file and offset choose pieces; Spark applies all of them again."""
        for f in filters:
            value = getattr(f, "value", None)
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.file = value
            elif getattr(f, "attribute", None) == ("offset",) and isinstance(value, int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = value if self.high is None else min(self.high, value)
            yield f


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log, self.known = Log(options), {}

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        self.known = self.log.complete(self.known)
        return self.known

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        return self.log.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.lines(partition)


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return (FilteredLogReader if self.options.get("pushdown") == "true" else LogReader)(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def read_log(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(file, offset, line) of the complete lines there are now. With ``spark.sql.python.filterPushdown.enabled``, filters on file and offset seek."""
    spark.dataSource.register(GrowingLog)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).option("piece", piece).option("pushdown", pushdown).load(path)


def stream_log(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """The same rows as a stream: each batch has the lines completed since the last."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format(FORMAT).option("piece", piece).load(path)
