"""Lines of text as a data source with bounds: partitions of plain files, whole gzip files, inflated in chunks.

A reader never holds more than one chunk and one line. A line is given up as soon as it exceeds max_line, and a file or
split as soon as it has given max_bytes, so that a small compressed file cannot fill a task's memory. Line numbers come
from counts per split: one pass counts, and its sums tell each split where its lines begin.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "bounded_lines"
CHUNK = 1 << 20  # bytes read, or inflated, at a time
SPLIT = 64 << 20  # bytes of a plain file that a task reads
MAX_LINE = 1 << 20  # bytes of a line
MAX_BYTES = 256 << 20
LINES = "file int, split int, place long, value string, error string"
COUNTS = "file int, split int, path string, lines long, bytes long, long_at long"
BATCH_LINES, BATCH_BYTES = 4_096, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in the order of their names; names that begin with _ or . are left out."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    head = path[: len(path) - len(at)] if path.endswith(at) else path[: path.index("://") + 3] if "://" in path else ""
    found = [x for x in system.get_file_info(fs.FileSelector(at, recursive=False)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
    return [(head + x.path, x.size) for x in sorted(found, key=lambda x: x.base_name)]


@dataclass
class Split(InputPartition):
    file: int
    split: int
    path: str
    begin: int
    end: int  # -1: a compressed file as a whole


def chunks(split: Split, max_bytes: int):
    """The split's bytes in chunks, from its begin to the end of its last line; one chunk beyond max_bytes at most.

    A plain split that does not begin its file starts one byte early, so that its first newline ends what is not its own.
    """
    system, path = opened(split.path)
    with system.open_input_file(path) as f:
        given = 0
        if split.end >= 0:
            at = max(split.begin - 1, 0)
            f.seek(at)
            while given <= max_bytes and (raw := f.read(CHUNK)):
                given += len(raw)
                yield raw
            return
        inflate, rest = zlib.decompressobj(31), b""
        while given <= max_bytes:
            raw = rest or f.read(CHUNK // 16)
            if inflate.eof:
                if not raw.strip(b"\0"):
                    return
                inflate = zlib.decompressobj(31)  # another member follows
            out = inflate.decompress(raw, CHUNK)
            if not raw and not out and not inflate.eof:
                raise OSError(f"{split.path}: the gzip file ends too early")
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            given += len(out)
            if out:
                yield out


def lines(split: Split, max_bytes: int, max_line: int):
    """(line or None, bytes) of every line that begins in a split; None for one longer than max_line, at which the split ends."""
    at, held, skip = max(split.begin - 1, 0), b"", split.begin > 0  # at: place in the file of what held begins with
    for chunk in chunks(split, max_bytes):
        parts = (held + chunk).split(b"\n")
        held = parts.pop()
        for line in parts:
            size = len(line) + 1
            if skip:
                skip = False
            elif split.end >= 0 and at >= split.end:
                return
            else:
                yield (line if len(line) <= max_line else None), size
                if len(line) > max_line:
                    return
            at += size
        if skip:
            at, held = at + len(held), b""  # what is not the split's own need not be held
            if at >= split.end:
                return
        elif split.end >= 0 and at >= split.end:
            return
        elif len(held) > max_line:
            yield None, len(held)
            return
    if held and not skip and (split.end < 0 or at < split.end):
        yield held, len(held)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.count = options["path"], options.get("mode") == "count"
        self.max_bytes, self.max_line = int(options.get("maxbytes", MAX_BYTES)), int(options.get("maxline", MAX_LINE))
        self.size = int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[Split]:
        out = []
        for i, (path, size) in enumerate(files_of(self.path)):
            if path.endswith(".gz"):
                out.append(Split(i, 0, path, 0, -1))
            else:
                out += [Split(i, k, path, b, min(b + self.size, size)) for k, b in enumerate(range(0, max(size, 1), self.size))]
        return out

    def read(self, split: Split):
        if self.count:
            yield self._counted(split)
            return
        place, held = 0, []
        size = 0
        for line, _ in lines(split, self.max_bytes, self.max_line):
            place += 1
            value, error = None, "line_long"
            if line is not None:
                try:
                    value, error = line.removesuffix(b"\r").decode(), None
                except UnicodeDecodeError:
                    error = "not_utf8"
            held.append((split.file, split.split, place, value, error))
            size += len(line or b"")
            if len(held) >= BATCH_LINES or size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _counted(self, split: Split) -> pa.RecordBatch:
        n = total = 0
        long_at = None
        for line, size in lines(split, self.max_bytes, self.max_line):
            n, total = n + 1, total + size
            if line is None:
                long_at = n
            if total > self.max_bytes:
                break
        columns = [[split.file], [split.split], [split.path], [n], [total], [long_at]]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in COUNTS.split(", ")])


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in LINES.split(", ")])


class BoundedLines(DataSource):
    """spark.read.format("bounded_lines").load(path): options maxBytes, maxLine and splitBytes; mode "count" gives a row per split."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNTS if self.options.get("mode") == "count" else LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


class TooLarge(ValueError):
    """A file beyond its bounds: the path, what bound, and the line where there is one."""


def read_lines(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, max_line: int = MAX_LINE, split_bytes: int = SPLIT) -> DataFrame:
    """(line, value, error) of a file or a folder's files one after the other; error is not_utf8 or null.

    Lines end at newlines, a carriage return before one is dropped, and empty lines are lines. Refused before anything
    is parsed: more than max_bytes of decompressed text in all, or a line of more than max_line bytes.
    """
    spark.dataSource.register(BoundedLines)
    source = spark.read.format(NAME).option("maxBytes", max_bytes).option("maxLine", max_line).option("splitBytes", split_bytes)
    counts = sorted(source.option("mode", "count").load(path).collect(), key=lambda r: (r.file, r["split"]))  # a row per split of split_bytes
    before, total, first = 0, 0, []
    for r in counts:
        total += r.bytes
        if total > max_bytes:
            raise TooLarge(f"{path}: more than {max_bytes} bytes decompressed")
        if r.long_at is not None:
            raise TooLarge(f"{path}:{before + r.long_at}: line_long")
        first.append((r.file, r["split"], before))
        before += r.lines
    starts = spark.createDataFrame(first, "file int, split int, before long")
    rows = source.option("mode", "lines").load(path)
    starts = F.broadcast(starts) if len(first) <= 100_000 else starts
    return rows.join(starts, ["file", "split"]).select((F.col("before") + F.col("place")).alias("line"), "value", "error")
