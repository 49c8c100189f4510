"""Lines as numbered part files, committed as a whole: the same rows give the same bytes.

Tasks write each part under a name of their own in a staging folder; the commit moves those of the tasks that count to
their final names and writes a manifest last, the abort deletes what was staged. Gzip files carry no time and no name.
"""

from __future__ import annotations

import gzip
import json
from dataclasses import dataclass
from hashlib import sha256
from uuid import uuid4

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wardstone.operators.metrics import with_position
from wardstone.sources.lines import opened

NAME = "numbered_parts"
MANIFEST = "_MANIFEST.json"
PART_ROWS = 100_000  # lines of a part file


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[int, str, int, str]]  # part, staged name, lines, sha256 of the file


class _Digested:
    """A stream that passes bytes on and digests them."""

    def __init__(self, stream):
        self.stream, self.digest = stream, sha256()

    def write(self, raw) -> int:
        raw = bytes(raw)
        self.digest.update(raw)
        self.stream.write(raw)
        return len(raw)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.stream.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.suffix = ".jsonl.gz" if options.get("compressed") == "true" else ".jsonl"
        self.staging = f"{self.path}/_staging-{uuid4().hex}"

    def write(self, batches) -> Written:
        system, folder = opened(self.staging)
        system.create_dir(folder, recursive=True)
        task, done, part, out, raw, n, name = TaskContext.get().taskAttemptId(), [], None, None, None, 0, ""

        def close() -> None:
            if out is not None:
                if out is not raw:
                    out.close()
                raw.close()
                done.append((part, name, n, raw.digest.hexdigest()))

        for batch in batches:
            for own, value in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if own != part:
                    close()
                    part, n, name = own, 0, f"{own}-{task}"
                    raw = _Digested(system.open_output_stream(f"{folder}/{name}", compression=None))
                    out = gzip.GzipFile("", "wb", 6, raw, mtime=0) if self.suffix.endswith(".gz") else raw
                out.write(value.encode() + b"\n")
                n += 1
        close()
        return Written(done)

    def _name(self, part: int) -> str:
        return f"part-{part:06d}{self.suffix}"

    def commit(self, messages: list) -> None:
        system, folder = opened(self.path)
        staged = opened(self.staging)[1]
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        there = [x.path for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.File]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds files already")
        if len({p for p, *_ in parts}) < len(parts):
            self.abort(messages)
            raise ValueError("a part was written by two tasks: deal the rows out by part")
        for x in there:
            system.delete_file(x)
        system.create_dir(folder, recursive=True)
        for part, name, *_ in parts:
            system.move(f"{staged}/{name}", f"{folder}/{self._name(part)}")
        body = {"format": 1, "parts": [{"name": self._name(p), "lines": n, "sha256": d} for p, _, n, d in parts]}
        with system.open_output_stream(f"{folder}/{MANIFEST}.new", compression=None) as f:
            f.write((json.dumps(body, sort_keys=True, indent=1) + "\n").encode())
        system.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")
        if parts:
            system.delete_dir(staged)

    def abort(self, messages: list) -> None:
        system, staged = opened(self.staging)
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)
        folder = opened(self.path)[1]
        if system.get_file_info(folder).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(folder)):
            system.delete_dir(folder)


class NumberedParts(DataSource):
    """df.write.format("numbered_parts").save(path) of rows (part, value), a part's rows together and in order; option compressed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def write_parts(lines: DataFrame, path: str, order: str = "ordinal", compressed: bool = False, part_rows: int = PART_ROWS) -> None:
    """lines (order, value) as part files of part_rows lines each, in order; an earlier folder's files are replaced.

    A part holds the rows from its number times part_rows on, so that neither partitions nor tasks change a byte. Until
    the commit the folder keeps its old files; a failed job leaves nothing of its own.
    """
    lines.sparkSession.dataSource.register(NumberedParts)
    rows = with_position(lines.select(order, "value"), order).withColumn("part", F.floor(F.col("position") / part_rows).cast("int"))
    dealt = rows.repartition("part").sortWithinPartitions("part", order).select("part", "value")
    dealt.write.format(NAME).option("compressed", str(compressed).lower()).mode("overwrite").save(path)
