"""Sparse rows as blocks: compressed row storage, one row of a table for some thousand texts.

A block keeps the cells of its rows in three flat arrays (where each row begins, buckets, values) beside the rows'
ids and their numbers of any other kind. Products with a weight vector, products of the transpose and selections of
rows work on whole blocks in Arrow passes; a matrix is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_CELLS = 2_048, 1_000_000  # a block ends at whichever comes first; a row of more cells is a block of its own
SLICE = 1_024  # buckets of a partial sum that travel together
SENT = 32_000_000  # numbers of all tasks' partial sums that the driver adds up itself; more are added up in a shuffle by slices
SCHEMA = "block string, ids array<long>, begin binary, bucket binary, value binary, marks binary"


@dataclass
class Block:
    ids: np.ndarray
    begin: np.ndarray  # rows + 1
    bucket: np.ndarray
    value: np.ndarray
    marks: np.ndarray  # (rows, marks): numbers of each row, such as its label

    def __len__(self) -> int:
        return len(self.ids)

    def rows(self) -> np.ndarray:
        """The row of each cell."""
        return np.repeat(np.arange(len(self)), np.diff(self.begin))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Products with one weight vector, or with the columns of a matrix."""
        row = self.rows()
        if weights.ndim == 1:
            return np.bincount(row, self.value * weights[self.bucket], len(self)).astype(float)
        return np.stack([np.bincount(row, self.value * w[self.bucket], len(self)) for w in weights.T], 1).astype(float)

    def transpose_dot(self, factor: np.ndarray, buckets: int) -> np.ndarray:
        """Sums per bucket of the cells times their row's factor, or factors."""
        row = self.rows()
        if factor.ndim == 1:
            return np.bincount(self.bucket, self.value * factor[row], buckets)
        return np.stack([np.bincount(self.bucket, self.value * f[row], buckets) for f in factor.T], 1)

    def take(self, rows: np.ndarray) -> Block:
        """The block of some rows, in their order; a row may come twice."""
        size = np.diff(self.begin)[rows]
        begin = np.r_[0, np.cumsum(size)]
        at = np.arange(begin[-1]) + np.repeat(self.begin[rows] - begin[:-1], size)
        return Block(self.ids[rows], begin, self.bucket[at], self.value[at], self.marks[rows])


def _packed(name: str, b: Block) -> pa.RecordBatch:
    columns = [[name], [b.ids], [b.begin.astype("<i8").tobytes()], [b.bucket.astype("<i4").tobytes()], [b.value.astype("<f8").tobytes()], [b.marks.astype("<f8").tobytes()]]
    kinds = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "ids", "begin", "bucket", "value", "marks"])


def unpacked(batches):
    """(name, Block) of every row of record batches of SCHEMA."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
            begin, bucket, value, marks = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("begin", "<i8"), ("bucket", "<i4"), ("value", "<f8"), ("marks", "<f8")))
            yield batch.column("block")[i].as_py(), Block(ids, begin, bucket, value, marks.reshape(len(ids), -1))


def to_blocks(rows: DataFrame, id_col: str, marks: tuple[str, ...] = (), bucket_col: str = "buckets", value_col: str = "values") -> DataFrame:
    """Blocks of rows (id, buckets, values): one pass, no shuffle. marks: columns of numbers that go along.

    Rows without cells stay as rows; null cells are none; an empty table has no blocks.
    """
    columns = [F.col(id_col).cast("long").alias("id"), F.coalesce(bucket_col, F.array()).cast("array<int>").alias("b"), F.coalesce(value_col, F.array()).cast("array<double>").alias("v"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(marks)]]

    def run(batches):
        part, made, held, cells = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            size = np.concatenate([h[1] for h in held])
            return _packed(f"{part}-{made}", Block(np.concatenate([h[0] for h in held]), np.r_[0, np.cumsum(size)], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])))

        for batch in batches:
            size = pc.list_value_length(batch.column("b")).to_numpy()
            ends = np.r_[0, np.cumsum(size)]
            ids, bucket, value = batch.column("id").to_numpy(), batch.column("b").flatten().to_numpy(), batch.column("v").flatten().to_numpy()
            mark = np.stack([batch.column(f"m{i}").to_numpy() for i in range(len(marks))], 1) if marks else np.empty((len(ids), 0))
            at = 0
            while at < len(ids):
                room = BLOCK_ROWS - sum(len(h[0]) for h in held)
                upto = min(at + room, max(int(np.searchsorted(ends, ends[at] + BLOCK_CELLS - cells, "right")) - 1, at + (not held)))
                if upto > at:
                    held.append((ids[at:upto], size[at:upto], bucket[ends[at] : ends[upto]], value[ends[at] : ends[upto]], mark[at:upto]))
                    cells += int(ends[upto] - ends[at])
                if upto < len(ids) or sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                    yield block()
                    made, held, cells = made + 1, [], 0
                at = upto
        if held:
            yield block()

    return rows.select(*columns).mapInArrow(run, SCHEMA)


def dot(blocks: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, value): each row's product with a weight vector, which is sent to all tasks."""
    sent = blocks.sparkSession.sparkContext.broadcast(np.asarray(weights, float))

    def run(batches):
        for _, b in unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(b.ids), pa.array(b.dot(sent.value))], ["id", "value"])

    return blocks.mapInArrow(run, "id long, value double")


def select_rows(blocks: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """Blocks of the rows whose ids are among the wanted, each once; ids travel, cells do not. Blocks without one go."""
    at = blocks.select("block", F.posexplode("ids").alias("row", "id"))
    rows = at.join(wanted.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def run(batches):
        for batch in batches:
            for (name, b), chosen in zip(unpacked([batch]), batch.column("rows"), strict=True):
                yield _packed(name, b.take(chosen.values.to_numpy(zero_copy_only=False)))

    return blocks.join(rows, "block").mapInArrow(run, SCHEMA)


def summed(blocks: DataFrame, part: Callable[[Block], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all blocks of part(block), an array of the given shape: partial sums per task, then of the tasks.

    Tasks are added up in order, so that the same blocks in the same tasks give the same sum. Beyond SENT numbers the
    tasks' sums meet slice by slice in a shuffle, and the driver gets one array whatever the number of tasks.
    """
    size = int(np.prod(shape))
    if not size:
        return np.zeros(shape)

    def run(batches):
        total = np.zeros(size)
        for _, b in unpacked(batches):
            total += np.asarray(part(b), float).reshape(-1)
        task = TaskContext.get().partitionId()
        cut = range(0, size, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int32()), pa.array([total[i : i + SLICE].tobytes() for i in cut], pa.binary())], ["task", "slice", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = np.sum([np.frombuffer(x.as_buffer(), float) for x in rows.column("sums")], 0)
        return pa.table({"slice": rows.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    found = blocks.mapInArrow(run, "task int, slice int, sums binary")
    if blocks.rdd.getNumPartitions() * size <= SENT:
        rows, out = sorted(found.collect(), key=lambda r: (r["slice"], r.task)), np.zeros(size)
    else:
        rows, out = found.groupBy("slice").applyInArrow(add, "slice int, sums binary").collect(), np.zeros(size)
    for r in rows:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(r.sums, float)
    return out.reshape(shape)


def transpose_dot(blocks: DataFrame, factor: Callable[[Block], np.ndarray], buckets: int) -> np.ndarray:
    """Sums per bucket of all cells times their row's factor, which is taken from its block."""
    return summed(blocks, lambda b: b.transpose_dot(np.asarray(factor(b), float), buckets), (buckets,))
