"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Unit vectors are nodes of a metric space (cosine c is distance sqrt(2 - 2c)). The top level is a bounded set
of pivots; every vector belongs to its nearest pivot's cell, and a cell's covering radius is measured over all
its vectors. Two cells can hold a pair only if their pivots are within both radii and the threshold distance;
a vector travels to a cell only if it can reach it. Inside each pair of bounded blocks two cover trees with
halving radii are traversed together, pruning node pairs by the same bound; surviving leaves are compared in
double precision. Equal vectors travel once, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import connected_components, shared_table

PIVOT_SAMPLE = 4_000  # vectors drawn to choose pivots from, at most
BLOCK = 10_000  # vectors of a cell that one task holds from each side
LEAF = 48
PRODUCTS = 2_000_000  # cosines of two leaves that a task holds at a time; scattered vectors make large leaves
VALUES = 4_000_000  # components that a task scales at a time
SLACK = 1e-6  # of distances: sqrt(2 - 2c) near 0 is only good to about 1e-7, and pruning must not lose a pair by that


def _unit_rows(batches):
    """(vec_id, dim, key, unit) of batches (vec_id, vector): unit vectors as bytes, nulls where a vector has none."""
    for batch in batches:
        vectors, n = batch.column(1), batch.num_rows
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        values = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
        begin = np.r_[0, np.cumsum(size)]
        unit, key = [None] * n, [None] * n
        for dim in np.unique(size[size > 0]):
            every, step = np.flatnonzero(size == dim), max(1, VALUES // int(dim))
            for rows in np.split(every, range(step, len(every), step)):
                x = values[begin[rows][:, None] + np.arange(dim)]
                most = np.abs(x).max(1)  # not a number if any component is none
                good = (most > 0) & np.isfinite(most)
                x = x[good] / most[good][:, None]
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                for i, u in zip(rows[good].tolist(), x, strict=True):
                    unit[i] = u.tobytes()
                    key[i] = xxhash.xxh3_128_digest(unit[i])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.array(key, pa.binary()), pa.array(unit, pa.binary())], ["vec_id", "dim", "key", "unit"])


def matrix(units, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), float).reshape(-1, dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Nested levels with halving radii: each level adds the sampled vectors that the radius leaves uncovered, farthest
    first, until the pivots are as many as wanted."""
    picked, reach = [0], distances(sample, sample[:1])[:, 0]
    radius = 2.0
    while len(picked) < min(most, len(sample)) and radius > 1e-6:
        far = int(np.argmax(reach))
        if reach[far] <= radius:
            radius /= 2
            continue
        picked.append(far)
        reach = np.minimum(reach, distances(sample, sample[far : far + 1])[:, 0])
    return sample[picked]


class Node:
    __slots__ = ("center", "children", "points", "radius")

    def __init__(self, x: np.ndarray, points: np.ndarray, scale: float):
        """A cover tree node over rows of x: its first point is the center, children cover it at half the scale.

        Points too few, or too scattered for the halved radius to gather them, stay together as a leaf.
        """
        self.center, self.points, self.children = int(points[0]), points, []
        self.radius = float(distances(x[points[:1]], x[points]).max())
        half = min(scale, self.radius) / 2
        if len(points) <= LEAF or half <= 1e-7:
            return
        rest, parts = points, []
        while len(rest):
            near = distances(x[rest[:1]], x[rest])[0] <= half
            near[0] = True
            parts.append(rest[near])
            rest = rest[~near]
            if len(parts) >= 32 and 2 * len(parts) > len(points) - len(rest):
                return
        self.children = [Node(x, p, half) for p in parts]


def close_pairs(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with x[i] @ y[j] >= cosine; with same (x is y) only i < j."""
    limit = math.sqrt(2 - 2 * cosine) + SLACK
    left = Node(x, np.arange(len(x)), 2.0)
    right = left if same else Node(y, np.arange(len(y)), 2.0)
    stack, found = [(left, right)], [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while stack:
        a, b = stack.pop()
        if a.children or b.children:
            aa, bb = a.children or [a], b.children or [b]
            d = distances(x[[n.center for n in aa]], y[[n.center for n in bb]])
            keep = d <= np.array([n.radius for n in aa])[:, None] + np.array([n.radius for n in bb])[None, :] + limit
            if same and a is b:
                keep &= np.tri(len(aa), dtype=bool).T
            stack += [(aa[i], bb[j]) for i, j in zip(*np.nonzero(keep), strict=True)]
            continue
        right, step = y[b.points].T, max(1, PRODUCTS // len(b.points))
        for at in range(0, len(a.points), step):
            part = a.points[at : at + step]
            i, j = np.nonzero(x[part] @ right >= cosine)
            i, j = part[i], b.points[j]
            if same and a is b:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side, keys, n = pdf["side"].to_numpy(), pdf["key"].to_numpy(), pdf["n"].to_numpy()
        x = matrix(pdf["unit"], int(pdf["dim"].iloc[0]))
        if (side < 0).all():
            i, j = close_pairs(x, x, cosine, True)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                return pd.DataFrame({"src": pd.Series([], dtype=object), "dst": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64")})
            i, j = close_pairs(x[a], x[b], cosine, False)
            i, j = a[i], b[j]
        count = np.bincount(i, n[j], len(keys)) + np.bincount(j, n[i], len(keys))
        low = np.arange(len(keys))  # one row that is reachable inside this task, the same for all that reach it
        while True:
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        some = count > 0
        return pd.DataFrame({"src": keys[some], "dst": keys[low[some]], "n": count[some].astype("int64")})

    return run


def _pivots(sample: list, total: int) -> dict[int, np.ndarray]:
    """Pivots of every vector length in the sample: a cell per BLOCK vectors, as far as the sample has them."""
    by_dim: dict[int, list] = {}
    for dim, unit in sample:
        by_dim.setdefault(dim, []).append(unit)
    return {dim: choose_pivots(matrix(units, dim), max(1, round(total * len(units) / len(sample) / BLOCK))) for dim, units in by_dim.items()}


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """(src, dst, n) over the keys of classes: links counted so far, and a class reachable from it (or itself)."""
    spark = classes.sparkSession
    sample = [(r[0], r[1]) for r in classes.select("dim", "unit").orderBy(F.xxhash64("key")).limit(PIVOT_SAMPLE).collect()]
    pivots = spark.sparkContext.broadcast(_pivots(sample, classes.count()))
    none = np.empty((0, 0))  # a length that the sample missed has one cell without a pivot, which everything of that length reaches

    def assign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, reach = np.zeros(len(dims), np.int32), np.full(len(dims), 2.0)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = pivots.value.get(int(dim), none)
                if len(own):
                    d = distances(matrix(batch.column("unit").take(pa.array(rows)).to_pylist(), int(dim)), own)
                    cell[rows], reach[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach)], ["dim", "key", "n", "unit", "cell", "reach"])

    celled = shared_table(classes.select("dim", "key", "n", "unit").mapInArrow(assign, "dim int, key binary, n long, unit binary, cell int, reach double"), "cells")
    limit = math.sqrt(2 - 2 * cosine) + 2 * SLACK
    plan: dict[int, tuple] = {}
    for r in celled.groupBy("dim", "cell").agg(F.max("reach").alias("radius"), F.count("*").alias("size")).collect():  # a row per pivot, and per length without one
        own = pivots.value.get(r.dim, none)
        radius, blocks = plan.setdefault(r.dim, (np.full(max(1, len(own)), -9.0), np.zeros(max(1, len(own)), int)))
        radius[r.cell], blocks[r.cell] = r.radius, math.ceil(r["size"] / BLOCK)
    plan = {dim: (radius, blocks, distances(own, own) <= radius[:, None] + radius[None, :] + limit if len(own := pivots.value.get(dim, none)) else np.ones((1, 1), bool)) for dim, (radius, blocks) in plan.items()}
    plan = spark.sparkContext.broadcast(plan)

    def deal(batches):
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            keys = batch.column("key").to_pylist()
            for dim in np.unique(dims):
                rows, own = np.flatnonzero(dims == dim), pivots.value.get(int(dim), none)
                radius, blocks, near = plan.value[int(dim)]
                d = distances(matrix(batch.column("unit").take(pa.array(rows)).to_pylist(), int(dim)), own) if len(own) else np.zeros((len(rows), 1))
                cell = cells[rows]
                block = np.array([xxhash.xxh32_intdigest(keys[i]) for i in rows]) % blocks[cell]
                reached = near[cell] & (d <= radius + limit)
                for other in np.flatnonzero(reached.any(0)):
                    k = np.flatnonzero(reached[:, other])
                    for b in range(int(blocks[other])):
                        first = (cell[k] < other) | (cell[k] == other) & (block[k] <= b)
                        side = np.where((cell[k] == other) & (block[k] == b), -1, np.where(first, 0, 1))
                        a1, b1, a2, b2 = (np.where(first, x, y).astype(np.int32) for x, y in ((cell[k], other), (block[k], b), (other, cell[k]), (b, block[k])))
                        part = batch.take(pa.array(rows[k])).select(["dim", "key", "n", "unit"])
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a1), pa.array(b1), pa.array(a2), pa.array(b2), pa.array(side.astype(np.int32))], ["dim", "key", "n", "unit", "c1", "b1", "c2", "b2", "side"])

    dealt = celled.mapInArrow(deal, "dim int, key binary, n long, unit binary, c1 int, b1 int, c2 int, b2 int, side int")
    return dealt.groupBy("dim", "c1", "b1", "c2", "b2").applyInPandas(_compare(cosine), "src binary, dst binary, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    Rows whose vectors have at least the given cosine (in double precision) are linked, whatever other columns
    say. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    rows with a null id (whose component is null, and which are kept); vectors of different lengths do not
    link. Links belong to vectors, not to ids: rows that repeat an id with other vectors are judged each by its
    own. Repeated rows are linked with each other. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    units = shared_table(rows.mapInArrow(_unit_rows, "vec_id long, dim int, key binary, unit binary"), "units")
    classes = units.where("key is not null and vec_id is not null").groupBy("dim", "key").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    classes = shared_table(classes, "classes")
    if classes.isEmpty():
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = shared_table(_links(classes, cosine), "links")
    component = connected_components(links.where("src <> dst").select("src", "dst"))
    count = links.groupBy(F.col("src").alias("key")).agg(F.sum("n").alias("others"))
    named = classes.select("key", "low", "n").join(count, "key", "left").join(component.withColumnRenamed("node", "key"), "key", "left")
    named = shared_table(named.select("key", "low", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = shared_table(named.join(smallest, "component").select("key", "n_links", "component_id"), "named")
    some = F.col("vec_id").isNotNull()
    out = units.select("vec_id", "key").join(named, "key", "left").select("vec_id", F.when(some, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(some, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
