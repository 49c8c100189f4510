"""Hard-negative mining by threshold joins of anchors with all vectors, in the manner of L2AP.

Vectors are whole numbers, so that scores are exact. A task's batch of vectors is an inverted index by slices of
dimensions, those with the anchors' largest energy first. A vector is indexed only as far as it has to be: where its
remaining norm times the largest remaining norm of the anchors stays below the least threshold, the dimensions that
follow are left out. Partial scores accumulate slice by slice over the vectors that are still indexed; pairs whose
partial score and remaining norms stay below the anchor's threshold go, and the others get their missing dimensions.

An anchor's positives come first: its threshold there is the score that its own list asks for as it fills. The
windows of its positives begin with a threshold a little below their upper ends; all windows that are not full
after a pass over the table get a lower one, down to their lower ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstone.llm.common import discard, shared_table
from wardstone.tables import dealt_out

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score, between which a negative's lies
ANCHORS = 20_000  # anchors that are sent to all tasks at a time, about
SHARES = (0.25, 0.6, 1.0)  # how far down its window each pass of the table looks
TILE, ROWS, SLICE = 256, 4_000, 8  # anchors and vectors whose scores a task holds together; dimensions of a slice
KEPT = 500_000  # found rows, beyond which a task's lists are cut to what they need
NO_SCORE = -(1 << 63)
EXACT = float(1 << 53)  # sums of products below this are exact in doubles


def whole_vectors(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(vec_id, label, dim, vector): components floor(256 * x) as bytes of doubles, rows that can take part alone."""

    def run(batches):
        for batch in batches:
            ids, label, values = batch.columns
            ok = pc.and_(pc.is_valid(ids), pc.and_(pc.is_valid(label), pc.is_valid(values))).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(values.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            begin = np.r_[0, np.cumsum(size)]
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            ok &= (bad[begin[1:]] == bad[begin[:-1]]) & (size > 0)
            flat = np.floor(256 * np.where(np.isfinite(flat), flat, 0))
            keep = np.flatnonzero(ok)
            found = [flat[begin[i] : begin[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), label.take(pa.array(keep)), pa.array(size[keep].astype(np.int32)), pa.array(found, pa.binary())], ["vec_id", "label", "dim", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, label long, dim int, vector binary")


def matrix(vectors, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), float).reshape(-1, dim)


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norms of what follows each slice boundary, a column per boundary; a little more than exact."""
    edges = range(0, x.shape[1], SLICE)
    with np.errstate(over="ignore"):
        squares = np.stack([np.einsum("ij,ij->i", x[:, e : e + SLICE], x[:, e : e + SLICE]) for e in edges], 1)
        return np.c_[np.sqrt(np.cumsum(squares[:, ::-1], 1)[:, ::-1]), np.zeros(len(x))] * (1 + 1e-9)


def pairs_above(anchors: np.ndarray, suffix: np.ndarray, x: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs with anchors[i] . x[j] >= least[i]; suffix and own: both sides' suffix norms.

    least may be minus infinity. Scores are whole; beyond 64 bits they are the nearest that fits.
    """
    if np.abs(anchors).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] >= EXACT:  # rare: whole numbers of any size
        whole = np.array([[int(v) for v in r] for r in anchors], object) @ np.array([[int(v) for v in r] for r in x], object).T
        found = [(i, j, max(-(1 << 63) + 1, min((1 << 63) - 1, v))) for i, r in enumerate(whole) for j, v in enumerate(r) if v >= least[i]]
        return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    slices, lowest = own.shape[1] - 1, float(least.min())
    reach = own * suffix.max(0)[None, :] < lowest  # dimensions from here on cannot reach the least threshold
    depth = np.where(reach.any(1), reach.argmax(1), slices)
    order = np.argsort(-depth, kind="stable")
    order = order[: int((depth > 0).sum())]
    x, own, depth = x[order], own[order], depth[order]
    partial = np.zeros((len(anchors), len(x)))
    for g in range(slices):
        indexed = int(np.searchsorted(-depth, -g))  # vectors with more than g slices
        if not indexed:
            break
        partial[:, :indexed] += anchors[:, g * SLICE : (g + 1) * SLICE] @ x[:indexed, g * SLICE : (g + 1) * SLICE].T
    rest = own[np.arange(len(x)), depth]
    i, j = np.nonzero(partial + suffix[:, depth] * rest[None, :] >= least[:, None])
    score = partial[i, j]
    for g in np.unique(depth[j]):
        if g < slices:
            some = np.flatnonzero(depth[j] == g)
            score[some] += np.einsum("ij,ij->i", anchors[i[some], g * SLICE :], x[j[some], g * SLICE :])
    keep = score >= least[i]
    return i[keep], order[j[keep]], np.rint(score[keep]).astype(np.int64)


class Best:
    """The best k of each list, by score and then the smaller id: what a task has found so far. Repeats count once."""

    def __init__(self, lists: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(float)  # least: the score that a list asks for now
        self.parts, self.held = [(np.empty(0, np.int64),) * 3], 0

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((of, score, ids))
        self.held += len(of)
        if self.held > KEPT:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, score, ids = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        by = np.lexsort((ids, -score, of))
        of, score, ids = of[by], score[by], ids[by]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        of, score, ids = of[new], score[new], ids[new]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        last = place == self.k - 1
        self.least[of[last]] = np.maximum(self.least[of[last]], score[last])
        keep = place < self.k
        self.parts, self.held = [(of[keep], score[keep], ids[keep])], 0
        return self.parts[0]


def _batches(batches, dim_of: dict):
    """(vec_ids, labels, vectors, suffix norms, anchors of that dim) of ROWS vectors of one length at a time."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.intersect1d(dims, list(dim_of)):
            rows = np.flatnonzero(dims == dim)
            for at in range(0, len(rows), ROWS):
                part = batch.take(pa.array(rows[at : at + ROWS]))
                side = dim_of[int(dim)]
                x = matrix(part.column("vector").to_pylist(), int(dim))[:, side["order"]]
                yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x, _suffix_norms(x), side


def _sides(anchors: list) -> dict:
    """Anchors (number, vec_id, label, dim, vector) by vector length, labels together, dimensions of the largest energy first."""
    out = {}
    for dim in {a.dim for a in anchors}:
        own = sorted((a for a in anchors if a.dim == dim), key=lambda a: (a.label, a.number))
        x = matrix([a.vector for a in own], dim)
        with np.errstate(over="ignore"):
            order = np.argsort(-(x * x).sum(0), kind="stable")
        x = x[:, order]
        out[dim] = {"order": order, "x": x, "suffix": _suffix_norms(x), "number": np.array([a.number for a in own]), "vec_id": np.array([a.vec_id for a in own]), "label": np.array([a.label for a in own])}
    return out


def _positives(sent, k: int):
    """Each anchor's best k other vectors of its label, among a task's."""

    def run(batches):
        sides, n = sent.value
        best = Best(n, k, np.full(n, -np.inf))
        for ids, labels, x, own, side in _batches(batches, sides):
            for label in np.intersect1d(labels, side["label"]):
                rows = np.flatnonzero(labels == label)
                first, last = np.searchsorted(side["label"], [label, label + 1])
                for at in range(first, last, TILE):
                    a = slice(at, min(at + TILE, last))
                    number = side["number"][a]
                    i, j, score = pairs_above(side["x"][a], side["suffix"][a], x[rows], own[rows], best.least[number])
                    other = ids[rows[j]] != side["vec_id"][a][i]
                    best.add(number[i[other]], score[other], ids[rows[j[other]]])
            best.cut()
        yield _found(best)

    return run


def _negatives(sent, k: int):
    """The best k vectors of other labels in each open window, among a task's."""

    def run(batches):
        sides, n, windows = sent.value  # windows: per place in an anchor's list, (list number or -1, least, most) of every anchor
        best = Best(n, k, np.full(n, -np.inf))
        for number, low, _ in windows:
            best.least[number[number >= 0]] = low[number >= 0]
        for ids, labels, x, own, side in _batches(batches, sides):
            for at in range(0, len(side["number"]), TILE):
                a = slice(at, at + TILE)
                anchor = side["number"][a]
                asks = [np.where(number[anchor] >= 0, best.least[number[anchor]], np.inf) for number, _, _ in windows]
                least = np.minimum.reduce(asks)
                some = np.flatnonzero(np.isfinite(least))
                if not len(some):
                    continue
                i, j, score = pairs_above(side["x"][a][some], side["suffix"][a][some], x, own, least[some])
                i = some[i]
                other = labels[j] != side["label"][a][i]
                i, j, score = i[other], j[other], score[other]
                for (number, _, most), ask in zip(windows, asks, strict=True):
                    fits = (score >= ask[i]) & (score <= most[anchor[i]])
                    best.add(number[anchor[i[fits]]], score[fits], ids[j[fits]])
            best.cut()
        yield _found(best)

    return run


def _found(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best.cut()], ["list", "score", "id"])


_FOUND = "list long, score long, id long"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(list, rank, score, id): the best k of every list over all tasks."""
    order = Window.partitionBy("list").orderBy(F.col("score").desc(), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mined(rows: DataFrame, anchors: list) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of a bounded block of anchors."""
    spark = rows.sparkSession
    sides, n = _sides(anchors), len(anchors)
    scan = rows.select("vec_id", "label", "dim", "vector")
    sent = spark.sparkContext.broadcast((sides, n))
    positives = sorted((r.list, r["rank"], r.score, r.id) for r in _merged(scan.mapInArrow(_positives(sent, POSITIVES), _FOUND), POSITIVES).collect())  # POSITIVES rows for each anchor
    low, high = [-(-LOW * p[2] // 100) for p in positives], [HIGH * p[2] // 100 for p in positives]
    open_lists, done, read = [k for k in range(len(positives)) if low[k] <= high[k]], [], []
    for share in SHARES:
        if not open_lists:
            break
        windows = []
        for place in range(1, POSITIVES + 1):
            number, least, most = np.full(n, -1), np.full(n, np.inf), np.full(n, -np.inf)
            for k in open_lists:
                if positives[k][1] == place:
                    least_now = low[k] if share == 1 else max(low[k], high[k] - math.floor((high[k] - low[k]) * share))
                    number[positives[k][0]], least[positives[k][0]], most[positives[k][0]] = k, least_now, high[k]
            windows.append((number, least, most))
        wanted = {positives[k][0] for k in open_lists}
        own = _sides([a for a in anchors if a.number in wanted])
        sent = spark.sparkContext.broadcast((own, len(positives), windows))
        found = shared_table(_merged(scan.mapInArrow(_negatives(sent, NEGATIVES), _FOUND), NEGATIVES), "negatives")
        read.append(found)
        full = {r.list for r in found.groupBy("list").count().where(F.col("count") == NEGATIVES).select("list").collect()} if share < 1 else set(open_lists)
        closed = spark.createDataFrame([(k, anchors[positives[k][0]].vec_id, positives[k][3], positives[k][2]) for k in open_lists if k in full], "list long, anchor_id long, positive_id long, positive_score long")
        done.append(found.join(F.broadcast(closed), "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        open_lists = [k for k in open_lists if k not in full]
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    mined = shared_table(done[0], "mined")
    discard(*read)
    return mined


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among vectors.

    anchor: a condition on vec_id that marks them. Scores are inner products of the components floor(256 * x). An
    anchor's positives are its first POSITIVES other rows of its label; each gets the first NEGATIVES rows of other
    labels whose scores lie between LOW and HIGH percent of the positive's. Higher scores come first, ties by the
    smaller id; fewer rows than wanted are all returned. Rows with a null id, label or vector, an empty vector, or a
    null or non-finite component take no part, and vectors of other lengths have no score. Rows that repeat an id
    with one score count once; a row with the anchor's id is the anchor; an anchor's id with several vectors or
    labels is several anchors. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = shared_table(whole_vectors(dealt_out(vectors, id_col), id_col, F.col(label) if isinstance(label, str) else label, vector_col), "vectors")
    asked = shared_table(rows.where(anchor).distinct().withColumn("at", F.xxhash64("vec_id", "label", "vector")), "anchors")
    blocks, out = math.ceil(asked.count() / ANCHORS), []
    for block in range(blocks):  # a stated query set against all rows, in blocks
        own = asked.where(F.pmod("at", F.lit(blocks)) == block).orderBy("vec_id", "label", "vector").collect()
        if own:
            out.append(_mined(rows, [_Anchor(i, r) for i, r in enumerate(own)]))
    discard(asked, rows)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


class _Anchor:
    __slots__ = ("dim", "label", "number", "vec_id", "vector")

    def __init__(self, number: int, row):
        self.number, self.vec_id, self.label, self.dim, self.vector = number, row.vec_id, row.label, row.dim, bytes(row.vector)
