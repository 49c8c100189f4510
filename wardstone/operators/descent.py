"""Full-batch descent over sparse blocks: training sets of any size, all folds at once.

Every step is one pass over the blocks: tasks add up the gradients of their rows, and the driver gets sums over
buckets and moves the weights as the local fit does. A row takes part in every fold but the one that holds its
family out. The blocks lie in the shared folder and are held in memory where there is room; a lost executor costs
the blocks it held. The state (weights, velocities, step) is written to the shared folder every SAVE_EVERY steps, and a
fit that is given that folder goes on from the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.operators import blocks as B
from wardstone.operators import training as T
from wardstone.tables import discard, shared_table

SAVE_EVERY = 100


@dataclass
class _State:
    w: np.ndarray  # (buckets, folds)
    v: np.ndarray
    b: np.ndarray  # (folds,)
    vb: np.ndarray
    used: np.ndarray
    converged: np.ndarray


def _errors(b: B.Block, w: np.ndarray, bias: np.ndarray, balance: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, labels, weights of rows) per row and live fold; marks are the label and the number of the row's own fold."""
    y, own = b.marks[:, 0], b.marks[:, 1]
    weight = np.where(y[:, None] > 0.5, balance[1, live], balance[0, live]) * (own[:, None] != live[None, :])
    return b.dot(w) + bias, y, weight


def _gradient(sent, live: np.ndarray):
    def part(b: B.Block) -> np.ndarray:
        w, bias, balance, buckets = sent.value
        z, y, weight = _errors(b, w, bias, balance, live)
        error = (T.sigmoid(z) - y[:, None]) * weight
        return np.concatenate([b.transpose_dot(error, buckets).ravel(), error.sum(0)])

    return part


def _loss(sent, live: np.ndarray):
    def part(b: B.Block) -> np.ndarray:
        w, bias, balance, _ = sent.value
        z, y, weight = _errors(b, w, bias, balance, live)
        p = np.clip(T.sigmoid(z), 1e-12, 1 - 1e-12)
        return -(weight * np.where(y[:, None] > 0.5, np.log(p), np.log(1 - p))).sum(0)

    return part


def _saved(spark, state: _State, step: int, folder: str) -> None:
    rows = [(f, int(state.used[f]), bool(state.converged[f]), float(state.b[f]), float(state.vb[f]), state.w[:, f].tobytes(), state.v[:, f].tobytes()) for f in range(len(state.b))]
    spark.createDataFrame(rows, "fold int, used int, converged boolean, bias double, bias_velocity double, weights binary, velocity binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/step={step}")


def _resumed(spark, folder: str, buckets: int, folds: int) -> tuple[_State, int]:
    """The last state in a folder and its step; zeros where there is none."""
    state = _State(np.zeros((buckets, folds)), np.zeros((buckets, folds)), np.zeros(folds), np.zeros(folds), np.zeros(folds, int), np.zeros(folds, bool))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return state, 0
    # a step whose write was cut off has no _SUCCESS
    steps = [int(s.getPath().getName()[5:]) for s in files.listStatus(path) if s.getPath().getName().startswith("step=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not steps:
        return state, 0
    for r in spark.read.parquet(f"{folder}/step={max(steps)}").collect():  # a row per fold
        state.used[r.fold], state.converged[r.fold], state.b[r.fold], state.vb[r.fold] = r.used, r.converged, r.bias, r.bias_velocity
        state.w[:, r.fold], state.v[:, r.fold] = np.frombuffer(r.weights), np.frombuffer(r.velocity)
    return state, max(steps)


def fit_folds(rows: DataFrame, folds: list[str], buckets: int, steps: int = T.STEPS, state: str | None = None) -> DataFrame:
    """training.fit_folds over all rows (ordinal, attack, family, buckets, values), without a bound on their number.

    folds: families to hold out; a name that no row has, such as 'none', holds out nothing. state: a shared folder
    for the state between steps; a fit that finds one there goes on from it. The iterates are the local fit's, but
    for the order of additions. Refused: a fold without both classes, and steps that leave the finite numbers.
    """
    spark = rows.sparkSession
    own = F.coalesce(F.element_at(F.create_map(*[x for i, f in enumerate(folds) for x in (F.lit(f), F.lit(i))]), F.coalesce("family", F.lit(""))), F.lit(-1))
    blocks = shared_table(B.to_blocks(rows.withColumn("own", own), "ordinal", ("attack", "own")), "blocks")
    per = {(r.own, r.attack): r.n for r in rows.groupBy(own.alias("own"), "attack").agg(F.count("*").alias("n")).collect()}  # a row per fold and class
    count = np.array([[sum(n for (o, a), n in per.items() if a == kind and o != f) for f in range(len(folds))] for kind in (0, 1)], float)
    if not count.all():
        raise T.TrainingError("training needs both classes")
    balance, total = count.sum(0) / (2 * count), count.sum(0)
    s, first = _resumed(spark, state or blocks.shared_at + "-state", buckets, len(folds))
    held = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for step in range(first + 1, steps + 1):
            live = np.flatnonzero(~s.converged)
            if not len(live):
                break
            sent = spark.sparkContext.broadcast((s.w[:, live], s.b[live], balance, buckets))  # buckets numbers per fold
            found = B.summed(held, _gradient(sent, live), ((buckets + 1) * len(live),))
            sent.destroy()
            g = found[: buckets * len(live)].reshape(buckets, len(live)) / total[live] + T.PENALTY * s.w[:, live]
            gb = found[buckets * len(live) :] / total[live]
            s.used[live] = step
            done = np.maximum(np.abs(g).max(0), np.abs(gb)) < T.TOLERANCE
            s.converged[live[done]] = True
            go = live[~done]
            s.v[:, go], s.vb[go] = T.MOMENTUM * s.v[:, go] - T.RATE * g[:, ~done], T.MOMENTUM * s.vb[go] - T.RATE * gb[~done]
            s.w[:, go], s.b[go] = s.w[:, go] + s.v[:, go], s.b[go] + s.vb[go]
            if not (np.isfinite(s.w).all() and np.isfinite(s.b).all()):
                raise T.TrainingError("training diverged")
            if state and step % SAVE_EVERY == 0:
                _saved(spark, s, step, state)
        every = np.arange(len(folds))
        sent = spark.sparkContext.broadcast((s.w, s.b, balance, buckets))
        loss = B.summed(held, _loss(sent, every), (len(folds),)) / total
    finally:
        held.unpersist()
        discard(blocks)
    out = [(f, float(s.b[i]), float(loss[i]), bool(s.converged[i]), int(s.used[i]), s.w[:, i].tolist()) for i, f in enumerate(folds)]
    return spark.createDataFrame(out, "fold string, bias double, loss double, converged boolean, iterations int, weights array<double>")
