"""The learned layer: logistic regression by heavy-ball descent, here with one fold per task.

Training sets of up to MAX_ROWS rows fit one task a fold, and all folds fit at once; larger ones go through
operators/descent.py by the same steps. Scoring has no bound and runs as a join with the weights.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.functions.features import CHAR_GRAM, WORD_GRAM

MAX_ROWS = 10_000
# Fixed values
RATE, MOMENTUM, PENALTY, STEPS, TOLERANCE, FORMAT = 8.0, 0.9, 1e-4, 4_000, 1e-6, 1


class TrainingError(ValueError):
    pass


@dataclass
class Fit:
    weights: np.ndarray
    bias: float
    loss: float
    converged: bool
    iterations: int
    families: list[str] = field(default_factory=list)

    def digest(self) -> str:
        return config_digest(len(self.weights), self.families)

    def to_json(self) -> str:
        body = {"format": FORMAT, "bias": self.bias, "weights": self.weights.tolist(), "trained_families": sorted(self.families), "final_loss": self.loss, "converged": self.converged, "iterations": self.iterations, "config_digest": self.digest()}
        return json.dumps(body, sort_keys=True)

    @staticmethod
    def from_json(text: str, buckets: int) -> Fit:
        try:
            body = json.loads(text)
        except ValueError as e:
            raise TrainingError("the model file is no JSON") from e
        if not isinstance(body, dict) or body.get("format") != FORMAT:
            raise TrainingError("the model file has another format")
        if len(body["weights"]) != buckets:
            raise TrainingError("the model has another number of weights")
        fit = Fit(np.array(body["weights"], float), body["bias"], body["final_loss"], body["converged"], body["iterations"], body["trained_families"])
        if body["config_digest"] != fit.digest():
            raise TrainingError("the model's digest does not match its contents")
        return fit


def config_digest(buckets: int, families: list[str]) -> str:
    """A digest of what a model was trained for: format, feature widths, families and size, not the weights."""
    body = {"format": FORMAT, "spec": {"buckets": buckets, "char_gram": CHAR_GRAM, "word_gram": WORD_GRAM}, "families": sorted(families), "size": buckets}
    return "sha256:" + sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, attack: np.ndarray, buckets: int, steps: int = STEPS, rate: float = RATE, momentum: float = MOMENTUM) -> Fit:
    """Minimise the class-balanced log loss with an L2 penalty on the weights (the bias is free) from zero.

    (row, bucket, value) are the non-zero cells, attack a 0/1 label per row. Converged: no gradient component
    reaches the tolerance, tested before each step. A step that leaves the finite numbers is an error.
    """
    y = np.asarray(attack, float)
    if not len(y) or set(np.unique(y)) != {0.0, 1.0}:
        raise TrainingError("training needs both classes")
    sample = np.where(y > 0.5, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    total, w, v, b, vb, converged, used = sample.sum(), np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, False, 0
    with np.errstate(over="ignore", invalid="ignore"):
        for used in range(1, steps + 1):
            p = sigmoid(np.bincount(row, value * w[bucket], len(y)) + b)
            error = (p - y) * sample
            g, gb = np.bincount(bucket, value * error[row], buckets) / total + PENALTY * w, error.sum() / total
            if max(np.abs(g).max(), abs(gb)) < TOLERANCE:
                converged = True
                break
            v, vb = momentum * v - rate * g, momentum * vb - rate * gb
            w, b = w + v, b + vb
            if not (np.isfinite(w).all() and np.isfinite(b)):
                raise TrainingError("training diverged")
    p = np.clip(sigmoid(np.bincount(row, value * w[bucket], len(y)) + b), 1e-12, 1 - 1e-12)
    loss = float(-(sample * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / total)
    return Fit(w, float(b), loss, converged, used)


def fit_folds(rows: DataFrame, buckets: int, steps: int = STEPS) -> DataFrame:
    """(fold, bias, loss, converged, iterations, weights array) for rows (fold, ordinal, attack, buckets, values)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        n = pdf["buckets"].map(len).to_numpy()
        row = np.repeat(np.arange(len(pdf)), n)
        bucket = np.concatenate([np.asarray(b, np.int64) for b in pdf["buckets"]])
        value = np.concatenate([np.asarray(v, float) for v in pdf["values"]])
        f = fit(row, bucket, value, pdf["attack"].to_numpy(), buckets, steps)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "bias": [f.bias], "loss": [f.loss], "converged": [f.converged], "iterations": [f.iterations], "weights": [f.weights.tolist()]})

    return rows.groupBy("fold").applyInPandas(run, "fold string, bias double, loss double, converged boolean, iterations int, weights array<double>")


def top_features(counts: DataFrame, weights: DataFrame, id_col: str, limit: int = 5) -> DataFrame:
    """(id, rank, bucket, contribution): the buckets that move a row most, from unscaled counts; ties by bucket."""
    from pyspark.sql import Window

    part = counts.join(F.broadcast(weights), "bucket").select(id_col, "bucket", (F.col("count") * F.col("weight")).alias("contribution"))
    order = Window.partitionBy(id_col).orderBy(F.abs("contribution").desc(), "bucket")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
