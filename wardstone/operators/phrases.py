"""Training sets as counts of phrases: exact features in three small tables, so that a fold of a large set fits one task.

With single words, pairs of words and 4-grams, what a word adds to a text's counts is decided by the word and the one
before it. A text is cut behind runs of marks into phrases, each with the mark before it. Rows then count phrases,
phrases count word pairs, and word pairs count buckets; a product with the weights goes up these tables and the
gradient comes down. Nothing is left out, whatever the texts: those that share no phrases only take more room, and sets
beyond MAX_SIZE go through operators/descent.py.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.functions import features as X
from wardstone.operators import training as T

MAX_SIZE = 16_000_000  # phrases of all rows and letters of all distinct phrases: some 300 MB in a task
BLOCK_ROWS, ROWS_AT_ONCE = 32_768, 8_192
#: A mark of its own, where something else than such a mark follows
CUT = re.compile(r"(?<![^ ])[^\w ] (?![^\w ](?: |$))")
SCHEMA = "phrases array<string>, begin binary, phrase binary, scale binary, marks binary"


def phrases_of(text: str) -> list[str]:
    """The phrases of blank-joined tokens, each led by the mark before it, the first one by a blank."""
    at = [m.start() for m in CUT.finditer(text)]
    out = [text[a:b] for a, b in zip([0, *at], [*(i + 1 for i in at), len(text)], strict=True)] if text else []
    return [" " + out[0], *out[1:]] if out else out


def pairs_of(phrase: str) -> list[str]:
    """The words of a phrase, each behind the word before it and a blank."""
    words = phrase.split(" ")
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def pair_cells(pairs: list[str], buckets: int, lane: str = "blake2b") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, bucket, count): what the second word of a pair adds to the counts of a text that ends in the first."""
    if X.WORD_GRAM > 2 or X.CHAR_GRAM > 4:
        raise ValueError("wider features reach beyond the word before")
    before, first = pd.factorize(np.array([p.split(" ")[0] for p in pairs], object))
    parts = []
    for texts, sign in (([p.strip(" ") for p in pairs], 1.0), (list(first), -1.0)):
        at = 0
        for begin, bucket, value in X._sparse(pa.array(texts, pa.string()), lane, False, buckets):
            parts.append((at + np.repeat(np.arange(len(begin) - 1), np.diff(begin)), bucket, sign * value))
            at += len(begin) - 1
        if sign > 0:
            whole, parts = parts, []
    less = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(less[0], kind="stable")
    begin = np.searchsorted(less[0][order], np.arange(len(first) + 1))
    size = np.diff(begin)[before]
    cell = order[np.repeat(begin[before] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
    row, bucket, value = (np.concatenate([*(w[i] for w in whole), x]) for i, x in enumerate((np.repeat(np.arange(len(pairs)), size), less[1][cell], less[2][cell])))
    key, where = np.unique(row * buckets + bucket, return_inverse=True)
    count = np.bincount(where, value, len(key))
    return key[count != 0] // buckets, key[count != 0] % buckets, count[count != 0]


def coded(rows: DataFrame) -> DataFrame:
    """Blocks of rows (text, attack, own, n): blank-joined tokens, their label, the number of their family, how often they come."""

    def block(texts: list, marks: list) -> pa.RecordBatch:
        own = [phrases_of(t) for t in texts]
        code, names = pd.factorize(np.array([p for x in own for p in x], object))
        square = [np.diff(np.r_[0.0, np.cumsum(value * value)][begin]) for begin, _, value in X._sparse(pa.array(texts, pa.string()), "blake2b", False, X.BUCKETS)]
        norm = np.sqrt(np.concatenate(square))
        columns = [np.r_[0, np.cumsum([len(x) for x in own])].astype("<i8"), code.astype("<i4"), 1 / np.where(norm > 0, norm, 1.0), np.concatenate(marks).astype("<f8")]
        return pa.RecordBatch.from_arrays([pa.array([list(names)], pa.list_(pa.string())), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], ["phrases", "begin", "phrase", "scale", "marks"])

    def run(batches):
        texts, marks = [], []
        for batch in batches:
            texts += [t or "" for t in batch["text"].to_pylist()]
            marks.append(np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("attack", "own", "n")], 1))
            if len(texts) >= BLOCK_ROWS:
                yield block(texts, marks)
                texts, marks = [], []
        if texts:
            yield block(texts, marks)

    return rows.select("text", *[F.col(c).cast("double").alias(c) for c in ("attack", "own", "n")]).mapInArrow(run, SCHEMA)


def size_of(blocks: DataFrame) -> int:
    """Phrases of all rows and letters of all distinct phrases."""
    refs = blocks.agg(F.sum(F.octet_length("phrase") / 4).alias("n")).first().n or 0
    letters = blocks.select(F.explode("phrases").alias("p")).distinct().agg(F.sum(F.length("p")).alias("n")).first().n or 0
    return int(refs + letters)


class Table:
    """The rows of one fold: all but those of the family that it holds out."""

    def __init__(self, blocks: list[dict], own: int, buckets: int):
        known, length, phrase, scale, marks = {}, [], [], [], []
        for b in blocks:
            begin, code, s, m = (np.frombuffer(b[c], t) for c, t in (("begin", "<i8"), ("phrase", "<i4"), ("scale", "<f8"), ("marks", "<f8")))
            m = m.reshape(-1, 3)
            kept = m[:, 1] != own
            size = np.diff(begin)
            used, code = np.unique(code[np.repeat(kept, size)], return_inverse=True)
            ids = np.array([known.setdefault(b["phrases"][i], len(known)) for i in used.tolist()], np.int64)
            length.append(size[kept])
            phrase.append(ids[code])
            scale.append(s[kept])
            marks.append(m[kept])
        length, phrase = np.concatenate(length), np.concatenate(phrase)
        order = np.argsort(length, kind="stable")
        begin = np.r_[0, np.cumsum(length)][:-1][order]
        self.scale, marks = np.concatenate(scale)[order], np.concatenate(marks)[order]
        self.y, self.n, length, at = marks[:, 0], marks[:, 2], length[order], 0
        self.parts = []  # (rows, phrases by place and row): rows of one length, some thousand at a time
        while at < len(order):
            upto = min(at + ROWS_AT_ONCE, int(np.searchsorted(length, length[at], "right")))
            self.parts.append((slice(at, upto), phrase[begin[at:upto] + np.arange(length[at])[:, None]]))
            at = upto
        pairs = [pairs_of(p) for p in known]
        code, names = pd.factorize(np.array([p for x in pairs for p in x], object))
        self.words, self.pair = np.array([len(x) for x in pairs], np.int64), code.astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.words)[:-1]].astype(np.int64)
        self.cells = pair_cells(list(names), buckets) if len(names) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.sizes, self.buckets = (len(known), len(names)), buckets

    def phrase_scores(self, w: np.ndarray) -> np.ndarray:
        row, bucket, count = self.cells
        return np.add.reduceat(np.bincount(row, count * w[bucket], self.sizes[1])[self.pair], self.first) if self.sizes[0] else np.empty(0)

    def spread(self, by_phrase: np.ndarray) -> np.ndarray:
        """Sums per bucket of sums per phrase."""
        row, bucket, count = self.cells
        by_pair = np.bincount(self.pair, np.repeat(by_phrase, self.words), self.sizes[1])
        return np.bincount(bucket, count * by_pair[row], self.buckets)

    def shares(self, w: np.ndarray, bias: float):
        """(rows, phrases, probability) of the parts."""
        scores = self.phrase_scores(w)
        for rows, phrase in self.parts:
            z = scores[phrase].sum(0)
            z *= -self.scale[rows]
            z -= bias
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            yield rows, phrase, z


def fit(table: Table, steps: int = T.STEPS) -> T.Fit:
    """training.fit on a table: the same steps, but for the order of additions."""
    y, n, w = table.y, table.n, np.zeros(table.buckets)
    if not len(y) or set(np.unique(y)) != {0.0, 1.0}:
        raise T.TrainingError("training needs both classes")
    many, hits = n.sum(), n[y > 0.5].sum()
    sample = np.where(y > 0.5, many / (2 * hits), many / (2 * (many - hits))) * n
    total, v, b, vb, converged, used = sample.sum(), np.zeros(table.buckets), 0.0, 0.0, False, 0
    with np.errstate(over="ignore", invalid="ignore"):
        for used in range(1, steps + 1):
            by_phrase, gb = np.zeros(table.sizes[0]), 0.0
            for rows, phrase, p in table.shares(w, b):
                p -= y[rows]
                p *= sample[rows]
                gb += p.sum()
                p *= table.scale[rows]
                by_phrase += np.bincount(phrase.ravel(), np.tile(p, len(phrase)), len(by_phrase))
            g, gb = table.spread(by_phrase) / total + T.PENALTY * w, gb / total
            if max(np.abs(g).max(), abs(gb)) < T.TOLERANCE:
                converged = True
                break
            v, vb = T.MOMENTUM * v - T.RATE * g, T.MOMENTUM * vb - T.RATE * gb
            w, b = w + v, b + vb
            if not (np.isfinite(w).all() and np.isfinite(b)):
                raise T.TrainingError("training diverged")
        loss = 0.0
        for rows, _, p in table.shares(w, b):
            p = np.clip(p, 1e-12, 1 - 1e-12)
            loss -= (sample[rows] * np.where(y[rows] > 0.5, np.log(p), np.log(1 - p))).sum()
    return T.Fit(w, float(b), float(loss / total), converged, used)


def fit_folds(sets: list[tuple[DataFrame, list[tuple[str, int]]]], buckets: int, steps: int = T.STEPS) -> DataFrame:
    """training.fit_folds of coded blocks and their folds (name, number of the family held out), a fold in a task; all sets at once."""
    names = [fold for _, folds in sets for fold in folds]
    if len({name for name, _ in names}) < len(names):
        raise ValueError("a fold has one set")
    each = None
    for blocks, folds in sets:
        own = blocks.select(F.explode(F.array(*[F.lit(names.index(f)) for f in folds])).alias("slot"), "*")
        each = own if each is None else each.unionByName(own)

    def run(batches):
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["slot"], []).append(r)
        for slot in list(held):
            name, own = names[slot]
            f = fit(Table(held.pop(slot), own, buckets), steps)
            yield pa.RecordBatch.from_pylist([{"fold": name, "bias": f.bias, "loss": f.loss, "converged": f.converged, "iterations": f.iterations, "weights": f.weights.tolist()}], schema=KIND)

    return each.repartitionById(len(names), F.col("slot")).mapInArrow(run, "fold string, bias double, loss double, converged boolean, iterations int, weights array<double>")


KIND = pa.schema([("fold", pa.string()), ("bias", pa.float64()), ("loss", pa.float64()), ("converged", pa.bool_()), ("iterations", pa.int32()), ("weights", pa.list_(pa.float64()))])
