"""Language ID: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Weights are learned by follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties on a
bounded sample, then a temperature is fitted on the part of the sample that the weights did not see. Scoring
runs inside Spark tasks over whole texts; a document's log-odds are the mean of its n-grams' weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import text_batches
from wardstone.llm.quality import held_out, labelled_sample, parts

BUCKETS = 1 << 16
TRAIN_ROWS, TRAIN_CHARS = 5_000, 20_000_000  # labelled rows fitted on, and their characters, at most
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 2
SCALE = 30.0  # brings relative n-gram frequencies to the size the penalties are meant for
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
_PRIMES = tuple(np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_rows(text: str | None) -> np.ndarray:
    """Hashed rows of the character 1- to 3-grams of a lower-cased text, repeats included; digits, marks and blanks
    of ASCII are one blank, and grams that hold two blanks are left out."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.r_[np.uint64(32), np.where((c < 128) & ((c < 97) | (c > 122)), np.uint64(32), c), np.uint64(32)]
    blank = c == 32
    c = c[~(blank & np.r_[False, blank[:-1]])]
    if len(c) < 3:
        return np.empty(0, np.int64)
    one, two = c * _PRIMES[0], c[:-1] * _PRIMES[1] + c[1:] * _PRIMES[2]
    three = (two[:-1] ^ two[:-1] >> np.uint64(29)) * _PRIMES[0] + c[2:] * _PRIMES[1]
    blank = c == 32
    h = np.r_[one[~blank], two + np.uint64(1), three[~(blank[:-2] & blank[2:])] + np.uint64(2)]
    h = (h ^ h >> np.uint64(32)) * _PRIMES[1]
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a Unicode letter category; number characters such as a half or Roman eight are none."""
    return any(m.group().isalpha() for m in _LETTER_OR_NUMBER.finditer(text or ""))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): weight times idf, at temperature 1
    bias: np.ndarray
    temperature: float

    def log_odds(self, text: str | None) -> np.ndarray:
        total, count = np.zeros(len(self.languages)), 0
        for rows in map(gram_rows, parts(text)):
            total, count = total + self.table[rows].sum(0), count + len(rows)
        return (SCALE * total / max(count, 1) + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); und with 0 where there is no letter or no language was learned."""
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.log_odds(text))
        return self.languages[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Minimises the log loss of softmax(z / t), by golden section on log t."""
    loss = lambda s: -np.log(np.maximum(softmax(z / np.exp(s))[np.arange(len(y)), y], 1e-300)).mean()
    low, high, g = -1.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(texts: list[str | None], labels: list[str], seed: int = 3) -> Model:
    """Train on texts and their languages; a fifth of them is kept for the temperature. No rows: every text is und."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    docs = []
    for text in texts:
        rows, n = np.unique(np.concatenate([np.empty(0, np.int64), *map(gram_rows, parts(text))]), return_counts=True)
        docs.append((rows, SCALE * n / max(n.sum(), 1)))
    seen = np.zeros(BUCKETS)
    for rows, _ in docs:
        seen[rows] += 1
    idf = np.log((1 + len(docs)) / (1 + seen)) + 1
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    calibrate, learn = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 50 else (order, order)
    k = len(languages)
    z, n, w = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    for _ in range(EPOCHS):
        for d in rng.permutation(learn):
            rows, tf = docs[d]
            at, x = np.r_[rows, BUCKETS], np.r_[tf * idf[rows], 1.0]  # the last row is the bias
            zz, nn = z[at], n[at]
            l1 = np.where(at < BUCKETS, L1, 0.0)[:, None]
            own = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))
            p = softmax(x @ own)
            p[y[d]] -= 1
            g = x[:, None] * p[None, :]
            z[at] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA * own
            n[at] = nn + g * g
    l1 = np.where(np.arange(BUCKETS + 1) < BUCKETS, L1, 0.0)[:, None]
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    model = Model(languages, w[:-1] * idf[:, None], w[-1], 1.0)
    if k > 1 and len(calibrate):
        logits = np.array([docs[d][1] @ model.table[docs[d][0]] + model.bias for d in calibrate])
        model.temperature = _temperature(logits, y[calibrate])
    return model


def train(docs: DataFrame) -> Model:
    """The model of a bounded sample of documents with a language.

    Repeated rows of an id count once, and an id with several languages has the first in order; null and empty texts
    have no n-grams; extra columns are ignored. Empty tables, or languages that are all null, give the model that
    calls every text und.
    """
    marks = docs.where("lang is not null").groupBy("doc_id").agg(F.min("lang").alias("label"))
    return fit(*labelled_sample(docs, marks, TRAIN_ROWS, TRAIN_CHARS))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs; null texts and texts without a letter are und with score 0.

    Repeated rows and null ids pass through; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights per language

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shared.value.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def fold(doc_id: int) -> int:
    """The fold of an id as the contract counts it."""
    return crc32(str(doc_id).encode()) % 4
