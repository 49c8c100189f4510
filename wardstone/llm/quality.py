"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax on top.

Features of a document are its blank-separated words (case and marks kept), their character n-grams and its
word pairs, hashed into embedding rows. Embeddings and output weights are trained together by stochastic
gradient descent in numpy on a bounded sample; scoring runs inside Spark tasks over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import text_batches

BUCKETS = 1 << 16  # rows of words and character n-grams; as many more for word pairs
DIM = 8
TRAIN_ROWS = 6_000  # labelled rows fitted on, at most
TRAIN_CHARS = 40_000_000  # and their characters, at most
EPOCHS, RATE = 6, 0.5


def held_out(doc_id) -> F.Column:
    """True for the fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def word_hashes(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text[begin:end], from running sums of a polynomial in an odd base."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    n = len(text)
    power, back = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    upto = np.r_[np.uint64(0), np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * power)]
    h = (upto[end] - upto[begin]) * back[begin]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def document_rows(text: str | None) -> np.ndarray:
    """Embedding rows of all features of a text, repeats included: words, their 3- and 4-grams with the blanks
    at either end, and word pairs; a word after itself, whichever word it is, is one and the same pair."""
    raw = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
    b = np.frombuffer(raw, np.uint8)
    inside = b > 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.int64)
    c = np.where(inside, b, 32).astype(np.uint64)
    g3 = c[:-2] | c[1:-1] << np.uint64(8) | c[2:] << np.uint64(16)
    g4 = (g3[:-1] | c[3:] << np.uint64(24) | np.uint64(1 << 40))[inside[1:-2] & inside[2:-1]]
    grams = np.r_[g3[inside[1:-1]], g4] * np.uint64(0x9E3779B97F4A7C15)
    w = word_hashes(raw, begin, end)
    pairs = _bucket((w[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ w[1:]) * np.uint64(0xD6E8FEB86659FD93)) + BUCKETS
    pairs[w[:-1] == w[1:]] = BUCKETS
    return np.r_[_bucket(grams), _bucket(w), pairs]


@dataclass
class Classifier:
    embedding: np.ndarray  # (2 * BUCKETS, DIM)
    output: np.ndarray  # (DIM, 2)
    bias: np.ndarray  # (2,)
    rows: int = 0  # texts it was fitted on

    def logits(self) -> np.ndarray:
        """Of class 1 against class 0, for each embedding row: averaging rows and averaging these agree."""
        return self.embedding.astype(float) @ (self.output[:, 1] - self.output[:, 0])


def score_texts(texts: list[str | None], logits: np.ndarray, bias: float) -> np.ndarray:
    """Softmax probability of class 1 for each whole text; a text without words gets the bias alone."""
    z = np.full(len(texts), bias)
    for at, text in enumerate(texts):
        total = count = 0
        for rows in map(document_rows, parts(text)):
            total, count = total + logits[rows].sum(), count + len(rows)
        z[at] += total / max(count, 1)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


_BLANK = re.compile(r"[\x00-\x20]")


def parts(text: str | None, size: int = 1 << 20):
    """A text in pieces that end at blanks, ASCII controls among them, of size to 2 * size characters; the last may be shorter.

    Where no blank follows for size characters a piece ends inside the run, whose parts count as words of their own:
    memory stays bounded whatever a very long text holds.
    """
    text, at = text or "", 0
    while at < len(text):
        cut = len(text)
        if cut - at > size:
            blank = _BLANK.search(text, at + size, at + 2 * size)
            cut = blank.end() if blank else min(cut, at + 2 * size)
        yield text[at:cut]
        at = cut


def fit(texts: list[str | None], labels: list[int], seed: int = 11, epochs: int = EPOCHS, rate: float = RATE) -> Classifier:
    """Train on texts with labels 0 or 1. No rows: every score is 0.5."""
    rng = np.random.default_rng(seed)
    model = Classifier(np.zeros((2 * BUCKETS, DIM), np.float32), rng.uniform(-1, 1, (DIM, 2)), np.zeros(2))  # unseen rows say nothing
    docs = []
    for text, label in zip(texts, labels, strict=True):
        rows, n = np.unique(np.concatenate([np.empty(0, np.int64), *map(document_rows, parts(text))]), return_counts=True)
        docs.append((rows.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32), int(label)))
    model.rows, steps, done = len(docs), max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            rows, share, y = docs[k]
            now = rate * (1 - done / steps)
            mean = share @ model.embedding[rows]
            z = mean @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = model.output @ p
            model.output -= now * np.outer(mean, p)
            model.bias -= now * 0.1 * p
            model.embedding[rows] -= (now * len(rows) ** 0.5) * share[:, None] * back.astype(np.float32)
            done += 1
    return model


def labelled_sample(docs: DataFrame, marks: DataFrame, rows: int, chars: int, outside=held_out) -> tuple[list, list]:
    """Texts and labels of a bounded sample of ids outside the held-out fold, the same for the same ids: lowest id hashes first.

    A text that no longer fits into chars is left out; later ones that fit are taken. marks holds (doc_id, label) once
    per id; of rows that repeat an id its shortest text is taken, of equal ones the first in order, and null texts
    are empty. At most rows ids and texts of chars characters in all reach the driver.
    """
    marks = marks.where(~outside(F.col("doc_id")))
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).join(marks, "doc_id")
    once = sized.groupBy("doc_id").agg(F.min("size").alias("size"), F.first("label").alias("label"))  # an id's labels are one
    label, sizes, total = {}, {}, 0
    for r in once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
        if total + r["size"] <= chars:
            total += r["size"]
            label[r["doc_id"]], sizes[r["doc_id"]] = r["label"], r["size"]
    if not label:
        return [], []
    wanted = docs.sparkSession.createDataFrame(sorted(sizes.items()), "doc_id long, size int")
    text = F.coalesce("text", F.lit("")).alias("text")
    found = docs.select("doc_id", text).join(F.broadcast(wanted), "doc_id").where(F.length("text") == F.col("size")).groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    return [texts[i] for i in sorted(texts)], [label[i] for i in sorted(texts)]


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of a bounded sample of labelled documents.

    Labels other than 0 and 1 are ignored, and an id with both is 0. Repeated rows of an id count once; null and
    empty texts are texts without words; extra columns are ignored. Empty tables, or labels of no document, give the
    classifier whose every score is 0.5.
    """
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return fit(*labelled_sample(docs, marks, TRAIN_ROWS, TRAIN_CHARS))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, held_out, score) of every row of docs; other columns are ignored, null and empty texts score too."""
    shared = docs.sparkSession.sparkContext.broadcast((model.logits(), float(model.bias[1] - model.bias[0])))  # 2 * BUCKETS numbers

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(part.column(1).to_pylist(), *shared.value))], ["doc_id", "score"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")


def keep_good(docs: DataFrame, model: Classifier, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, whole and in all columns whatever their names, whose text scores at least threshold.

    Every row is judged by its own text, repeated rows alike; null and empty texts are texts without words; a score at
    the threshold is kept; an empty table stays empty. A classifier that was fitted on nothing judges nothing: all rows stay.
    """
    if not model.rows:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.logits(), float(model.bias[1] - model.bias[0])))
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array(score_texts(part.column(text).to_pylist(), *shared.value) >= threshold))

    return text_batches(docs).mapInArrow(run, docs.schema)
