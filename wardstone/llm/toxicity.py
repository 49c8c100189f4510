"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a given and of a learned lexicon, second-person words near its hits, capitals,
punctuation, and words in disguise (digits or signs for letters, letters apart, letters repeated). The lexicon is
learned from a bounded labelled sample: words whose texts are toxic far more often than others, seen in many
different surroundings, so that copies of one text do not make its words toxic. Everything that is fitted on
learned words sees texts that those words were not learned from: the sample falls into folds, and each fold is
measured with the others' lexicon.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import text_batches
from wardstone.llm.quality import labelled_sample

TRAIN_ROWS, TRAIN_CHARS = 8_000, 40_000_000  # labelled rows fitted on, and their characters, at most
FOLDS = 5
PIECE = 1 << 20  # bytes of a text that are measured at a time
SURROUNDINGS = 4  # different pairs of neighbours that a learned word has in toxic texts, at least
NEAR = 5  # words between a hit and a second-person word that belong together
TREES, DEPTH, RATE, LEAST_LEAF, BINS = 80, 3, 0.15, 4, 32

#: Insults and slurs on persons in four languages, all in lower case.
LEXICON = """
asshole bastard bitch bullshit clown coward cretin creep crap degenerate disgusting dumb dumbass dunce fool freak filth filthy
garbage hate idiot idiotic imbecile jackass jerk liar loser lunatic moron moronic nitwit parasite pathetic pig rat retard rubbish
scum scumbag shit slut stupid trash twat twit ugly vermin vile weakling worthless wretch
abschaum arschloch blödmann depp dreck drecksack dumm dummkopf ekelhaft feigling idioten lügner mistkerl müll schwachkopf schwein
trottel versager wertlos widerlich
abruti con connard connasse crétin débile dégoûtant imbécile lâche menteur minable ordure pathétique pourriture raté salaud salope
stupide
asqueroso basura cabrón cobarde escoria estúpido estúpida gilipollas idiota imbécil inútil mentiroso patético pendejo perdedor
""".split()
#: Words that address the reader, in four languages.
SECOND_PERSON = "you your yours yourself youre ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DISGUISED = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])(?=[0-9@$!|+*]*[A-Za-z])(?=[A-Za-z]*[0-9@$!|+*])[A-Za-z0-9@$!|+*]{3,24}")
_APART = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Za-z](?:[ ._*-][A-Za-z]){2,23}(?![A-Za-z\x80-\xff])")
_REPEATED = re.compile(rb"[A-Za-z]*([A-Za-z])\1\1[A-Za-z]*")
_RUN = re.compile(rb"(.)\1+")
_BLANKS = re.compile(rb"[\x00-\x20]")
_FOLD = bytes.maketrans("".join(SIGNS).encode(), "".join(SIGNS.values()).encode())
FEATURES = ["words", "given", "learned", "weight", "kinds", "second", "near", "capitals", "shouted", "exclaimed", "asked", "piled", "disguised", "signs", "repeated"]


def held_out(doc_id) -> F.Column:
    """True for the fold that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def pieces(text: str | None):
    """A text's bytes in pieces of PIECE bytes that end at blanks, or at a character where there is none for another PIECE."""
    raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(raw):
        cut = len(raw)
        if cut - at > PIECE:
            blank = _BLANKS.search(raw, at + PIECE, at + 2 * PIECE)
            cut = blank.end() if blank else min(cut, at + 2 * PIECE)
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut += 1
        yield raw[at:cut]
        at = cut


def plain_words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


@lru_cache(maxsize=20_000)
def _undisguised(token: bytes) -> tuple[bytes, ...]:
    """Words that a token may stand for: signs read as letters, marks between letters dropped, runs of one letter as one and as two."""
    letters = token.lower().translate(_FOLD, b" ._*-")
    return tuple({letters, _RUN.sub(rb"\1", letters), _RUN.sub(rb"\1\1", letters)})


class Lexicon:
    """The given words and the learned ones with their weights."""

    def __init__(self, learned: dict[bytes, float], given: list[str] | None = None):
        self.given, self.learned = frozenset(w.encode() for w in (LEXICON if given is None else given)), learned
        self.all = self.given | learned.keys()
        self.starred = {(len(w), w[:1], w[-1:]) for w in self.all if len(w) >= 4}

    def hides(self, token: bytes) -> bool:
        """Whether a disguised token is one of the words; a star stands for any letter inside."""
        if not self.all.isdisjoint(_undisguised(token)):
            return True
        low = token.lower()
        return b"*" in low and low.strip(b"*") == low and (len(low), low[:1], low[-1:]) in self.starred and any(len(w) == len(low) and all(a in (b, 42) for a, b in zip(low, w, strict=True)) for w in self.all)


_SECOND = frozenset(w.encode() for w in SECOND_PERSON)


def measure(text: str | None, lexicon: Lexicon) -> list[float]:
    """The features of a whole text, in the order of FEATURES; all zero for null and empty texts."""
    n = given = learned = weight = second = near = upper = letters = shouted = marks = asks = piled = disguised = signs = repeated = 0
    kinds, size = set(), 0
    for raw in pieces(text):
        size += len(raw)
        words = plain_words(raw)
        n += len(words)
        hits = [i for i, w in enumerate(words) if w in lexicon.all]
        you = [i for i, w in enumerate(words) if w in _SECOND]
        second += len(you)
        for i in hits:
            given += words[i] in lexicon.given
            learned += words[i] in lexicon.learned
            weight += lexicon.learned.get(words[i], 0.0)
            kinds.add(words[i])
        if hits and you:
            at, addressed = np.array(hits), np.array(you)
            k = np.searchsorted(addressed, at)
            near += int((np.minimum(np.abs(at - addressed[np.maximum(k - 1, 0)]), np.abs(at - addressed[np.minimum(k, len(you) - 1)])) <= NEAR).sum())
        codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, letters = upper + int(codes[65:91].sum()), letters + int(codes[65:91].sum() + codes[97:123].sum() + codes[192:].sum())
        marks, asks = marks + int(codes[33]), asks + int(codes[63])
        if codes[33] + codes[63] > 1:
            piled += len(re.findall(rb"[!?]{2,}", raw))
        if upper:
            shouted += len(re.findall(rb"(?<![A-Za-z0-9])[A-Z]{3,}(?![A-Za-z0-9])", raw))
        if codes[[*range(48, 58), 64, 36, 33, 124, 43, 42]].any():
            tokens = [t for t in _DISGUISED.findall(raw) if not t.rstrip(b"!|+*$").isalpha()]  # marks after a word are no disguise
            signs += len(tokens)
            hidden = [t for t in tokens if lexicon.hides(t)]
            disguised += len(hidden)
        for m in _APART.finditer(raw):
            disguised += lexicon.hides(m[0])
        for m in _REPEATED.finditer(raw):
            repeated += 1
            disguised += lexicon.hides(m[0])
    hits = given + learned + disguised
    share = 1000 / max(n, 1)
    return [np.log1p(n), given * share, learned * share, weight * share, len(kinds), second * share, near / max(hits, 1), upper / max(letters, 1), shouted * share, marks * share, asks * share, piled * share, disguised * share, signs * share, repeated * share]


def learn_lexicon(texts: list[str | None], labels: np.ndarray) -> dict[bytes, float]:
    """Words with their log-odds of toxic texts: those far more frequent there, in SURROUNDINGS pairs of neighbours or more.

    A word with fewer surroundings than half its texts is left out: copies repeat both.
    """
    toxic, clean = Counter(), Counter()
    around = defaultdict(set)
    for text, y in zip(texts, labels, strict=True):
        seen = set()
        for raw in pieces(text):
            words = plain_words(raw)
            seen.update(words)
            if y:
                for before, word, after in zip([b"", *words[:-1]], words, [*words[1:], b""], strict=True):
                    if len(around[word]) < 1000:
                        around[word].add((before, after))
        (toxic if y else clean).update(seen)
    positive, negative = int(np.sum(labels)), int(len(labels) - np.sum(labels))
    out = {}
    for word, a in toxic.items():
        if len(word) < 3 or len(around[word]) < SURROUNDINGS or 2 * len(around[word]) < min(a, 2000):
            continue
        odds = np.log((a + 0.5) / (positive + 1)) - np.log((clean[word] + 0.5) / (negative + 1))
        error = (1 / (a + 0.5) + 1 / (clean[word] + 0.5)) ** 0.5
        if odds - 1.64 * error > 1.5:
            out[word] = float(odds)
    return out


# -- trees ----------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees of DEPTH levels as arrays: per tree and inner node a feature and an edge (below or equal goes left), per leaf a value."""

    base: float
    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    edge: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, leaf in zip(self.feature, self.edge, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            z += leaf[node - (2**DEPTH - 1)]
        return z


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Newton steps on the logistic loss; splits on at most BINS quantiles of a feature, leaves of LEAST_LEAF rows or more."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = np.log(p / (1 - p))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)  # x <= e[k] exactly where its bin is k or less
    z = np.full(len(x), base)
    inner, shape = 2**DEPTH - 1, (x.shape[1], BINS)
    feature, edge, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**DEPTH))
    at = np.arange(x.shape[1]) * BINS
    for t in range(trees):
        prob = 1 / (1 + np.exp(-z))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if len(own) < 2 * LEAST_LEAF:
                    continue
                cell = (binned[own] + at).ravel()
                sums = [np.bincount(cell, np.repeat(v, x.shape[1]), x.shape[1] * BINS).reshape(shape).cumsum(1) for v in (g[own], h[own], np.ones(len(own)))]
                left_g, left_h, left_n = (s[:, :-1] for s in sums)
                all_g, all_h, all_n = (s[:, -1:] for s in sums)
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                gain[(left_n < LEAST_LEAF) | (all_n - left_n < LEAST_LEAF)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, k], edge[t, k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > edge[t, node])
        place = node - inner
        leaf[t] = RATE * np.bincount(place, g, 2**DEPTH) / (np.bincount(place, h, 2**DEPTH) + 1)
        z += leaf[t, place]
    return Trees(float(base), feature, edge, leaf)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (z, share of ones), by pooling adjacent violators; equal z are one step from the start. One half of a
    row of either kind is added to each step, so that no step is quite sure."""
    values, of = np.unique(z, return_inverse=True)
    blocks: list[list[float]] = []  # [ones, rows, first z, last z]
    for v, ones, rows in zip(values, np.bincount(of, y), np.bincount(of), strict=True):
        blocks.append([ones, rows, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            ones, rows, _, last = blocks.pop()
            blocks[-1][0] += ones
            blocks[-1][1] += rows
            blocks[-1][3] = last
    x = np.array([e for b in blocks for e in (b[2], b[3])])
    p = np.maximum.accumulate(np.repeat([(b[0] + 0.5) / (b[1] + 1) for b in blocks], 2))
    return x, p


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), 0.5)
        z = self.trees.raw(np.array([measure(t, self.lexicon) for t in texts]).reshape(-1, len(FEATURES)))
        return np.clip(np.interp(z, *self.steps), 0, 1)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Train on texts with labels 0 or 1. With labels of one kind or none every score is 0.5."""
    y = np.array(labels, float)
    if len(np.unique(y)) < 2:
        return Model(Lexicon({}), None, (np.zeros(1), np.zeros(1)))
    fold = np.empty(len(y), np.int64)
    for kind in (0, 1):  # as many toxic texts in each fold
        own = np.flatnonzero(y == kind)
        fold[own] = np.arange(len(own)) % FOLDS
    x = np.zeros((len(y), len(FEATURES)))
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        lexicon = Lexicon(learn_lexicon([texts[i] for i in rest], y[rest]))
        for i in np.flatnonzero(fold == f):
            x[i] = measure(texts[i], lexicon)
    z = np.empty(len(y))
    for f in range(FOLDS):
        z[fold == f] = boost(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(Lexicon(learn_lexicon(texts, y)), boost(x, y), isotonic(z, y))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled documents outside the held-out fold.

    Labels other than 0 and 1 are ignored; an id with both is toxic; without usable labels every score is 0.5.
    """
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return fit(*labelled_sample(docs, marks, TRAIN_ROWS, TRAIN_CHARS, held_out))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) of every row of docs; null and empty texts are texts without words.

    Rows that repeat are scored each by its own text; null ids pass through, outside the fold; other columns are
    ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees and a lexicon of at most the sample's words

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1).to_pylist()))], ["doc_id", "score"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")
