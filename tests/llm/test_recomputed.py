"""Classifiers, linking and template labels against plain recomputations."""

import math
import random
import re

import numpy as np

from tests.llm.texts import ODD, frame, prose, rows, words
from wardstone.llm import language, license, quality, secrets

M = 2**64 - 1
GOLD = 0x9E3779B97F4A7C15
TEXTS = [prose(k, 5 + 7 * (k % 9), 40) + " É" * (k % 3) for k in range(58)] + ["", "a", "x x x y"]


def quality_rows(text):
    raw = b" " + text.encode() + b" "
    c = [b if b > 32 else 32 for b in raw]
    inside = [b > 32 for b in raw]
    bucket = lambda h: (h >> 40) % quality.BUCKETS
    grams = [c[i] | c[i + 1] << 8 | c[i + 2] << 16 for i in range(len(c) - 2) if inside[i + 1]]
    grams += [c[i] | c[i + 1] << 8 | c[i + 2] << 16 | c[i + 3] << 24 | 1 << 40 for i in range(len(c) - 3) if inside[i + 1] and inside[i + 2]]
    w = []
    for word in re.findall(rb"[^\x00-\x20]+", raw):
        h = sum((b + 1) * pow(GOLD, k, 1 << 64) for k, b in enumerate(word)) & M
        w.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M)
    pairs = [quality.BUCKETS + (0 if a == b else bucket(((a * GOLD & M) ^ b) * 0xD6E8FEB86659FD93 & M)) for a, b in zip(w, w[1:], strict=False)]
    return [bucket(g * GOLD & M) for g in grams] + [bucket(h) for h in w] + pairs if w else []


def test_quality_features_and_training_are_as_written_down():
    labels = [k * 7 % 5 < 2 for k in range(len(TEXTS))]
    for t in TEXTS:
        assert sorted(quality.document_rows(t).tolist()) == sorted(quality_rows(t))
    model = quality.fit(TEXTS, labels, seed=11, epochs=2, rate=0.5)
    rng = np.random.default_rng(11)
    emb, out, bias = {}, rng.uniform(-1, 1, (quality.DIM, 2)).tolist(), [0.0, 0.0]
    steps, done = 2 * len(TEXTS), 0
    for _ in range(2):
        for k in rng.permutation(len(TEXTS)):
            own = quality_rows(TEXTS[k])
            share = {r: own.count(r) / len(own) for r in own}
            mean = [sum(s * emb.get(r, [0.0] * quality.DIM)[d] for r, s in share.items()) for d in range(quality.DIM)]
            z = [sum(mean[d] * out[d][j] for d in range(quality.DIM)) + bias[j] for j in (0, 1)]
            p = [math.exp(x - max(z)) for x in z]
            p = [x / sum(p) - (j == labels[k]) for j, x in enumerate(p)]
            now = 0.5 * (1 - done / steps)
            back = [sum(out[d][j] * p[j] for j in (0, 1)) for d in range(quality.DIM)]
            for d in range(quality.DIM):
                for j in (0, 1):
                    out[d][j] -= now * mean[d] * p[j]
            bias = [bias[j] - now * 0.1 * p[j] for j in (0, 1)]
            for r, s in share.items():
                row = emb.setdefault(r, [0.0] * quality.DIM)
                for d in range(quality.DIM):
                    row[d] -= now * len(share) ** 0.5 * s * back[d]
            done += 1
    logit = {r: sum(e[d] * (out[d][1] - out[d][0]) for d in range(quality.DIM)) for r, e in emb.items()}
    scores = quality.score_texts(TEXTS, model.logits(), float(model.bias[1] - model.bias[0]))
    for t, got in zip(TEXTS, scores, strict=True):
        own = quality_rows(t)
        z = bias[1] - bias[0] + (sum(logit[r] for r in own) / len(own) if own else 0)
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-4


def language_rows(text):
    c = [32, *[32 if ord(x) < 128 and not "a" <= x <= "z" else ord(x) for x in text.lower()], 32]
    c = [x for k, x in enumerate(c) if not (k and x == 32 == c[k - 1])]
    if len(c) < 3:
        return []
    p0, p1, p2 = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    two = [(a * p1 + b * p2) & M for a, b in zip(c, c[1:], strict=False)]
    h = [x * p0 & M for x in c if x != 32] + [(x + 1) & M for x in two]
    h += [((x ^ x >> 29) * p0 + c[k + 2] * p1 + 2) & M for k, x in enumerate(two[:-1]) if not c[k] == 32 == c[k + 2]]
    return [((x ^ x >> 32) * p1 & M) // 2**40 % language.BUCKETS for x in h]


def test_language_weights_and_temperature_are_as_written_down():
    rng = random.Random(2)
    kinds = {"aa": "tha nea ro", "bb": "lou éra ti", "cc": "sch üb ein"}
    labels = [rng.choice(list(kinds)) for _ in range(60)]
    texts = [" ".join(rng.choice((kinds[x] if rng.random() < 0.8 else "ro ti ein").split()) for _ in range(4)) for x in labels]
    for t in [*texts, "", "A1 b", "É"]:
        assert sorted(language.gram_rows(t).tolist()) == sorted(language_rows(t))
    model = language.fit(texts, labels, seed=3)
    names = sorted(kinds)
    tf = [{r: language.SCALE * own.count(r) / len(own) for r in own} for own in map(language_rows, texts)]
    seen = {r: sum(r in x for x in tf) for x in tf for r in x}
    idf = {r: math.log((1 + len(texts)) / (1 + n)) + 1 for r, n in seen.items()}
    rng = np.random.default_rng(3)
    order = rng.permutation(len(texts))
    calibrate, learn = order[:12], order[12:]
    z, n = {}, {}

    def weight(r, j):
        l1, zz = (0.0 if r == "bias" else language.L1), z.get((r, j), 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - math.copysign(l1, zz)) / ((language.BETA + math.sqrt(n.get((r, j), 0.0))) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for d in rng.permutation(learn):
            x = {r: v * idf[r] for r, v in tf[d].items()} | {"bias": 1.0}
            w = {(r, j): weight(r, j) for r in x for j in range(3)}
            s = [sum(v * w[r, j] for r, v in x.items()) for j in range(3)]
            p = [math.exp(v - max(s)) for v in s]
            p = [v / sum(p) - (names[j] == labels[d]) for j, v in enumerate(p)]
            for (r, j), own in w.items():
                g, old = x[r] * p[j], n.get((r, j), 0.0)
                z[r, j] = z.get((r, j), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language.ALPHA * own
                n[r, j] = old + g * g
    for r in idf:
        assert np.allclose(model.table[r], [weight(r, j) * idf[r] for j in range(3)], atol=1e-9)
    assert np.allclose(model.bias, [weight("bias", j) for j in range(3)], atol=1e-9)
    assert 0 < np.count_nonzero(model.table) < 3 * len(idf)  # the penalty keeps weights at zero
    logits = np.array([sum(v * model.table[r] for r, v in tf[d].items()) + model.bias for d in calibrate])
    loss = lambda t: -np.log([language.softmax(a / t)[names.index(labels[d])] for a, d in zip(logits, calibrate, strict=True)]).mean()
    best = min((loss(math.exp(s / 500)), s / 500) for s in range(-500, 1501))[1]
    assert abs(math.log(model.temperature) - best) < 0.01


def test_und_for_texts_without_letters(spark):
    model = language.fit(["the of and"] * 3, ["en"] * 3)
    got = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, rows("½ ²", "Ⅷ", "12 _ !", "ª", "é", None, "")), model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en", 6: "und", 7: "und"}


def linked(text):
    """Spans of all kinds with the weak ones that have a complement in scope and no strong span over them."""
    spans = []
    for kind, (pattern, least, group) in secrets.PATTERNS.items():
        spans += [(m.start(), i, kind, m.end()) for i in [list(secrets.PATTERNS).index(kind)] for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    strong = [s for s in spans if s[2] in secrets.STRONG]
    weak = [s for s in spans if s[2] not in secrets.STRONG and any(o[2] in secrets.COMPLEMENTS[s[2]] and abs(o[0] - s[0]) <= secrets.SCOPE for o in spans) and not any(s[0] < o[3] and o[0] < s[3] for o in strong)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(strong + weak))


def test_linking_equals_brute_force(spark):
    rng = random.Random(12)
    parts = ["AKIA" + "Q7" * 8, "password = hunter2hunter2", "deadbeef" * 5, "A1B2C3D4E5F6G7H8J9K0", "aB3+/" * 8, "https://db.example.org/x", "redis://h:1", "token: abc", "é ü", "word " * 9, "x" * 150]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(150)]
    got = {r.doc_id: r.spans for r in secrets.scan(frame(spark, rows(*texts, *[t for t in ODD if t]))).collect()}
    want = dict(enumerate([linked(t) for t in [*texts, *[t for t in ODD if t]]], 1))
    assert got == want and any("weak" in x or "endpoint" in x for x in want.values())


def copies(text):
    w, out = words(text), set()
    for label, template in license.TEXTS.items():
        t, k = template.split(), license.TEXT_GRAM
        votes = [(p, q) for p in range(len(w) - k + 1) for q in range(len(t) - k + 1) if w[p : p + k] == t[q : q + k]]
        diagonals = sorted({p - q for p, q in votes})
        groups = []
        for d in diagonals:
            if groups and d - groups[-1][-1] <= license.DRIFT:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            own = [(p, q) for p, q in votes if p - q in g]
            start, end = min(p for p, _ in own), max(p for p, _ in own) + k
            share = min(len({p + i for p, _ in own for i in range(k)}) / (end - start), len({q + i for _, q in own for i in range(k)}) / len(t))
            if share >= license.SHARE:
                out.add((label, start, end, round(share, 9)))
    return out


def test_template_copies_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [*ODD[:6]]
    for label, template in license.TEXTS.items():
        t = template.split()
        texts += [template, " ".join(x for x in t if rng.random() > 0.1), prose(1, 30) + " " + " ".join(t[: len(t) * 2 // 3]) + " " + prose(2, 9) + " " + template, label]
        texts.append(" ".join(x + (" filler words in between here" if i % 4 == 3 else "") for i, x in enumerate(t)))  # grams far apart: no copy
    got = {r.doc_id: {(c.label, c.start, c.end, round(c.share, 9)) for c in r.copies} for r in license.scan(frame(spark, rows(*texts))).collect()}
    assert got == {i: copies(t or "") for i, t in enumerate(texts, 1)} and any(got.values())
