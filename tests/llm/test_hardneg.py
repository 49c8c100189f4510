import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, score string"


def whole(v):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(data, positives=5, negatives=10):
    rows = [(i, label, whole(v)) for i, label, v, _ in data]
    rows = [r for r in dict.fromkeys((i, label, tuple(v)) for i, label, v in rows if i is not None and label is not None and v is not None)]
    out = []
    for a, label, v in rows:
        if a % 100:
            continue
        score = {(i, other, sum(x * y for x, y in zip(v, w, strict=True))) for i, other, w in rows if i != a and len(w) == len(v)}
        same = sorted({(-s, i) for i, other, s in score if other == label})[:positives]
        for p, pid in same:
            p = -p
            own = sorted({(-s, i) for i, other, s in score if other != label and 30 * p <= 100 * s <= 90 * p})[:negatives]
            out += [(a, pid, r, n, p, -s) for r, (s, n) in enumerate(own, 1)]
    return sorted(out)


def table(n=900, dim=20, seed=1, scale=1.0):
    rng, out = random.Random(seed), []
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    for i in range(n):
        c = centres[min(int(rng.expovariate(0.4)), 11)]
        out.append((i, rng.choice([0, 1, 1, 1, 2]), [scale * (x + rng.gauss(0, 0.8)) for x in c], "x"))
    return out


ODD = [
    (100, None, [1.0] * 20, "x"), (200, 1, None, "x"), (300, 1, [], "x"), (400, 1, [float("nan")] * 20, "x"), (500, 1, [None] * 20, "x"), (600, 1, [float("inf")] + [1.0] * 19, "x"),
    (None, 1, [1.0] * 20, "x"), (700, 1, [0.0] * 20, "x"), (800, 2, [0.5, 0.5], "x"), (801, 2, [0.5, 0.4], "x"), (802, 1, [0.4, 0.2], "x"), (803, 7, [0.4] * 20, "x"), (-100, 1, [0.1] * 20, "x"),
]


def mined(spark, data):
    got = hardneg.mine(spark.createDataFrame(data, SCHEMA).repartition(5), F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_equals_brute_force_with_odd_rows_ties_and_repeats(spark, monkeypatch):
    held = {i for i, *_ in ODD}
    data = [r for r in table() if r[0] not in held] + ODD
    data += [data[0], data[0], data[5], (data[5][0], 0, data[5][2], "another label"), (901, 1, data[5][2], "tie"), (902, 0, data[0][2], "tie")]
    want = brute(data)
    assert want and mined(spark, data) == want
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    monkeypatch.setattr(hardneg, "SHARES", (0.02, 0.1, 1.0))
    assert mined(spark, data) == want


def test_scores_beyond_doubles_are_exact(spark):
    data = [(i, i % 2, [float(2**20 + 977 * i + 64 * j) for j in range(9)], "x") for i in range(0, 300, 25)]
    data += [(i, label, [0.6 * x for x in v], s) for (i, label, v, s) in [(k + 1000, b, v, s) for k, b, v, s in data]]
    assert mined(spark, data) == brute(data) != []


def test_few_rows_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0, 0.0], "x")]) == []
    data = [(100, 1, [1.0, 0.0], "x"), (1, 1, [0.9, 0.1], "x"), (2, 2, [0.5, 0.1], "x"), (3, 2, [0.9, 0.9], "x")]
    assert mined(spark, data) == [(100, 1, 1, 2, 230 * 256, 128 * 256)]


@pytest.mark.parametrize("share", [0.2, 0.8, 2.0, -math.inf])
def test_pairs_above_equal_all_products_and_leave_dimensions_out(share):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 40, (500, 40)) * np.linspace(3, 0.02, 40))
    a = np.floor(rng.normal(0, 40, (30, 40)) * np.linspace(3, 0.02, 40))
    least = np.full(30, share * 20_000.0)
    i, j, score = hardneg.pairs_above(a, hardneg._suffix_norms(a), x, hardneg._suffix_norms(x), least)
    full = a @ x.T
    assert sorted(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == [(p, q, int(full[p, q])) for p, q in zip(*map(np.ndarray.tolist, np.nonzero(full >= least[:, None])), strict=True)]
