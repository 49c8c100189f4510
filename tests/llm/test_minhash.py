import random
import re

import numpy as np

from wardstone.llm import minhash


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["É", "naïve", "Ünter"]
    rows = []
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 20, 60, 300]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append("\n".join([" ".join(w[:10]).upper(), " ".join(w[10:])]))
    rows += [None, "", "  \t\n", "one two", "One  two", "one two three", "x", "nul\x00byte here", " "]
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


def run(spark, rows, schema="doc_id long, text string", **kw):
    return minhash.near_duplicates(spark.createDataFrame(rows, schema), **kw).collect()


def test_equals_brute_force(spark):
    rows = corpus()
    for percent in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows, percent=percent)}
        assert got == brute(rows, percent)


def test_many_blocks_give_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows, percent=80)}
    assert got == brute(rows, 80)


def chained():
    """Groups that no hub settles: texts that drift from one to the next, copies around two centres, and a bridge between them."""
    rng = random.Random(9)
    rows = []
    for _ in range(3):
        w = [f"d{rng.randrange(500)}" for _ in range(80)]
        for _ in range(25):
            w[rng.randrange(len(w))] = f"d{rng.randrange(500)}"
            rows.append(" ".join(w))
    centre = [f"c{i}" for i in range(200)]
    for shift in (0, 12, 24):
        moved = [f"m{i}" for i in range(shift)] + centre[shift:]
        for k in range(15):
            rows.append(" ".join([*moved, f"tail{k}"]))
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


def test_groups_that_hang_together_by_chains(spark, monkeypatch):
    rows = chained()
    want = brute(rows, 80)
    assert any(n >= 20 for n in np.unique([c for _, c in want.values()], return_counts=True)[1])
    for shingles, block in ((400_000, 500), (2_000, 5)):
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows, percent=80)} == want


def test_bands_keep_the_bound_for_every_threshold():
    for percent in range(5, 101):
        rows, bands = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISSES and (rows == 1 or rows * bands <= minhash.VALUES)
    assert minhash.banding(85) == (7, 36) and minhash.banding(80) == (5, 35)


def test_dropping_takes_any_column_names(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t, 5, "x"), (2, t, 6, "y"), (3, "other", 7, None), (None, t, 8, "z")], "doc_id int, text string, `of` int, __id string")
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted([(1, t, 5, "x"), (3, "other", 7, None), (None, t, 8, "z")], key=str)
    assert minhash.drop_near_duplicates(df.limit(0)).collect() == []


def test_nulls_repeats_clashing_columns_and_empty(spark):
    text = "a b c d e f g"
    rows = [(None, text, "x"), (2, text, "y"), (2, text, "y"), (9, None, "z"), (1, text, None)]
    got = run(spark, rows, "doc_id long, text string, component_id string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (9, 0, 9, True)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(3, None, True)]
    assert run(spark, []) == []


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000, np.uint64)
    b = np.r_[a[:3000], rng.integers(0, 2**63, 1000, np.uint64)]
    x, y = minhash.signatures([np.unique(a), np.unique(b)])
    assert abs((x == y).mean() - 3000 / 5000) < 0.12


def test_very_long_text(spark):
    rng = random.Random(1)
    w = [f"q{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:59_000], "tail"])), (3, " ".join(w[:30_000]))]
    assert {r.doc_id: r.component_id for r in run(spark, rows, percent=85)} == {1: 1, 2: 1, 3: 3}
