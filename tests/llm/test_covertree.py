import numpy as np

from wardstone.llm import covertree


def brute(vectors, cosine):
    ids = sorted(vectors)
    unit = {}
    for i in ids:
        v = vectors[i]
        x = np.array(v, float) if v and all(c is not None for c in v) else np.array([0.0])
        if np.isfinite(x).all() and (x @ x) > 0:
            unit[i] = x / np.sqrt(x @ x)
    comp, n = {i: i for i in ids}, dict.fromkeys(ids, 0)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                n[b] += 1
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return {i: (n[i], comp[i], comp[i] == i) for i in ids}


def vectors():
    rng = np.random.default_rng(5)
    out = [rng.normal(size=12) for _ in range(150)]
    for k in range(12):
        base = rng.normal(size=12)
        out += [base + rng.normal(size=12) * rng.choice([0, 0.05, 0.2, 0.4]) for _ in range(k * 3)]
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(out, -3)}
    rows |= {900: None, 901: [0.0] * 12, 902: [float("nan")] + [1.0] * 11, 903: [None] + [1.0] * 11, 904: [float("inf")] * 12, 905: [], 906: [1.0, 2.0], 907: [2.0, 4.0], 908: [1e-30] * 12}
    return rows


def run(spark, rows, **kw):
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string"), **kw).collect()
    return [(r.vec_id, (r.n_links, r.component_id, r.kept)) for r in got]


def test_equals_brute_force_with_any_blocks(spark, monkeypatch):
    data = vectors()
    for block, leaf in ((2500, 48), (40, 4)):
        monkeypatch.setattr(covertree, "BLOCK", block)
        monkeypatch.setattr(covertree, "LEAF", leaf)
        assert dict(run(spark, [(i, v, "") for i, v in data.items()])) == brute(data, 0.95)


def test_local_traversal_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = covertree.close_pairs(x, x, 0.97, True)
    want = np.argwhere(np.triu(x @ x.T >= 0.97, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(p) for p in want.tolist()]
    i, j = covertree.close_pairs(x[:150], x[150:], 0.97, False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(x[:150] @ x[150:].T >= 0.97).tolist()]


def test_repeats_nulls_and_empty(spark):
    assert sorted(run(spark, [(4, [1.0, 0.0], ""), (4, [1.0, 0.0], ""), (None, [1.0, 0.0], ""), (5, None, "")]), key=str) == sorted([(4, (1, 4, True)), (4, (1, 4, True)), (None, (0, None, True)), (5, (0, 5, True))], key=str)
    assert run(spark, []) == []
    assert run(spark, [(1, None, "")]) == [(1, (0, 1, True))]


def test_links_belong_to_vectors_not_to_ids(spark):
    rows = [(1, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [1.0, 0.01], ""), (3, [0.0, -1.0], "")]
    assert sorted(run(spark, rows)) == [(1, (0, 1, True)), (1, (1, 1, True)), (2, (1, 1, False)), (3, (0, 3, True))]


def test_many_lengths_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(covertree, "PIVOT_SAMPLE", 5)
    monkeypatch.setattr(covertree, "BLOCK", 3)
    rng = np.random.default_rng(8)
    data = {}
    for dim in range(1, 12):
        base = rng.normal(size=dim)
        data |= {dim * 100 + k: (base + rng.normal(size=dim) * 0.02 * (k % 3)).tolist() for k in range(8)}
    data |= {5000: [1e200] * 4, 5001: [2e200] * 4, 5002: [1e-200, 0.0]}
    got = covertree.near_duplicates(spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")).collect()
    del data[5000], data[5001], data[5002]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert found[5000][0] >= 1 and found[5001][1] == found[5000][1]
    rest = {i: v for i, v in found.items() if i < 5000 and not 400 <= i < 500 and not 200 <= i < 300}
    assert rest == {i: v for i, v in brute(data, 0.95).items() if i in rest}
