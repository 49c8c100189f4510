import numpy as np
import pyarrow as pa
import pytest

from wardstone.functions import features as X
from wardstone.operators import corpus as C
from wardstone.operators import descent, evaluate
from wardstone.operators import phrases as P
from wardstone.operators import training as T


def test_phrases_hold_the_counts_of_any_text():
    rng = np.random.default_rng(4)
    words = ["a", ".", ",", "x1", "the", "<", "​", "ab", "abc", "ignore", "!", "7", "ü", "#", "_"]
    texts = ["", ".", "a"] + [" ".join(rng.choice(words, rng.integers(1, 14))) for _ in range(300)]
    assert [P.phrases_of(t) for t in ("", "a , , b . c", ". a")] == [[], [" a , ,", ", b .", ". c"], [" .", ". a"]]
    pairs = sorted({q for t in texts for p in P.phrases_of(t) for q in P.pairs_of(p)})
    row, bucket, count = P.pair_cells(pairs, X.BUCKETS)
    [(begin, where, value)] = X._sparse(pa.array(texts), "blake2b", False, X.BUCKETS)
    for i, text in enumerate(texts):
        want, got, own = np.zeros(X.BUCKETS), np.zeros(X.BUCKETS), slice(begin[i], begin[i + 1])
        want[where[own]] = value[own]
        for pair in (q for p in P.phrases_of(text) for q in P.pairs_of(p)):
            cells = row == pairs.index(pair)
            np.add.at(got, bucket[cells], count[cells])
        assert (got == want).all(), text


def test_folds_by_phrases_equal_those_by_cells_and_take_no_job_a_step(spark, monkeypatch):
    drawn = C.mixed(spark.range(240).selectExpr("id % 150 AS draw"), 7, 0)
    rows = drawn.selectExpr("ordinal", "text", "IF(attack = 1, 'attack', 'benign') AS label", "family").localCheckpoint()
    monkeypatch.setattr(evaluate, "check_converged", lambda folds: None)
    families = ["direct_override", "encoding_wrapper"]

    def fitted():
        return sorted((r for *_, f in evaluate.fitted_folds(rows, families, 30) for r in f.collect()), key=lambda r: r.fold)

    few = fitted()
    monkeypatch.setattr(T, "MAX_ROWS", 5)
    by_blocks = descent.fit_folds
    monkeypatch.setattr(descent, "fit_folds", lambda *_, **__: pytest.fail("a job for every step"))
    many = fitted()
    monkeypatch.setattr(descent, "fit_folds", by_blocks)
    monkeypatch.setattr(P, "MAX_SIZE", 0)
    most = fitted()
    assert [r.fold for r in few] == [r.fold for r in many] == [r.fold for r in most] == [*families, "none"]
    for a, b, c in zip(few, many, most, strict=True):
        for other in (b, c):
            assert np.allclose(a.weights, other.weights, rtol=0, atol=1e-9) and abs(a.bias - other.bias) < 1e-9 and abs(a.loss - other.loss) < 1e-9
            assert (a.converged, a.iterations) == (other.converged, other.iterations)


def test_one_class_is_refused_by_phrases():
    table = P.Table([{"phrases": [" a"], "begin": np.array([0, 1], "<i8").tobytes(), "phrase": np.zeros(1, "<i4").tobytes(), "scale": np.ones(1).tobytes(), "marks": np.array([1.0, -1, 2]).tobytes()}], -2, 64)
    with pytest.raises(T.TrainingError, match="both classes"):
        P.fit(table)
