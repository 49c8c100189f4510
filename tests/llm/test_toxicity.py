import random
import time
from zlib import crc32

import numpy as np
import pytest

from tests.llm.texts import ODD, prose
from wardstone.llm import toxicity
from wardstone.tables import read_table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_on_documents_with_signs(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "toxic").toPandas()
    toxic, clean = got[got.toxic == 1].score >= 0.7, got[got.toxic == 0].score >= 0.7
    assert toxic.mean() > 0.85 and clean.mean() < 0.005, (toxic.mean(), clean.mean())


def plain_raw(trees, row):
    z = trees.base
    for f, e, leaf in zip(trees.feature, trees.edge, trees.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > e[node])
        z += leaf[node - len(f)]
    return z


def test_trees_lower_the_loss_and_are_read_as_written():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.5)).astype(float)
    model = toxicity.boost(x, y)
    z = model.raw(x)
    assert ((z > 0) == (y == 1)).mean() > 0.98
    assert np.allclose(z[:50], [plain_raw(model, r) for r in x[:50]])


def test_isotonic_steps_equal_the_least_squares_rising_fit():
    rng = np.random.default_rng(5)
    z = rng.normal(size=60).round(1)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * z))).astype(float)
    x, p = toxicity.isotonic(z, y)
    values = np.unique(z)
    n, m = np.array([(z == v).sum() for v in values]), np.array([y[z == v].mean() for v in values])
    # the rising fit by its formula: the greatest over starts of the least over ends of the mean between
    want = [max(min((n[a : b + 1] * m[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(k, len(values))) for a in range(k + 1)) for k in range(len(values))]
    rows = {w: sum(c for c, v in zip(n, want, strict=True) if abs(v - w) < 1e-12) for w in want}
    expected = [(w * rows[w] + 0.5) / (rows[w] + 1) for w in want]
    assert np.allclose(np.interp(values, x, p), np.maximum.accumulate(expected))
    assert (np.diff(p) >= 0).all()


@pytest.mark.parametrize("text", ["you are an idiot", "you 1d10t", "such an i.d.i.o.t you are", "iddddiot", "st*pid thing", "$tup1d"])
def test_disguised_words_are_found(text):
    own = dict(zip(toxicity.FEATURES, toxicity.measure(text, toxicity.Lexicon({})), strict=True))
    assert own["given"] + own["disguised"] > 0


@pytest.mark.parametrize("text", ["hello!!! wow!", "a1b2 c3", "v1.2", "i am a b c", "class1", None, "", "***", "\n\t"])
def test_plain_words_are_not(text):
    own = dict(zip(toxicity.FEATURES, toxicity.measure(text, toxicity.Lexicon({})), strict=True))
    assert own["given"] + own["disguised"] == 0


def test_words_near_the_reader_capitals_and_marks():
    own = dict(zip(toxicity.FEATURES, toxicity.measure("YOU idiot!! " + "word " * 20 + "idiot", toxicity.Lexicon({})), strict=True))
    assert own["near"] == 0.5 and own["shouted"] > 0 and own["piled"] > 0 and own["capitals"] > 0 and own["kinds"] == 1


def test_copies_do_not_make_their_words_toxic():
    rng = random.Random(1)
    fillers = [prose(s, 40) for s in range(300)]
    copy = "odd zzunique " + prose(999, 40)
    texts = fillers + [copy] * 40 + [prose(s, 10) + " grawlix " + prose(s + 1, 10) for s in range(2000, 2040)]
    labels = np.array([0] * 300 + [1] * 40 + [1] * 40)
    order = rng.sample(range(len(texts)), len(texts))
    learned = toxicity.learn_lexicon([texts[i] for i in order], labels[order])
    assert b"grawlix" in learned and b"zzunique" not in learned


def test_odd_rows_repeats_and_empty_tables(spark):
    model = toxicity.fit([prose(s, 5 + s % 19) + (" you idiot" if s % 4 == 0 else "") for s in range(120)], [int(s % 4 == 0) for s in range(120)])
    data = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, "you idiot", "x", 1), (3, "you idiot", "x", 1), (None, "good day", "x", 1)]
    got = toxicity.score(spark.createDataFrame(data, "doc_id long, text string, score string, held_out int"), model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert [r.score >= 0.7 for r in got if r.doc_id == 3] == [False, True, True]
    assert toxicity.fit([], []).score(["x", None]).tolist() == [0.5, 0.5]
    assert toxicity.fit(["a", "b"], [0, 0]).score(["x"]).tolist() == [0.5]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []


def test_very_long_texts_of_any_shape():
    model = toxicity.Lexicon({})
    for text in ("word\n" * 1_000_000, "x" * 5_000_000, "é" * 3_000_000, "a " * 2_000_000, "1a" * 2_000_000):
        began = time.time()
        toxicity.measure(text, model)
        assert time.time() - began < 20
        assert b"".join(toxicity.pieces(text)).decode() == text
