import random
import subprocess
import sys
from zlib import crc32

import numpy as np
import pytest

from tests.llm.texts import ODD
from pyspark.sql import functions as F

from wardstone.llm import language, quality

WORDS = {"en": "the of and to in that with from this have", "fr": "le la les des une dans pour que avec être", "de": "der die das und nicht über für ist ein auch"}


def line(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "e"]) for _ in range(n))


def corpus(n=240):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        lang, bad = rng.choice(list(WORDS)), i % 5 == 0
        text = line(rng, lang)
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text, None if i % 17 == 0 else lang, "s", "clash"))
        labels.append((i, int(not bad), 0))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, score string"


def odd():
    return [(10_000 + k, t, "en", "s", "") for k, t in enumerate([*ODD, "1234 !!", " — "])] + [(None, "the of and", "en", "s", ""), (1, "the of and", "en", "s", "")]


def test_quality_separates_held_out_rows_and_scores_odd_ones(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs + odd(), DOCS)
    marks = spark.createDataFrame([*labels, (999_999, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table, marks)
    got = quality.score(table, model).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    want = {i: q for i, q, _ in labels}
    right = [(r.score >= 0.7) == want[r.doc_id] for r in got if r.held_out and r.doc_id in want]
    assert len(right) > 30 and np.mean(right) > 0.95
    kept = quality.keep_good(table, model)
    assert kept.schema == table.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.7}


def test_quality_learns_nothing_from_the_held_out_fold(spark):
    docs, labels = corpus(80)
    flipped = [(i, 1 - q if crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = (quality.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert (a.embedding == b.embedding).all() and (a.bias == b.bias).all()


def test_empty_tables(spark):
    none, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(none, marks)
    assert quality.score(none, model).collect() == [] and quality.score_texts([None, "x"], model.logits(), 0.0).tolist() == [0.5, 0.5]
    assert language.identify(none, language.train(none)).collect() == []
    assert language.fit([], []).predict("hello") == ("und", 0.0)


def test_pieces_of_a_long_text_join_up():
    text = " ".join(str(i) for i in range(5000))
    assert "".join(quality.parts(text, 100)) == text and all(len(p) >= 100 for p in list(quality.parts(text, 100))[:-1])


def test_language_is_right_on_held_out_rows_and_und_without_letters(spark):
    docs, _ = corpus()
    docs = [(i, t.lower().replace("!!", ""), x, s, c) for i, t, x, s, c in docs]
    table = spark.createDataFrame(docs + odd(), DOCS)
    got = language.identify(table, language.train(table)).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    truth = {i: x for i, _, x, *_ in docs}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth.get(r.doc_id)]
    assert len(right) > 30 and np.mean(right) > 0.95
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {10_000 + k for k, t in enumerate([*ODD, "1234 !!", " — "]) if not any(c.isalpha() for c in t or "")}


def test_weights_are_sparse_and_temperature_is_fitted():
    rng = random.Random(1)
    labels = [rng.choice(list(WORDS)) for _ in range(200)]
    model = language.fit([line(rng, x, 5) for x in labels], labels)
    assert 0 < (model.table != 0).mean() < 0.05 and 0.36 < model.temperature < 20.2
    z, y = np.array([[2.0, 0.0]] * 50), np.array([0] * 40 + [1] * 10)
    t = language._temperature(z, y)
    assert abs(2 / t - np.log(4)) < 0.02


def test_an_oversized_text_does_not_end_the_sample(spark):
    ids = spark.range(40).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()
    first, *others = [r.id for r in ids]
    docs = spark.createDataFrame([(first, "x" * 500)] + [(i, f"text {i}") for i in others], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in [first, *others]], "doc_id long, label int")
    assert quality.labelled_sample(docs, marks, 100, 400) == ([f"text {i}" for i in sorted(others)], [i % 2 for i in sorted(others)])


def test_repeats_of_one_id_do_not_fill_the_sample(spark):
    docs = [(i, f"text number {i}", "x") for i in range(300)]
    ids = spark.createDataFrame([(i,) for i, *_ in docs], "doc_id long").where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id")
    first = ids.first().doc_id
    repeated = spark.createDataFrame([*docs, *[(first, f"text number {first}", "x")] * 7000, (first, None, "x"), (first, "y", "x")], "doc_id long, text string, label string")
    marks = spark.createDataFrame([(i, i % 2) for i, *_ in docs], "doc_id long, label int")
    texts, labels = quality.labelled_sample(repeated, marks, 50, 10**6)
    want = sorted(r.doc_id for r in ids.limit(50).collect())
    assert labels == [i % 2 for i in want] and texts == ["" if i == first else f"text number {i}" for i in want]
    assert quality.labelled_sample(repeated.where("false"), marks, 50, 10**6) == ([], [])


@pytest.mark.parametrize("text", ["word\n" * 2_000_000, "wörd\t" * 1_500_000, "x" * 8_000_000, "漢" * 4_000_000])
def test_very_long_texts_are_scored_in_pieces_whatever_their_blanks(text):
    assert "".join(quality.parts(text)) == text
    assert max(map(len, quality.parts(text))) <= 2 << 20
    code = f"import resource, sys; import numpy as np; from wardstone.llm import language, quality; text = {text[:5]!r} * {len(text) // len(text[:5])}; logits = np.zeros(2 * quality.BUCKETS); model = language.Model(['a', 'b'], np.zeros((language.BUCKETS, 2)), np.zeros(2), 1.0); base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; quality.score_texts([text], logits, 0.0); model.predict(text); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, cwd=quality.__file__.rsplit("/wardstone/", 1)[0])
    assert done.returncode == 0, done.stderr[-1000:]
    assert int(done.stdout) < 400 * 1024


def test_a_classifier_fitted_on_nothing_judges_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "b"), (None, None, "c")], "doc_id long, text string, lang string")
    assert quality.keep_good(docs, quality.fit([], [])).count() == 2
