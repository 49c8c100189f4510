from tests.llm.texts import ODD, frame, prose, rows, words
from wardstone.llm import license

TEXTS = [
    *ODD,
    "Released under the MIT License.",
    "mit license mit   LICENSE; the gnu general public license, General Public",
    "mit-license apache license mit licenses license mit",
    prose(1, 200) + " " + license.TEXTS["mit-text"].title() + " " + prose(2, 50),
    " ".join(w for i, w in enumerate(license.TEXTS["apache-2.0-text"].split()) if i % 17 != 3),
]


def brute(text):
    w = words(text)
    at = sorted((i, label) for label, phrase in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_equals_brute_force(spark):
    got = {r.doc_id: r for r in license.scan(frame(spark, rows(*TEXTS))).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == {i: brute(t) for i, t in enumerate(TEXTS, 1)}
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.values() if r.base_labels)
    n = len(ODD)
    assert got[n + 1].labels == "mit,mit-notice" and got[n + 4].labels == "mit-text" and got[n + 5].labels == "apache-2.0-text"
    assert 0.5 <= got[n + 5].score < 1 and got[n + 4].score == 1 and got[1].score == 0


def test_each_template_is_found_in_its_own_text_and_not_in_half_of_it(spark):
    labels = sorted(license.TEXTS)
    whole = [prose(i, 30) + " " + license.TEXTS[k].upper() + ". " + prose(i + 99, 30) for i, k in enumerate(labels)]
    some = [prose(i, 30) + " " + " ".join(license.TEXTS[k].split()[: len(license.TEXTS[k].split()) // 3]) for i, k in enumerate(labels)]
    got = {r.doc_id: r for r in license.scan(frame(spark, rows(*whole, *some))).collect()}
    assert all(k in got[i].labels.split(",") and got[i].score == 1 for i, k in enumerate(labels, 1))
    assert all(k not in got[len(labels) + i].labels.split(",") for i, k in enumerate(labels, 1))


def test_repeats_nulls_and_empty(spark):
    t = "the mit license"
    got = [(r.doc_id, r.n_base) for r in license.scan(frame(spark, [(None, t, ""), (2, t, ""), (2, t, ""), (2, "no", "")])).collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (2, 1), (2, 1), (2, 0)], key=str)
    assert license.scan(frame(spark, [])).collect() == []
