from collections import Counter

from pyspark.sql import functions as F

from tests.llm.texts import ODD
from wardstone.llm import linededup


def brute(rows, ratio):
    pages, held = Counter(), Counter()
    for host, text in {(host or "", text or "") for _, text, host in rows}:
        pages[host] += 1
        held.update({(host, x.strip(" \t\r")) for x in text.split("\n") if x.strip(" \t\r")})
    bad = {k for k, n in held.items() if n > 1 and n > ratio * pages[k[0]]}
    out = []
    for i, text, host in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (host or "", x.strip(" \t\r")) not in bad]
        out.append((i, text if text is None else "\n".join(kept), 0 if text is None else len(lines), 0 if text is None else len(lines) - len(kept)))
    return out


def data():
    rows = []
    for i in range(60):
        host = ["a.com", "b.com", "", None][i % 4]
        lines = [f"own {i}", "menu" if i % 3 else " menu\t", f"part {i % 7}", "", "menu" if i % 5 == 0 else "x" * i]
        rows.append((i, "\n".join(lines), host))
    return rows + [(100 + k, t, "odd") for k, t in enumerate(ODD)] + [(200, "own 3\nmenu", "a.com"), (200, "own 3\nmenu", "a.com"), (None, "menu\r\nmenu", "b.com"), (201, "menu", "small.com"), (202, "menu\nmenu", "b.com")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "keep", 7) for r in rows], "doc_id long, text string, source string, keys string, n_lines int")
    return linededup.drop_boilerplate(df, **kw)


def test_equals_brute_force(spark):
    for ratio in (0.02, 0.1, 0.2, 0.9):
        got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in run(spark, data(), max_ratio=ratio).collect()]
        want = sorted(brute(data(), ratio), key=repr)
        assert sorted(got, key=repr) == want and any(x[3] for x in want)


def test_small_sites_are_cleaned_and_exact_copies_are_one_page(spark):
    rows = [(i, f"own {i}\nmenu", "small.com") for i in range(4)] + [(10 + i, "one copied page\nof two lines", "copied.com") for i in range(9)]
    got = {r.doc_id: r.text for r in run(spark, rows).collect()}
    assert [got[i] for i in range(4)] == [f"own {i}" for i in range(4)] and {got[10 + i] for i in range(9)} == {"one copied page\nof two lines"}


def test_two_pages_make_a_site_and_a_quotation_is_no_furniture(spark):
    rows = [(1, "own 1\nmenu", "two.com"), (2, "own 2\nmenu", "two.com"), (3, "own 3\nmenu", "one.com")]
    rows += [(100 + i, f"own {i}" + "\nas someone said" * (i < 4) + "\nfooter" * (i < 5), "hundred.com") for i in range(100)]
    got = {r.doc_id: r.text for r in run(spark, rows).collect()}
    assert (got[1], got[2], got[3]) == ("own 1", "own 2", "own 3\nmenu")
    assert [got[100 + i] for i in range(5)] == [f"own {i}\nas someone said" for i in range(4)] + ["own 4"]


def test_many_boilerplate_lines_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(linededup, "KEYS_SENT", 0)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in run(spark, data()).collect()]
    assert sorted(got, key=repr) == sorted(brute(data(), linededup.MAX_RATIO), key=repr)


def test_columns_stay_and_tables_may_be_empty(spark):
    out = run(spark, data())
    assert out.columns == ["doc_id", "text", "source", "keys", "n_lines", "n_dropped"] and {r["keys"] for r in out.collect()} == {"keep"}
    assert run(spark, []).collect() == []


def test_helper_names_never_clash(spark):
    df = spark.createDataFrame([(i, f"own {i}\nmenu", "a", 1, 2, 3, 4, 5, 6, 7) for i in range(5)], "doc_id long, text string, source string, `of` int, Keys int, lines int, found int, kept int, judged int, n_dropped int")
    out = linededup.strip_boilerplate(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(i, f"own {i}", "a", 1, 2, 3, 4, 5, 6, 7) for i in range(5)]
    assert linededup.drop_boilerplate(df).columns == [*df.columns[:-1], "n_lines", "n_dropped"]


def test_hosts_come_from_urls(spark):
    urls = ["https://www.A.com:8080/x?y=//b.com", "http://a.com", "//a.com./z", "HTTP://user@A.com#f", "no url", None, "http://[::1]/x", "http:///x"]
    rows = spark.createDataFrame([(u, f"own {i}\nmenu") for i, u in enumerate(urls)], "url string, text string")
    assert [r[0] for r in rows.select(linededup.site_of(F.col("url"))).collect()] == ["a.com", "a.com", "a.com", "a.com", None, None, "[::1]", None]
    out = {r.url: r.text for r in linededup.drop_boilerplate(rows, host=linededup.site_of(F.col("url"))).collect()}
    assert out["http://a.com"] == "own 1" and out["http://[::1]/x"] == "own 6\nmenu"
