from pyspark.sql import functions as F

from tests.llm.texts import ODD, SCHEMA, frame, prose, rows, words
from wardstone.llm import decontaminate

ITEMS = [(1, prose(1, 40)), (2, prose(2, 13)), (10, prose(3, 7)), (11, "Two Words"), (12, "solo"), (13, None), (14, "!!"), (15, prose(2, 13))]


def brute(texts, items):
    found = []
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    for text in texts:
        w = words(text)
        hit, ids = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                own = wins.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    ids |= own
        found.append((len(w), len(hit), sorted(map(str, ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return found


def texts():
    a = ITEMS[0][1].split()
    return [*ODD, prose(9, 300) + " " + " ".join(a[5:25]).upper() + ", " + prose(8, 50), " ".join(a[:12]) + " " + prose(7, 30), " ".join(a), prose(3, 7) + " solo two, words", "two  words!", prose(2, 13) + " " + prose(2, 13), " ".join(a[0:13] + a[3:16])]


def run(spark, data, items):
    got = decontaminate.contamination(frame(spark, data), frame(spark, [(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")).collect()
    return [(r.doc_id, (r.n_words, r.n_hit, r.item_ids, r.contaminated)) for r in got]


def test_equals_brute_force(spark):
    data = texts()
    assert dict(run(spark, rows(*data), ITEMS)) == dict(enumerate(brute(data, ITEMS), 1))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    data = texts()
    try:
        assert dict(run(spark, rows(*data), ITEMS)) == dict(enumerate(brute(data, ITEMS), 1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_prefixes_are_joined_with_places(spark, monkeypatch):
    tables = {}
    kept = decontaminate.shared_table
    monkeypatch.setattr(decontaminate, "shared_table", lambda df, label: tables.setdefault(label, kept(df, label)))
    data = [prose(1, 40), *[" ".join(prose(1, 40).split()[4:9])] * 30]  # a shingle that is common by itself, inside an item
    assert dict(run(spark, rows(*data), ITEMS))[1][3]
    common = data[1].split()
    assert tables["prefix"].count() == 28 and tables["places"].where("hit").count() < 30  # each of 31 documents holds the common one
    assert tables["places"].where(F.slice("around", F.col("pos") - F.col("first") + 1, 5) == F.array(*map(F.lit, common))).count() == 0


def test_dropping_takes_any_column_names(spark):
    a = ITEMS[1][1]
    df = spark.createDataFrame([(1, a, 4, 5, 6), (2, "clean", 4, 5, 6), (None, a, 4, 5, 6), (3, None, 4, 5, 6)], "doc_id int, text string, `of` int, of_text int, __id int")
    out = decontaminate.drop_contaminated(df, frame(spark, ITEMS, "item_id long, text string"))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_repeats_nulls_and_empty_tables(spark):
    a = ITEMS[1][1]
    got = sorted(run(spark, [(None, a, ""), (3, a, ""), (3, a, ""), (3, "other text", "")], ITEMS), key=str)
    want = brute([a], ITEMS)[0]
    assert got == sorted([(None, want), (3, want), (3, want), (3, brute(["other text"], ITEMS)[0])], key=str)
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, a, "")], []) == [(1, (13, 0, [], False))]
    assert SCHEMA.startswith("doc_id")


def test_a_line_of_many_items_multiplies_nothing(spark):
    line = prose(77, 13)
    items = [(i, line + " " + prose(1000 + i, 5)) for i in range(300)] + [(1000 + i, line) for i in range(50)]
    data = rows(*[prose(i, 60) + " " + line for i in range(40)], prose(5, 30))
    got = dict(run(spark, data, items))
    assert {i: got[i] for i, *_ in data} == {i: b for (i, *_), b in zip(data, brute([t for _, t, *_ in data], items), strict=True)}
    assert len(got[1][2]) == 350 and got[41][2] == []
