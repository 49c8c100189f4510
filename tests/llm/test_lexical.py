import math
import random
from collections import Counter

import numpy as np

from tests.llm.texts import ODD, SCHEMA, frame, prose, rows, words
from wardstone.llm import lexical

ITEMS = [(1, "v1 v2 v3 V4"), (2, "v5 v5 v5 nowhere"), (3, None), (4, "!? ,"), (5, "the É x"), (6, prose(3, 40)), (7, "unheard of"), (None, "v9"), (2, "v7 v8"), (1, "v1 v2 v3 V4")]
ITEM_SCHEMA = "item_id long, text string, doc_id long"


def brute(docs, items, k=20):
    """(item, text) -> [(rank, doc_id, score)], by the plain formula."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for item, text in set(items):
        found = []
        for i, b in bags:
            size, score = sum(b.values()), 0
            for w in words(text):
                if b[w]:
                    m = 75 + 25 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item, text] = [(r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted((item, r, d, s) for (item, _), own in out.items() for r, d, s in own if item is not None) + sorted((r, d, s) for (item, _), own in out.items() for r, d, s in own if item is None)


def listed(found):
    found = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]
    return sorted(x for x in found if x[0] is not None) + sorted(x[1:] for x in found if x[0] is None)


def corpus():
    rng = random.Random(5)
    texts = [prose(s, rng.choice([1, 3, 20, 60, 200])) for s in range(150)]
    return [*ODD, *texts, texts[7], texts[7], "v1 " * 3000, "v1 v2 v3 v4"]


def test_results_equal_the_plain_formula_ties_repeats_and_odd_rows_included(spark):
    data = rows(*corpus())
    data += [(3, prose(9, 30), "x"), (data[20][0], data[20][1], "again"), (None, "v1 v2 v3", "n")]
    docs = frame(spark, data, SCHEMA).repartition(7)
    got = listed(lexical.rank_documents(docs, spark.createDataFrame([(i, t, 0) for i, t in ITEMS], ITEM_SCHEMA)))
    want = brute([(i, t) for i, t, _ in data], ITEMS)
    assert [x if x[0] is None else x for x in got] == want


def test_small_shards_blocks_and_query_blocks_change_nothing(spark, monkeypatch):
    data = rows(*corpus())
    docs, items = frame(spark, data, SCHEMA).repartition(3), spark.createDataFrame([(i, t, 0) for i, t in ITEMS], ITEM_SCHEMA)
    want = brute([(i, t) for i, t, _ in data], ITEMS)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 10)
    monkeypatch.setattr(lexical, "INDEX_TERMS", 3)  # so all terms are indexed
    assert listed(lexical.rank_documents(docs, items)) == want


def test_an_index_serves_other_queries(spark):
    data = rows(*corpus())
    index = lexical.build_index(frame(spark, data, SCHEMA).repartition(2))
    for asked in ([(1, "v3 v4 v5")], [(2, "v100 É"), (3, "v7")]):
        got = listed(lexical.search(index, spark.createDataFrame([(i, t, 0) for i, t in asked], ITEM_SCHEMA), k=5))
        assert got == brute([(i, t) for i, t, _ in data], asked, 5)


def test_empty_tables(spark):
    docs, items = frame(spark, [], SCHEMA), spark.createDataFrame([(1, "a b", 0)], ITEM_SCHEMA)
    assert lexical.rank_documents(docs, items).collect() == []
    assert lexical.rank_documents(frame(spark, rows("a b")), items.where("false")).collect() == []
    assert lexical.rank_documents(frame(spark, rows(None, "")), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_shard_search_skips_blocks_and_finds_what_a_full_one_finds():
    rng = np.random.default_rng(2)
    size, decoded = 20_000, []
    lengths = np.sort(rng.integers(5, 500, size))
    m = lexical.length_norm(lengths, size, int(lengths.sum()))

    class Watched(lexical._List):
        __slots__ = ()

        def blocks(self, chosen):
            decoded.append(len(chosen))
            return super().blocks(chosen)

    lists, full = [], np.zeros(size, np.int64)
    for share in (0.002, 0.3, 0.6, 0.9):
        docs = np.flatnonzero(rng.random(size) < share)
        counts = rng.geometric(0.5, len(docs))
        begin = np.arange(0, len(docs), lexical.BLOCK)
        first = docs[begin]
        offsets = docs - np.repeat(first, np.diff(np.r_[begin, len(docs)]))
        w = lexical.weight(size, len(docs))
        lists.append((Watched(len(docs), first.astype("<u2").tobytes(), np.maximum.reduceat(counts, begin).astype("<u4").tobytes(), offsets.astype("<u2").tobytes(), counts.astype("<u4").tobytes(), m), w))
        full[docs] += lexical.impact(counts, m[docs]) * w
    seen = np.zeros(size, bool)
    docs, score = lexical.search_shard(lists, m, seen, 20, 1)
    want = sorted(zip((-full).tolist(), range(size), strict=True))[:20]
    assert sorted(zip((-score).tolist(), docs.tolist(), strict=True))[:20] == want
    assert not seen.any()
    assert sum(decoded) < sum(len(x.first) for x, _ in lists)  # some blocks stayed compressed


def test_terms_of_very_long_texts_are_whole():
    text = " ".join(f"w{i}É" for i in range(300_000)) + " " + "z" * 3_000_000 + " end"
    found = [w for part in lexical.terms_of(text) for w in part]
    assert [w.decode() for w in found] == text.lower().replace("É".lower(), "É").split()
