"""Benchmark decontamination as a prefix-filtered set join with exact verification (DataFrame functions only).

Every item is cut into windows of `window` words (a shorter item is one window). A window occurs in a document
only if each of its word shingles does, so its rarest shingle is a sufficient prefix. A first pass over the
documents counts how often each benchmark shingle occurs in them, and stores nothing else. A second pass joins the
prefixes alone and keeps the words around each place; the prefix's offset fixes where the window would start, the
lengths bound it, and the words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import broadcast_if_small, fresh, shared_table, words_of

WINDOW, SHINGLE = 13, 5
BROADCAST_ROWS = 1_000_000  # benchmark shingles, of 12 bytes each, that are broadcast; more are joined by a shuffle


def _shingle(words: Column | str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, n, window_words): the windows of every item with words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    return items.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda i: F.slice("words", i + 1, F.col("n")))).alias("window_words")).distinct()


def shingles_at(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_hash, words, n_words, pos, k, hash): the shingle of each of the given sizes at every word.

    hash is null where fewer words follow, and a document without words has one row with null pos.
    """
    rows = docs.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_hash", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word")).drop("word")
    shingle = lambda k: F.when(F.col("pos") <= F.col("n_words") - k, _shingle("words", F.col("pos"), k))
    if len(sizes) == 1:
        return rows.select("*", F.lit(sizes[0]).alias("k"), shingle(sizes[0]).alias("hash"))
    return rows.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), shingle(k).alias("hash")) for k in sizes])))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows, with a broadcast hint if they are few; beyond that the join shuffles by hash."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prefix_places(docs: DataFrame, sizes: list[int], wanted: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Places (doc_id, text_hash, n_words, k, hash, pos, first, around) of the wanted shingles (k, hash), around being the
    words from first on that a window over the place can reach; and texts (doc_id, text_hash, n_words), a row per document."""
    rows, first = shingles_at(docs, sizes), F.greatest(F.col("pos") - (window - F.col("k")), F.lit(0))
    around = F.slice("words", first + 1, 2 * window - F.col("k"))
    keep = ["doc_id", "text_hash", "n_words", "k", "hash", "pos"]
    if wanted.count() <= BROADCAST_ROWS:  # one scan for both: besides the hits, a row per document, that of its last word or of none
        last = F.coalesce(F.col("pos") == F.col("n_words") - 1, F.lit(True)) & (F.col("k") == sizes[0])
        rows = rows.join(F.broadcast(wanted.withColumn("hit", F.lit(True))), ["k", "hash"], "left").where(F.col("hit") | last)
        both = shared_table(rows.select(*keep, first.alias("first"), F.when(F.col("hit"), around).alias("around"), "hit", last.alias("last")), "places")
        return both.where("hit").select(*keep, "first", "around"), both.where("last").select("doc_id", "text_hash", "n_words")
    hits = rows.where("hash is not null").select(*keep).join(wanted, ["k", "hash"])  # positions travel without their texts
    hits = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("n_words", "k", "hash", "pos")).alias("at")).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    texts = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")))
    found = texts.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"), F.inline("at")).select(*keep, first.alias("first"), around.alias("around"))
    return shared_table(found, "places"), docs.select("doc_id", "text_hash", F.size(words_of(F.col("text"))).alias("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, per_hit: int = 20) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated) of every row of docs.

    n_hit counts the words inside any occurrence of a window; n_items the items with occurring windows;
    contaminated means n_hit > 0 and per_hit * n_hit >= n_words. Null or wordless texts have no words and are
    clean; null or wordless items have no windows. Rows that repeat, also with one id and different texts,
    are judged each by its own text. Extra columns are ignored; empty tables on either side give zeros.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    windows = shared_table(benchmark_windows(benchmark.select("item_id", "text"), window), "windows")
    parts = windows.select("window_words", "n").distinct().withColumn("k", F.least("n", F.lit(shingle)))
    token = parts.select("window_words", "n", "k", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("k")), lambda i: F.coalesce(*[F.when(F.col("k") == k, _shingle("window_words", i, k)) for k in range(1, shingle + 1)]))).alias("offset", "hash"))
    token = shared_table(token, "shingles")
    known = {r.k: r.n for r in token.groupBy("k").agg(F.count_distinct("hash").alias("n")).collect()}  # at most `shingle` rows
    sizes = sorted(known) or [1]

    wanted = token.select("k", "hash").distinct()
    rarity = shingles_at(docs, sizes).where("hash is not null").select("k", "hash").join(_bounded(wanted, sum(known.values())), ["k", "hash"]).groupBy("k", "hash").agg(F.count("*").alias("df"))
    # a window without a row here has a shingle that no document holds; an inner join leaves the others to be counted
    ranked = token.join(shared_table(rarity, "rarity"), ["k", "hash"]).groupBy("window_words", "n", "k").agg(F.count("*").alias("present"), F.min(F.struct("df", "hash", "offset")).alias("rarest"))
    prefix = shared_table(ranked.where("present = n - k + 1").select("window_words", "n", "k", "rarest.hash", "rarest.offset"), "prefix")

    places, texts = prefix_places(docs, sizes, prefix.select("k", "hash").distinct(), window)
    start = F.col("pos") - F.col("offset")
    hits = places.join(broadcast_if_small(prefix), ["k", "hash"]).where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    hits = hits.where(F.slice("around", start - F.col("first") + 1, F.col("n")) == F.col("window_words")).select("doc_id", "text_hash", start.alias("start"), "n", "window_words").distinct()

    # windows of the same items share one set of them, so that a line that many items hold multiplies no hits
    owned = windows.groupBy("window_words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")).withColumn("of_items", F.sha2(F.to_json("items"), 256))
    owned = shared_table(owned, "owned")
    hits = shared_table(hits.join(broadcast_if_small(owned.select("window_words", "of_items")), "window_words").select("doc_id", "text_hash", "start", "n", "of_items"), "hits")

    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("upto"))
    union = F.aggregate("spans", zero, lambda a, s: F.struct((a.covered + F.greatest(s.end - F.greatest(s.start, a.upto), F.lit(0))).alias("covered"), F.greatest(a.upto, s.end).alias("upto")))
    found = hits.groupBy("doc_id", "text_hash").agg(ends.alias("spans")).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), union["covered"].alias("n_hit"))
    sets = hits.select("doc_id", "text_hash", "of_items").distinct().join(owned.select("of_items", "items").distinct(), "of_items")
    held = sets.groupBy(F.col("doc_id").alias("held_id"), F.col("text_hash").alias("held_hash")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    found = found.join(held, F.col("hit_id").eqNullSafe(F.col("held_id")) & (F.col("hit_hash") == F.col("held_hash")))
    joined = texts.withColumn("n_words", F.col("n_words").cast("long")).join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (per_hit * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, in all columns whatever their names, that are not contaminated.

    Rows with null or wordless texts stay; repeated rows go or stay each by its own text; an empty table gives no
    rows, and an empty benchmark leaves all.
    """
    own, text = fresh(docs, "of", "of_text")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).distinct()
    bad = shared_table(bad, "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text)), "left_anti")
