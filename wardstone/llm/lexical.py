"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

Index: every task of one Arrow pass deals its documents into shards. A shard numbers its documents by length, and
a term's postings lie there in blocks: ordinals as distances from the block's first one, and counts, both in the
narrowest width. Of a block only its first ordinal and its largest count are read to bound its scores: lengths
ascend with ordinals, so that the first document of a block is its shortest.

Search: a shard's lists are taken from the highest bound down. Once the bounds of the lists that are left add up to
less than the k-th best score so far, those lists are not essential: no document that only they hold can enter. New
documents of an essential list are held against the lists below it, block bound first; blocks without a surviving
document are never decompressed. A sixteenth of the shards is searched first and its k-th scores are where the
others begin; the shards' heaps are merged by rank.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstone.llm.common import discard, shared_table, text_batches, words_of

K = 20
BLOCK = 128  # postings of a block
SHARD_DOCS, SHARD_POSTINGS = 65_536, 2_000_000  # a shard ends at the first document that reaches either
PIECE = 1 << 20  # bytes of a text that are split into terms at a time
QUERY_TERMS = 250_000  # terms of the queries that are searched for together, about
INDEX_TERMS = 1_000_000  # distinct query terms that are sent to the indexing tasks; beyond that all terms are indexed
FIRST_SHARDS = 16  # one in so many shards is searched first
#: A term's bytes: digits, letters in lower case and everything beyond ASCII; all others are blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "shard string, term string, postings int, first binary, most binary, offsets binary, counts binary, ids array<long>, lengths array<long>"


def terms_of(text: str | None):
    """Lists of the terms of a text, one list for each PIECE bytes or so; terms are whole."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES), 0
    while at < len(raw):
        cut = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        cut = len(raw) if cut < 0 else cut
        yield raw[at:cut].split()
        at = cut


def impact(count, m):
    """What a document's length and a term's count in it make of the term's weight; rises with the count, falls with m."""
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


def length_norm(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents by their numbers of terms, in whole numbers."""
    if len(lengths) and 25 * int(lengths.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * int(n) * documents // terms for n in lengths], np.int64)
    return 75 + (25 * lengths.astype(np.int64) * documents) // max(terms, 1)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# -- index ----------------------------------------------------------------------------------------------


class _Shard:
    """Documents gathered for one shard: ids, lengths, and (document, term, count) so far."""

    def __init__(self):
        self.ids, self.lengths, self.parts, self.postings = [], [], [], 0

    def add(self, doc_id, text: str | None, number: dict, fixed: bool) -> None:
        length, found = 0, Counter()
        for words in terms_of(text):
            length += len(words)
            found.update(filter(number.__contains__, words) if fixed else words)
        if not length:
            return
        if not fixed:
            for w in found:
                number.setdefault(w, len(number))
        if found:
            terms = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
            self.parts.append((np.full(len(terms), len(self.ids)), terms, np.fromiter(found.values(), np.int64, len(found))))
            self.postings += len(terms)
        self.ids.append(doc_id)
        self.lengths.append(length)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def rows(self, shard: str, names: list[str]):
        """Record batches of the shard: its documents, then its terms' lists."""
        lengths = np.array(self.lengths)
        order = np.argsort(lengths, kind="stable")
        ordinal = np.empty(len(order), np.int64)
        ordinal[order] = np.arange(len(order))
        none = [None]
        yield _batch([[shard], none, none, none, none, none, none, [[self.ids[i] for i in order]], [lengths[order]]])
        if not self.parts:
            return
        doc, term, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        doc = ordinal[doc]
        by = np.lexsort((doc, term))
        doc, term, count = doc[by], term[by], count[by]
        begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        end = np.r_[begin[1:], len(term)]
        within = np.arange(len(term)) - np.repeat(begin, end - begin)
        block = np.flatnonzero(within % BLOCK == 0)
        first, most = doc[block], np.maximum.reduceat(count, block)
        offset = doc - np.repeat(first, np.diff(np.r_[block, len(doc)]))
        widest, largest = np.maximum.reduceat(offset, begin), np.maximum.reduceat(count, begin)
        of_list = np.searchsorted(block, np.r_[begin, len(doc)])
        offsets, counts = {n: offset.astype(f"<u{n}") for n in (1, 2)}, {n: np.minimum(count, 256**n - 1).astype(f"<u{n}") for n in (1, 4)}
        first, most = first.astype("<u2"), most.astype("<u4")
        for at in range(0, len(begin), 4096):
            k = range(at, min(at + 4096, len(begin)))
            yield _batch(
                [
                    [shard] * len(k),
                    [names[term[begin[i]]] for i in k],
                    (end - begin)[at : at + 4096],
                    [first[of_list[i] : of_list[i + 1]].tobytes() for i in k],
                    [most[of_list[i] : of_list[i + 1]].tobytes() for i in k],
                    [offsets[1 if widest[i] < 256 else 2][begin[i] : end[i]].tobytes() for i in k],
                    [counts[1 if largest[i] < 256 else 4][begin[i] : end[i]].tobytes() for i in k],
                    [None] * len(k),
                    [None] * len(k),
                ]
            )


_TYPES = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """The index of docs (doc_id, text) as a table in the shared folder: rows of INDEX, a shard's documents in that with null term.

    terms: where given, only these have lists; documents and their lengths are whole either way. Documents without
    a term are not in it; repeated rows are documents of their own; other columns are ignored.
    """
    sent = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        part, shards, shard = TaskContext.get().partitionId(), 0, _Shard()
        names = None if sent is None else sent.value
        number = {} if names is None else {t.encode(): i for i, t in enumerate(names)}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    shard.add(doc_id, text, number, sent is not None)
                    if shard.full():
                        yield from shard.rows(f"{part}-{shards}", names or [t.decode("utf-8", "replace") for t in number])
                        shards, shard, number = shards + 1, _Shard(), number if sent is not None else {}
        if shard.ids:
            yield from shard.rows(f"{part}-{shards}", names or [t.decode("utf-8", "replace") for t in number])

    return shared_table(text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "index")


# -- search ---------------------------------------------------------------------------------------------


class _List:
    """A term's postings in a shard; blocks are decompressed when asked for."""

    __slots__ = ("bounds", "counts", "first", "most", "offsets", "top")

    def __init__(self, n: int, first: bytes, most: bytes, offsets: bytes, counts: bytes, m: np.ndarray):
        self.first, most = np.frombuffer(first, "<u2").astype(np.int64), np.frombuffer(most, "<u4").astype(np.int64)
        self.offsets, self.counts = np.frombuffer(offsets, f"<u{len(offsets) // n}"), np.frombuffer(counts, f"<u{len(counts) // n}")
        self.bounds = impact(most, m[self.first])
        self.top = int(self.bounds.max())

    def blocks(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, counts) of the chosen blocks, which ascend."""
        if len(chosen) == len(self.first):
            at, of = slice(None), np.arange(len(self.offsets)) // BLOCK
        else:
            at = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < len(self.offsets)]
            of = at // BLOCK
        return self.first[of] + self.offsets[at], self.counts[at].astype(np.int64)


def search_shard(lists: list[tuple[_List, int]], m: np.ndarray, seen: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordinals, scores) of a shard's documents that may be among the best k: all with a score of the k-th best or more.

    lists: a query's (list, weight) pairs; least: a score that the k-th best has at least. seen: false for every
    ordinal, and so again afterwards. Scores are exact.
    """
    lists = sorted(lists, key=lambda x: -x[0].top * x[1])
    rest = np.cumsum([0, *[x.top * w for x, w in lists[::-1]]])[::-1].tolist()  # rest[i]: of lists i and on
    best, touched = [(np.empty(0, np.int64), np.empty(0, np.int64))], []
    for i, (own, w) in enumerate(lists):
        if rest[i] < least:
            break  # this list and those below are not essential
        docs, counts = own.blocks(np.flatnonzero(own.bounds * w + rest[i + 1] >= least))
        new = ~seen[docs]
        docs, counts = docs[new], counts[new]
        seen[docs] = True
        touched.append(docs)
        score = impact(counts, m[docs]) * w
        for j in range(i + 1, len(lists)):
            keep = score + rest[j] >= least
            docs, score = docs[keep], score[keep]
            if not len(docs):
                break
            other, v = lists[j]
            block = np.searchsorted(other.first, docs, "right") - 1
            bound = np.where(block >= 0, other.bounds[block] * v, 0)
            keep = score + bound + rest[j + 1] >= least
            docs, score, block = docs[keep], score[keep], block[keep]
            if not len(docs):
                break
            wanted = np.zeros(len(other.first), bool)
            wanted[block[block >= 0]] = True
            held, counts = other.blocks(np.flatnonzero(wanted))
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                hit = held[at] == docs
                score[hit] += impact(counts[at[hit]], m[docs[hit]]) * v
        keep = score >= least
        best.append((docs[keep], score[keep]))
        scores = np.concatenate([s for _, s in best])
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            best = [(d[s >= least], s[s >= least]) for d, s in best]
    for docs in touched:
        seen[docs] = False
    docs, score = (np.concatenate(x) for x in zip(*best, strict=True))
    return docs, score


def _search(sent, k: int, kind: pa.DataType):
    schema = pa.schema([("query", pa.int64()), ("item_id", kind), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(shard: pa.Table) -> pa.Table:
        documents, terms, weights, queries, least = sent.value
        out, ids, lengths, row = [], None, None, {}
        for at, term in enumerate(shard.column("term").to_pylist()):
            if term is None:
                ids, lengths = shard.column("ids")[at].as_py(), np.array(shard.column("lengths")[at].as_py())
            else:
                row[term] = at
        m = length_norm(lengths, documents, terms)
        names = ("postings", "first", "most", "offsets", "counts")
        lists = {t: _List(*[shard.column(c)[at].as_py() for c in names], m) for t, at in row.items() if weights.get(t)}
        seen = np.zeros(len(ids), bool)
        for number, (item, own) in enumerate(queries):
            some = [(lists[t], weights[t] * n) for t, n in own if t in lists]
            if not some:
                continue
            docs, score = search_shard(some, m, seen, k, least[number])
            if len(docs) > k:  # the heap: ties beyond it go by the smaller id
                by = sorted(range(len(docs)), key=lambda i: (-score[i], (x := ids[docs[i]]) is None, x or 0))[:k]
                docs, score = docs[by], score[by]
            out.append((np.full(len(docs), number), [item] * len(docs), [ids[d] for d in docs], score))
        columns = [np.concatenate([x[0] for x in out]), sum((x[1] for x in out), []), sum((x[2] for x in out), []), np.concatenate([x[3] for x in out])] if out else [[]] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of the best k documents of every item (item_id, text), scores above 0, ties by smaller doc_id.

    Rows that repeat an item's id and text are one item; an id with several texts has a list for each. Null texts
    and items without a known term have no rows; an empty table on either side gives none.
    """
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType
    plain = "long" if kind.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    words = items.select(F.col("item_id").cast(plain).alias("item_id"), "text").distinct().select("item_id", "text", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    words = shared_table(words.select("item_id", "words", F.xxhash64("item_id", "text").alias("at")), "queries")
    total = words.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("terms")).first()
    documents, terms = index.where("term is null").select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.sum("n"), F.sum("t")).first()
    empty = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    if not total.n or not documents:
        discard(words)
        return empty
    blocks, out = math.ceil(total.terms / QUERY_TERMS), []
    for block in range(blocks):  # a stated set of queries, so many terms of it at a time
        own = words.where(F.pmod("at", F.lit(blocks)) == block)
        queries = sorted(((r.item_id, sorted(Counter(r.words).items())) for r in own.collect()), key=repr)
        wanted = F.broadcast(own.select(F.explode("words").alias("term")).distinct())  # QUERY_TERMS rows, about
        lists = index.where("term is not null").join(wanted, "term", "left_semi")
        df = {r.term: r.df for r in lists.groupBy("term").agg(F.sum("postings").alias("df")).collect()}
        weights = {t: weight(documents, n) for t, n in df.items()}
        rows = lists.unionByName(index.where("term is null").select(*lists.columns))
        least, first, found = [1] * len(queries), F.pmod(F.xxhash64("shard"), F.lit(FIRST_SHARDS)) == 0, []
        for some in (first, ~first):
            sent = spark.sparkContext.broadcast((documents, terms, weights, queries, least))
            heaps = rows.where(some).groupBy("shard").applyInArrow(_search(sent, k, pa.int64() if plain == "long" else pa.string()), f"query long, item_id {plain}, doc_id long, score long")
            found.append(shared_table(_ranked(heaps, k).drop("rank"), "heaps"))
            for r in found[-1].groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k).collect():  # a row per query
                least[r.query] = max(least[r.query], r.low)
        out.append(shared_table(_ranked(found[0].unionByName(found[1]), k).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"), "ranked"))
        discard(*found)
    discard(words)
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """search() over an index of docs made for these items: only terms that occur in them get lists, while those are INDEX_TERMS at most."""
    asked = items.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).distinct()
    known = [r.term for r in asked.limit(INDEX_TERMS + 1).collect()]
    index = build_index(docs, sorted(known) if len(known) <= INDEX_TERMS else None)
    found = search(index, items, k)
    discard(index)
    return found
