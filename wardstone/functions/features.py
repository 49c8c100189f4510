"""Hashed n-gram features of normalised messages.

A key adds +1 or -1 (by the hash's top bit) to the bucket hash modulo buckets; rows are scaled to length 1. A text's
keys never leave its row: one Arrow pass hashes the distinct keys of a batch and sums them per text, so that
features need no shuffle. Two hash lanes: 'md5', which SQL can follow, and 'blake2b', the exact 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

try:  # the interpreter's own takes half the time of OpenSSL's on short keys
    from _md5 import md5
except ImportError:
    from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, CHAR_GRAM, WORD_GRAM = 16_384, 4, 2  # fixed values
TOKEN = r"(?U)[[\p{L}\p{N}]&&[^\p{Nd}]]+|\p{Nd}+|[^\s\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """Words, numbers and single marks of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_grams(words: Column, n: int) -> Column:
    if n == 1:
        return F.transform(words, lambda w: F.concat(F.lit("w1:"), w))
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.lit(f"w{n}:"), F.array_join(F.slice(words, i, n), " ")))


def char_grams(words: Column, width: int = CHAR_GRAM) -> Column:
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.transform(F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{width}}}))."), F.lit(1)), lambda g: F.concat(F.lit("c:"), g))


def keys(df: DataFrame, text: str, id_col: str, word_gram: int = WORD_GRAM, char_gram: int = CHAR_GRAM) -> DataFrame:
    """(id, key): every feature key of every text, repeats included."""
    df = df.select(id_col, tokens(F.col(text)).alias("words"))
    grams = [word_grams(F.col("words"), n) for n in range(1, word_gram + 1)]
    return df.select(id_col, F.explode(F.concat(*grams, char_grams(F.col("words"), char_gram))).alias("key"))


def bucket_and_sign(key: Column, buckets: int = BUCKETS) -> tuple[Column, Column]:
    """md5 lane: the first 64 bits of the digest, modulo a power of two up to 2**16, and the top bit."""
    if buckets & (buckets - 1) or buckets > 1 << 16:
        raise ValueError("the md5 lane takes powers of two up to 65536")
    digest = F.md5(key)
    return F.pmod(F.conv(F.substring(digest, 13, 4), 16, 10).cast("int"), F.lit(buckets)), F.when(F.substring(digest, 1, 1) >= "8", 1.0).otherwise(-1.0)


def hashed(df: DataFrame, text: str, id_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, bucket, count): signed counts; keys that cancel leave a zero."""
    rows = df.select(id_col, row_features(tokens(F.col(text)), "md5", False, buckets).alias("f"))
    return rows.select(id_col, F.inline(F.arrays_zip(F.col("f.buckets").alias("bucket"), F.col("f.values").alias("count"))))


def unit_rows(df: DataFrame, text: str, id_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, bucket, value): rows scaled to length 1 where they have a length."""
    rows = df.select(id_col, row_features(tokens(F.col(text)), "md5", True, buckets).alias("f"))
    return rows.select(id_col, F.inline(F.arrays_zip(F.col("f.buckets").alias("bucket"), F.col("f.values").alias("value"))))


def select_rows(rows: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """The rows whose ids are among the wanted, each once, whatever their order."""
    return rows.join(wanted.select(id_col).distinct(), id_col, "left_semi")


def column_sums(rows: DataFrame, factors: DataFrame, id_col: str) -> DataFrame:
    """(bucket, total): the transpose of rows (id, bucket, value) times a factor per id."""
    joined = rows.join(factors.select(id_col, "factor"), id_col)
    return joined.groupBy("bucket").agg(F.sum(F.col("value") * F.col("factor")).alias("total"))


def scorer(weights: DataFrame, bias: float, lane: str = "md5") -> Callable[[Column], Column]:
    """A column function: bias plus the weighted sum of a text's unit row; weights (bucket, weight) hold a row per bucket."""
    known = np.zeros(BUCKETS)
    for r in weights.collect():  # BUCKETS rows at most
        known[r["bucket"]] = r["weight"]
    shared = weights.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(T.DoubleType())
    def score(joined: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for begin, bucket, value in _sparse(joined, lane, True, BUCKETS):
            part = np.r_[0.0, np.cumsum(shared.value[bucket] * value)]
            out.append(part[begin[1:]] - part[begin[:-1]])
        return pa.array(np.concatenate(out) + bias)

    return lambda text: score(F.array_join(tokens(text), " "))


TOP = T.ArrayType(T.StructType().add("bucket", T.IntegerType()).add("contribution", T.DoubleType()))


def strongest(weights: DataFrame, limit: int, lane: str = "md5") -> Callable[[Column], Column]:
    """A column function: array of struct(bucket, contribution), the buckets that move a text most, from unscaled counts; ties by bucket.

    A text's cells stay in its row, so that texts of any length need no shuffle and no sort; buckets without a weight are left out.
    """
    known = np.full(BUCKETS, np.nan)
    for r in weights.collect():  # BUCKETS rows at most
        known[r["bucket"]] = r["weight"]
    shared = weights.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(TOP)
    def top(joined: pa.Array) -> pa.Array:
        size, buckets, moves = [np.zeros(1, np.int64)], [np.empty(0, np.int32)], [np.empty(0)]
        for begin, bucket, value in _sparse(joined, lane, False, BUCKETS):
            move = value * shared.value[bucket]
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            order = np.lexsort((bucket, -np.abs(move), row))
            order = order[~np.isnan(move[order])]
            own = np.bincount(row[order], minlength=len(begin) - 1)
            place = np.arange(len(order)) - np.repeat(np.cumsum(own) - own, own)
            order = order[place < limit]
            size.append(np.minimum(own, limit))
            buckets.append(bucket[order].astype(np.int32))
            moves.append(move[order])
        cells = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(moves))], ["bucket", "contribution"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(size)), pa.int32()), cells)

    return lambda text: top(F.array_join(tokens(text), " "))


def text_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, with whole texts sent to Python workers a thousand at a time where the session has Spark's default of 10,000."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(rows))
    return df


def stable_hash(key: str) -> int:
    return int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "big")


def _md5_digests(keys) -> bytes:
    return b"".join([md5(k.encode("utf-8", "surrogatepass")).digest() for k in keys])


def _exact_digests(keys) -> bytes:
    return b"".join([blake2b(k.encode(), digest_size=8).digest() for k in keys])


#: lane -> (digests of keys, bytes of a digest, bytes that modulo buckets give the bucket); the first bit is the sign
PLACES = {"md5": (_md5_digests, 16, slice(6, 8)), "blake2b": (_exact_digests, 8, slice(0, 8))}
CHARS = 1_000_000  # characters that are hashed at a time


def _placed(texts: list[str], lane: str, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, sign) of every key of texts, each the blank-joined tokens of a message; a key is hashed once."""
    digests, width, part = PLACES[lane]

    def table(keys) -> np.ndarray:
        raw = np.frombuffer(digests(keys), np.uint8).reshape(-1, width)
        number = np.ascontiguousarray(raw[:, part]).view(f">u{part.stop - part.start}")[:, 0]
        return np.stack([(number % buckets).astype(np.int64), np.where(raw[:, 0] >= 128, 1, -1)], 1)

    flat = [t.split(" ") if t else [] for t in texts]
    size = np.array([len(w) for w in flat])
    of, found = np.repeat(np.arange(len(texts)), size), []
    code, words = pd.factorize(np.array([w for own in flat for w in own], object))
    found.append((of, table(f"w1:{w}" for w in words)[code]))
    if WORD_GRAM > 1 and len(of) > 1:
        same = of[1:] == of[:-1]
        at, pair = pd.factorize(code[:-1][same] * len(words) + code[1:][same])
        found.append((of[1:][same], table(f"w2:{words[p // len(words)]} {words[p % len(words)]}" for p in pair)[at]))
    padded = "".join(f" {t} " for t in texts)
    length = np.array([len(t) + 2 for t in texts])
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4")
    there = np.zeros(int(points.max(initial=0)) + 1, bool)
    there[points] = True
    letters, dense = np.flatnonzero(there), (np.cumsum(there) - 1)[points]  # as np.unique, without a sort
    own = np.repeat(np.arange(len(texts)), length)
    if len(points) >= CHAR_GRAM:
        start = np.flatnonzero(own[: len(own) - CHAR_GRAM + 1] == own[CHAR_GRAM - 1 :])
        gram = np.zeros(len(start), np.int64)
        if len(letters) < 1 << (63 // CHAR_GRAM):
            for i in range(CHAR_GRAM):
                gram = gram * len(letters) + dense[start + i]
        else:  # more characters than the packed grams can tell apart
            gram = pd.factorize(np.array([padded[i : i + CHAR_GRAM] for i in start.tolist()], object))[0]
        at, kinds = pd.factorize(gram)
        first = np.empty(len(kinds), np.int64)
        first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        found.append((own[start], table(f"c:{padded[i : i + CHAR_GRAM]}" for i in start[first].tolist())[at]))
    of, places = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    return of, places[:, 0], places[:, 1].astype(float)


def _sparse(joined: pa.Array, lane: str, unit: bool, buckets: int):
    """(begin, bucket, value) for slices of a batch in order: the cells of text i lie at begin[i] to begin[i + 1]."""
    texts, at = [t or "" for t in joined.to_pylist()], 0
    while at < len(texts):
        upto, chars = at + 1, len(texts[at])
        while upto < len(texts) and chars + len(texts[upto]) <= CHARS:
            chars += len(texts[upto])
            upto += 1
        of, bucket, sign = _placed(texts[at:upto], lane, buckets)
        key, room = of * buckets + bucket, (upto - at) * buckets
        if room <= 8 * len(key):  # long texts: a place for every bucket of every text takes less time than a sort
            there = np.zeros(room, bool)
            there[key] = True
            cell = np.flatnonzero(there)
            value = np.bincount(key, sign, room)[cell]
        else:
            cell, where = np.unique(key, return_inverse=True)
            value = np.bincount(where, sign, len(cell))
        row = cell // buckets
        if unit:
            norm = np.sqrt(np.bincount(row, value * value, upto - at))
            value = value / np.where(norm > 0, norm, 1.0)[row]
        yield np.searchsorted(row, np.arange(upto - at + 1)), cell % buckets, value
        at = upto


FEATURES = T.StructType().add("buckets", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.DoubleType()))


def row_features(words: Column, lane: str = "blake2b", unit: bool = True, buckets: int = BUCKETS) -> Column:
    """struct(buckets, values): the cells of a text's tokens in order of their buckets."""

    @F.arrow_udf(FEATURES)
    def cells(joined: pa.Array) -> pa.Array:
        parts = list(_sparse(joined, lane, unit, buckets))
        begin = np.concatenate([[0], *(np.diff(b) for b, *_ in parts)]).cumsum()
        bucket = np.concatenate([np.empty(0, np.int64), *(x for _, x, _ in parts)]).astype(np.int32)
        value = np.concatenate([np.empty(0), *(x for *_, x in parts)])
        lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x)) for x in (bucket, value)]
        return pa.StructArray.from_arrays(lists, ["buckets", "values"])

    return cells(F.array_join(words, " "))


def exact_features(words: Column) -> Column:
    """Buckets and unit values of a text's tokens under the exact hash."""
    return row_features(words)


def exact_row(words: list[str], buckets: int = BUCKETS) -> tuple[list[int], list[float]]:
    """exact_features of one text's tokens."""
    [(_, bucket, value)] = _sparse(pa.array([" ".join(words)]), "blake2b", True, buckets)
    return bucket.tolist(), value.tolist()
