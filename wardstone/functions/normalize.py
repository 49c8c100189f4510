"""Normalisation of messages as column expressions.

Seven stages in order: nfkc, zero_width, confusables, whitespace, decode, reassemble, casefold; where decode or
reassemble changed the text, the character stages run once more. `nfkc` and `casefold` have two lanes: built-in
expressions (equal on the fullwidth block, ASCII and letters whose lower case is their fold, plus the sharp s)
and exact Unicode in an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardstone.functions.registry import STAGES

# Fixed values
ZERO_WIDTH = "​‌‍﻿⁠"
LOOKALIKES = "асеіјорѕхуԁһ" + "οινρταε"  # Cyrillic, then Greek
LOOKALIKES_LATIN = "aceijopsxydh" + "oivptae"
FULLWIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
FULLWIDTH_ASCII = "".join(map(chr, range(0x21, 0x7F))) + " "
ROT13_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
FUNCTION_WORDS = (
    "the and you your all any are for from have not now this that with instructions instruction ignore previous above system "
    "prompt must should reply output print answer text before them then what which who was were will would can do does"
).split()
BUDGET, MIN_BASE64, MIN_PRINTABLE, MIN_WORDS, MIN_GAIN = 64 * 1024, 24, 0.9, 4, 0.15
BASE64_RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
HEX_RUN = r"(?:\b[0-9a-fA-F]{2}\b[ \t]*){8,}"
HEX_RUN_POSSESSIVE = HEX_RUN + "+"  # the same runs, matched without recursion however long they are
ASSIGNMENT = r"""(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(['"])(.*?)\2\s*$"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(c: Column) -> Column:
    return F.translate(c, FULLWIDTH, FULLWIDTH_ASCII)


def zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def confusables(c: Column) -> Column:
    return F.translate(c, LOOKALIKES, LOOKALIKES_LATIN)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def whitespace(c: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"(?U)[^\S\n]+", " ")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def casefold(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))


def rot13(c: Column) -> Column:
    return F.translate(c, ROT13_FROM, ROT13_TO)


def any_word(words: list[str]) -> str:
    """A pattern for any of words, branching at the first letter."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        groups.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(first + "(?:" + "|".join(rest) + ")" for first, rest in groups.items()) + ")"


FUNCTION_WORD = "(?<![a-z'])" + any_word(FUNCTION_WORDS) + "(?![a-z'])"


def function_word_density(c: Column) -> Column:
    """Share of words that are function words; 0 below four words."""
    lower = F.lower(c)
    words = F.regexp_count(lower, F.lit("[a-z']+"))
    return F.when(words < MIN_WORDS, 0.0).otherwise(F.regexp_count(lower, F.lit(FUNCTION_WORD)) / words)


def printable_ratio(c: Column) -> Column:
    """Share of printable characters; line feed, tab and format characters count, an empty text is 0."""
    odd = r"[[\p{Cc}\p{Cs}\p{Co}\p{Cn}\p{Z}]&&[^ \n\t]]"
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(c, odd, "")) / F.length(c))


def _readable(c: Column) -> Column:
    return c.isNotNull() & (printable_ratio(c) > MIN_PRINTABLE) & c.rlike("[A-Za-z']")


def _utf8(c: Column) -> Column:
    return F.try_validate_utf8(c.cast("string"))


def decode_base64(c: Column, budget: Column | None = None) -> Column:
    """Readable UTF-8 texts of a text's base64 runs, in order; runs are cut to whole groups of four. Texts without runs take one search."""
    budget = F.lit(BUDGET) if budget is None else budget
    runs = F.transform(F.regexp_extract_all(c, F.lit(BASE64_RUN), F.lit(0)), lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(x) % 4))
    raw = F.filter(F.transform(F.filter(runs, lambda x: F.length(x) >= MIN_BASE64), lambda x: F.try_to_binary(x, F.lit("base64"))), lambda b: b.isNotNull() & (F.octet_length(b) <= budget))
    texts = F.filter(F.transform(raw, _utf8), _readable)
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("spent"))
    step = lambda a, t: F.when(a.spent > budget, a).otherwise(F.struct(F.concat(a.kept, F.array(t)).alias("kept"), (a.spent + F.length(t)).alias("spent")))
    return F.when(c.rlike(BASE64_RUN), F.aggregate(texts, zero, step)["kept"]).otherwise(F.array().cast("array<string>"))


def decode_hex(c: Column, budget: Column | None = None) -> Column:
    """Readable UTF-8 texts of a text's runs of two-digit hex tokens, in order."""
    budget = F.lit(BUDGET) if budget is None else budget
    runs = F.transform(F.regexp_extract_all(c, F.lit(HEX_RUN_POSSESSIVE), F.lit(0)), lambda x: F.regexp_replace(x, r"[ \t]", ""))
    fit = F.filter(runs, lambda x: (F.length(x) % 2 == 0) & (F.length(x) / 2 <= budget))
    return F.when(c.rlike(HEX_RUN_POSSESSIVE), F.filter(F.transform(fit, lambda x: _utf8(F.unhex(x))), _readable)).otherwise(F.array().cast("array<string>"))


def decode_substitution(c: Column) -> Column:
    """The text in rot13 and reversed, each where that raises the share of function words enough."""
    return let(function_word_density(c) + MIN_GAIN, lambda enough: F.filter(F.array(rot13(c), F.reverse(c)), lambda x: function_word_density(x) >= enough))


def _discover(c: Column, budget: Column) -> Column:
    return F.concat(decode_base64(c, budget), decode_hex(c, budget), decode_substitution(c))


def decode(c: Column) -> Column:
    """The text with everything it carries in an encoding appended, through two rounds and one budget of characters."""
    total = lambda texts: F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t))

    def second(t: Column, one: Column) -> Column:
        left = F.lit(BUDGET) - total(one)
        two = F.filter(F.flatten(F.transform(one, lambda x: _discover(x, left))), lambda x: (x != t) & ~F.array_contains(one, x))
        return F.when(left > 0, F.concat(one, two)).otherwise(one)

    def expand(t: Column) -> Column:
        first = F.filter(_discover(t, F.lit(BUDGET)), lambda x: x != t)
        return let(first, lambda one: F.when(F.size(one) == 0, t).otherwise(F.concat(t, F.lit("\n"), F.array_join(second(t, one), "\n"))))

    return let(c, expand)


def reassemble(c: Column) -> Column:
    """The text with its quoted assignments' values joined and appended, where there are two and the join is new."""
    values = lambda t: F.filter(F.regexp_extract_all(t, F.lit(ASSIGNMENT), F.lit(3)), lambda v: strip(v) != "")
    return let(c, lambda t: let(F.struct(F.size(values(t)).alias("n"), F.array_join(values(t), " ").alias("joined")), lambda v: F.when((v.n < 2) | F.contains(t, v.joined), t).otherwise(F.concat(t, F.lit("\n"), v.joined))))


BUILDERS = {"nfkc": nfkc, "zero_width": zero_width, "confusables": confusables, "whitespace": whitespace, "decode": decode, "reassemble": reassemble, "casefold": casefold}
GROWING, AGAIN = ("decode", "reassemble"), ("nfkc", "zero_width", "confusables", "casefold")


def _beyond_ascii(texts: pa.Array, plain: pa.Array, other) -> pa.Array:
    """plain where a text is null or ASCII, as whole batches mostly are; other(text, place) for the rest."""
    ascii_only = pc.fill_null(pc.string_is_ascii(texts), True)
    places = np.flatnonzero(~ascii_only.to_numpy(zero_copy_only=False))
    if not len(places):
        return plain
    found = [other(t, i) for t, i in zip(texts.take(pa.array(places)).to_pylist(), places.tolist(), strict=True)]
    return pc.replace_with_mask(plain, pc.invert(ascii_only), pa.array(found, plain.type))


@F.arrow_udf(StringType())
def nfkc_exact(texts: pa.Array) -> pa.Array:
    return _beyond_ascii(texts, texts, lambda t, _: unicodedata.normalize("NFKC", t))


@F.arrow_udf(StringType())
def casefold_exact(texts: pa.Array) -> pa.Array:
    return _beyond_ascii(texts, pc.ascii_lower(texts), lambda t, _: t.casefold())


def _with_last_exact(df: DataFrame, on: list[str]) -> DataFrame:
    """df with norm: casefold of __grown, and the character stages again where the text grew, in exact Unicode.

    Arrow batches keep every other column as it is; pandas would turn whole numbers beside nulls into doubles.
    """
    table = str.maketrans(LOOKALIKES, LOOKALIKES_LATIN)
    steps = {
        "nfkc": lambda t: unicodedata.normalize("NFKC", t), "zero_width": lambda t: t.translate(dict.fromkeys(map(ord, ZERO_WIDTH))),
        "confusables": lambda t: t.translate(table), "casefold": str.casefold,
    }

    def one(text: str, grew: bool) -> str:
        for name in ["casefold"] * ("casefold" in on) + [n for n in AGAIN if n in on and grew]:
            text = steps[name](text)
        return text

    def last(batches):
        for batch in batches:
            texts, grew = batch["__grown"], batch["__grew"]
            # the character stages leave ASCII as it is, but for its case
            norm = _beyond_ascii(texts, pc.ascii_lower(texts) if "casefold" in on else texts, lambda t, i, grew=grew: one(t, grew[i].as_py()))
            yield pa.RecordBatch.from_arrays([*batch.columns, norm], names=[*batch.schema.names, "norm"])

    df = df.drop("norm")
    return df.mapInArrow(last, StructType([*df.schema.fields, StructField("norm", StringType())]))


def with_normalized(df: DataFrame, text: str = "text", disabled: Iterable[str] = (), exact: bool = False) -> DataFrame:
    """df with norm, applied, skipped and expanded: the normalised text, its stages and whether it outgrew the original.

    A stage that runs a second time is listed as name:2. Null texts stay null.
    """
    disabled = frozenset(disabled)
    on = [s.name for s in STAGES if s.name not in disabled]
    cur = F.col(text)
    for name in [n for n in on if n in ("nfkc", "zero_width", "confusables", "whitespace")]:
        cur = nfkc_exact(cur) if exact and name == "nfkc" else BUILDERS[name](cur)
    df = df.withColumn("__base", cur)
    grown = F.col("__base")
    for name in [n for n in on if n in GROWING]:
        grown = BUILDERS[name](grown)
    df = df.withColumn("__grown", grown).withColumn("__grew", F.coalesce(F.col("__grown") != F.col("__base"), F.lit(False)))
    again = [n for n in AGAIN if n in on]
    if exact:
        df = _with_last_exact(df, on)
    else:
        once = casefold(F.col("__grown")) if "casefold" in on else F.col("__grown")
        twice = F.col("__once")
        for name in again:
            twice = BUILDERS[name](twice)
        df = df.withColumn("__once", once).withColumn("norm", F.when(F.col("__grew"), twice).otherwise(F.col("__once"))).drop("__once")
    plain = (casefold_exact if exact else casefold)(whitespace(F.col(text)))
    return (
        df.withColumn("applied", F.concat(F.array(*map(F.lit, on)), F.when(F.col("__grew"), F.array(*[F.lit(f"{n}:2") for n in again])).otherwise(F.array().cast("array<string>"))))
        .withColumn("skipped", F.array(*[F.lit(s.name) for s in STAGES if s.name in disabled]).cast("array<string>"))
        .withColumn("expanded", F.length("norm") > F.length(plain))
        .drop("__base", "__grown", "__grew")
    )
