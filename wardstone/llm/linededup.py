"""Line dedup by site-relative frequency (DataFrame functions only).

A site's pages are its distinct texts, so that exact copies of a page count once. A line is boilerplate where two pages
or more hold it and its share of the site's pages exceeds max_ratio. The shares of one site's lines add up to its mean
lines per page, so a site has at most about (mean lines per page / max_ratio) boilerplate lines, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import fresh, shared_table

MAX_RATIO = 0.04  # a line that a reader meets on more than every twenty-fifth page of a site
KEYS_SENT = 200_000  # boilerplate lines of all sites, of about 60 bytes each, that are sent to all tasks; more are joined by a shuffle


def site_of(url: Column) -> Column:
    """The site of a page's URL: its host in lower case without a leading www and without a port; null where there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.(?=.)|\.$", ""), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """Digest of a line without blanks at its ends; null for blank lines, which are never boilerplate."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.md5(bare))


def _host(host: Column | str) -> Column:
    return F.coalesce((F.col(host) if isinstance(host, str) else host).cast("string"), F.lit(""))


def _page(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _page_lines(rows: DataFrame) -> DataFrame:
    """(host, page, key): each line of each distinct page once; rows are (host, text)."""
    keys = F.array_distinct(F.transform(_lines(F.col("text")), _key))
    return rows.select("host", _page(F.col("text")).alias("page"), F.explode(keys).alias("key")).where("key is not null").distinct()


def boilerplate(docs: DataFrame, host: Column | str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(host, key): digests of every host's boilerplate lines.

    A null text is the page without lines; a null host is the host ''.
    """
    rows = docs.select(_host(host).alias("host"), F.col(text_col).alias("text"))
    total = rows.select("host", _page(F.col("text")).alias("page")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    held = _page_lines(rows).groupBy("host", "key").agg(F.count("*").alias("held")).where("held > 1")
    return held.join(total, "host").where(F.col("held") > max_ratio * F.col("pages")).select("host", "key")


def _judged(docs: DataFrame, host: Column | str, text_col: str, max_ratio: float) -> tuple[DataFrame, str]:
    """docs with one more column: a struct of the text that is left, the lines there were and those dropped; and its name."""
    of, page, keys, lines, found, kept, out = fresh(docs, "of", "page", "keys", "lines", "found", "kept", "judged")
    known, text = shared_table(boilerplate(docs, host, text_col, max_ratio), "boilerplate"), F.col(text_col)
    if known.count() <= KEYS_SENT:
        own = known.groupBy("host").agg(F.collect_set("key").alias(keys)).withColumnRenamed("host", of)
        rows = docs.join(F.broadcast(own), _host(host) == F.col(of), "left").withColumn(page, F.lit(None))
    else:  # lines meet boilerplate by host and digest; a page then gets its own boilerplate alone
        own = _page_lines(docs.select(_host(host).alias("host"), text.alias("text"))).join(known, ["host", "key"])
        own = own.groupBy(F.col("host").alias(of), F.col("page").alias(page)).agg(F.collect_set("key").alias(keys))
        rows = docs.join(own, (_host(host) == F.col(of)) & (_page(text) == F.col(page)), "left")
    # the document's own boilerplate by one hashed intersection; lines are then held against that alone
    rows = rows.withColumn(lines, F.when(F.col(keys).isNotNull(), _lines(text))).withColumn(found, F.array_intersect(F.transform(lines, _key), F.col(keys)))
    left = F.when(text.isNotNull() & (F.size(found) > 0), F.filter(lines, lambda line: ~F.coalesce(F.array_contains(found, _key(line)), F.lit(False))))
    rows = rows.withColumn(kept, left)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    n_dropped = F.when(F.col(kept).isNull(), 0).otherwise(n_lines - F.size(kept))
    judged = F.struct(F.when(F.col(kept).isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text"), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
    return rows.withColumn(out, judged).drop(of, page, keys, lines, found, kept), out


def drop_boilerplate(docs: DataFrame, host: Column | str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with text_col stripped of its host's boilerplate lines, and the columns n_lines and n_dropped beside it.

    host is a column's name or an expression such as site_of(F.col("url")). Lines end at newlines; order, blank
    lines and other lines stay. Of rows that repeat a text on one host one counts as a page, and all are
    stripped; a line twice on one page counts once and goes twice. A null text stays null with no lines; a null
    host is the host ''. A document whose lines all go keeps an empty text. Columns named n_lines or n_dropped
    are replaced; all others survive, whatever their names. An empty table gives no rows.
    """
    rows, judged = _judged(docs, host, text_col, max_ratio)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return rows.select(*[F.col(f"{judged}.text").alias(c) if c == text_col else F.col(c) for c in names], f"{judged}.n_lines", f"{judged}.n_dropped")


def strip_boilerplate(docs: DataFrame, host: Column | str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """drop_boilerplate with the columns of docs alone, in their order."""
    rows, judged = _judged(docs, host, text_col, max_ratio)
    return rows.select(*[F.col(f"{judged}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns])
