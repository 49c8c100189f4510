"""Hash trees over ordered rows: a digest for every range of rows, up to one root, and where two trees differ.

Leaves digest FANOUT rows each by their place in the order, every level above as many digests below it, so that a
tree depends on rows and order alone. Levels are grouped aggregations; a level's groups are of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.operators.metrics import with_position
from wardstone.tables import shared_table

FANOUT = 1_024


def leaves(rows: DataFrame, order: str, line: Column, fanout: int = FANOUT) -> DataFrame:
    """(range, first, rows, digest): the sha256 over the joined sha256 digests of each range's lines, with the least value of order.

    order has neither nulls nor repeats; a null line counts as an empty one. An empty table has no leaves.
    """
    placed = with_position(rows.select(F.col(order).alias("at"), F.sha2(F.coalesce(line, F.lit("")), 256).alias("d")), "at")
    return _folded(placed.select("position", "d", "at", F.lit(1).cast("long").alias("rows")), fanout)


def _folded(rows: DataFrame, fanout: int) -> DataFrame:
    """(range, first, rows, digest) of rows (position, d, at, rows), fanout positions to a range."""
    by = F.floor(F.col("position") / fanout)
    parts = F.array_sort(F.collect_list(F.struct("position", "d")))  # fanout rows at most
    out = rows.groupBy(by.alias("range")).agg(F.min("at").alias("first"), F.sum("rows").alias("rows"), parts.alias("parts"))
    return out.select("range", "first", "rows", F.sha2(F.array_join(F.transform("parts", lambda p: p.d), ""), 256).alias("digest"))


def tree(rows: DataFrame, order: str, line: Column, fanout: int = FANOUT) -> DataFrame:
    """(level, range, first, rows, digest) as a shared table: level 0 holds the leaves, the last level the root."""
    level, levels = shared_table(leaves(rows, order, line, fanout), "leaves"), []
    while True:
        levels.append(level.select(F.lit(len(levels)).alias("level"), "range", "first", "rows", "digest"))
        if level.limit(2).count() < 2:
            break
        level = shared_table(_folded(level.select(F.col("range").alias("position"), F.col("digest").alias("d"), F.col("first").alias("at"), "rows"), fanout), "level")
    return reduce(DataFrame.unionByName, levels)


def root(found: DataFrame) -> str:
    """The digest of a tree's last level, with the number of rows; of no rows that of nothing."""
    top = found.orderBy(F.col("level").desc()).select("rows", "digest").first()
    return f"sha256:{top.digest}" if top else "sha256:"


def differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """(range, first, rows, other_rows): the leaves that differ between two trees of one fanout, in no order.

    A leaf that only one tree has differs. Rows put in or taken out shift all later leaves; the first that differs is
    where the trees part.
    """
    a, b = (t.where("level = 0").select("range", *[F.col(c).alias(f"{c}_{n}") for c in ("first", "rows", "digest")]) for n, t in enumerate((one, two)))
    both = a.join(b, "range", "full").where(~F.col("digest_0").eqNullSafe(F.col("digest_1")))
    return both.select("range", F.coalesce("first_0", "first_1").alias("first"), F.coalesce("rows_0", F.lit(0)).alias("rows"), F.coalesce("rows_1", F.lit(0)).alias("other_rows"))


def first_difference(one: DataFrame, two: DataFrame):
    """The first of differences() as a row, or None where the trees are equal."""
    return differences(one, two).orderBy("range").first()
