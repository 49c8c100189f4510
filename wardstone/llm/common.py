"""Shared pieces of the training-data operators: words, shared tables, bounded broadcasts, components."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.tables import discard, shared_path, shared_table

__all__ = ["NOT_WORD", "broadcast_if_small", "connected_components", "discard", "fresh", "lower_ascii", "shared_path", "shared_table", "spread", "text_batches", "words_of"]

ARROW_ROWS = 1_000  # rows with whole texts in an Arrow batch
#: Separators of the word class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z and everything beyond ASCII are word characters).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; no other character changes."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; an empty array for null or no words."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_batches(df: DataFrame) -> DataFrame:
    """df, with the session set to send rows to Python workers ARROW_ROWS at a time where it has Spark's default of 10,000.

    Rows that hold whole texts make Arrow batches of many megabytes otherwise, on both sides, for every task at once.
    Another setting of the session's own stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))
    return df


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint only when df has at most max_rows rows (counted here); else Spark shuffles the join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by keys over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (src, dst): component is the smallest node reachable.

    Nodes are of any ordered type. Each round takes the smallest label among neighbours and then jumps to the
    label's own label, so the rounds grow with the logarithm of the longest chain. Every round is a table in the
    shared folder; tables of earlier rounds are deleted. Empty edges give no rows; repeated edges and loops change
    nothing; an edge without one of its ends is left out.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).dropna().distinct()
    both = shared_table(both, "edges")
    label = shared_table(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")), "label")
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = shared_table(label.select("node", "component").join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "step")
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        moved = shared_table(step.join(up, "component", "left").select("node", "was", F.coalesce("up", "component").alias("component")), "label")
        discard(label, step)
        label = moved
        if moved.where("component <> was").isEmpty():
            discard(both)
            return moved.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
